"""Reading labelled corpora and predictions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import MANIFEST, PREDICTION, QA, TRUTH, WORDS


def read_truth(spark: SparkSession, folder: str, categories: list[str] | None = None) -> DataFrame:
    """Truth documents (one JSON object a file) of a folder, with their paths; only wanted categories."""
    truth = spark.read.schema(TRUTH).option("multiLine", True).json(folder)
    return truth.where(F.col("category").isin(categories)) if categories else truth


def read_manifest(spark: SparkSession, path: str, categories: list[str] | None = None) -> DataFrame:
    manifest = spark.read.schema(MANIFEST).json(path)
    return manifest.where(F.col("category").isin(categories)) if categories else manifest


#: Categories whose documents are whole pages, for which truth is loaded by ``read_truth(..., PAGE_SETS[name])``.
PAGE_SETS = {"photo": ["photo_doc"], "table": ["table"], "forms": ["receipt", "invoice", "card"]}


def load_samples(spark: SparkSession, manifest: str, truth_folder: str, categories: list[str] | None = None) -> DataFrame:
    """Manifest rows with their truth as struct ``gt_doc``; the category filter is applied to both sides before the join."""
    gt = read_truth(spark, truth_folder, categories).select("id", F.struct("*").alias("gt_doc"))
    return read_manifest(spark, manifest, categories).join(gt, "id")


def originals(docs: DataFrame, source: str = "rendered") -> DataFrame:
    """Documents as they were made, without degraded copies."""
    return docs.where(F.col("source") == source)


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(id, path, size, content) of the images of a folder; decoding is the recogniser's."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jpg,jpeg,png,webp,tif,tiff,bmp}").load(folder)
    return raw.select(file_stem(F.col("path")).alias("id"), "path", F.col("length").alias("size"), "content")


def read_page_truth(spark: SparkSession, path: str) -> DataFrame:
    """(document, page, id, text) of truth files that list a document's pages: {"name": ..., "docs": [id, ...], "pages": [text, ...]}."""
    raw = spark.read.schema("name string, docs array<string>, pages array<string>").option("multiLine", True).json(path)
    return raw.select(F.col("name").alias("document"), F.posexplode(F.arrays_zip("docs", "pages")).alias("page", "p")).select("document", "page", F.col("p.docs").alias("id"), F.col("p.pages").alias("text"))


def build_manifest(truth: DataFrame) -> DataFrame:
    """Manifest of truth documents: characters without line breaks, lines; sorted by id."""
    return truth.select(
        "id",
        "category",
        "source",
        "parent",
        F.concat(F.lit("images/"), "id", F.lit(".png")).alias("image"),
        F.concat(F.lit("gt/"), "id", F.lit(".json")).alias("gt"),
        "width",
        "height",
        F.length(F.replace("text", F.lit("\n"), F.lit(""))).cast("bigint").alias("chars"),
        F.size("lines").cast("bigint").alias("lines"),
    ).orderBy("id")


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QA).json(path)


def engine_dataset(path: Column) -> tuple[Column, Column]:
    """Engine and data set of a result file named engine__dataset.json."""
    stem = F.regexp_extract(path, r"([^/]+)\.json[^/]*$", 1)
    return F.split_part(stem, F.lit("__"), F.lit(1)), F.split_part(stem, F.lit("__"), F.lit(2))


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """Result files (a JSON object of id to reading, with a ``_meta`` entry) as rows (engine, dataset, id, text, tables, time, error)."""
    kind = f"map<string,struct<{', '.join(f.replace(' ', ':') for f in PREDICTION.split(', ')[1:])}>>"
    raw = spark.read.option("wholetext", True).text(folder).withColumn("path", F.col("_metadata.file_path"))
    engine, dataset = engine_dataset(F.col("path"))
    rows = raw.select(engine.alias("engine"), dataset.alias("dataset"), F.explode(F.from_json("value", kind)).alias("id", "r"))
    return rows.where(F.col("id") != "_meta").select("engine", "dataset", "id", "r.*")


def with_truth_engine(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions with the truth itself as engine 'gt': errors of later steps can then be told apart."""
    own = truth.select(F.lit("gt").alias("engine"), "id", "text")
    return predictions.select("engine", "id", "text").unionByName(own)


def truth_with_predictions(truth: DataFrame, predictions: DataFrame, partial: bool = False) -> DataFrame:
    """Truth joined to predictions by id: all truth rows with empty texts for missing ones, or only those present."""
    hyp = predictions.withColumnRenamed("text", "hyp")
    joined = truth.join(hyp, "id", "inner" if partial else "left")
    return joined.withColumn("hyp", F.coalesce("hyp", F.lit("")))


def missing_from_cache(docs: DataFrame, cache: DataFrame, key: str = "id") -> DataFrame:
    return docs.join(cache.select(key), key, "left_anti")


def with_parent(docs: DataFrame, key: str = "id", parent: str = "parent") -> DataFrame:
    """Degraded documents joined to those they were made from: all columns, those of the parent as struct ``origin``."""
    origin = docs.select(F.col(key).alias("_origin"), F.struct(*docs.columns).alias("origin"))
    return docs.join(origin, F.col(parent) == F.col("_origin")).drop("_origin")


def copies_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, parent): texts that another document of a smaller key has byte for byte, with the smallest such key."""
    d = docs.select(key, F.md5(text).alias("_h"), F.sha2(text, 256).alias("_s"))
    groups = d.groupBy("_h", "_s").agg(F.min(key).alias("parent"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return d.join(groups, ["_h", "_s"]).where(F.col(key) != F.col("parent")).select(key, "parent")


def by_position(truth: DataFrame, predictions: DataFrame, key: str = "id", pos: str = "pos", got: str = "got") -> DataFrame:
    """Truth joined to predictions by place: all rows of the truth, with empty texts for missing predictions."""
    return truth.join(predictions.select(key, pos, got), [key, pos], "left").withColumn(got, F.coalesce(got, F.lit("")))


def extend_cache(cache: DataFrame, made: DataFrame, path: str) -> DataFrame:
    """Appends what was made for missing keys to the cache at ``path``; returns the whole cache as read back."""
    made.select(*cache.columns).write.mode("append").parquet(path)
    return cache.sparkSession.read.schema(cache.schema).parquet(path)


@F.pandas_udf(T.StringType())
def decode_text(content: pd.Series) -> pd.Series:
    """Bytes as UTF-8 (byte-order mark dropped) or else CP949; null where neither fits."""

    def decode(raw):
        for encoding in ("utf-8-sig", "cp949"):
            try:
                return bytes(raw).decode(encoding)
            except UnicodeDecodeError:
                pass
        return None

    return content.map(lambda x: None if x is None else decode(x))


@F.pandas_udf(T.BinaryType())
def encode_cp949(text: pd.Series) -> pd.Series:
    """Texts as CP949, which Spark's own functions don't know; null where a character has no place in it."""

    def encode(value):
        try:
            return value.encode("cp949")
        except UnicodeEncodeError:
            return None

    return text.map(lambda x: None if x is None else encode(x))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def label_image_pairs(spark: SparkSession, labels: str, images: str) -> DataFrame:
    """Label files and images of the same stem: (stem, content, image_path)."""
    lab = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(labels)
    img = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jpg,jpeg,png}").load(images)
    left = lab.select(file_stem(F.col("path")).alias("stem"), decode_text("content").alias("label"))
    return left.join(img.select(file_stem(F.col("path")).alias("stem"), F.col("path").alias("image_path")), "stem")


def _corners(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    pts = [F.array(a.cast("double"), b.cast("double")) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
    return F.array(*pts)


def _word(text: Column, poly: Column, ignore: Column, kind: Column) -> Column:
    return F.struct(text.alias("text"), poly.alias("poly"), ignore.alias("ignore"), kind.cast("string").alias("kind"))


def read_photo_words(label: Column) -> Column:
    """Words of a photographed document's label: polygons of annotations[0] with type 0 unreadable, 1 print, 2 hand."""
    d = F.from_json(label, "annotations array<struct<polygons:array<struct<text:string,type:int,points:array<array<double>>>>>>")

    def word(p: Column) -> Column:
        xs, ys = F.transform(p["points"], lambda q: q[0]), F.transform(p["points"], lambda q: q[1])
        kind = F.when(p["type"] == 1, "print").when(p["type"] == 2, "hand")
        return _word(p["text"], _corners(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)), (p["type"] == 0) | (F.coalesce(p["text"], F.lit("")) == ""), kind)

    return F.transform(d["annotations"][0]["polygons"], word).cast(WORDS)


def _unreadable(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).isin("xxx", "")


def read_hand_words(label: Column) -> Column:
    """Words of a handwriting label: bbox[] of data, x[4], y[4]."""
    d = F.from_json(label, "bbox array<struct<data:string,x:array<double>,y:array<double>>>")
    word = lambda b: _word(b["data"], _corners(F.array_min(b["x"]), F.array_min(b["y"]), F.array_max(b["x"]), F.array_max(b["y"])), _unreadable(b["data"]), F.lit("hand"))
    return F.transform(d["bbox"], word).cast(WORDS)


def read_scene_words(label: Column) -> Column:
    """Words of a street scene label: annotations[] of text, bbox[x, y, width, height]."""
    d = F.from_json(label, "annotations array<struct<text:string,bbox:array<double>>>")
    word = lambda a: _word(a["text"], _corners(a["bbox"][0], a["bbox"][1], a["bbox"][0] + a["bbox"][2], a["bbox"][1] + a["bbox"][3]), _unreadable(a["text"]), F.lit(None))
    return F.transform(d["annotations"], word).cast(WORDS)


WORD_READERS = {"photo_doc": read_photo_words, "handwriting": read_hand_words, "scene": read_scene_words}


def read_stage_times(spark: SparkSession, path: str, stages: list[str]) -> DataFrame:
    """Stage timings (stage, calls, milliseconds) of known stages with their share of the total."""
    raw = spark.read.schema("stage string, calls string, ms string, extra string").csv(path)
    rows = raw.where(F.col("extra").isNull() & F.col("stage").isin(stages)).select("stage", F.col("calls").try_cast("double").alias("calls"), F.col("ms").try_cast("double").alias("ms"))
    total = rows.agg(F.sum("ms").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("stage", "calls", "ms", F.try_divide("ms", "total").alias("share"))


def page_text(native: Column, recognised: Column, least: int = 20) -> Column:
    """Struct (text, source) of a PDF page: its own text if it has ``least`` characters, else what was recognised."""
    own = F.length(F.trim(F.coalesce(native, F.lit("")))) >= least
    return F.struct(F.when(own, native).otherwise(recognised).alias("text"), F.when(own, "native").otherwise("recognised").alias("source"))

"""Exact duplicates: 128-bit content hashes group the rows, their bytes decide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _classes(docs: DataFrame, id_col: str, text_col: str, keep: str) -> tuple[DataFrame, DataFrame]:
    """(rows with _id, _text, _h; classes with _h, text_sha256, keep_id, group_size)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    rows = rows.withColumn("_h", F.unhex(F.md5(F.col("_text").cast("binary"))))
    choose = F.max if keep == "max" else F.min
    classes = rows.groupBy("_h", "_text").agg(choose("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return rows, classes.select("_h", F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """Classes of byte-identical texts.

    Rows meet by a 128-bit content hash (MD5) and are grouped by hash *and* bytes, so a collision of
    the hash cannot merge different texts. Copies are counted before the shuffle (map-side
    aggregation), so a text that a third of the rows share crosses it once per task; the classes are
    joined back to narrow rows (id, hash, digest) in a join that adaptive execution may split where
    a key is hot.

    A null text counts as empty; all empty texts form one class. A null id never wins against
    another id; where a class has only null ids, they stay. Repeated rows (same id, same text) are
    counted and returned as often as they come, and stay or go together. An id with several texts is in a
    class for each: what is kept is a row, not an id.
    Other columns of ``docs`` are ignored. An empty table gives an empty result.

    Returns (id_col, keep_id, group_size, kept, text_sha256); ``keep`` is 'min' or 'max': the id that stays.
    """
    rows, classes = _classes(docs, id_col, text_col, keep)
    narrow = rows.select("_id", "_h", F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"))
    out = narrow.join(classes, ["_h", "text_sha256"])
    return out.select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts those with the smallest (or largest) id.

    Rows are kept by id and text, so an id with several texts keeps those that no other row has. Rows that
    repeat both stay together, whatever their other columns; rows with null ids stay only where no row with an id
    has their text. A null text counts as empty and stays null. An empty table gives an empty result.
    """
    _, classes = _classes(docs, id_col, text_col, keep)
    kept = classes.select(F.col("_h").alias("_kept_h"), F.col("text_sha256").alias("_kept_sha"), F.col("keep_id").alias("_kept_id"))
    raw = F.coalesce(docs[text_col], F.lit("")).cast("binary")
    same = (F.unhex(F.md5(raw)) == kept["_kept_h"]) & (F.sha2(raw, 256) == kept["_kept_sha"]) & docs[id_col].eqNullSafe(kept["_kept_id"])
    return docs.join(kept, same, "left_semi")

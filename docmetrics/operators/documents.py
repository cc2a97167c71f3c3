"""Whole documents: layout blocks to pages, parsed documents to scores, words to accuracies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.metrics import cer, overflow, text_rate
from ..functions.text import normalize, word_kind
from .tables import html_cells, markdown_text, table_similarity

# Labels of layout blocks that hold text, and the Markdown marks of headings.
TEXT_LABELS = ("doc_title", "paragraph_title", "text", "abstract", "content", "header", "footer", "number", "aside_text", "reference", "footnote", "vision_footnote", "figure_title")
HEADINGS = {"doc_title": "# ", "paragraph_title": "## "}


def table_lines(table: Column) -> Column:
    """Cells of a table (struct of header and rows) as lines, row by row."""
    return F.concat(table["header"], F.flatten(table["rows"]))


def blocks_to_pages(blocks: DataFrame, key: str = "id", labels: list[str] | None = None) -> DataFrame:
    """Blocks (key, pos, label, content) in order as (key, text, markdown, tables).

    Table blocks give a line for each cell, text blocks with a known label their content; headings are marked in the
    Markdown. Only tables reach the HTML parser.
    """
    content, label = F.trim("content"), F.col("label")
    is_table = label == "table"
    cells = html_cells(F.when(is_table & F.contains(content, F.lit("<t")), content))
    text = F.when(is_table, F.coalesce(F.array_join("_cells", "\n"), content)).when(label.isin(*(labels or TEXT_LABELS)) & (content != ""), content)
    mark = F.lit("")
    for name, prefix in HEADINGS.items():
        mark = F.when(label == name, prefix).otherwise(mark)
    rows = blocks.withColumn("_cells", cells).withColumn("_text", text).where(F.col("_text").isNotNull())
    part = F.struct("pos", F.col("_text").alias("t"), F.when(is_table, content).otherwise(F.concat(mark, content)).alias("m"), F.when(is_table, content).alias("table"))
    ordered = rows.groupBy(key).agg(F.array_sort(F.collect_list(part)).alias("p"))
    pick = lambda f: F.transform("p", lambda x: x[f])
    return ordered.select(key, F.array_join(pick("t"), "\n").alias("text"), F.array_join(pick("m"), "\n\n").alias("markdown"), F.array_compact(pick("table")).alias("tables"))


@F.pandas_udf(T.StructType([T.StructField("cer", T.DoubleType()), T.StructField("teds", T.DoubleType()), T.StructField("n_tables", T.IntegerType())]))
def parsed_scores(markdown: pd.Series, ref_text: pd.Series, ref_tables: pd.Series) -> pd.DataFrame:
    """A document is parsed and scored in one pass: each further Python step would hold the whole texts once more."""
    rows = []
    for m, ref, wanted in zip(markdown, ref_text, ref_tables, strict=True):
        text, html, other = markdown_text(m or "")
        found = html + other
        scores = [table_similarity(found[i] if i < len(found) else "", t) for i, t in enumerate(() if wanted is None else wanted)]
        rows.append((text_rate(ref, text), sum(scores) / len(scores) if scores else None, len(found)))
    return pd.DataFrame(rows, columns=["cer", "teds", "n_tables"]).astype({"cer": "float64", "teds": "float64", "n_tables": "int32"})


def document_scores(docs: DataFrame, key: str = "id") -> DataFrame:
    """Parsed documents (key, markdown, ref_text, ref_tables) scored: (key, cer, teds, n_tables).

    Tables are paired by position, a missing one counts 0; the mean is null where there is none to find.
    """
    return docs.select(key, parsed_scores("markdown", "ref_text", "ref_tables").alias("s")).select(key, "s.cer", "s.teds", "s.n_tables")


def word_accuracy(words: DataFrame, category: str = "category") -> DataFrame:
    """Readings of single words (category, ref, hyp): accuracy and clipped error without white space, overflows, and accuracy by kind of word.

    (category, kind, n, accuracy, cer, overflow): kind is null for the category as a whole; kinds only come where a
    category has more than one.
    """
    hyp = normalize(F.col("hyp"))
    rows = words.select(
        category,
        word_kind(F.col("ref")).alias("kind"),
        (normalize(F.col("ref"), False) == normalize(hyp, False)).cast("int").alias("ok"),
        F.least(F.lit(1.0), cer(F.col("ref"), hyp, keep_space=False)).alias("cer"),
        overflow(F.col("ref"), hyp).cast("int").alias("over"),
    )
    grouped = rows.rollup(category, "kind").agg(F.count(F.lit(1)).alias("n"), F.avg("ok").alias("accuracy"), F.avg("cer").alias("cer"), F.sum("over").alias("overflow"), F.count_distinct("kind").alias("kinds"), F.grouping_id().alias("g"))
    whole = grouped.where("g = 1").select(F.col(category).alias("_c"), F.col("kinds").alias("_k"))
    kept = grouped.where("g <= 1").join(whole, F.col(category).eqNullSafe(F.col("_c")))
    return kept.where("g = 1 or _k > 1").select(category, "kind", "n", "accuracy", "cer", "overflow")


def with_fallback(output: Column, fallback: Column) -> Column:
    """A corrected text, or what it was made from where it is empty."""
    return F.coalesce(F.nullif(F.trim(output), F.lit("")), fallback)

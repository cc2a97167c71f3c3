"""Answers of a model, checked against a schema: what can't be read is a row with an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsontext import closed

CORRUPT = "_corrupt"


def answer_body(text: Column) -> Column:
    """The JSON object in an answer: without a code fence around it, from the first brace to the last; to the end where none closes."""
    fenced = F.when(F.contains(text, F.lit("```")), F.regexp_extract(text, r"(?s)```(?:json)?\s*+(.*?)(?:```|$)", 1)).otherwise(text)
    body = F.regexp_replace(fenced, r"(?s)^[^{]*+", "")
    return F.when(body.rlike(r"(?s)\}[^{}\"]*$"), F.regexp_replace(body, r"(?s)(?<=\})[^{}\"]*$", "")).otherwise(body)


def parse_answers(rows: DataFrame, fields: str, required: list[str], text: str = "text") -> DataFrame:
    """``rows`` with ``answer`` (struct of ``fields``, a DDL string), ``repaired`` and ``_error``.

    ``_error`` is null where the answer is an object with values of the right types in all ``required`` fields, else the first of
    "empty" (null or blank), "not json", "wrong type", "missing field"; ``answer`` is then null, so that later steps
    skip such rows and count them. An object that was cut off is closed (``repaired``) and judged by what is left. Fields
    that ``fields`` does not name are left out.
    """
    body = answer_body(F.col(text))
    whole = F.coalesce(F.try_parse_json(body).isNotNull(), F.lit(False))
    staged = rows.withColumn("_body", body).withColumn("_whole", whole)
    staged = staged.withColumn("_body", F.when(F.col("_whole"), F.col("_body")).otherwise(closed(F.col("_body"))))
    read = F.from_json("_body", f"{fields}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    staged = staged.withColumns({"_read": read, "_json": F.try_parse_json("_body").isNotNull() & F.startswith("_body", F.lit("{"))})
    lacks = F.lit(False)
    for name in required:
        lacks = lacks | F.col(f"_read.{name}").isNull()
    error = (
        F.when(F.coalesce(F.trim(F.col(text)), F.lit("")) == "", "empty")
        .when(~F.coalesce("_json", F.lit(False)), "not json")
        .when(F.col(f"_read.{CORRUPT}").isNotNull(), "wrong type")
        .when(lacks, "missing field")
    )
    staged = staged.withColumn("_error", error)
    return staged.select(*rows.columns, F.when(F.col("_error").isNull(), F.col("_read").dropFields(CORRUPT)).alias("answer"), (F.col("_error").isNull() & ~F.col("_whole")).alias("repaired"), "_error")


def answer_fields(parsed: DataFrame, key: str = "id") -> DataFrame:
    """(key, name, value) of the readable answers' fields as strings, for ``scoring.document_fields``."""
    names = parsed.schema["answer"].dataType.fieldNames()
    listed = F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"answer.{n}").cast("string").alias("value")) for n in names))
    return parsed.where("_error is null").select(key, F.explode(listed).alias("f")).select(key, "f.*")

"""The corpus pipeline: toxicity, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docmetrics.llm.exactdedup import drop_exact_duplicates
from docmetrics.llm.minhash import drop_near_duplicates
from docmetrics.llm.packing import pack_documents
from docmetrics.llm.pii import redact_documents
from docmetrics.llm.shared import discard, materialize, written_tables
from docmetrics.llm.toxicity import drop_toxic, held_out, learn


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that score 0.5 or more; learned from the labels of rows that are not held out.

    Null and empty texts score as texts without matches and stay, as do null ids; repeated rows are scored row by row. An
    empty table, or no labels, gives what the seed words alone reject. Other columns pass unchanged.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    return drop_toxic(docs, learn(docs, labels))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest doc_id of equal texts.

    Null counts as empty; a null id stays only where no row with an id has its text; rows that repeat id and text stay
    together; an id with several texts keeps each that is its own. An empty table stays empty.
    """
    return drop_exact_duplicates(docs, keep="max")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of each class of near copies (five words, 0.8).

    Null ids and texts without words stay; rows are dropped by id and text, so an id with several texts loses only those that are
    near another row's; rows that repeat id and text stay or go together. An empty table stays empty.
    """
    return drop_near_duplicates(docs, percent=80)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; n_chars follows the new text.

    Every row stays: null and empty texts, null ids and repeated rows as they are. Of overlapping spans the first gives the kind.
    """
    return redact_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenises and packs into sequences of 2048; the rows carry their ids.

    A null text packs as an empty one (id 0 alone); null ids and repeated rows are packed as often as they come; an empty table
    gives no rows.
    """
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("minhash near-dedup", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Learned scores and tokenizers can't be expressed in SQL; test_pipeline_rows compares rows and texts of every stage with brute force on planted data.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again.

    What a stage wrote for itself, and its predecessor's documents, are deleted once its own documents are written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with written_tables() as made:
            docs = materialize(stage(spark, before, sf_dir), name.replace(" ", "-"))
        discard(before, *(t for t in made if t is not docs))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Chunks, nearest neighbours and retrieval scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import char_f1, dot, norm2
from ..functions.text import is_correct, unknown_answer
from .neighbours import nearest_join


def chunks(text: Column, size: int) -> Column:
    """Lines put together into chunks; a line that would make a chunk longer than ``size`` begins the next. Lines are never cut."""
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def add(s: Column, line: Column) -> Column:
        full = (s["cur"] != "") & (F.length(s["cur"]) + F.length(line) > size)
        out = F.when(full, F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"])
        cur = F.when(full | (s["cur"] == ""), line).otherwise(F.concat(s["cur"], F.lit("\n"), line))
        return F.struct(out.alias("out"), cur.alias("cur"))

    last = lambda s: F.when(s["cur"].rlike(r"(?U)\S"), F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"])
    return F.aggregate(F.split(text, "\n"), state, add, last)


def chunk_documents(docs: DataFrame, size: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(id_col, F.posexplode(chunks(F.col(text_col), size)).alias("no", "text"))


def top_k(queries: DataFrame, items: DataFrame, k: int = 3, query_id: str = "qid", item_id: str = "cid", query_vec: str = "qvec", item_vec: str = "cvec", same: list[str] | None = None) -> DataFrame:
    """The k items of the largest cosine for every query; the lowest item id on ties: (query_id, item_id, sim, rank).

    Without ``same`` this is ``nearest_join``. ``same`` names columns that must be equal, which makes the pairing an equi-join;
    norms are then computed once a vector, and the rank limit is pushed below the shuffle.
    """
    if not same:
        return nearest_join(queries, items, k, query_id, item_id, query_vec, item_vec)
    pairs = queries.withColumn("_qn", norm2(F.col(query_vec))).join(items.withColumn("_cn", norm2(F.col(item_vec))), same)
    sim = F.try_divide(dot(F.col(query_vec), F.col(item_vec)), F.col("_qn") * F.col("_cn"))
    w = Window.partitionBy(query_id).orderBy(F.desc_nulls_last("sim"), item_id)
    return pairs.select(query_id, item_id, sim.alias("sim")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hit_ranks(hits: DataFrame, truth: DataFrame, query_id: str = "qid", hit: str = "hit", want: str = "want") -> DataFrame:
    """First rank at which the wanted document is among the hits, null where it is not: (query_id, rank)."""
    joined = truth.select(query_id, want).join(hits.select(query_id, hit, "rank"), query_id, "left")
    return joined.groupBy(query_id).agg(F.min(F.when(F.col(hit) == F.col(want), F.col("rank"))).alias("rank"))


def hit_rates(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.col("rank") == 1, F.lit(False)).cast("int")).alias("hit_at_1"), F.avg(F.col("rank").isNotNull().cast("int")).alias("hit_at_k"))


def answer_in_chunks(answer: Column, texts: Column) -> Column:
    """Whether an answer occurs, white space aside, in one of the retrieved texts (an array)."""
    squash = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    return F.coalesce(F.exists(texts, lambda x: F.contains(squash(x), squash(answer))), F.lit(False))


def answer_report(answers: DataFrame, by: list[str] | None = None, composed: bool = False) -> DataFrame:
    """Rates over answered questions (rank, in_chunks, answer, pred): hits, right answers, mean character F1, unknown ones, wrong ones that do not say so.

    ``composed``: the texts are composed already.
    """
    correct = is_correct(F.col("answer"), F.col("pred"), not composed)
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    rows = answers.withColumns({"_correct": correct, "_unknown": unknown_answer(F.col("pred")), "_f1": char_f1(F.col("answer"), F.col("pred"))})
    aggs = {
        "hit_at_1": share(F.col("rank") == 1),
        "hit_at_k": share(F.col("rank").isNotNull()),
        "in_chunks": share(F.col("in_chunks")),
        "correct": share(F.col("_correct")),
        "f1": F.avg("_f1"),
        "unknown": share(F.col("_unknown")),
        "wrong": share(~F.col("_correct") & ~F.col("_unknown")),
    }
    named = [F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in aggs.items())]
    return rows.groupBy(*by).agg(*named) if by else rows.agg(*named)

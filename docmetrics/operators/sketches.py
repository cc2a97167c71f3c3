"""Sketches by partition that are stored once and merged later, for any grouping of the partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize

#: Bits of the distinct-count sketch, k of the quantile sketch, items that the top sketch tracks.
HLL_BITS, KLL_K, TRACKED = 12, 400, 1000

#: Bounds on the errors: four standard errors of a distinct count (1.04 / sqrt(2 ** bits), as a share of it), and of a rank (as a share of n).
DISTINCT_ERROR, RANK_ERROR = 4 * 1.04 / 2 ** (HLL_BITS / 2), 0.02

#: Bound on what the count of an item is too large by, as a share of n: 3.5 / size of the map, three quarters of which hold the tracked items.
ITEM_ERROR = 3.5 * 0.75 / TRACKED


def sketched(rows: DataFrame, by: list[str], distinct: str, value: str, item: str) -> DataFrame:
    """(by..., n, distinct, value, item): sketches of a column's distinct values, of another's quantiles, of a third's most frequent values.

    They are made where the rows lie, and their size does not grow with the rows: a few kilobytes a group. Nulls don't count, except in n, and NaN is no value.
    """
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.hll_sketch_agg(distinct, HLL_BITS).alias("distinct"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_K).alias("value"),
        F.expr(f"approx_top_k_accumulate(`{item}`, {TRACKED}) FILTER (WHERE `{item}` IS NOT NULL)").alias("item"),
    )


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of finer groups as those of coarser ones; the result can be stored and merged again."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("value").alias("value"),
        F.expr("approx_top_k_combine(item)").alias("item"),
    )


def estimates(sketches: DataFrame, shares: list[float], top: int) -> DataFrame:
    """Each sketch column replaced by what it says: the number of distinct values, quantiles at ``shares``, the ``top`` items with their counts.

    The distinct count is within ``DISTINCT_ERROR`` of itself, a quantile within ``RANK_ERROR`` in rank (both with the certainty of four standard errors);
    quantiles of no values are null. Counts of items are never too small, too large by ``ITEM_ERROR`` at most, and exact while a group has no more than
    ``TRACKED`` different ones. Of more, only those that stand out are listed, fewer than ``top`` or none where all are about as frequent:
    ``completed`` has the rest.
    """
    some = F.kll_sketch_get_n_double("value") > 0
    return sketches.withColumns({
        "distinct": F.hll_sketch_estimate("distinct"),
        "value": F.array(*(F.when(some, F.kll_sketch_get_quantile_double("value", F.lit(s))) for s in shares)),
        "item": F.expr(f"approx_top_k_estimate(item, {top})"),
    })


def completed(estimates: DataFrame, rows: DataFrame, by: list[str], item: str, top: int) -> DataFrame:
    """``estimates`` with the ``top`` items of every group: where the sketch lists fewer, the group's items are counted in ``rows``.

    Those counts are exact, items of equal count go by the smaller item, and a list is shorter than ``top`` only if the group has no more items.
    The estimates are written once, as sketches merged in another order may list others.
    """
    key = F.struct(*by, F.lit(0).alias("_")).alias("_g")
    found = materialize(estimates, "estimates").select("*", key)
    short = found.where(F.size("item") < top).select("_g")
    counts = rows.where(F.col(item).isNotNull()).select(key, F.col(item).alias("item")).join(short, "_g", "left_semi").groupBy("_g", "item").agg(F.count(F.lit(1)).alias("count"))
    place = F.row_number().over(Window.partitionBy("_g").orderBy(F.desc("count"), "item")).alias("_place")
    first = counts.select("*", place).where(F.col("_place") <= top).groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("_place", "item", "count"))).alias("_items"))
    exact = F.transform("_items", lambda x: F.struct(x["item"].alias("item"), x["count"].alias("count")))
    return found.join(first, "_g", "left").withColumn("item", F.coalesce(exact, "item")).drop("_g", "_items")

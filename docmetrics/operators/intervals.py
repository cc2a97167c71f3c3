"""Joins of intervals that overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import materialize

#: Buckets that an interval is put into at most, and rows of one bucket that meet in one task.
SPREAD, HOT = 8, 50_000


def _level(start: Column, end: Column, width: float) -> Column:
    """The smallest level whose buckets (``width`` times a power of SPREAD) cut the interval into SPREAD at most."""
    ratio = (end - start) / F.lit(float(width) * (SPREAD - 1))
    return F.when(ratio <= 1, 0).otherwise(F.ceil(F.log(float(SPREAD), ratio) - F.lit(1e-9))).cast("int")


def _size(level: Column, width: float) -> Column:
    return F.lit(float(width)) * F.pow(F.lit(float(SPREAD)), level)


def _bucketed(rows: DataFrame, name: str, by: list[str], width: float, others: list[int]) -> DataFrame:
    """A row for every bucket an interval touches, at its own level and at the coarser ones of the other side."""
    at = F.array_distinct(F.concat(F.array("_level"), F.filter(F.array(*(F.lit(x) for x in others)).cast("array<int>"), lambda x: x > F.col("_level"))))
    spread = rows.withColumn("_at", F.explode(at))
    size = _size(F.col("_at"), width)
    first, last = F.floor(F.col("_start") / size), F.greatest(F.floor(F.col("_start") / size), F.ceil(F.col("_end") / size) - 1)
    return spread.select(*by, F.col("_row").alias(name), F.col("_level").alias(f"_{name}"), "_at", first.alias(f"_first_{name}"), F.explode(F.sequence(first, last)).alias("_bucket"))


def interval_join(left: DataFrame, right: DataFrame, by: list[str], start: str = "start", end: str = "end", width: float = 3600.0, hot: int = HOT) -> DataFrame:
    """Pairs of rows with equal ``by`` whose intervals [start, end) overlap, each once: (by..., l struct, r struct).

    Time is cut into buckets of ``width``; longer intervals go to levels with buckets ``SPREAD`` times as wide each, so that no
    interval is in more than ``SPREAD`` of its own level. A pair meets at the coarser of its two levels, as an equi-join on key, level and
    bucket, in the first bucket that both touch. Buckets with more than ``hot`` rows of a side are cut into slices: a slice of one side meets
    each slice of the other, so one key or one moment is spread over many tasks.

    ``start`` and ``end`` are numbers (seconds, micros). Null or empty intervals, and null keys, meet nothing. Rows that are
    repeated pair as often as they come.
    """
    sides = {}
    for name, rows in (("l", left), ("r", right)):
        s, e = F.col(start).cast("double"), F.col(end).cast("double")
        kept = rows.where(s < e).where(" and ".join(["true", *(f"`{c}` is not null" for c in by)]))
        sides[name] = kept.select(*by, F.struct("*").alias("_row"), s.alias("_start"), e.alias("_end"), _level(s, e, width).alias("_level"))
    levels = {name: sorted(r[0] for r in side.select("_level").distinct().collect()) for name, side in sides.items()}
    spread = {name: _bucketed(sides[name], name, by, width, levels["r" if name == "l" else "l"]) for name in sides}
    key = [*by, "_at", "_bucket"]
    parts = lambda n: F.ceil(F.col(n) / hot).cast("int")
    many = None
    for name, side in spread.items():
        n = side.groupBy(*key).agg(F.count(F.lit(1)).alias(f"_n_{name}")).where(F.col(f"_n_{name}") > hot)
        many = n if many is None else many.join(n, key, "full")
    many = materialize(many.select(*key, *(F.coalesce(parts(f"_n_{name}"), F.lit(1)).alias(f"_s_{name}") for name in sides)), "hot-buckets")
    if many.isEmpty():
        spread = {name: side.withColumns({"_a": F.lit(0), "_b": F.lit(0)}) for name, side in spread.items()}
    else:
        for name, own, other in (("l", "_a", "_b"), ("r", "_b", "_a")):
            there = "r" if name == "l" else "l"
            numbered = materialize(spread[name].withColumn("_i", F.monotonically_increasing_id()), "numbered")  # written, so that a lost task deals its rows alike
            side = numbered.join(many, key, "left").fillna(1, ["_s_l", "_s_r"])
            slice_ = F.pmod(F.xxhash64("_i"), F.col(f"_s_{name}")).cast("int")
            spread[name] = side.withColumn(own, slice_).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"_s_{there}") - 1))).drop("_s_l", "_s_r", "_i")
    pairs = spread["l"].join(spread["r"], [*key, "_a", "_b"])
    once = (F.col("_at") == F.greatest("_l", "_r")) & (F.col("_bucket") == F.greatest("_first_l", "_first_r"))
    overlap = (F.col(f"l.{start}") < F.col(f"r.{end}")) & (F.col(f"r.{start}") < F.col(f"l.{end}"))
    return pairs.where(once & overlap).select(*by, "l", "r")

"""Subsamples and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize


def numbered(df: DataFrame, order: list[Column], number: str) -> DataFrame:
    """``df`` with the place of each row, from 0, in an order; equal rows in any order.

    The rows are range-partitioned and sorted once, and written to the shared folder with their place in their
    partition: a second evaluation might cut the ranges elsewhere. Numbers are these places plus the
    counts of the partitions before (one number a partition), so nothing is gathered in one task.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(sorted_rows.withColumn("_n", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_n", 33).alias("_p"), F.col("_n").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = placed.withColumn("_p", part).join(F.broadcast(before.select("_p", "_before")), "_p")
    return ranked.select(*df.columns, (F.col("_before") + place).alias(number))


def every_kth(df: DataFrame, k: int, shard: int = 0, order: str = "id") -> DataFrame:
    """Rows number ``shard``, ``shard`` + k, ... in the order of a column; rows of one value by a hash of all their columns, nulls first."""
    plain = [f.name for f in df.schema if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    ranked = numbered(df.withColumn("_tie", F.xxhash64(*plain)), [F.col(order), F.col("_tie")], "_number")
    return ranked.where(F.col("_number") % k == shard).select(*df.columns)


def first_n_per_group(df: DataFrame, n: int, group: str, order: str = "id") -> DataFrame:
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def seeded_sample(df: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """n rows in a fixed random order of the seed: the limit is taken in every partition before rows meet."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def first_valid(df: DataFrame, n: int, valid: Column, order: str = "id") -> DataFrame:
    """The first n rows, in the order of a column, that are valid (null counts as not): a top-n, taken in every partition before rows meet."""
    return df.where(F.coalesce(valid, F.lit(False))).orderBy(order).limit(n)

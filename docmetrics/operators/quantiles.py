"""Exact order statistics of groups of any size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import discard, materialize

#: Distinct values that one task ranks at most, and the parts that larger groups are cut into at a time.
LIMIT, PARTS = 500_000, 64

Place = Callable[[Column], Column]

LOWER, UPPER = (lambda n: F.floor((n - 1) / 2)), (lambda n: F.floor(n / 2))  # places of the two middle values


def _narrowed(rows: DataFrame, targets: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """Groups (g, path) with values v of weight w, and the places p wanted of them, cut to the parts that hold those places.

    Edges come from a sketch of each group; that they are approximate only makes parts uneven, as the values of each part are
    counted. Sketches and counts are made where the rows lie, so a group that is most of the table sends a few numbers from
    each task.
    """
    shares = F.array(*(F.lit(i / parts) for i in range(1, parts)))
    edges = materialize(rows.groupBy("g", "path").agg(F.percentile_approx("v", shares, 16 * parts).alias("edges")), "edges")
    part = F.size(F.filter("edges", lambda e: e < F.col("v")))
    cut = rows.join(edges, ["g", "path"]).select("g", "path", "v", "w", part.alias("part"))
    sizes = cut.groupBy("g", "path", "part").agg(F.sum("w").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("g", "path").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    sizes = sizes.withColumn("before", upto - F.col("n"))
    held = sizes.join(targets, ["g", "path"]).where((F.col("p") >= F.col("before")) & (F.col("p") < F.col("before") + F.col("n")))
    held = materialize(held.select("g", "path", "part", "name", (F.col("p") - F.col("before")).alias("p")), "places")
    longer = F.concat_ws(".", "path", F.col("part").cast("string")).alias("path")
    kept = cut.join(held.select("g", "path", "part").distinct(), ["g", "path", "part"], "left_semi")
    kept = materialize(kept.groupBy("g", longer, "v").agg(F.sum("w").alias("w")), "values")
    discard(edges)
    return kept, held.select("g", longer, "name", "p")


def order_statistics(rows: DataFrame, by: list[str], wanted: dict[str, dict[str, Place]], limit: int | None = None, parts: int = PARTS) -> DataFrame:
    """Values at given places of each group's sorted values: (by..., a column for each place).

    ``wanted`` maps a value column to names and places; a place, from 0, is a function of the number of the group's values.
    All groups and columns go together. While a group has more than ``limit`` values, it is cut into parts by
    approximate edges, the parts are counted exactly, and only those that hold a wanted place are kept: a group of any size
    comes down by about ``parts`` a round, and no task ever ranks more than ``limit`` distinct values. Groups of all sizes
    give the same results.

    Null values don't count; a null key is a group; NaN is the largest value; places beyond the values give null. Groups without values have
    no row; without ``by`` there is one row. Value columns of different types are taken as doubles.
    """
    limit = LIMIT if limit is None else limit
    kinds = {rows.schema[v].dataType.simpleString() for v in wanted}
    kind = kinds.pop() if len(kinds) == 1 else "double"
    cells = F.array(*(F.struct(F.lit(i).alias("c"), F.col(v).cast(kind).alias("v")) for i, v in enumerate(wanted)))
    stacked = rows.select(F.struct(*by, F.lit(0).alias("_")).alias("b"), F.explode(cells).alias("x")).where("x.v is not null")
    now = stacked.select(F.struct("b", "x.c").alias("g"), F.lit("").alias("path"), "x.v", F.lit(1).cast("long").alias("w"))
    sizes = materialize(now.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "sizes")
    listed = [(i, name, place) for i, places in enumerate(wanted.values()) for name, place in places.items()]
    asked = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(i).alias("c"), place(F.col("n")).cast("long").alias("p")) for i, name, place in listed))
    targets = sizes.select("g", F.lit("").alias("path"), F.explode(F.filter(asked, lambda a: a["c"] == F.col("g.c"))).alias("a")).select("g", "path", "a.name", "a.p")
    most = sizes.agg(F.max("n")).first()[0] or 0
    while most > limit:
        now, targets = _narrowed(now, targets, parts)
        most = now.groupBy("g", "path").count().agg(F.max("count")).first()[0] or 0
    counts = now.groupBy("g", "path", "v").agg(F.sum("w").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("g", "path").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("before", upto - F.col("n")).join(targets, ["g", "path"])
    found = ranked.where((F.col("p") >= F.col("before")) & (F.col("p") < F.col("before") + F.col("n")))
    # every group has its row, whether or not its places have values
    rest = sizes.select("g.b", F.lit(None).cast("string").alias("name"), F.lit(None).cast(kind).alias("v"))
    cells_found = found.select("g.b", "name", "v").unionByName(rest).select(*(F.col(f"b.{c}").alias(c) for c in by), "name", "v")
    picked = [F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for _, name, _ in listed]
    return cells_found.groupBy(*by).agg(*picked) if by else cells_found.agg(*picked)

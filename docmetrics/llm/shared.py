"""What the corpus operators share: the shared folder, written tables and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import discard, materialize, scratch, shared_folder, written_tables  # noqa: F401


#: Edges that one task reduces at a time.
PORTION = 500_000


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition, a bounded portion at a time, to stars around the smallest node of each of their components."""

    def stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        up = list(range(len(nodes)))
        for x, y in zip(place[: len(a)].tolist(), place[len(a) :].tolist(), strict=True):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            while up[y] != y:
                up[y] = up[up[y]]
                y = up[y]
            if x != y:
                up[max(x, y)] = min(x, y)
        for x in range(len(up)):  # parents are smaller, so theirs are final
            up[x] = up[up[x]]
        root = np.array(up, np.int64)
        far = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], ["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(h.num_rows for h in held) >= PORTION:
            yield stars(*(np.concatenate([h.column(c).to_numpy() for h in held]) for c in (0, 1)))
            held = []
    if held:
        yield stars(*(np.concatenate([h.column(c).to_numpy() for h in held]) for c in (0, 1)))


def _settled(edges: DataFrame) -> bool:
    """Whether edges (a > b) are stars: no node has two edges to smaller ones, or one if a larger one has one to it."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where(F.col("up") + F.col("down") > F.greatest(F.lit(1), "down"))
    return odd.limit(1).count() == 0


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every node that has an edge.

    ``edges`` has two bigint columns ``a`` and ``b`` (direction, repeats and self-loops don't matter; null ends have no edge).
    Returns (id, component), one row per node of an edge between different nodes; component is the
    smallest id reachable, in a written table. Each partition first reduces its edges to a forest, a bounded portion
    at a time. Then large-star and small-star rounds alternate, each a pre-aggregated minimum joined back to the edges, until
    the edges are stars. Minima and rounds are written to the shared folder: so the joins read plain shuffles, in which a
    node with very many edges can be split. Links stay on the executors: the driver sees counts.
    """
    fine = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    n = edges.count()
    now = materialize(fine.mapInArrow(_local_forest, "a long, b long").distinct(), "edges", n)
    for _ in range(max_rounds):
        if _settled(now):
            break
        # large star: larger neighbours of a node point to the smallest of its neighbourhood
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        minima = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "minima", 2 * n)
        large = both.join(minima.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # small star: smaller neighbours and the node itself point to the smallest of them
        large = materialize(large.distinct(), "edges", n)
        discard(minima, now)
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "minima", 2 * n)
        small = large.join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        now = materialize(small, "edges", n)
        discard(large, least)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("id")).distinct()
    out = materialize(now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select("id", F.col("id").alias("component"))), "components", 2 * n)
    discard(now)
    return out

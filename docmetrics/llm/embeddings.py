"""Near-duplicate vectors by a pivot-permutation index and exact verification."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, discard, materialize

#: Similarities held at a time by one task.
TILE = 4 << 20
#: Pairs whose vectors one task holds at a time.
PAIRS_HELD = 1 << 16
#: At most so many long lists (16 bytes each) are broadcast; more are joined by a shuffle.
LONG_LISTS = 500_000


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` most similar pivots of each row, most similar first (the lower number on ties)."""
    top = min(top, len(pivots))
    out = np.empty((len(x), top), np.int64)
    step = max(1, TILE // len(pivots))
    for at in range(0, len(x), step):
        sim = _unit(x[at : at + step]) @ pivots.T
        part = np.argpartition(-sim, top - 1, axis=1)[:, :top] if top < len(pivots) else np.tile(np.arange(len(pivots)), (len(sim), 1))
        part.sort(axis=1)
        order = np.argsort(-np.take_along_axis(sim, part, 1), axis=1, kind="stable")
        out[at : at + step] = np.take_along_axis(part, order, 1)
    return out


def reference_points(sample: np.ndarray, n: int, apart: float = 0.7) -> np.ndarray:
    """Up to ``n`` unit vectors of the sample, in its order, that have pairwise cosines below ``apart``.

    A dense cluster so gives one point, not many that would share its members' lists out at random.
    Fewer than 16 are filled up with fixed random directions.
    """
    dim = sample.shape[1]
    chosen = np.empty((n, dim))
    count = 0
    for at in range(0, len(sample), 512):
        if count == n:
            break
        x = _unit(sample[at : at + 512])
        if count:
            x = x[np.max([(x @ chosen[b : min(b + 8192, count)].T).max(1) for b in range(0, count, 8192)], axis=0) < apart]
        near = x @ x.T >= apart
        taken: list[int] = []
        for k in range(len(x)):
            if count + len(taken) < n and not near[k, taken].any():
                taken.append(k)
        chosen[count : count + len(taken)] = x[taken]
        count += len(taken)
    chosen = chosen[:count]
    return np.concatenate([chosen, directions(dim)[: 16 - count]]) if count < 16 else chosen


def lists_for(pivots: int) -> int:
    """Lists that a vector is posted under: half the binary logarithm of the number of pivots, 4 at least.

    Among more pivots two near vectors agree in fewer of the nearest. With as many lists, and permutations of twice
    that length, of pairs of random directions with a cosine of exactly 0.93 in 64 dimensions 0.99 are found, for 256 to 65,536 pivots.
    """
    return max(4, math.ceil(math.log2(max(2, pivots)) / 2))


def directions(dim: int) -> np.ndarray:
    """Sixteen fixed directions, for lengths of vectors of which the sample has too few."""
    return _unit(np.random.default_rng(dim).normal(size=(16, dim)))


def _rows(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vectors in a list array."""
    starts, sizes = vectors.offsets.to_numpy()[:-1], np.diff(vectors.offsets.to_numpy())
    flat = vectors.values.to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        yield rows, flat[starts[rows][:, None] + np.arange(dim)]


def _describe(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray], top: int) -> Iterator[pa.RecordBatch]:
    """(node, label_key, size, vector) to (node, label_key, near, payload): numbers of the nearest pivots in their order, and what travels to the lists.

    The payload holds the node, the size, the numbers and the vector's own numbers, all little-endian.
    """
    for batch in batches:
        near: list = [None] * batch.num_rows
        payload: list = [b""] * batch.num_rows
        nodes, sizes = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        for rows, x in _rows(batch.column(3)):
            found = nearest_pivots(x, pivots.get(x.shape[1], directions(x.shape[1])), top).astype("<i4")
            kept = np.full((len(x), top), -1, "<i4")
            kept[:, : found.shape[1]] = found
            raw = np.ascontiguousarray(x.astype(f"<f{x.dtype.itemsize}"))
            for k, row in enumerate(rows.tolist()):
                near[row] = found[k].tolist()
                payload[row] = struct.pack("<qq", nodes[row], sizes[row]) + kept[k].tobytes() + raw[k].tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.list_(pa.int32())), pa.array(payload, pa.binary())], ["node", "label_key", "near", "payload"])


class _Trees:
    """Union-find over node numbers, smallest first."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def link(self, a: int, others: np.ndarray) -> None:
        a = self.find(a)
        for b in np.unique(self.up[others]).tolist():
            b = self.find(b)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                a = min(a, b)


def _shared_counts(left: np.ndarray, right: np.ndarray, own: int) -> np.ndarray:
    """How many numbers (others than ``own`` and -1) each row of ``left`` has in common with each row of ``right``: sums over inverted lists."""
    counts = np.zeros((len(left), len(right)), np.int8)
    rows = [np.repeat(np.arange(len(side)), side.shape[1]) for side in (left, right)]
    numbers = [side.ravel() for side in (left, right)]
    order = [np.argsort(x, kind="stable") for x in numbers]
    numbers = [x[o] for x, o in zip(numbers, order, strict=True)]
    rows = [r[o] for r, o in zip(rows, order, strict=True)]
    common = np.intersect1d(numbers[0], numbers[1])
    for pivot in common[(common >= 0) & (common != own)].tolist():
        a, b = (r[np.searchsorted(x, pivot) : np.searchsorted(x, pivot, "right")] for r, x in zip(rows, numbers, strict=True))
        counts[a[:, None], b[None, :]] += 1
    return counts


def _lower_list(a: np.ndarray, b: np.ndarray, own: int) -> np.ndarray:
    """Whether the rows of a and b, pairwise, have a number below ``own`` in common."""
    return ((a[:, :, None] == b[:, None, :]) & (a >= 0)[:, :, None] & (a < own)[:, :, None]).any((1, 2))


def _match(table: pa.Table, threshold: float, top: int, lists: int, shared: int, width: int) -> pa.Table:
    """Link counts and a spanning forest of all units (inverted lists or pairs of their blocks) in the table.

    Two vectors of a list are candidates where they share at least ``shared`` of their ``top`` pivots, and this list's pivot is the
    lowest one that both are listed under: so a pair counts once. Candidates are verified by their cosine in double precision.
    """
    payload = table.column("payload").to_pylist()
    unit, meta = table.column("unit").to_numpy(), table.column("meta").to_numpy()
    pivot, home, cross = meta >> 32, (meta >> 1) & 0x7FFFFFFF, (meta & 1).astype(bool)
    head = np.array([struct.unpack_from("<qq", p) for p in payload], np.int64).reshape(-1, 2)
    near = np.frombuffer(b"".join(p[16 : 16 + 4 * top] for p in payload), "<i4").reshape(-1, top)
    lengths = np.array([len(p) for p in payload])
    names, local = np.unique(head[:, 0], return_inverse=True)
    size, weight, trees = head[:, 1], np.zeros(len(names), np.int64), _Trees(len(names))
    order = np.lexsort((head[:, 0], lengths, unit))
    change = np.flatnonzero((np.diff(unit[order]) != 0) | (np.diff(lengths[order]) != 0)) + 1
    for rows in np.split(order, change):
        if len(rows) < 2:
            continue
        x = _unit(np.frombuffer(b"".join(payload[r][16 + 4 * top :] for r in rows), f"<f{width}").reshape(len(rows), -1))
        own, crossing = int(pivot[rows[0]]), cross[rows[0]]
        sides = home[rows] == home[rows].min()
        left, right = (np.flatnonzero(sides), np.flatnonzero(~sides)) if crossing else (np.arange(len(rows)),) * 2
        step = max(1, TILE // max(1, len(right)))
        for at in range(0, len(left), step):
            part = left[at : at + step]
            ok = _shared_counts(near[rows[part]], near[rows[right]], own) >= shared - 1  # both have the list's own pivot
            if not crossing:
                ok &= part[:, None] < right[None, :]
            i, j = np.nonzero(ok)
            similar = np.empty(len(i))
            if 8 * len(i) > ok.size:
                similar = (x[part] @ x[right].T)[i, j]
            else:
                for b in range(0, len(i), PAIRS_HELD):
                    k = slice(b, b + PAIRS_HELD)
                    similar[k] = np.einsum("nd,nd->n", x[part[i[k]]], x[right[j[k]]])
            i, j = i[similar >= threshold], j[similar >= threshold]
            first = np.ones(len(i), bool)
            for b in range(0, len(i), PAIRS_HELD):
                k = slice(b, b + PAIRS_HELD)
                first[k] = ~_lower_list(near[rows[part[i[k]]], :lists], near[rows[right[j[k]]], :lists], own)
            i, j = i[first], j[first]
            if not len(i):
                continue
            a, b = rows[part[i]], rows[right[j]]
            np.add.at(weight, local[a], size[b])
            np.add.at(weight, local[b], size[a])
            cuts = np.flatnonzero(np.diff(i)) + 1
            for run in np.split(np.arange(len(i)), cuts):
                trees.link(int(local[a[run[0]]]), local[b[run]])
    linked = np.flatnonzero(weight)
    roots = np.array([names[trees.find(i)] for i in linked.tolist()], np.int64)
    return pa.table({"a": pa.array(names[linked], pa.int64()), "links": pa.array(weight[linked]), "b": pa.array(roots, pa.int64())})


def near_duplicate_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.93,
    top: int | None = None,
    lists: int | None = None,
    shared: int = 2,
    block: int = 16_384,
    pivots: int | None = None,
) -> DataFrame:
    """Links between vectors of one label with a cosine of ``threshold`` or more, and their components.

    1. Equal vectors of a label collapse to one with the smallest id and their number (pre-aggregated).
    2. Reference points: ``pivots`` vectors (by default the root of the number of vectors, 64 to 131,072: at most 64 MB at
       64 dimensions) of a sample by hash of about four times as many; every vector is described by its ``top`` nearest ones in
       their order (by default twice ``lists``). Reference points keep apart from each other.
    3. Inverted lists: a vector is posted under its ``lists`` nearest pivots (by default ``lists_for`` their number, 4 to 9), once each
       with its permutation and its own numbers. Two vectors of a list are candidates where they share ``shared`` or more of their ``top`` pivots, in the list of the
       lowest pivot that both are posted under alone. Lists of more than ``block`` vectors are cut into blocks, and every
       two blocks meet, so no list is truncated and no task grows with a list. (Lists hold about ``lists`` times the root of
       the number of vectors, a label's share of it; beyond 17 billion vectors, where the pivots end, they grow with the table.)
    4. Candidates are verified by their cosines in double precision. Link counts and spanning trees
       leave the task, never pairs.
    5. Connected components of the trees.

    The index is approximate: of pairs of random directions exactly at 0.93 about 0.99 are found (64 dimensions, 256 to
    65,536 pivots), of closer ones more; nothing below the threshold is linked. Vectors of different lengths
    never link. Vectors that are null, empty, all zero or hold null or non-finite components, and null
    labels, link with nothing. Null ids are returned unlinked. Rows that repeat an id count as vectors of
    their own, each with its own links and component. Other columns are ignored. An empty table gives an empty result.

    Returns (id_col, n_links, component_id, kept).
    """
    v = F.col("v")
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    wide = kind if kind in ("float", "double") else "double"
    numbers = F.transform(F.col(vector_col), lambda x: x.cast(wide) + F.lit(0).cast(wide))  # there is one zero only
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), numbers.alias("v"))
    norm = F.aggregate(v, F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0)
    fine = F.coalesce(F.when(fine & ~F.coalesce(odd, F.lit(True)), (norm > 0) & (norm < float("inf"))), F.lit(False))
    # equal vectors of a label are known by 128 bits where they need not travel
    rows = rows.withColumns({"fine": fine, "k1": F.xxhash64("label", "v"), "k2": F.xxhash64(F.lit(7), "v", "label")})
    valid = rows.where("fine")
    count = F.count(F.lit(1))
    groups = materialize(valid.groupBy("label", "v").agg(F.min("id").alias("rep"), count.alias("size"), F.min("k1").alias("k1"), F.min("k2").alias("k2")), "vectors")

    n = groups.count()
    repeated = groups.groupBy("rep").agg(count.alias("_n"), F.min(F.struct("k1", "k2")).alias("_first")).where("_n > 1").select("rep", "_first")
    repeats = repeated.limit(1).count() > 0
    if repeats:  # an id with several vectors: all but the first are known by hashes of theirs
        node = F.when(F.col("_first") != F.struct("k1", "k2"), F.xxhash64("k1", "k2")).otherwise(F.col("rep"))
        groups = materialize(groups.join(repeated, "rep", "left").withColumn("node", node).drop("_first"), "vectors")
    else:
        groups = groups.withColumn("node", F.col("rep"))

    n_pivots = pivots or int(min(131_072, max(64, math.sqrt(n))))
    lists = lists or lists_for(n_pivots)
    top = top or 2 * lists
    every = max(1, n // (4 * n_pivots))
    picked = groups.where(F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(every)) == 0).select(F.xxhash64(F.lit(2), "node").alias("h"), "v").toArrow().sort_by("h")
    points = {x.shape[1]: reference_points(x, n_pivots) for _, x in _rows(picked.column("v").combine_chunks())} if picked.num_rows else {}

    label_key = F.xxhash64("label", F.size("v"))
    described = groups.select("node", label_key.alias("label_key"), "size", "v").mapInArrow(lambda it: _describe(it, points, top), "node long, label_key long, near array<int>, payload binary")
    described = materialize(described, "described")
    posted = described.select("node", "payload", "label_key", F.explode(F.slice("near", 1, lists)).alias("pivot")).withColumn("list", F.xxhash64("label_key", "pivot"))
    long_lists = materialize(posted.select("list").groupBy("list").agg(count.alias("members")).where(F.col("members") > block), "lists")
    hint = F.broadcast if long_lists.count() <= LONG_LISTS else (lambda df: df.hint("merge"))
    blocks = F.coalesce(F.ceil(F.col("members") / block), F.lit(1)).cast("int")
    dealt = posted.join(hint(long_lists), "list", "left").withColumn("blocks", blocks)
    dealt = dealt.withColumn("home", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("home", "j"), F.greatest("home", "j")
    meta = F.shiftleft(F.col("pivot").cast("long"), 32) + F.shiftleft(F.col("home").cast("long"), 1) + (low != high).cast("long")
    dealt = dealt.select(F.xxhash64("list", low, high).alias("unit"), meta.alias("meta"), "payload")
    deal = F.pmod("unit", F.lit(max(1, n // 4000 + 1) * 4))
    width = 4 if wide == "float" else 8
    found = dealt.groupBy(deal.alias("deal")).applyInArrow(lambda t: _match(t, threshold, top, lists, shared, width), "a long, links long, b long")
    found = materialize(found, "links")

    counts = materialize(found.groupBy("a").agg(F.sum("links").alias("links")), "counts")
    components = connected_components(found.select("a", "b"))
    named = groups.select("k1", "k2", "rep", "node", "size").join(counts.withColumnRenamed("a", "node"), "node", "left").join(components.withColumnRenamed("id", "node"), "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    if repeats:  # the smallest id of a component, not its smallest node
        least = named.groupBy("component").agg(F.min("rep").alias("_least"))
        named = named.join(least, "component").withColumn("component", F.col("_least"))
    named = materialize(named.select("k1", "k2", "size", "links", "component"), "named")
    discard(groups, described, long_lists, found, counts, components)
    member = valid.select("id", "k1", "k2").join(named.hint("merge"), ["k1", "k2"])
    linked = member.select("id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = materialize(linked.unionByName(alone), "vector-links")
    discard(named)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))

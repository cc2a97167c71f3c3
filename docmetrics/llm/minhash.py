"""Near duplicates by MinHash bands, sequential Bayesian pruning and exact verification."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, discard, materialize, written_tables
from .wordcache import portions

BATCH = 32
PRIME = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of word hashes spread over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * STEP
    h = h ^ (h >> np.uint64(29))
    h = h * PRIME
    return h ^ (h >> np.uint64(32))


class Words(dict):
    """Word (bytes) to 64-bit hash, computed once per worker; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _word_hashes(raws: list[bytes], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts laid end to end, and the number of words before each text. Distinct words are hashed once."""
    buf = np.frombuffer(b" ".join(raws).lower(), np.uint8)
    inside = ~_SPACE[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    start = np.flatnonzero(begins)
    offsets = np.zeros(len(start) + 1, np.int32)
    offsets[:-1] = np.cumsum(inside, dtype=np.int32)[start] - 1
    data = buf[inside]
    offsets[-1] = len(data)
    found = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    own = np.fromiter(map(words.__getitem__, found.dictionary.to_pylist()), np.uint64, len(found.dictionary))
    places = np.cumsum([0] + [len(r) + 1 for r in raws])
    return own[found.indices.to_numpy()], np.searchsorted(start, places, "left")


def shingle_sets(texts: Iterable[str | None], words: Words, size: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each whole text, in order.

    Words are maximal runs without ASCII white space, A-Z lower-cased. Fewer words than ``size`` make
    one shingle of the whole sequence; no words (or null) make none.
    """
    for part in portions(texts, 4 << 20):
        h, at = _word_hashes([t.encode("utf-8", "surrogatepass") for t in part], words)
        total = np.zeros(max(0, len(h) - size + 1), np.uint64)
        for i in range(size):
            total = total * PRIME + h[i : i + len(total)]
        total = _mix(total)
        for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
            if b - a >= size:
                yield np.unique(total[a : b - size + 1])
            elif b > a:
                whole = np.zeros(1, np.uint64)
                for x in h[a:b]:
                    whole = whole * PRIME + x
                yield _mix(whole ^ np.uint64(b - a))
            else:
                yield np.empty(0, np.uint64)


@lru_cache(maxsize=4)
def _permutations(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def signature(hashes: np.ndarray, n: int) -> np.ndarray:
    """``n`` minima of multiply-add permutations over the shingle hashes."""
    a, b = _permutations(n)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    high = (hashes >> np.uint64(32)).astype(np.uint32)[:, None]
    room = np.empty((min(256, len(high)), n), np.uint32)
    for at in range(0, len(high), 256):
        part = high[at : at + 256]
        v = np.multiply(part, a, out=room[: len(part)])
        v += b
        np.minimum(out, v.min(0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    s = sig.reshape(bands, rows).astype(np.uint64)
    h = np.arange(1, bands + 1, dtype=np.uint64) * STEP
    for i in range(rows):
        h = _mix(h * PRIME + s[:, i])
    return h.view(np.int64)


@lru_cache(maxsize=8)
def least_matches(threshold: float, n: int, batch: int, miss: float, bits: int = 8) -> dict[int, int]:
    """For each number of compared hashes: the fewest matches that keep a pair alive.

    A pair with fewer has a posterior probability (uniform prior over similarities, binomial
    likelihood of ``bits``-bit matches) below ``miss`` of being at the threshold or above.
    """
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 2**bits
    above = s >= threshold - 1 / 4000
    out = {}
    for k in range(batch, n + 1, batch):
        for m in range(k + 1):
            log = m * np.log(p) + (k - m) * np.log1p(-p)
            w = np.exp(log - log.max())
            if w[above].sum() >= miss * w.sum():
                out[k] = m
                break
    return out


def banding(percent: int, hashes: int = 192, miss: float = 1e-6) -> tuple[int, int]:
    """(bands, rows) within ``hashes``: the most rows with which a pair at the threshold misses all bands with at most ``miss``."""
    for rows in range(16, 1, -1):
        bands = hashes // rows
        if (1 - (percent / 100) ** rows) ** bands <= miss:
            return bands, rows
    return hashes, 1


SIGNED = "id long, text_key long, n_shingles long, set_key binary, sig binary, keys array<long>"


def _low_bytes(sig: np.ndarray) -> bytes:
    return (sig & np.uint32(0xFF)).astype(np.uint8).tobytes()


def _sign(batches: Iterator[pa.RecordBatch], bands: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """(id, key of the text, text) to the size and key of its set, its 8-bit signature and its band keys."""
    words = Words()
    for batch in batches:
        n, sets, sigs, keys = [], [], [], []
        for h in shingle_sets((t.as_py() for t in batch.column(2)), words, size):
            n.append(len(h))
            if not len(h):
                for out in (sets, sigs, keys):
                    out.append(None)
                continue
            full = signature(h, bands * rows)
            sets.append(xxhash.xxh3_128_digest(h.tobytes()))
            sigs.append(_low_bytes(full))
            keys.append(band_keys(full, bands, rows))
        arrays = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["id", "text_key", "n_shingles", "set_key", "sig", "keys"])


FULL = "node long, grp long, blocks int, sig binary, hashes binary"


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(node, grp, blocks, sig, set_key, text) to the full set; texts of the id that have another set go."""
    words = Words()
    for batch in batches:
        own, sets = [], []
        found = shingle_sets((t.as_py() for t in batch.column("text")), words, size)
        for want, h in zip(batch.column("set_key"), found, strict=True):
            raw = h.tobytes()
            own.append(xxhash.xxh3_128_digest(raw) == want.as_py())
            sets.append(raw)
        columns = [batch.column(c) for c in ("node", "grp", "blocks", "sig")] + [pa.array(sets, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["node", "grp", "blocks", "sig", "hashes"]).filter(pa.array(own))


def _signatures(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def survivors(a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Positions of the rows of two arrays of signatures that no batch prunes: hashes are compared ``BATCH`` at a time, and pairs below the bound go."""
    alive, got = np.arange(len(a)), np.zeros(len(a), np.int64)
    for at in range(0, a.shape[1], BATCH):
        if not len(alive):
            break
        got = got + (a[alive, at : at + BATCH] == b[alive, at : at + BATCH]).sum(1)
        if at + BATCH in least:
            keep = got >= least[at + BATCH]
            alive, got = alive[keep], got[keep]
    return alive


def _plausible(batches: Iterator[pa.RecordBatch], width: int, percent: int, miss: float) -> Iterator[pa.RecordBatch]:
    """(a, b, signatures of both) to (a, b, whether the pair survives)."""
    least = least_matches(percent / 100, width, BATCH, miss)
    for batch in batches:
        ok = np.zeros(batch.num_rows, bool)
        ok[survivors(_signatures(batch.column(2), width), _signatures(batch.column(3), width), least)] = True
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok)], ["a", "b", "ok"])


class Forest:
    """Union-find over row numbers; the smallest id of a tree is its root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _units(unit: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of each unit that has two or more."""
    by = np.argsort(unit, kind="stable")
    for rows in np.split(by, np.flatnonzero(np.diff(unit[by])) + 1):
        if len(rows) > 1:
            yield rows


def _partners(i: int, late: np.ndarray) -> np.ndarray:
    """Rows behind row i that it is compared with: all, or only late ones where it is not late itself."""
    rest = np.arange(i + 1, len(late))
    return rest if late[i] else rest[late[i + 1 :]]


def _survive_together(table: pa.Table, width: int, percent: int, miss: float) -> pa.Table:
    """Spanning pairs of the rows that survive each other's signatures in each unit, where one of the two is late."""
    nodes, late = table.column("node").to_numpy(), table.column("late").to_numpy(zero_copy_only=False)
    sigs = _signatures(table.column("sig"), width)
    least = least_matches(percent / 100, width, BATCH, miss)
    pairs: list[tuple[int, int]] = []
    for rows in _units(table.column("unit").to_numpy()):
        forest = Forest(len(rows))
        for i in range(len(rows) - 1):
            rest = _partners(i, late[rows])
            one = np.broadcast_to(sigs[rows[i]], (len(rest), width))
            for j in rest[survivors(sigs[rows[rest]], one, least)].tolist():
                if forest.union(i, j):
                    pairs.append((int(nodes[rows[i]]), int(nodes[rows[j]])))
    return pa.table({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([y for _, y in pairs], pa.int64())})


def similar_in_group(ids: np.ndarray, sets: list[np.ndarray], sigs: np.ndarray, late: np.ndarray, percent: int, miss: float) -> list[tuple[int, int]]:
    """Links (id, id) that span the classes of a group of candidates.

    Every row is compared with all later ones of its group at once (with late ones only where it is not late
    itself): first the sizes of the sets, then batches of signature hashes with the Bayesian bounds, then, for survivors
    that are not yet in one tree, the full sets.
    """
    order = np.argsort(ids, kind="stable")
    ids, sigs, sets, late = ids[order], sigs[order], [sets[i] for i in order], late[order]
    sizes = np.array([len(s) for s in sets])
    least = least_matches(percent / 100, sigs.shape[1], BATCH, miss)
    forest, links = Forest(len(ids)), []
    for i in range(len(ids) - 1):
        rest = _partners(i, late)
        small, large = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
        rest = rest[100 * small >= percent * large]
        rest = rest[survivors(sigs[rest], np.broadcast_to(sigs[i], (len(rest), sigs.shape[1])), least)]
        for j in rest.tolist():
            if forest.find(i) == forest.find(j):
                continue
            a, b = sets[i], sets[j]
            both = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * both >= percent * (len(a) + len(b) - both):
                forest.union(i, j)
                links.append((int(ids[i]), int(ids[j])))
    return links


def _verify(table: pa.Table, width: int, percent: int, miss: float) -> pa.Table:
    ids, late = table.column("node").to_numpy(), table.column("late").to_numpy(zero_copy_only=False)
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("hashes")]
    sigs = _signatures(table.column("sig"), width)
    links: list[tuple[int, int]] = []
    for rows in _units(table.column("unit").to_numpy()):
        links += similar_in_group(ids[rows], [sets[r] for r in rows], sigs[rows], late[rows], percent, miss)
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


PAIRS = "a long, b long"


def _n() -> F.Column:
    return F.count(F.lit(1))


def _dealt(df: DataFrame, rows: int, each: int = 500) -> DataFrame:
    """Units dealt into groups of about ``each`` rows, of which several make a task."""
    return df.withColumn("deal", F.pmod("unit", F.lit(max(1, rows // each + 1) * 8))).groupBy("deal")


def _late_units(df: DataFrame, key: str, block: int, n: int) -> DataFrame:
    """Rows (key, node, late, ...) in units in which every late row of a key meets every row of it.

    Late rows and all rows are cut into blocks of about ``block`` rows, and a unit is a pair of blocks. Rows that are not late
    travel once for each block of late ones, of which there are few.
    """
    count = materialize(df.groupBy(key).agg(_n().alias("_m"), F.count_if("late").alias("_r")).where("_r > 0 and _m > 1"), "counts", n)
    sized = df.join(count.hint("merge"), key)
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    home, late_home = F.pmod(F.xxhash64("node"), blocks("_m")).cast("int"), F.pmod(F.xxhash64(F.lit(1), "node"), blocks("_r")).cast("int")
    sized = sized.withColumns({"_home": home, "_late_home": late_home})
    as_any = F.transform(F.sequence(F.lit(0), blocks("_r") - 1), lambda r: F.xxhash64(key, r, "_home"))
    as_late = F.when(F.col("late"), F.transform(F.sequence(F.lit(0), blocks("_m") - 1), lambda m: F.xxhash64(key, "_late_home", m))).otherwise(F.array().cast("array<bigint>"))
    return sized.withColumn("unit", F.explode(F.array_union(as_any, as_late)))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 80,
    shingle: int = 5,
    bands: int | None = None,
    rows: int | None = None,
    miss: float = 1e-7,
    block: int = 512,
) -> DataFrame:
    """Classes of documents whose word-shingle sets have a Jaccard similarity of ``percent``/100 or more.

    1. Every whole text becomes its set of distinct shingles and a signature of bands*rows MinHashes.
    2. Documents with equal sets collapse to one with the smallest id (a pre-aggregated group-by),
       so copies of one text, however many, go on as one row.
    3. Band keys that several sets share join each to the smallest of the band. These pairs are pruned by their
       signatures alone: batches of hashes against posterior bounds (a pair at the threshold is lost with a probability
       of about ``miss``). In a band where a set does not survive with the smallest, that set meets all others of the band,
       again by signatures. What survives makes the candidate families; chains of chance hits do not.
    4. Full sets travel to the families only, once each: a family of more than ``block`` sets is cut into blocks, which
       all hold its smallest set. Only links that join classes leave a task. Sets that are not in the class of the smallest
       then meet all others of the family, block by block; no pair is skipped and no task holds more than about 2*block sets.
    5. Connected components of the links, spread to the collapsed copies.

    Without ``bands`` and ``rows``, 192 hashes are dealt so that a pair at the threshold misses all bands with a
    probability of at most 1e-6 (0.8: 38 bands of 5, 3e-7; 0.85: 32 bands of 6, 3e-7).
    Null and empty texts (or texts of white space only) have no shingles and link with nothing. Rows
    that repeat an id with the same text are returned as often as they come. An id with several texts counts as a document for
    each: every row has the component of its own text, which may be kept for one and not for the other. A null id is returned
    with component null and kept true. An empty table gives an empty result. Other columns are ignored.

    Returns (id_col, n_shingles, component_id, kept): the smallest id reachable by links, and whether
    it is the row's own.
    """
    with written_tables() as made:
        found = materialize(_classes(docs, id_col, text_col, percent, shingle, bands, rows, miss, block), "near")
    discard(*(t for t in made if t is not found))
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def _classes(docs: DataFrame, id_col: str, text_col: str, percent: int, shingle: int, bands: int | None, rows: int | None, miss: float, block: int) -> DataFrame:
    """(id, text_key, n_shingles, component_id, kept) of every row."""
    if not bands or not rows:
        bands, rows = banding(percent)
    width = bands * rows
    text_key = F.xxhash64(F.col(text_col))
    rows_in = docs.select(F.col(id_col).cast("long").alias("id"), text_key.alias("text_key"), F.col(text_col).alias("text"))
    signed = materialize(rows_in.mapInArrow(lambda it: _sign(it, bands, rows, shingle), SIGNED), "minhash")

    sets = signed.where("set_key is not null and id is not null").groupBy("set_key").agg(F.min("id").alias("rep"))
    n = signed.count()
    sets = materialize(sets, "sets", n)  # written first, so that the join can split a set that very many rows have
    # a set is known by its smallest id; where an id has several sets, the others are known by hashes of theirs
    shared = sets.groupBy("rep").agg(_n().alias("_n"), F.min("set_key").alias("_first")).where("_n > 1").select("rep", "_first")
    repeated = shared.limit(1).count() > 0
    if repeated:
        named = sets.join(shared, "rep", "left").select("set_key", "rep", F.when(F.col("_first") != F.col("set_key"), F.xxhash64("set_key")).otherwise(F.col("rep")).alias("node"))
        sets = materialize(named, "sets", n)
    else:
        sets = sets.withColumn("node", F.col("rep"))
    member = signed.select("id", "text_key", "n_shingles", "set_key").join(sets.hint("merge"), "set_key", "left")
    member = materialize(member, "members", n)

    own = member.where("id = rep").select("set_key", "node", "rep").distinct()
    first = signed.where("set_key is not null").groupBy("set_key").agg(F.min("sig").alias("sig"), F.min("keys").alias("keys"))
    nodes = materialize(own.join(first.hint("merge"), "set_key").select("node", "rep", "set_key", "sig", "keys"), "nodes")
    candidates = _candidates(nodes, width, percent, miss, block)
    families = connected_components(candidates).withColumnRenamed("component", "grp")
    discard(candidates)
    links = _links(rows_in, nodes, families, width, percent, shingle, miss, block)
    classes = connected_components(links)
    discard(signed, links, families)
    if repeated:  # the smallest id of a class, not its smallest node
        least = classes.join(nodes.select(F.col("node").alias("id"), "rep"), "id").groupBy("component").agg(F.min("rep").alias("_least"))
        classes = materialize(classes.join(least, "component").select("id", F.col("_least").alias("component")), "classes", n)
    out = member.join(classes.withColumnRenamed("id", "node").hint("merge"), "node", "left")
    component = F.coalesce("component", "rep", "id")
    return out.select("id", "text_key", "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _candidates(nodes: DataFrame, width: int, percent: int, miss: float, block: int) -> DataFrame:
    """Pairs (a, b), written, whose components are the candidate families: band neighbours that survive by their signatures."""
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    n = nodes.count()
    bands = nodes.select(F.max(F.size("keys"))).first()[0] or 0
    least = materialize(keyed.groupBy("key").agg(F.min("node").alias("head"), _n().alias("n")).where("n > 1").select("key", "head"), "heads", n * bands)
    banded = materialize(keyed.join(least.hint("merge"), "key").select("key", "node", "head"), "banded", n * bands)
    sig = nodes.select("node", "sig")
    stars = banded.where("node <> head").select("node", "head").distinct()
    stars = stars.join(sig.hint("merge"), "node").join(sig.select(F.col("node").alias("head"), F.col("sig").alias("head_sig")).hint("merge"), "head")
    judged = stars.select(F.col("node").alias("a"), F.col("head").alias("b"), "sig", "head_sig").mapInArrow(lambda it: _plausible(it, width, percent, miss), "a long, b long, ok boolean")
    found = banded.count()
    judged = materialize(judged, "judged")  # signatures are read, so the tasks stay as many as the shuffle makes
    discard(least)
    # bands with a set that does not survive with the smallest
    odd = judged.where("not ok").select(F.col("a").alias("node"), F.col("b").alias("head"), F.lit(True).alias("late"))
    late = materialize(banded.join(odd.hint("merge"), ["node", "head"]).select("key", "node", "late"), "late", found)
    open_keys = late.select("key").distinct()
    rows = banded.select("key", "node").join(open_keys.hint("merge"), "key", "left_semi").join(late.hint("merge"), ["key", "node"], "left")
    rows = materialize(rows.select("key", "node", F.coalesce("late", F.lit(False)).alias("late")), "open", found)
    n = rows.count()
    units = _late_units(rows, "key", block, n).select("unit", "node", "late").join(sig.hint("merge"), "node")
    more = _dealt(units, n, 2000).applyInArrow(lambda t: _survive_together(t, width, percent, miss), PAIRS)
    pairs = materialize(judged.where("ok").select("a", "b").unionByName(more).distinct(), "candidates", found)
    discard(banded, judged, late, rows)
    return pairs


def _links(rows_in: DataFrame, nodes: DataFrame, families: DataFrame, width: int, percent: int, shingle: int, miss: float, block: int) -> DataFrame:
    """Verified links of the candidate families, written to the shared folder."""
    n = families.count()
    sized = families.groupBy("grp").agg(_n().alias("_m")).select("grp", F.ceil(F.col("_m") / block).cast("int").alias("blocks"))
    wanted = families.withColumnRenamed("id", "node").join(sized, "grp").join(nodes.select("node", "rep", "set_key", "sig").hint("merge"), "node")
    # no broadcast, even where the candidates are few: the same plan and shuffle at every size
    with_text = rows_in.join(wanted.hint("merge"), rows_in["id"] == wanted["rep"]).select("node", "grp", "blocks", "sig", "set_key", "text")
    full = materialize(with_text.mapInArrow(lambda it: _sets(it, shingle), FULL), "full")

    home = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    homes = F.when(F.col("node") == F.col("grp"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(home))
    units = full.select("node", "sig", "hashes", F.lit(True).alias("late"), F.explode(F.transform(homes, lambda h: F.xxhash64("grp", h))).alias("unit"))
    verify = lambda t: _verify(t, width, percent, miss)
    links = materialize(_dealt(units, n).applyInArrow(verify, PAIRS), "links")  # few rows are written, but sets are read: no fewer tasks
    large = full.where("blocks > 1")
    if large.limit(1).count():  # sets of large families that their blocks did not join to the smallest one's class
        classes = connected_components(links)
        late = F.coalesce("component", "node") != F.col("grp")
        marked = large.select("node", "grp").distinct().join(classes.withColumnRenamed("id", "node"), "node", "left").select("grp", "node", late.alias("late"))
        marked = materialize(marked, "marked", n)
        units = _late_units(marked, "grp", block, n).select("unit", "node", "late").join(large.select("node", "sig", "hashes").hint("merge"), "node")
        more = materialize(_dealt(units, n).applyInArrow(verify, PAIRS).unionByName(links), "links")
        discard(links, classes, marked)
        links = more
    discard(full)
    return links


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their class, with all their columns.

    Rows are dropped by id and text: an id with several texts keeps those that are not near another. Rows with a null id, and
    texts without words, stay. Rows that repeat id and text stay or go together. An empty table gives an empty result.
    """
    with written_tables() as made:
        found = _classes(docs, id_col, text_col, percent, 5, None, None, 1e-7, 512).where("not kept")
        gone = materialize(found.select(F.col("id").alias("_gone"), F.col("text_key").alias("_gone_text")).distinct(), "gone")
    discard(*(t for t in made if t is not gone))
    same = (docs[id_col].cast("long") == gone["_gone"]) & (F.xxhash64(docs[text_col]) == gone["_gone_text"])
    return docs.join(gone.hint("merge"), same, "left_anti")

"""Repeated passages: sparse suffix arrays, sorted deep-shallow, over anchored candidates."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize, written_tables

#: Bytes hashed at a time; longer texts are cut into overlapping pieces of this size.
CHUNK = 1 << 20
POSITION = np.uint64((1 << 21) - 1)
BASE = 0x9E3779B97F4A7C15 | 1
SHALLOW = 32
#: Claims that are compared in one place, about.
CLAIMS = 4000


# ---------------------------------------------------------------- anchors


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes; powers of the base and of its inverse modulo 2**64."""
    values = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
    n = CHUNK + 4096
    powers, inverses = np.empty(n, np.uint64), np.empty(n, np.uint64)
    for out, base in ((powers, BASE), (inverses, pow(BASE, -1, 2**64))):
        out[0] = 1
        filled = 1
        while filled < n:
            m = min(filled, n - filled)
            out[filled : filled + m] = out[:m] * np.uint64(pow(base, filled, 2**64))
            filled += m
    return values, powers, inverses


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    span = 1
    while span * 2 <= w:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    return np.minimum(v[: len(v) - (w - span)], v[w - span :]) if w > span else v


def anchors(buf: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of the windows of ``length`` bytes in texts laid end to end.

    Every window picks the gram of ``gram`` bytes in it with the least hash (the first of equal ones),
    so equal windows pick the same place in them. Consecutive windows with one anchor make a row:
    (first window, last window, anchor, hash of the gram, hash of all bytes of the windows and of
    where they lie). ``ends``: the end of the text that each byte belongs to; windows stay within one.
    """
    n = len(buf)
    empty = np.empty(0, np.int64)
    if n < length:
        return empty, empty, empty, empty, empty
    values, powers, inverses = _tables()
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values[buf] * powers[:n], out=prefix[1:])
    grams = (prefix[gram:] - prefix[:-gram]) * inverses[: n - gram + 1]
    mixed = _mix(grams)
    keys = (mixed & ~POSITION) | np.arange(len(mixed), dtype=np.uint64)
    least = (_sliding_min(keys, length - gram + 1) & POSITION).astype(np.int64)
    inside = np.flatnonzero(np.arange(len(least)) + length <= ends[: len(least)])
    if not len(inside):
        return empty, empty, empty, empty, empty
    picked = least[inside]
    starts = np.flatnonzero(np.concatenate([[True], picked[1:] != picked[:-1]]))
    first, last = inside[starts], inside[np.concatenate([starts[1:], [len(inside)]]) - 1]
    at = picked[starts]
    whole = (prefix[last + length] - prefix[first]) * inverses[first]
    shape = ((at - first) * 4096 + (last - first)).astype(np.uint64)
    return first, last, at, mixed[at].view(np.int64), _mix(whole + shape * np.uint64(BASE)).view(np.int64)


def _laid_out(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of a batch (id, bytes) end to end, in chunks: (bytes, end of each byte's text, row of each byte's text, shift).

    A text's position is its place in the chunk less ``shift`` of its row. Long texts are cut so that the pieces
    overlap by one byte less than a window: every window is in exactly one piece.
    """
    part: list[tuple[int, int, np.ndarray]] = []
    filled = 0

    def chunk():
        sizes = np.array([len(p[2]) for p in part])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        rows = np.repeat(np.arange(len(part)), sizes)
        ids = np.array([p[0] for p in part])
        shift = starts - np.array([p[1] for p in part])
        return np.concatenate([p[2] for p in part]), np.repeat(starts + sizes, sizes), ids[rows], shift[rows]

    for row, text in enumerate(batch.column(1)):
        raw = np.frombuffer(text.as_py(), np.uint8)
        at = 0
        while len(raw) - at >= length:
            piece = raw[at : at + CHUNK]
            if filled + len(piece) > CHUNK and part:
                yield chunk()
                part, filled = [], 0
            part.append((row, at, piece))
            filled += len(piece)
            at += len(piece) - length + 1
    if part:
        yield chunk()


ANCHORS = "fp long, ctx long, id long, first int, span short, at short"


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        for buf, ends, rows, shift in _laid_out(batch, length):
            first, last, at, fp, ctx = anchors(buf, ends, length, gram)
            if len(first):
                ids = keys[rows[first]]
                arrays = [pa.array(fp), pa.array(ctx), pa.array(ids, pa.int64()), pa.array((first - shift[first]).astype(np.int32)), pa.array((last - first).astype(np.int16)), pa.array((at - first).astype(np.int16))]
                yield pa.RecordBatch.from_arrays(arrays, ["fp", "ctx", "id", "first", "span", "at"])


# ---------------------------------------------------------------- deep-shallow sorting


class _Blind:
    """A node of a blind trie: the depth at which its subtrees differ, and these by their byte there."""

    __slots__ = ("depth", "below")

    def __init__(self, depth: int):
        self.depth, self.below = depth, {}


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of two strings that agree in the first ``at`` bytes."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    step = 32
    while a[at : at + step] == b[at : at + step]:
        at += step
    while a[at] == b[at]:
        at += 1
    return at


def _byte(s: bytes, depth: int) -> int:
    return s[depth] if depth < len(s) else -1


def blind_sort(strings: list[bytes], members: list[int], depth: int) -> list[int]:
    """Orders strings with a long common prefix by a blind trie.

    A string walks down by the bytes at branching depths alone, is compared once with a leaf below to
    find where it really differs, and is inserted there. Reading the trie in byte order gives the order.
    """
    root: _Blind | list[int] = [members[0]]
    for m in members[1:]:
        s = strings[m]
        node, path = root, []
        while isinstance(node, _Blind):
            path.append(node)
            b = _byte(s, node.depth)
            node = node.below[b] if b in node.below else next(iter(node.below.values()))
        other = strings[node[0]]
        d = _common(s, other, depth)
        if d == len(s) == len(other):
            node.append(m)
            continue
        parent = None
        for p in path:
            if p.depth >= d:
                break
            parent = p
        if parent is None:
            child = root
        else:
            child = parent.below.get(_byte(s, parent.depth))
        if isinstance(child, _Blind) and child.depth == d:
            child.below[_byte(s, d)] = [m]
            continue
        fork = _Blind(d)
        fork.below[_byte(other, d)] = child
        fork.below[_byte(s, d)] = [m]
        if parent is None:
            root = fork
        else:
            parent.below[_byte(s, parent.depth)] = fork
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            out += node
        else:
            stack += [node.below[b] for b in sorted(node.below, reverse=True)]
    return out


def deep_shallow_sort(strings: list[bytes], members: list[int], shallow: int = SHALLOW) -> list[int]:
    """Lexicographic order of ``members`` (positions in ``strings``); equal strings keep their order.

    Three-way multikey quicksort by one byte at a time down to ``shallow`` bytes; groups that still
    agree there go to a blind trie.
    """
    out: list[int] = []
    stack = [(members, 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) < 2:
            out += group
            continue
        if depth >= shallow:
            out += blind_sort(strings, group, depth)
            continue
        head = [strings[m][depth : depth + 1] for m in group]
        pivot = head[len(head) // 2]
        low, same, high = [], [], []
        for m, b in zip(group, head, strict=True):
            (same if b == pivot else low if b < pivot else high).append(m)
        if high:
            stack.append((high, depth))
        if not pivot:  # these end here and are equal; nothing sorts before them
            out += same
        elif low or high:
            stack.append((same, depth + 1))
            if low:
                stack.append((low, depth))
        else:  # all agree: go down to where the first of them part
            first = strings[same[0]]
            stack.append((same, min(shallow, *(_common(first, strings[m], depth) for m in same))))
    return out


def suffix_classes(strings: list[bytes], groups: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorts every group; returns the order over all and the common prefix of each string with the one before (-1 at a group's start)."""
    order: list[int] = []
    shared: list[int] = []
    for group in groups:
        own = deep_shallow_sort(strings, group)
        order += own
        shared.append(-1)
        shared += [_common(strings[a], strings[b], 0) for a, b in zip(own, own[1:], strict=False)]
    return np.array(order, np.int64), np.array(shared, np.int64)


# ---------------------------------------------------------------- edges


CUT = "fp long, id long, first int, span short, at short, other long, shift int, salt int, bytes binary"


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(id, bytes, wanted) to the bytes of what is wanted of a text.

    Edges (``other`` null) give the bytes of an anchor's windows. Claims, that windows are those of another text
    (``other``) a ``shift`` away, give the bytes of their union: claims on the same text and shift that meet are put together first.
    """
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    names = [x.split()[0] for x in CUT.split(", ")]
    for batch in batches:
        out: list[tuple] = []
        held = 0
        for key, raw, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            text = raw.as_py()
            claims: dict[tuple[int, int, int], list[list[int]]] = {}
            for w in sorted(wanted or (), key=lambda w: w["first"]):
                end = w["first"] + w["span"] + length
                if w["other"] is None:
                    out.append((w["fp"], key, w["first"], w["span"], w["at"], None, None, None, text[w["first"] : end]))
                    held += end - w["first"]
                    continue
                runs = claims.setdefault((w["other"], w["shift"], w["salt"]), [])
                if runs and w["first"] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], end)
                else:
                    runs.append([w["first"], end])
            for (other, shift, salt), runs in claims.items():
                for start, end in runs:
                    out.append((None, key, start, None, None, other, shift, salt, text[start:end]))
                    held += end - start
            if held > 16 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def agreeing(a: bytes, b: bytes, length: int) -> list[tuple[int, int]]:
    """Stretches of ``length`` bytes or more in which two strings agree, byte by byte, at the same places."""
    if a == b:
        return [(0, len(a))] if len(a) >= length else []
    n = min(len(a), len(b))
    same = np.frombuffer(a, np.uint8, n) == np.frombuffer(b, np.uint8, n)
    turns = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
    return [(int(x), int(y)) for x, y in zip(turns[::2], turns[1::2], strict=True) if y - x >= length]


def _confirm(table: pa.Table, length: int) -> pa.Table:
    """Claims (other, salt, id, first, shift, bytes) and the other texts (without an id) to ranges, on both sides, in which the bytes are the same."""
    keys = list(zip(table.column("other").to_pylist(), table.column("salt").to_pylist(), strict=True))
    ids, firsts, shifts = (table.column(c).to_pylist() for c in ("id", "first", "shift"))
    bytes_ = table.column("bytes")
    texts = {keys[i]: bytes_[i].as_py() for i, key in enumerate(ids) if key is None}
    out: set[tuple[int, int, int]] = set()
    for i, key in enumerate(ids):
        if key is not None:
            claimed, at = bytes_[i].as_py(), firsts[i] + shifts[i]
            for a, b in agreeing(claimed, texts[keys[i]][at : at + len(claimed)], length):
                out.add((key, firsts[i] + a, firsts[i] + b))
                out.add((keys[i][0], at + a, at + b))
    cols = list(zip(*out, strict=True)) if out else [[], [], []]
    return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32()), strict=True)], ["id", "start", "end"])


def repeated_windows(fp: np.ndarray, span: np.ndarray, at: np.ndarray, texts: list[bytes], length: int, gram: int, low: np.ndarray | None = None, high: np.ndarray | None = None) -> list[np.ndarray]:
    """For each anchor, the windows (0 to span) whose bytes occur at another anchor of the same group ``fp``.

    What follows the gram and, reversed, what precedes it are sorted deep-shallow within each group. At
    a distance d of a window's start before the anchor, two windows are equal where they are in one
    class of both orders: d bytes agree before the anchor, length - d after it. ``low`` and ``high`` limit the distances looked at.
    """
    by = np.argsort(fp, kind="stable")
    groups = [g.tolist() for g in np.split(by, np.flatnonzero(np.diff(fp[by])) + 1)]
    after = [t[a + gram :] for t, a in zip(texts, at.tolist(), strict=True)]
    before = [t[:a][::-1] for t, a in zip(texts, at.tolist(), strict=True)]
    order_r, shared_r = suffix_classes(after, groups)
    order_l, shared_l = suffix_classes(before, groups)
    n = len(texts)
    found = np.zeros((n, length - gram + 1), bool)
    left, right = np.empty(n, np.int64), np.empty(n, np.int64)
    low = at - span if low is None else np.maximum(low, at - span)
    high = at if high is None else np.minimum(high, at)
    for d in range(length - gram + 1):
        rows = np.flatnonzero((low <= d) & (d <= high))
        if len(rows) < 2:
            continue
        left[order_l] = np.cumsum(shared_l < d)
        right[order_r] = np.cumsum(shared_r < length - d - gram)
        code = left[rows] * (n + 1) + right[rows]
        o = np.argsort(code, kind="stable")
        c = code[o]
        same = np.zeros(len(c), bool)
        eq = c[1:] == c[:-1]
        same[1:] |= eq
        same[:-1] |= eq
        found[rows[o[same]], d] = True
    return [np.flatnonzero(found[i, ::-1][length - gram - at[i] : length - gram - at[i] + span[i] + 1]) for i in range(n)]


def _edge_ranges(table: pa.Table, length: int, gram: int) -> pa.Table:
    """Ranges of the repeated windows of (group, id, first, span, at, bytes, low, high)."""
    group, first, span, at, low, high = (table.column(c).to_numpy().astype(np.int64) for c in ("fp", "first", "span", "at", "low", "high"))
    ids = table.column("id").to_pylist()
    texts = [b.as_py() for b in table.column("bytes")]
    windows = repeated_windows(group, span, at, texts, length, gram, low, high)
    out_id, start, end = [], [], []
    for key, f, w in zip(ids, first.tolist(), windows, strict=True):
        if len(w):
            cut = np.flatnonzero(np.diff(w) > 1) + 1
            for run in np.split(w, cut):
                out_id.append(key)
                start.append(f + int(run[0]))
                end.append(f + int(run[-1]) + length)
    return pa.table({"id": pa.array(out_id, pa.int64()), "start": pa.array(start, pa.int32()), "end": pa.array(end, pa.int32())})


EDGES = "fp long, id long, first int, span short, at short, bytes binary, low int, high int"


def _split(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows of too large groups, dealt anew by the bytes next to their gram.

    The distances of a group are halved. Windows that begin near the anchor hold many bytes behind the gram, so equal ones agree in
    these; windows that begin far from it agree in many bytes before it. Each half makes groups by such bytes.
    """
    for batch in batches:
        rows = {k: batch.column(k).to_pylist() for k in ("fp", "id", "first", "span", "at", "low", "high")}
        out: list[tuple] = []
        for group, key, first, span, at, low, high, raw in zip(*rows.values(), batch.column("bytes"), strict=True):
            text, mid = raw.as_py(), (low + high) // 2
            near, far = max(low, at - span), min(high, at)
            if near <= mid:
                behind = text[at + gram : at + length - mid]
                out.append((xxhash.xxh3_64_intdigest(struct.pack("<qB", group, 0) + behind, mid) - 2**63, key, first, span, at, text, low, mid))
            if far > mid:
                before = text[at - mid - 1 : at]
                out.append((xxhash.xxh3_64_intdigest(struct.pack("<qB", group, 1) + before, mid) - 2**63, key, first, span, at, text, mid + 1, high))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.binary(), pa.int32(), pa.int32())
        names = [x.split()[0] for x in EDGES.split(", ")]
        for i in range(0, len(out), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out[i : i + 20_000], strict=True), kinds, strict=True)], names)


def _split_ranges(edges: DataFrame, length: int, gram: int, most: int, deals: Callable[[int], F.Column]) -> DataFrame:
    """Ranges of groups of more than ``most`` contexts: the groups are split by their next bytes until they can be sorted.

    A group whose windows are down to one distance holds equal windows, or nearly so: these are counted by their own bytes.
    """
    out = None
    single = F.col("low") == F.col("high")
    while True:
        edges = materialize(edges.mapInArrow(lambda it: _split(it, length, gram), EDGES), "split")
        sizes = materialize(edges.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.first(single).alias("single")), "sizes")
        large = sizes.where(F.col("n") > most)
        ready = edges.join(sizes.where(f"n > 1 and n <= {most}").select("fp"), "fp", "left_semi")
        ranges = ready.withColumn("deal", deals(ready.count())).groupBy("deal").applyInArrow(lambda t: _edge_ranges(t, length, gram), "id long, start int, end int")
        last = edges.join(large.where("single").select("fp"), "fp", "left_semi")
        window = F.col("at") - F.col("low")
        equal = last.select("id", (F.col("first") + window).alias("start"), F.substring("bytes", (window + 1).cast("int"), F.lit(length)).alias("w"))
        twice = equal.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w")
        whole = equal.join(twice, "w").select("id", F.col("start").cast("int").alias("start"), (F.col("start") + length).cast("int").alias("end"))
        found = materialize(ranges.unionByName(whole), "ranges")
        out = found if out is None else out.unionByName(found)
        rest = large.where("not single")
        if not rest.limit(1).count():
            return out
        edges = edges.join(rest.select("fp"), "fp", "left_semi")


# ---------------------------------------------------------------- the operator


def _cut(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """(id, bytes, ranges) to what stays: id, n_bytes, n_removed, n_spans, kept_sha256 [, kept, spans]."""
    for batch in batches:
        n, removed, spans, digests, kept_all, runs_all = [], [], [], [], [], []
        for raw, ranges in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            text = raw.as_py()
            runs: list[list[int]] = []
            for r in sorted((r["start"], r["end"]) for r in ranges or ()):
                if runs and r[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], r[1])
                else:
                    runs.append(list(r))
            kept, at = [], 0
            for a, b in runs:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            whole = b"".join(kept)
            n.append(len(text))
            removed.append(len(text) - len(whole))
            spans.append(len(runs))
            digests.append(hashlib.sha256(whole).hexdigest())
            kept_all.append(whole)
            runs_all.append(runs)
        arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            arrays += [pa.array(kept_all, pa.binary()), pa.array(runs_all, pa.list_(pa.list_(pa.int64())))]
            names += ["kept", "spans"]
        yield pa.RecordBatch.from_arrays(arrays, names)


def _repeats(raw: DataFrame, length: int, gram: int, hot: int) -> DataFrame:
    """(id, ranges) of the documents (id, raw) that lose bytes, written: steps 1 to 3 of ``remove_repeats``."""
    rows = materialize(raw.where(F.octet_length("raw") >= length).mapInArrow(lambda it: _anchor_rows(it, length, gram), ANCHORS), "anchors")

    # sums are written before they are joined back, so that a join reads plain shuffles and hot grams can be split
    seen = materialize(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp"), "seen")
    again = materialize(rows.join(seen.hint("merge"), "fp", "left_semi"), "again")
    discard(rows, seen)

    contexts = materialize(again.groupBy("fp", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "first")).alias("one")), "contexts")
    grams = materialize(contexts.groupBy("fp").agg(F.count(F.lit(1)).alias("kinds")), "grams")
    counted = materialize(contexts.join(grams.hint("merge"), "fp").select("fp", "ctx", "n", "kinds", "one"), "counted")
    own = F.struct("id", "first") == F.col("one")
    settled = again.join(counted.hint("merge"), ["fp", "ctx"]).where((F.col("n") > 1) | (F.col("kinds") > 1))
    role = F.when((F.col("n") > 1) & ~own, F.struct(F.col("one.id").alias("other"), (F.col("one.first") - F.col("first")).cast("int").alias("shift")))
    settled = materialize(settled.select("fp", "id", "first", "span", "at", "kinds", own.alias("edge"), role.alias("claim")), "settled")
    discard(again, contexts, grams, counted)

    edge = F.col("edge") & (F.col("kinds") > 1)
    claimed = F.col("claim").isNotNull()
    n, many, n_claims = settled.select(F.count_if(edge), F.count_if(edge & (F.col("kinds") > hot)), F.count_if(claimed)).first()
    # a text that very many claim to be copies of is compared with them in several places
    asked = settled.where(claimed).groupBy(F.col("claim.other").alias("other")).agg(F.ceil(F.count(F.lit(1)) / CLAIMS).cast("int").alias("blocks"))
    asked = materialize(asked, "asked")
    salted = settled.where(claimed).join(asked.hint("merge"), F.col("claim.other") == F.col("other"))
    salted = salted.select("id", F.struct("fp", "first", "span", "at", "other", F.col("claim.shift").alias("shift"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("salt")).alias("w"))

    def cut(rows: DataFrame) -> DataFrame:
        """Bytes of the wanted rows (id, w). All joins of texts by id read one shuffle of them; no broadcast, so that it is so at every size."""
        wanted = rows.groupBy("id").agg(F.collect_list("w").alias("wanted"))
        return raw.join(wanted.hint("merge"), "id").select("id", "raw", "wanted").mapInArrow(lambda it: _contexts(it, length), CUT)

    def edges_where(which: F.Column) -> DataFrame:
        w = F.struct("fp", "first", "span", "at", F.lit(None).cast("long").alias("other"), F.lit(None).cast("int").alias("shift"), F.lit(None).cast("int").alias("salt"))
        found = cut(settled.where(edge & which).select("id", w.alias("w")))
        return found.select("fp", "id", "first", "span", "at", "bytes", F.lit(0).alias("low"), F.lit(length - gram).alias("high"))

    def deals(rows: int) -> F.Column:
        return F.pmod(F.xxhash64("fp"), F.lit(max(1, rows // 20_000 + 1) * 4))

    edges = edges_where(F.col("kinds") <= hot).withColumn("deal", deals(n)).groupBy("deal").applyInArrow(lambda t: _edge_ranges(t, length, gram), "id long, start int, end int")
    claims = cut(salted).select("other", "salt", "id", "first", "shift", "bytes")
    asked_texts = raw.join(asked.hint("merge"), raw["id"] == asked["other"]).select("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("shift"), F.col("raw").alias("bytes"))
    met = claims.unionByName(asked_texts).groupBy(F.pmod(F.xxhash64("other", "salt"), F.lit((n_claims // CLAIMS + 1) * 4)).alias("deal"))
    ranges = edges.unionByName(met.applyInArrow(lambda t: _confirm(t, length), "id long, start int, end int"))
    if many:
        ranges = ranges.unionByName(_split_ranges(edges_where(F.col("kinds") > hot), length, gram, hot, deals))
    return materialize(ranges.distinct().groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("ranges")), "repeats")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int | None = None, hot: int = 20_000, with_text: bool = True) -> DataFrame:
    """Removes every byte that lies in a string of ``length`` bytes which also starts anywhere else.

    1. Every window of ``length`` bytes picks an anchor by its content (the least gram hash in it); windows
       with one anchor travel as one narrow row (about one per 50 bytes), never as text.
    2. Grams are counted (map-side first); rows whose gram is seen once, most of them, go. Of the others,
       rows with equal context are counted by hashes. A row whose context is seen before claims to be a copy of the first such row.
       Claims of a text on the same other text that meet are put together, and their bytes meet that text (copies of it, where very
       many claim) and are compared; only ranges that agree byte by byte are removed, on both sides.
    3. What is left are edges of repeats: grams with several contexts. One text of each context goes to
       the task of its gram. There the suffixes after the gram and before it (reversed) are sorted:
       multikey quicksort to a shallow depth, blind tries for groups that agree further. Classes of
       both orders tell which windows repeat. A gram with more than ``hot`` contexts is split by the bytes next to it, and again,
       until its groups can be sorted.
    4. Each document's ranges are merged and cut out. Only documents and ranges of one id meet.

    What is removed has been compared byte by byte; that texts are looked at at all rests on hashes of 64 bits (grams) and
    128 bits (contexts). Matches never cross documents; overlaps within one count. Null texts count as empty; texts shorter
    than ``length`` keep every byte. Where ids repeat or are null, the rows are first written to the
    shared folder with numbers of their own, and each counts as a document. Other columns are ignored. An
    empty table gives an empty result.

    Returns (id_col, n_bytes, n_removed, n_spans, kept_sha256[, kept binary, spans array<array<long>>]).
    """
    gram = gram or max(1, 2 * length // 5)
    if not 1 <= gram <= length or length - gram > 2047:
        raise ValueError("gram must be at most length, and length - gram at most 2047")
    odd = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(id_col).isNull())
    if odd.limit(1).count():
        numbered = materialize(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.monotonically_increasing_id().alias("_row")), "numbered")
        out = remove_repeats(numbered, "_row", "_text", length, gram, hot, with_text)
        names = [c for c in out.columns if c != "_row"]
        return out.join(numbered.select("_row", "_id"), "_row").select(F.col("_id").alias(id_col), *names)
    raw = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw")).where("id is not null")
    with written_tables() as made:
        per_doc = _repeats(raw, length, gram, hot)
    discard(*(t for t in made if t is not per_doc))
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<array<long>>" * with_text
    out = raw.join(per_doc.hint("merge"), "id", "left").select("id", "raw", "ranges").mapInArrow(lambda it: _cut(it, with_text), schema)
    return out.withColumnRenamed("id", id_col)

"""Phrase collocations: count tries of shards, merged by ranges of paths; left parts by trie walks, right parts by suffix links."""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import portions_of, separators, text_bytes, words_of
from .shared import materialize

#: Words of a path. A path is what follows from one word on within its piece, up to this depth.
DEPTH = 4
BLANK = separators(b" \t")
MARKS = separators(b".,;:!?\n\v\f\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes of the texts of one shard; a longer text is a shard of its own.
SHARD = 10 << 20
#: Documents (about) that give paths to cut the ranges by, and paths of each.
SAMPLED, PATHS = 4000, 16
#: Bytes of text for one range of paths.
RANGE = 16 << 20
MOST_RANGES = 1 << 16

Cut = tuple[bytes, ...]  # language, then the words of a path; shorter paths come first


class Trie:
    """Paths with their counts, sorted by language and words.

    ``group`` has the language of each path, ``words`` its words as ``DEPTH`` columns of numbers from 1 on (0: the path has ended),
    ``vocabulary`` the words in byte order, so that numbers sort as words do. A path's prefixes are the trie's nodes; a node's
    count is the sum over the paths through it.
    """

    def __init__(self, langs: list[bytes], vocabulary: pa.BinaryArray, group: np.ndarray, words: list[np.ndarray], times: np.ndarray):
        self.langs, self.vocabulary, self.group, self.words, self.times = langs, vocabulary, group, words, times

    @classmethod
    def counted(cls, langs: list[bytes], vocabulary: pa.BinaryArray, group: np.ndarray, words: list[np.ndarray], times: np.ndarray | None = None) -> Trie:
        """Equal paths once, with the sum of their counts, in order. Sorted runs among the paths are merged as they are."""
        if not len(group):
            return cls(langs, vocabulary, group, words, np.zeros(0, np.int64))
        base = len(vocabulary) + 1
        key, top = group.astype(np.int64), int(group.max()) + 1
        for column in words:
            if top * base >= 2**62:  # the prefixes so far are numbered, in order
                found, key = np.unique(key, return_inverse=True)
                top = len(found)
            key, top = key * base + column, top * base
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        total = np.diff(np.append(first, len(key))) if times is None else np.add.reduceat(times[order], first)
        one = order[first]
        return cls(langs, vocabulary, group[one], [c[one] for c in words], total)

    def place(self, cut: Cut) -> int:
        """How many paths come before ``cut``."""
        at = bisect_left(self.langs, cut[0])
        low = int(np.searchsorted(self.group, at))
        if at == len(self.langs) or self.langs[at] != cut[0]:
            return low
        high = int(np.searchsorted(self.group, at, "right"))
        for word, column in zip(cut[1:], self.words, strict=False):
            number = self._rank(word)
            part = column[low:high]
            known = number < len(self.vocabulary) and self.vocabulary[number].as_py() == word
            low, high = low + int(np.searchsorted(part, number + 1)), low + int(np.searchsorted(part, number + 1, "right"))
            if not known:
                return low
        return low

    def _rank(self, word: bytes) -> int:
        low, high = 0, len(self.vocabulary)
        while low < high:
            middle = (low + high) // 2
            if self.vocabulary[middle].as_py() < word:
                low = middle + 1
            else:
                high = middle
        return low

    def packed(self, start: int, stop: int) -> bytes:
        """A stretch of the paths, serialised: numbers of its own words, each path only from where it differs from the one before."""
        columns = [w[start:stop] for w in self.words]
        used = np.unique(np.concatenate(columns))
        used = used[used > 0]
        group = self.group[start:stop]
        here = np.unique(group)
        columns = [np.where(c > 0, np.searchsorted(used, c) + 1, 0).astype(np.int32) for c in columns]
        same = np.zeros(stop - start, np.int8)  # how many words are those of the path before
        alike = np.concatenate([[False], group[1:] == group[:-1]])
        for c in columns:
            alike[1:] &= c[1:] == c[:-1]
            same += alike
        names, spelled = [self.langs[g] for g in here.tolist()], self.vocabulary.take(pa.array(used - 1))
        lengths = pc.binary_length(spelled).to_numpy(zero_copy_only=False).astype(np.int32)
        parts = [
            b"".join(struct.pack("<i", len(n)) + n for n in names), np.searchsorted(here, group).astype(np.int32).tobytes(), same.tobytes(),
            *(c[same <= k].tobytes() for k, c in enumerate(columns)), self.times[start:stop].astype(np.int64).tobytes(), lengths.tobytes(), b"".join(spelled.to_pylist()),
        ]
        raw = struct.pack(f"<{2 + len(parts)}q", len(names), stop - start, *map(len, parts)) + b"".join(parts)
        return struct.pack("<q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)

    @classmethod
    def unpacked(cls, data: bytes) -> Trie:
        raw = pa.decompress(data[8:], struct.unpack_from("<q", data)[0], codec="zstd", asbytes=True)
        head = struct.unpack_from(f"<{2 + DEPTH + 6}q", raw)
        at = 8 * len(head)
        parts = []
        for size in head[2:]:
            parts.append(raw[at : at + size])
            at += size
        langs, p = [], 0
        for _ in range(head[0]):
            (size,) = struct.unpack_from("<i", parts[0], p)
            langs.append(parts[0][p + 4 : p + 4 + size])
            p += 4 + size
        n = head[1]
        same = np.frombuffer(parts[2], np.int8)
        words = []
        for k in range(DEPTH):
            own = np.frombuffer(parts[3 + k], np.int32)
            words.append(own[np.cumsum(same <= k) - 1] if n else own)
        lengths = np.frombuffer(parts[-2], np.int32)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        vocabulary = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(parts[-1])])
        return cls(langs, vocabulary, np.frombuffer(parts[1], np.int32), words, np.frombuffer(parts[3 + DEPTH], np.int64))

    @classmethod
    def merged(cls, tries: list[Trie]) -> Trie:
        """The tries of several shards as one: their words are numbered anew, in order, and their sorted paths merged."""
        langs = sorted({x for t in tries for x in t.langs})
        every = pa.chunked_array([t.vocabulary for t in tries], pa.binary()).unique()
        vocabulary = every.take(pc.sort_indices(every))
        vocabulary = vocabulary.combine_chunks() if isinstance(vocabulary, pa.ChunkedArray) else vocabulary
        groups, columns = [], [[] for _ in range(DEPTH)]
        for t in tries:
            number = np.append(0, pc.index_in(t.vocabulary, value_set=vocabulary).to_numpy(zero_copy_only=False) + 1).astype(np.int32)
            groups.append(np.array([bisect_left(langs, x) for x in t.langs], np.int32)[t.group])
            for listed, c in zip(columns, t.words, strict=True):
                listed.append(number[c])
        return cls.counted(langs, vocabulary, np.concatenate(groups), [np.concatenate(c) for c in columns], np.concatenate([t.times for t in tries]))

    def nodes(self, least: int) -> pa.RecordBatch:
        """The trie walked level by level: each node's phrase, its count, the counts of its left parts, and how many of its first
        words are ``open``, that is on the first or the last path, so that a neighbouring range may hold more of them.

        Nodes under ``least`` are left out unless they are open. The languages (no words) come as open nodes.
        """
        numbers, counts, opens = [], [], []
        new = np.concatenate([[True], self.group[1:] != self.group[:-1]])
        edge = (self.group == self.group[0], self.group == self.group[-1])
        out: list[list] = [[] for _ in range(6)]
        spelled = self.vocabulary
        for k in range(DEPTH + 1):
            if k:
                c = self.words[k - 1]
                new = new | np.concatenate([[True], c[1:] != c[:-1]])
                edge = (edge[0] & (c == c[0]), edge[1] & (c == c[-1]))
            first = np.flatnonzero(new)
            total = np.add.reduceat(self.times, first)
            numbers.append(np.cumsum(new) - 1)
            counts.append(total)
            opens.append(edge[0] | edge[1])
            real = self.words[k - 1][first] > 0 if k else np.ones(len(first), bool)
            depth_open = np.sum([o[first] for o in opens[1:]], axis=0) if k else np.zeros(len(first), np.int64)
            chosen = np.flatnonzero(real & ((total >= least) | opens[k][first]))
            at = first[chosen]
            left = [counts[j][numbers[j][at]] for j in range(1, k)]
            words = [spelled.take(pa.array(self.words[j][at] - 1)) for j in range(k)]
            phrase = pc.binary_join_element_wise(*words, b" ") if k else pa.array([b""] * len(at), pa.binary())
            out[0] += [self.langs[g].decode() for g in self.group[at].tolist()]
            out[1] += [k] * len(at)
            out[2] += phrase.to_pylist()
            out[3] += total[chosen].tolist()
            out[4] += np.stack(left, 1).tolist() if left else [[]] * len(at)
            out[5] += depth_open[chosen].tolist() if k else [0] * len(at)
        kinds = [pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int32()]
        columns = [pa.array(c, t) for c, t in zip(out, kinds, strict=True)]
        columns[2] = columns[2].cast(pa.string())
        return pa.RecordBatch.from_arrays(columns, ["lang", "k", "phrase", "f", "left", "open"])


NODES = "lang string, k int, phrase string, f long, left array<long>, open int"


def shard_trie(langs: pa.Array, texts: pa.Array) -> Trie:
    """The count trie of a shard's texts."""
    buf, cuts = text_bytes(texts)
    buf = LOWER[buf]
    mark = MARKS[buf]
    words, starts = words_of(buf, cuts, BLANK | MARKS)
    names = langs.dictionary_encode()
    known = names.dictionary.cast(pa.binary()).to_pylist()
    order = sorted(range(len(known)), key=known.__getitem__)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    text = np.searchsorted(cuts, starts, "right") - 1
    group = place[names.indices.to_numpy()][text] if len(starts) else np.zeros(0, np.int32)
    piece = np.cumsum(mark, dtype=np.int64)[starts] + text
    encoded = words.dictionary_encode()
    rank = pc.sort_indices(encoded.dictionary).to_numpy()
    number = np.empty(len(rank), np.int32)
    number[rank] = np.arange(1, len(rank) + 1)
    code = number[encoded.indices.to_numpy()] if len(starts) else np.zeros(0, np.int32)
    columns = [code]
    for k in range(1, DEPTH):
        column = np.zeros(len(code), np.int32)
        column[:-k] = np.where(piece[k:] == piece[:-k], code[k:], 0)
        columns.append(column)
    return Trie.counted([known[i] for i in order], encoded.dictionary.take(pa.array(rank)), group, columns)


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Trie]:
    """Tries of about ``size`` bytes of text each."""
    held: list[pa.RecordBatch] = []
    so_far = 0
    for batch in batches:
        for part in portions_of(batch, 1, size):
            held.append(part)
            so_far += part.column(1).nbytes
            if so_far >= size:
                yield _trie_of(held)
                held, so_far = [], 0
    if held:
        yield _trie_of(held)


def _trie_of(held: list[pa.RecordBatch]) -> Trie:
    table = pa.Table.from_batches(held)
    return shard_trie(*(table.column(c).cast(pa.large_string()).combine_chunks() for c in (0, 1)))


def _count(batches: Iterator[pa.RecordBatch], cuts: list[Cut], size: int) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (range, trie): each shard's trie in stretches by range."""
    for trie in _shards(batches, size):
        edges = [0, *(trie.place(c) for c in cuts), len(trie.times)]
        for r, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if a < b:
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([trie.packed(a, b)], pa.binary())], ["range", "trie"])


def _merge(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The stretches of one range to the nodes of their merged trie; some are merged on the way, so that few are held unpacked."""
    held: list[Trie] = []
    for batch in batches:
        for data in batch.column("trie"):
            held.append(Trie.unpacked(data.as_py()))
            if len(held) == 64:
                held = [Trie.merged(held)]
    if held:
        yield Trie.merged(held).nodes(least)


def _some_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to a few paths of each text, evenly spaced."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            trie = _trie_of([row])
            n = len(trie.times)
            listed = []
            for p in np.unique(np.linspace(0, max(n - 1, 0), PATHS).astype(int)).tolist() if n else []:
                listed.append([trie.langs[trie.group[p]], *(trie.vocabulary[int(w[p]) - 1].as_py() for w in trie.words if w[p])])
            yield pa.RecordBatch.from_arrays([pa.array(listed, pa.list_(pa.binary()))], ["path"])


def _cuts(rows: DataFrame, rows_in_all: int, size: float) -> list[Cut]:
    """Paths that part all paths into ranges of about ``RANGE`` bytes of text, from a bounded sample; any cuts give right results."""
    ranges = min(MOST_RANGES, max(1, round(size / RANGE)))
    if ranges == 1:
        return []
    some = rows.where(F.rand(1) * rows_in_all < SAMPLED)
    paths = sorted({tuple(map(bytes, r["path"])) for r in some.mapInArrow(_some_paths, "path array<binary>").collect()})
    return sorted({paths[len(paths) * r // ranges] for r in range(1, ranges)}) if paths else []


def frequent_phrases(docs: DataFrame, least: int = 30, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, k, phrase, f, left, right, n): the phrases of 1 to 4 words that occur ``least`` times or more in a language.

    ``left`` has the counts of the phrase's first 1, 2, ... words, ``right`` of what follows them, and n that of all word
    occurrences of the language. A row with no words and n alone comes for no language. Phrases are counted in tries of depth 4, one for each shard of a task; a shard's
    trie is cut at paths that are the same for all shards, and the stretches of a range are merged. A path has all its words for
    key, so frequent words and phrases are cut as well as others. Only tries travel, in which equal paths of a shard are one. Nodes that lie on the border of a range are
    added up (eight a range, so they are broadcast). ``right`` follows suffix links, from shorter phrases to longer ones, by joins.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and these into words at spaces and tabs.
    Null texts count as empty, null languages as ``und``; ids are not read, and repeated rows count as often as they come.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    many = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")).first()
    cuts = _cuts(rows, many["n"], many["size"] or 0)
    size = SHARD
    shards = rows.mapInArrow(lambda it: _count(it, cuts, size), "range int, trie binary")
    found = shards.repartitionById(len(cuts) + 1, F.col("range")).mapInArrow(lambda it: _merge(it, least), NODES)
    found = materialize(found, "trie-nodes")
    border = found.where(F.col("k") <= F.col("open")).groupBy("lang", "phrase").agg(F.max("k").alias("k"), F.sum("f").alias("f"))
    border = materialize(border, "border-nodes")
    inner = found.where((F.col("k") > F.col("open")) & (F.col("f") >= least)).select("lang", "k", "phrase", "f", "left", "open")
    outer = border.where((F.col("k") > 0) & (F.col("f") >= least)).select("lang", "k", "phrase", "f", F.array_repeat(F.lit(0).cast("long"), F.col("k") - 1).alias("left"), F.col("k").alias("open"))
    nodes = inner.unionByName(outer)
    for j in range(1, DEPTH):  # left parts that lie on a border
        part = border.where(F.col("k") == j).select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("f").alias(f"_f{j}"))
        here = (F.col("lang") == F.col("_lang")) & (F.col("_part") == _first_words(j)) & (F.col("open") >= j) & (F.col("k") > j)
        nodes = nodes.join(F.broadcast(part), here, "left").drop("_lang", "_part")
    total = F.array(*(F.coalesce(F.col(f"_f{j}"), F.get("left", F.lit(j - 1))) for j in range(1, DEPTH)))
    nodes = nodes.withColumn("left", F.slice(total, F.lit(1), F.col("k") - 1)).select("lang", "k", "phrase", "f", "left")
    nodes = materialize(nodes, "frequent-nodes")
    n = border.where("k = 0").select("lang", F.col("f").alias("n"))
    linked = nodes.where("k = 1").withColumn("right", F.array().cast("array<long>"))
    levels = [linked]
    for k in range(2, DEPTH + 1):
        link = F.expr("substr(phrase, instr(phrase, ' ') + 1)")
        below = levels[-1].select(F.col("lang").alias("_lang"), F.col("phrase").alias("_link"), F.concat(F.array("f"), "right").alias("right"))
        here = nodes.where(F.col("k") == k).withColumn("_to", link)
        levels.append(here.join(below, (F.col("lang") == F.col("_lang")) & (F.col("_to") == F.col("_link"))).select("lang", "k", "phrase", "f", "left", "right"))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every.join(F.broadcast(n), "lang")


def _first_words(j: int) -> Column:
    return F.substring_index("phrase", " ", j)


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, inside_percent: int = 80, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of 2 to 4 words of each language by score.

    A candidate occurs a >= ``least`` times. Cut after its first k words it has l = f(first part), r = f(rest) and the score
    floor(2000000 a / (l + r)); the lowest-scoring cut counts, ties go to the smallest k. Candidates that lie in a longer one with
    100 f(longer) >= ``inside_percent`` a are dropped: it is enough to look at those longer by one word, as a phrase is as
    frequent as any that holds it. Order: score, then a, both descending, then the phrase in the order of its UTF-8 bytes.
    The number of first rows is taken in each task before it is taken of all.

    An empty table, or texts without frequent phrases, give no rows; see ``frequent_phrases`` for nulls.
    """
    phrases = materialize(frequent_phrases(docs, least, lang_col, text_col).where("k > 1"), "phrases")
    scored = phrases.withColumn("cuts", F.expr("""
        transform(left, (l, i) -> struct(cast(f as decimal(20, 0)) * 2000000 div (l + right[i]) as score, i as k, l as l, right[i] as r))"""))
    scored = scored.withColumn("cut", F.array_min("cuts"))
    longer = phrases.where("k > 2")
    held = longer.select("lang", F.expr("substr(phrase, instr(phrase, ' ') + 1)").alias("phrase"), "f").unionByName(longer.select("lang", F.expr("substring_index(phrase, ' ', k - 1)").alias("phrase"), "f"))
    held = held.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    free = scored.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("f") * inside_percent))
    chosen = free.select("lang", "phrase", F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("long").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

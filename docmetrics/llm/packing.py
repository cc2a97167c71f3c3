"""Packing token sequences: best-two-fit over pieces of tokenised documents."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .wordcache import portions
from .wordids import WordIds

SEPARATOR = 0
#: Characters of the texts that a task holds as ids at a time.
PORTION = 2 << 20


@lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, size: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """(id, text) to one row per piece: id, piece, start, length, crc32, the piece's number in its task [, ids]."""
    words, end = _word_ids(path), np.array([SEPARATOR], np.uint32)
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["id", "piece", "start", "length", "ids_crc32", "turn"]
    turn = 0
    for batch in batches:
        at = 0
        for texts in portions((t.as_py() for t in batch.column(1)), PORTION):
            out: list[tuple] = []
            listed: list[np.ndarray] = []
            for key, ids in zip(batch.column(0).slice(at, len(texts)).to_pylist(), words.batch(texts), strict=True):
                ids = np.concatenate([ids, end])
                for piece, start in enumerate(range(0, len(ids), size)):
                    part = ids[start : start + size]
                    out.append((key, piece, start, len(part), zlib.crc32(part), turn))
                    turn += 1
                    if with_ids:
                        listed.append(part)
            at += len(texts)
            arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in listed])]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(listed).view(np.int32))))
            yield pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)


def best_two_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bins of at most ``size``: (bin of each item, offset in it, number of bins).

    Items are placed greedily, largest first, each into a new bin that is filled with the largest
    unpacked items that fit. A bin that is not full then tries to give up its smallest item for two
    unpacked ones that fit the widened gap more tightly; the best such two are taken and the smallest
    goes back to the unpacked. Repeats while the bin gets fuller. Items of equal length are taken by
    position, so the result depends on the order of ``lengths`` alone.
    """
    order = np.argsort(-lengths, kind="stable")
    waiting: dict[int, list[int]] = {}
    for i in order[::-1].tolist():
        waiting.setdefault(int(lengths[i]), []).append(i)
    keys = sorted(waiting)
    bins = np.full(len(lengths), -1, np.int64)
    offsets = np.zeros(len(lengths), np.int64)

    def take(length: int) -> int:
        items = waiting[length]
        item = items.pop()
        if not items:
            del waiting[length]
            del keys[bisect_left(keys, length)]
        return item

    def give(item: int) -> None:
        length = int(lengths[item])
        if length in waiting:
            waiting[length].append(item)
        else:
            waiting[length] = [item]
            insort(keys, length)

    def best_two(gap: int, more_than: int) -> tuple[int, int] | None:
        """Two waiting lengths with the largest sum in (more_than, gap]."""
        best, lo, hi = None, 0, bisect_right(keys, gap) - 1
        while lo <= hi:
            total = keys[lo] + keys[hi]
            if total > gap:
                hi -= 1
                continue
            if total > more_than and (lo != hi or len(waiting[keys[lo]]) > 1):
                best, more_than = (keys[lo], keys[hi]), total
                if total == gap:
                    break
            if lo == hi:
                break
            lo += 1
        return best

    n = 0
    while keys:
        bin_, gap = [], size
        while keys and gap:
            at = bisect_right(keys, gap) - 1
            if at < 0:
                break
            item = take(keys[at])
            bin_.append(item)
            gap -= int(lengths[item])
        while gap and len(bin_) > 1 and keys:
            smallest = min(bin_, key=lambda i: (lengths[i], -i))
            widened = gap + int(lengths[smallest])
            two = best_two(widened, int(lengths[smallest]))
            if not two:
                break
            bin_.remove(smallest)
            for length in two:
                item = take(length)
                bin_.append(item)
            give(smallest)
            gap = widened - sum(two)
        at = 0
        for item in bin_:
            bins[item], offsets[item] = n, at
            at += int(lengths[item])
        n += 1
    return bins, offsets, n


def _pack(table: pa.Table, size: int) -> pa.Table:
    table = table.sort_by([("id", "ascending"), ("piece", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
    lengths = table.column("length").to_numpy()
    bins, offsets, _ = best_two_fit(lengths, size)
    number = table.column("deal").to_numpy().astype(np.int64) * 2**32 + bins
    table = table.drop_columns(["deal"])
    return table.append_column("sequence_id", pa.array(number, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))


def _even_labels(spark: SparkSession, groups: int) -> list[int]:
    """Numbers for a few groups that a shuffle deals out evenly: hashing 0, 1, 2, ... may put many of few groups into one task."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = F.col("id").cast("int")
    by_part: dict[int, list[int]] = {}
    for n, part in spark.range(64 * parts).select(number, F.pmod(F.hash(number), F.lit(parts))).collect():
        by_part.setdefault(part, []).append(n)
    turns = [by_part.get(g * parts // groups if groups <= parts else g % parts, []) for g in range(groups)]
    return [t.pop(0) if t else -1 - g for g, t in enumerate(turns)]


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 2048,
    with_ids: bool = True,
    group: int = 8192,
) -> DataFrame:
    """Tokenised documents, each ended by id 0, packed into sequences of at most ``size`` tokens.

    Tokenising runs where the rows lie; only pieces travel (and their ids where ``with_ids``). Pieces
    are dealt by hash into groups of about ``group`` documents, and each group is packed on its own by
    ``best_two_fit``: a group wastes part of its last few sequences, so thousands of documents a group
    cost well under one sequence in a thousand, and no task grows with the input. The hash takes the number of the piece in its
    task too, so rows that repeat an id, or have none, are dealt as evenly as others; ``docs`` should be read from a table, so that a
    lost task's rows come in the same order again. Only documents longer
    than ``size`` are cut, into pieces of ``size``; the last may be shorter. Strings of added tokens in a
    text become their ids, as in a plain call of the tokenizer. ``tokenizer`` must be one that ``WordIds`` takes.

    A null text counts as empty (one piece holding id 0). Repeated rows are packed as often as they come;
    a null id is kept. An empty table gives an empty result. Other columns are ignored.

    Returns (id_col, piece, start, length, ids_crc32[, ids], sequence_id, offset).
    """
    groups = max(1, -(-docs.count() // group))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = rows.mapInArrow(lambda it: _pieces(it, tokenizer, size, with_ids), schema.replace("ids_crc32 long", "ids_crc32 long, turn long"))
    deal = F.pmod(F.xxhash64("id", "piece", "ids_crc32", "turn"), F.lit(groups)).cast("int")
    if groups < 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        deal = F.get(F.lit(_even_labels(docs.sparkSession, groups)), deal)
    dealt = pieces.withColumn("deal", deal).drop("turn")
    packed = dealt.groupBy("deal").applyInArrow(lambda t: _pack(t, size), schema + ", sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)

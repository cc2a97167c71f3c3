"""Runs: maximal periodic stretches of words, from Lyndon words under both orders of the alphabet."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import portions_of, separators, text_bytes, words_of

WHITE = separators(b" \t\n\v\f\r")
#: Bytes of the texts that a task cuts into words at a time; a longer text is taken whole.
PORTION = 4 << 20

MODULUS = 2**61 - 1
BASE = 0x1B873593CC9E2D51 % MODULUS
#: Equal words that are compared one by one before hashes are asked.
NEAR = 8


class Extensions:
    """Longest common extensions of a sequence of words.

    Prefix hashes answer "equal?" for any two stretches, and a binary search over them gives the length, which is then confirmed
    word by word. What is confirmed is kept as one interval for each distance, so that neighbours with the same distance
    are answered from it and no word is confirmed twice for it. Hashes that agree for unequal words (never seen) lead to a plain scan.
    """

    def __init__(self, words: list[int]):
        self.words = words
        self.known: dict[int, tuple[int, int]] = {}
        self.hashes: list[int] = []

    def _prepare(self) -> None:
        self.hashes = list(accumulate(self.words, lambda h, x: (h * BASE + x + 1) % MODULUS, initial=0))
        self.powers = list(accumulate(self.words, lambda p, _: p * BASE % MODULUS, initial=1))
        self.raw = np.array(self.words, np.int64)

    def _equal(self, i: int, j: int, length: int) -> bool:
        h, p = self.hashes, self.powers[length]
        return (h[i + length] - h[i] * p - h[j + length] + h[j] * p) % MODULUS == 0

    def _search(self, most: int, equal) -> int:
        """The largest length up to ``most`` for which ``equal`` holds, by doubling and halving."""
        low, step = NEAR, NEAR
        while low + step <= most and equal(low + step):
            low, step = low + step, 2 * step
        high = min(most, low + step)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if equal(middle) else (low, middle - 1)
        return low

    def right(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on (i < j)."""
        words, n, shift = self.words, len(self.words), j - i
        low, high = self.known.get(shift, (n, -1))
        if low <= i <= high:
            return high - i
        most, length = n - j, 0
        gap = low - i if low > i else NEAR + 1  # words before those that are known
        near = min(most, NEAR, gap)
        while length < near and words[i + length] == words[j + length]:
            length += 1
        if length == gap:
            length = high - i
        elif length == NEAR:
            if not self.hashes:
                self._prepare()
            joined = i < low < n and self._equal(i, j, gap)  # goes on in what is known
            length = gap if joined else self._search(most, lambda k: self._equal(i, j, k))
            if not np.array_equal(self.raw[i : i + length], self.raw[j : j + length]):
                length = int(np.argmin(np.append(self.raw[i : i + most] == self.raw[j : j + most], False)))
            elif joined:
                length = high - i
        self.known[shift] = (i, i + length)
        return length

    def left(self, i: int, j: int) -> int:
        """How many words before i equal those before j (i < j)."""
        words, length = self.words, 0
        while length < i and length < NEAR and words[i - length - 1] == words[j - length - 1]:
            length += 1
        if length == NEAR:
            if not self.hashes:
                self._prepare()
            length = self._search(i, lambda k: self._equal(i - k, j - k, k))
            if not np.array_equal(self.raw[i - length : i], self.raw[j - length : j]):
                length = int(np.argmin(np.append(self.raw[:i][::-1] == self.raw[j - i : j][::-1], False)))
        return length


def runs_of(words: list[int], least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal stretches with smallest period q and length >= max(least, exponent * q), exponent >= 2.

    Every run holds, under one of the two orders of the alphabet, its period as the longest Lyndon word that starts somewhere
    in its first period. That word ends where the next smaller suffix begins, which a stack of suffixes gives from right to
    left. From such a place the run goes on for more than ``exponent - 1`` periods, so other places are passed over.
    """
    n, found = len(words), {}
    ext = Extensions(words)
    right = ext.right
    for up in (True, False):
        stack: list[int] = []
        for i in range(n - 1, -1, -1):
            x = words[i]
            while stack:
                j = stack[-1]
                y = words[j]
                if x == y:
                    length = right(i, j)
                    if j + length == n:  # a prefix is the smaller one, under both orders
                        break
                    if (words[j + length] > words[i + length]) is not up:
                        break
                elif (y > x) is not up:
                    break
                stack.pop()
            end = stack[-1] if stack else n
            stack.append(i)
            period = end - i
            if end < n and words[end] == x:
                stop = end + right(i, end)
                if stop - i > (exponent - 1) * period and (stop, period) not in found:
                    start = i - ext.left(i, end)
                    found[stop, period] = start
    return sorted((s, e - s, q) for (e, q), s in found.items() if e - s >= max(least, exponent * q))


def stretches(code: np.ndarray, owner: np.ndarray, least: int, exponent: int) -> list[tuple[int, int]]:
    """Where runs can be: (first word, end) of stretches that hold every run of their text whole.

    In a run each pair of neighbouring words comes ``exponent - 1`` times at least, as its period does. Pairs that are rarer
    in their stretch part it, until none is; most texts are left without any.
    """
    place = np.flatnonzero(owner[1:] == owner[:-1])
    if not len(place):
        return []
    pair = np.unique(code[place].astype(np.int64) * (int(code.max()) + 1) + code[place + 1], return_inverse=True)[1]
    part = owner[place].astype(np.int64)
    while len(place):
        _, number, times = np.unique(part * (int(pair.max()) + 1) + pair, return_inverse=True, return_counts=True)
        stays = times[number] >= exponent - 1
        if not stays.all():
            place, pair, part = place[stays], pair[stays], part[stays]
        breaks = np.ones(len(place), bool)
        breaks[1:] = (place[1:] != place[:-1] + 1) | (part[1:] != part[:-1])
        part = np.cumsum(breaks) - 1
        sizes = np.bincount(part, minlength=0)
        long = sizes[part] >= least - 1 if len(place) else np.zeros(0, bool)
        if stays.all() and long.all():
            first = place[breaks]
            return list(zip(first.tolist(), (first + sizes + 1).tolist(), strict=True))
        place, pair, part = place[long], pair[long], part[long]
    return []


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _find(batches: Iterator[pa.RecordBatch], least: int, exponent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in portions_of(batch, 1, PORTION):
            buf, cuts = text_bytes(part.column(1))
            words, starts = words_of(buf, cuts, WHITE)
            encoded = words.dictionary_encode()
            code, spelled = encoded.indices.to_numpy(), encoded.dictionary.to_pylist()
            first = np.searchsorted(starts, cuts)  # number of the first word of each text
            owner = np.repeat(np.arange(part.num_rows), np.diff(first))
            kept = np.ones(len(code), bool)
            runs: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for begin, end in stretches(code, owner, least, exponent):
                text = int(owner[begin])
                for start, length, period in runs_of(code[begin:end].tolist(), least, exponent):
                    kept[begin + start + period : begin + start + length] = False
                    runs[text].append({"start": begin + start - int(first[text]), "length": length, "period": period})
            for listed in runs:
                listed.sort(key=lambda r: (r["start"], r["period"]))
            rest = []
            for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
                rest.append(b" ".join(map(spelled.__getitem__, code[a:b][kept[a:b]].tolist())))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([b - a for a, b in zip(first.tolist(), first[1:].tolist(), strict=False)], pa.int64()), pa.array(runs, RUNS), pa.array(rest, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """(id_col, n_words, runs array<struct<start, length, period>>, collapsed) of every whole text.

    Words are stretches without ASCII white space, numbered from 0. A run is a stretch of consecutive words with smallest period
    q (words q apart are identical) and at least max(``least``, ``exponent`` * q) words (``least`` 2 or more, ``exponent`` 3 or
    more) that no neighbouring word extends keeping period q. Runs come by start, then period. ``collapsed`` has the words that no run contains after its first q words,
    joined by one space. Rows never shuffle; a task holds a few megabytes of texts, or one longer text.

    Null and empty texts, and texts of white space, have no words, no runs and an empty ``collapsed``. Repeated rows are judged
    as often as they come; null ids are kept; other columns are ignored; an empty table gives an empty result.
    """
    if least < 2 or exponent < 3:
        raise ValueError("runs have two words and three periods at least")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _find(it, least, exponent), "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string").withColumnRenamed("id", id_col)


def run_digests(runs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): the longest run (ties: smallest
    start, then period; nulls without a run) and digests of all runs, one ``start,length,period`` a line, and of the rest."""
    order = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = runs.select(id_col, "runs", "collapsed", order.alias("_best"))
    length = (-F.col("_best.less")).alias("length")
    return best.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), length, F.col("_best.period").alias("period"),
        F.expr("-_best.less * 1000 div _best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text, in which one id of ten repeats a stretch of its words up to the end.

    With h the CRC-32 of the decimal id, g = floor(h / 10) and n words: where h % 10 = 0 and n > 0, each word i >= a becomes word
    a + (i - a) % p, with a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). Other texts, and those of null ids, stay.
    """
    h = F.crc32(F.col(id_col).cast("long").cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        return F.struct(words.alias("w"), F.when(n > 0, g % n).alias("a"), F.when(n > 0, 1 + F.floor((n - g % n) / (3 + g % 8))).alias("p"))

    # a text's words, then its numbers, are bound by lambdas of one-element arrays: each is computed once
    bound = F.transform(F.array(F.regexp_extract_all(F.col(text_col), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))), repeated)
    done = F.transform(bound, lambda s: F.array_join(F.transform(s["w"], lambda w, i: F.when(i < s["a"], w).otherwise(F.get(s["w"], (s["a"] + (i - s["a"]) % s["p"]).cast("int")))), " "))
    return F.when(h % 10 == 0, F.get(done, F.lit(0))).otherwise(F.col(text_col))

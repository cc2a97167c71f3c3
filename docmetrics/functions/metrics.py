"""Scores of a text against another: error rates, bags, compression, vectors."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import nfd, normalize, squash_symbols, without_citations

#: White space as Spark's (?U)\s has it.
WHITE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _rate(distance: Column, ref_size: Column, hyp_size: Column) -> Column:
    """Errors a unit of reference; an empty reference gives 0 with an empty hypothesis, else 1."""
    return F.when(ref_size == 0, F.when(hyp_size == 0, 0.0).otherwise(1.0)).otherwise(distance / ref_size)


def cer(ref: Column, hyp: Column, keep_space: bool = True, compose: bool = True) -> Column:
    """Character error rate of normalised texts; may exceed 1."""
    r, h = normalize(ref, keep_space, compose), normalize(hyp, keep_space, compose)
    return _rate(F.levenshtein(r, h), F.length(r), F.length(h))


def cer_raw(ref: Column, hyp: Column) -> Column:
    """Without normalisation or guard: null for an empty reference."""
    return F.try_divide(F.levenshtein(ref, hyp).cast("double"), F.length(ref).cast("double"))


def sequence_distance(a: Sequence, b: Sequence) -> int:
    """Unit-cost edit distance of two sequences, a row of the table at a time: a step along a row costs one, so its minima are running ones."""
    numbers: dict = {}
    x, y = (np.array([numbers.setdefault(i, len(numbers)) for i in s], np.int64) for s in sorted((a, b), key=len))
    steps = np.arange(len(y) + 1)
    row = steps
    for i, own in enumerate(x, 1):
        new = np.empty_like(row)
        new[0] = i
        np.minimum(row[1:] + 1, row[:-1] + (y != own), out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps
    return int(row[-1])


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def text_distance(a: str, b: str) -> int:
    """Edit distance of two texts, exact at any length: common ends go, then one column a character as bit vectors (Hyyrö)."""
    n = _common(a, b)
    a, b = a[n:][::-1], b[n:][::-1]
    n = _common(a, b)
    a, b = a[n:], b[n:]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    places: dict[str, bytearray] = {}
    for i, x in enumerate(a):
        places.setdefault(x, bytearray(len(a) // 8 + 1))[i >> 3] |= 1 << (i & 7)
    match = {x: int.from_bytes(v, "little") for x, v in places.items()}
    full, top = (1 << len(a)) - 1, len(a) - 1
    up, down, distance = full, 0, len(a)
    for y in b:
        m = match.get(y, 0)
        d = (((m & up) + up) ^ up) | m | down
        right, left = down | (full & ~(d | up)), d & up
        distance += (right >> top & 1) - (left >> top & 1)
        right, left = (right << 1 | 1) & full, left << 1 & full
        up, down = left | (full & ~(d | right)), right & d
    return distance


def text_rate(ref: str | None, hyp: str | None) -> float | None:
    """``cer`` of two texts in Python: composed, single spaces, the same rate."""
    if ref is None or hyp is None:
        return None
    r, h = (WHITE.sub(" ", unicodedata.normalize("NFC", s)).strip(" ") for s in (ref, hyp))
    return float(bool(h)) if not r else text_distance(r, h) / len(r)


@F.pandas_udf(T.IntegerType())
def word_distance(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([None if r is None or h is None else sequence_distance(r.split(), h.split()) for r, h in zip(ref, hyp, strict=True)], dtype="Int32")


def _n_words(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def wer(ref: Column, hyp: Column, compose: bool = True) -> Column:
    """Word error rate of normalised texts."""
    r, h = normalize(ref, compose=compose), normalize(hyp, compose=compose)
    return _rate(word_distance(r, h), _n_words(r), _n_words(h))


def word_distance_expr(ref: Column, hyp: Column) -> Column:
    """Word distance without Python, for short texts: the rows of the table folded over word arrays."""
    a, b = F.split(ref, " "), F.split(hyp, " ")
    first = F.sequence(F.lit(0), F.size(b))

    def next_row(row: Column, x: Column) -> Column:
        start = F.array(F.element_at(row, 1) + 1)
        step = lambda out, j: F.concat(
            out,
            F.array(F.least(F.element_at(out, -1) + 1, F.element_at(row, j + 1) + 1, F.element_at(row, j) + (F.element_at(b, j) != x).cast("int"))),
        )
        return F.aggregate(F.sequence(F.lit(1), F.size(b)), start, step)

    return F.element_at(F.aggregate(a, first, next_row), -1)


def jamo_cer(ref: Column, hyp: Column) -> Column:
    """Character error rate over decomposed texts, without other normalisation."""
    return cer_raw(nfd(ref), nfd(hyp))


def similarity(a: Column, b: Column, compose: bool = True) -> Column:
    """1 - CER of letters and digits, not below 0; 1 where both are empty, 0 where only the first is."""
    x, y = squash_symbols(a, compose), squash_symbols(b, compose)
    score = F.greatest(F.lit(0.0), 1 - F.levenshtein(x, y) / F.length(x))
    return F.when(x == "", F.when(y == "", 1.0).otherwise(0.0)).otherwise(score)


def overflow(ref: Column, hyp: Column, compose: bool = True) -> Column:
    """Whether an output has more than twice the characters of its reference, white space aside."""
    return F.length(normalize(hyp, False, compose)) > 2 * F.greatest(F.lit(1), F.length(normalize(ref, False, compose)))


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it in lambdas (where common expressions are not shared)."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def shared_characters(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of the characters of two texts."""
    count = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    return bind(F.struct(a.alias("a"), b.alias("b")), lambda s: F.aggregate(F.array_distinct(F.split(s["a"], "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(count(s["a"], c), count(s["b"], c)))))


def _bags(x: Column, y: Column) -> Column:
    """Struct of the shared characters and of all characters of two texts."""
    return bind(F.struct(x.alias("x"), y.alias("y")), lambda s: F.struct(shared_characters(s["x"], s["y"]).alias("hit"), (F.length(s["x"]) + F.length(s["y"])).alias("total")))


def disagreement(a: Column, b: Column) -> Column:
    """1 - F1 of the character bags, white space aside; 0 where both are empty. No composition."""
    return bind(_bags(normalize(a, False, False), normalize(b, False, False)), lambda s: F.when(s["total"] == 0, 0.0).otherwise(1 - 2 * s["hit"] / s["total"]))


def char_f1(gold: Column, pred: Column) -> Column:
    """F1 of the character bags of an answer and the gold text, citations and white space aside. Takes composed texts."""
    return bind(_bags(normalize(gold, False, False), normalize(without_citations(pred), False, False)), lambda s: F.when(s["hit"] == 0, 0.0).otherwise(2 * s["hit"] / s["total"]))


@F.pandas_udf(T.DoubleType())
def compression_ratio(text: pd.Series) -> pd.Series:
    """Bytes a compressed byte: high for text that repeats itself."""

    def ratio(s):
        raw = s.encode("utf-8", "surrogatepass")
        return len(raw) / max(1, len(zlib.compress(raw)))

    return text.map(lambda s: None if s is None else ratio(s))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for a zero vector."""
    return F.try_divide(dot(a, b), norm2(a) * norm2(b))


def l2_normalized(a: Column) -> Column:
    n = norm2(a)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), n))


def f1(precision: Column, recall: Column) -> Column:
    return 2 * precision * recall / F.greatest(F.lit(1e-9), precision + recall)

"""Word-level BPE by speculation: longest matches propose tokens, pair checks confirm them, the rest is merged exactly."""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordcache import portions
from .wordids import WordIds

#: Characters of the texts that are encoded together.
PORTION = 2 << 20
#: The end of a word, after its last byte.
END = 256
LATER = np.iinfo(np.int64).max
NONE = int(LATER)
#: Words with more symbols are merged by a heap.
LONG = 100


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 is itself, the rest follows from 256 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """The merges of a BPE vocabulary with word ends, as arrays over token ids.

    ``left`` and ``right`` are the parts of a token (-1 for single symbols), ``rank`` the place of the merge that makes it (-1 for single symbols).
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix = model["end_of_word_suffix"]
        if model["type"] != "BPE" or not suffix or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError(f"{path} is no plain BPE vocabulary with word ends")
        self.byte = byte_of_character()
        self.ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        size = max(self.ids.values()) + 1
        self.left, self.right, self.rank = (np.full(size, -1, np.int64) for _ in range(3))
        self.merged: dict[tuple[int, int], int] = {}
        self.product: list[int] = []
        for rank, (a, b) in enumerate(pairs):
            x, y, z = self.ids[a], self.ids[b], self.ids[a + b]
            self.merged.setdefault((x, y), rank)
            self.product.append(z)
            if self.rank[z] < 0:
                self.left[z], self.right[z], self.rank[z] = x, y, rank
        keys = np.array([x * size + y for x, y in self.merged], np.int64)
        order = np.argsort(keys)
        self.size, self.keys = size, keys[order]
        self.ranks = np.array(list(self.merged.values()), np.int64)[order]
        #: symbols of each token; special tokens have none
        self.spelled: dict[int, list[int]] = {}
        for token, i in self.ids.items():
            ends = token.endswith(suffix) and token != suffix
            inner = token[: -len(suffix)] if ends else token
            if all(c in self.byte for c in inner) and (len(inner) == 1 or self.rank[i] >= 0):
                self.spelled[i] = [self.byte[c] for c in inner] + [END] * ends
        self.single = np.full((2, 256), -1, np.int64)  # by whether it ends the word
        for i, symbols in self.spelled.items():
            if len(symbols) == 1 + (symbols[-1] == END):
                self.single[int(symbols[-1] == END), symbols[0]] = i
        if (self.single < 0).any():
            raise ValueError(f"{path} does not spell every byte")
        self.symbols = self.single[0].tolist(), self.single[1].tolist()

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging a and b; where there is none, LATER."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], LATER)

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether exact merging of a's and b's symbols together leaves a and b as they are (``until`` ranks, else for good).

        The symbols that face each other at the border are those on the right edge of a's merges and the left edge of b's. Going back in
        time, the later made of the two is taken apart; a merge across the border that comes before the two go into larger
        symbols of their own side would have been taken. Of equal ranks the one further left comes first.
        """
        a, b = a.copy(), b.copy()
        a_until = np.full(len(a), LATER) if until is None else until.copy()
        b_until = a_until.copy()
        fine = np.ones(len(a), bool)
        open_ = np.arange(len(a))
        first = until is not None  # the pair itself is the merge in question
        while len(open_):
            x, y = a[open_], b[open_]
            if not first:
                across = self.pair_rank(x, y)
                taken = (across < a_until[open_]) & (across <= b_until[open_]) & (across < LATER)
                fine[open_[taken]] = False
            first = False
            rx, ry = self.rank[x], self.rank[y]
            back_left = rx > ry
            back_right = ~back_left & (ry >= 0)
            i = open_[back_left]
            a_until[i], a[i] = rx[back_left], self.right[x[back_left]]
            i = open_[back_right]
            b_until[i], b[i] = ry[back_right], self.left[y[back_right]]
            open_ = open_[(back_left | back_right) & fine[open_]]
        return fine

    def reachable(self) -> np.ndarray:
        """Tokens that merging their own symbols gives; no other token is ever the result of merging."""
        good = np.zeros(self.size, bool)
        good[list(self.spelled)] = True
        made = np.array([i for i in self.spelled if self.rank[i] >= 0], np.int64)
        made = made[np.argsort(self.rank[made])]
        fine = self.compatible(self.left[made], self.right[made], self.rank[made])
        ordered = (self.rank[self.left[made]] < self.rank[made]) & (self.rank[self.right[made]] < self.rank[made])
        for i, ok in zip(made.tolist(), (fine & ordered).tolist(), strict=True):
            good[i] = ok and good[self.left[i]] and good[self.right[i]]
        return good

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the adjacent pair of the lowest rank first, of equal ranks the leftmost."""
        inner, last = self.symbols
        ids = [*map(inner.__getitem__, word[:-1]), last[word[-1]]]
        return self._merge_long(ids) if len(ids) > LONG else self._merge_short(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        get, product = self.merged.get, self.product
        ranks = [get(pair, NONE) for pair in zip(ids, ids[1:], strict=False)]
        while ranks and (rank := min(ranks)) != NONE:
            i = ranks.index(rank)
            ids[i : i + 2] = [product[rank]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), NONE)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap of pairs over linked symbols, n log n in the length of the word."""
        n, merged = len(ids), self.merged
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(rank, i, pair) for i, pair in enumerate(zip(ids, ids[1:], strict=False)) if (rank := merged.get(pair)) is not None]
        heapify(waiting)
        while waiting:
            rank, i, pair = heappop(waiting)
            j = after[i]
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            z = ids[i] = self.product[rank]
            ids[j] = -1
            after[i] = k = after[j]
            h = before[i]
            if k < n:
                before[k] = i
                if (got := merged.get((z, ids[k]))) is not None:
                    heappush(waiting, (got, i, (z, ids[k])))
            if h >= 0 and (got := merged.get((ids[h], z))) is not None:
                heappush(waiting, (got, h, (ids[h], z)))
        return [t for t in ids if t >= 0]


class Speculator:
    """Ids of words: longest matches, accepted where every adjacent pair is compatible, else exact merging.

    That all adjacent pairs stay as they are is enough: the first merge across any border of the word would also be one of the two tokens beside it alone.
    """

    def __init__(self, path: str):
        self.merges = Merges(path)
        good = self.merges.reachable()
        paths: dict[tuple[int, int], int] = {}
        token = [-1]
        for i, symbols in self.merges.spelled.items():
            if good[i]:
                node = 0
                for s in symbols:
                    node = paths.setdefault((node, s), len(token))
                    if node == len(token):
                        token.append(-1)
                token[node] = i
        keys = np.array([node * (END + 1) + s for node, s in paths], np.int64)
        order = np.argsort(keys)
        self.keys, self.child, self.token = keys[order], np.array(list(paths.values()), np.int64)[order], np.array(token, np.int64)
        self.root = np.full(END + 1, -1, np.int64)
        for (node, s), child in paths.items():
            if node == 0:
                self.root[s] = child
        self.exact = 0  # words that needed exact merging

    def longest(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At every symbol the longest token that starts there and leaves no word end alone: its id and its end."""
        token, stop = np.full(len(symbols), -1, np.int64), np.zeros(len(symbols), np.int64)
        place = np.flatnonzero(symbols != END)
        node = self.root[symbols[place]]
        depth = 1
        while len(place):
            at = place + depth  # the next symbol: every word ends by END, so there is one unless END was taken
            ended = symbols[at - 1] == END
            fits = (self.token[node] >= 0) & (ended | (symbols[np.minimum(at, len(symbols) - 1)] != END))
            token[place[fits]], stop[place[fits]] = self.token[node[fits]], at[fits]
            goes = ~ended
            place, node = place[goes], node[goes]
            key = node * (END + 1) + symbols[place + depth]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[i] == key
            place, node = place[there], self.child[i[there]]
            depth += 1
        return token, stop

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Packed ids (unsigned 32-bit) of each word, which has one byte at least."""
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes)
        symbols = np.full(int(ends[-1]), END, np.int64)
        inner = np.ones(len(symbols), bool)
        inner[ends - 1] = False
        symbols[inner] = np.frombuffer(b"".join(words), np.uint8)
        token, stop = self.longest(symbols)
        follow, chosen, counts = stop.tolist(), [], []
        for at, end in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
            before = len(chosen)
            while at < end:
                chosen.append(at)
                at = follow[at]
            counts.append(len(chosen) - before)
        ids = token[chosen]
        word = np.repeat(np.arange(len(words)), counts)
        inside = np.flatnonzero(word[1:] == word[:-1])
        pairs, which = np.unique(ids[inside] * self.merges.size + ids[inside + 1], return_inverse=True)
        fails = ~self.merges.compatible(pairs // self.merges.size, pairs % self.merges.size)[which]
        raw, cuts = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        found = [raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
        failing = np.unique(word[inside[fails]]).tolist()
        for w in failing:
            found[w] = array("I", self.merges.merge(words[w])).tobytes()
        self.exact += len(failing)
        return found


class SpeculativeIds(WordIds):
    """Ids of whole texts, every pre-token by speculation.

    Words of ASCII and common Latin letters are cut by byte classes; other words go through the normaliser and the pre-tokenizer of the
    tokenizer's file, whose added tokens are cut out of the texts first.
    """

    def __init__(self, path: str, room: int = 300_000):
        self.speculator, self.cut_added = Speculator(path), None
        super().__init__(path, room)
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError(f"added tokens of {path} are not plain strings")
        self.added_ids = {str(t.content): i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        if self.added_ids:
            self.cut_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added_ids, key=len, reverse=True))) + ")")

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        return self.speculator.encode([p.encode() for p in pieces])

    def _encode_words(self, words: list[str]) -> list[bytes]:
        normal, cut, byte = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str, self.speculator.merges.byte
        parts = [[bytes(map(byte.__getitem__, t)) for t, _ in cut(normal(w)) if t] for w in words]
        ids = iter(self.speculator.encode([p for listed in parts for p in listed]))
        return [b"".join(next(ids) for _ in listed) for listed in parts]

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text (unsigned 32-bit); null counts as empty."""
        cut = self.cut_added
        mixed = {i: cut.split(t) for i, t in enumerate(texts) if t and cut and cut.search(t)}
        if not mixed:
            return super().batch(texts)
        plain = [None if i in mixed else t for i, t in enumerate(texts)]
        out = super().batch(plain)
        for i, parts in mixed.items():  # texts between added tokens, and these, take turns
            between = super().batch(parts[::2])
            ids = [between[0]]
            for name, rest in zip(parts[1::2], between[1:], strict=True):
                ids += [np.array([self.added_ids[name]], np.uint32), rest]
            out[i] = np.concatenate(ids)
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> SpeculativeIds:
    return SpeculativeIds(path)


@lru_cache(maxsize=2)
def _tokens(path: str) -> list[str | None]:
    """The token of each id; ids that name none are skipped in decoding."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    if file.get("decoder"):
        raise ValueError(f"{path} has a decoder of its own")
    named = {i: t for t, i in file["model"]["vocab"].items()} | {t["id"]: t["content"] for t in file["added_tokens"]}
    return [named.get(i) for i in range(max(named) + 1)]


def decode(ids: np.ndarray, tokens: list[str | None]) -> str:
    """The tokens of the ids, special ones too, joined by one space, as a tokenizer without decoder gives them."""
    return " ".join([t for t in map(tokens.__getitem__, ids.tolist()) if t is not None])


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path)
    for batch in batches:
        at = 0
        for part in portions((t.as_py() for t in batch.column(1)), PORTION):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array([x.tobytes() for x in encoder.batch(part)], pa.binary())], ["id", "packed"])
            at += len(part)


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tokens = _tokens(path)
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = [None if x is None else decode(np.frombuffer(x, "<u4"), tokens) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["id", "packed", "decoded"])


def _round_trip(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, number of ids, digest of the ids, digest of what the ids decode to)."""
    tokens = _tokens(path)
    decimal = list(map(str, range(len(tokens))))
    for batch in _encode(batches, path):
        n, first, second = [], [], []
        for raw in batch.column(1).to_pylist():
            ids = np.frombuffer(raw, "<u4")
            n.append(len(ids))
            first.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids.tolist())).encode()).hexdigest())
            second.append(hashlib.sha256(decode(ids, tokens).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, packed binary): ids of every whole text, little-endian unsigned 32-bit, as ``Tokenizer.encode`` without special
    tokens gives them; strings of added tokens in a text become their ids. ``tokenizer``: path of its file on the workers.

    A null or empty text has no ids. Repeated rows are encoded as often as they come; null ids are kept; other columns are
    ignored; an empty table gives an empty result. Rows never shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _encode(it, tokenizer), "id long, packed binary").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, packed, decoded string): the tokens of the ids joined by one space. Null ids give null, no ids an empty text."""
    rows = encoded.select(F.col(id_col).alias("id"), "packed")
    return rows.mapInArrow(lambda it: _decode(it, tokenizer), "id long, packed binary, decoded string").withColumnRenamed("id", id_col)


def round_trip_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): digests of the decimal ids joined by one space, and of the decoded text.

    One worker a task encodes a portion of texts and decodes its ids; rows are as in ``encode_documents``.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col("text"))
    return rows.mapInArrow(lambda it: _round_trip(it, tokenizer), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)

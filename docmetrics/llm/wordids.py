"""Ids of a lower-casing word tokenizer for many texts at once: words are found in Arrow and NumPy, each new one is encoded once."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .wordcache import WordCache, gathered

SPACE, LETTER, DIGIT, MARK, OTHER = range(5)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower-case form of each byte. Bytes from 128 on count as letters until they are looked at in pairs."""
    kind, lower = np.full(256, OTHER, np.uint8), np.arange(256, dtype=np.uint8)
    kind[33:127] = MARK
    for c in b" \n\t\r":
        kind[c] = SPACE
    for c in range(ord("a"), ord("z") + 1):
        kind[c] = kind[c - 32] = LETTER
        lower[c - 32] = c
    kind[ord("0") : ord("9") + 1] = DIGIT
    kind[ord("'")] = OTHER  # contractions are pieces of their own
    kind[128:192] = kind[0xC3:0xC6] = LETTER
    return kind, lower


def _pairs() -> tuple[np.ndarray, np.ndarray]:
    """By leading byte (C3 to C5) and second byte: whether it is a Latin letter that is lowered in place, and the second byte of its lower case."""
    known, second = np.zeros((3, 256), bool), np.zeros((3, 256), np.uint8)
    for lead in range(0xC3, 0xC6):
        for byte in range(0x80, 0xC0):
            c = bytes((lead, byte)).decode()
            low = c.lower().encode()
            known[lead - 0xC3, byte] = c.isalpha() and len(low) == 2 and low[0] == lead
            second[lead - 0xC3, byte] = low[1] if known[lead - 0xC3, byte] else byte
    return known, second


KIND, LOWER = _classes()
PAIR_KNOWN, PAIR_LOWER = _pairs()


def _strings(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.StringArray:
    """The byte ranges of ``buf`` as Arrow strings. Ranges are ascending and do not overlap."""
    sizes = ends - starts
    mark = np.zeros(len(buf) + 1, np.int8)
    mark[starts] += 1
    np.subtract.at(mark, ends, 1)  # a range may begin where another ends
    data = buf[np.cumsum(mark[:-1], dtype=np.int8).view(bool)] if len(starts) else buf[:0]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def classes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each byte of UTF-8 texts, and the bytes with ASCII and common Latin letters in lower case. Other characters are OTHER at their first byte."""
    kind, low = KIND[buf], LOWER[buf]
    lead = np.flatnonzero((buf >= 0xC3) & (buf <= 0xC5))
    if len(lead):
        second = buf[lead + 1]
        known = PAIR_KNOWN[buf[lead] - 0xC3, second]
        low[lead + 1] = PAIR_LOWER[buf[lead] - 0xC3, second]
        kind[lead[~known]] = OTHER
    return kind, low


class WordIds:
    """Ids of whole texts as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    For a tokenizer that lower-cases, drops white space, cuts letters, single digits and runs of marks apart
    and ends each piece by a suffix of its own; ``__init__`` refuses any other. The pieces of words
    of ASCII and common Latin letters are found by byte classes, other words (between ASCII white space) go to
    the tokenizer as they are, as do whole texts that hold the string of an added token. Distinct
    pieces of a portion are looked up in a table of two generations, and new ones are encoded together by the tokenizer.
    """

    def __init__(self, path: str, room: int = 200_000, portion: int = 3 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks of an executor are its parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not suffix:
            raise ValueError(f"the tokenizer in {path} does not end its words by a suffix")
        for piece, i in vocabulary.items():
            self.last[i] = piece.endswith(suffix)
        self.added = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.portion, self.cache = portion, WordCache(room)
        probe = "Zwei Wörter, ÉTÉ 2024-7x a\tb\nc %%% d"
        if self.batch([probe])[0].tolist() != self._plain(probe).tolist():
            raise ValueError(f"the tokenizer in {path} does not cut words as this table does")

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Letters, digits or marks of ASCII and Latin: each is one piece, so its last id is the only one with the suffix."""
        out: list[bytes] = []
        groups = [pieces[i : i + 200] for i in range(0, len(pieces), 200)]
        for at in range(0, len(groups), 50):
            some = groups[at : at + 50]
            for group, got in zip(some, self.tokenizer.encode_batch_fast([" ".join(g) for g in some], add_special_tokens=False), strict=True):
                ids = np.array(got.ids, np.uint32)
                cuts = 4 * (np.flatnonzero(self.last[ids]) + 1)
                if len(cuts) == len(group):
                    raw = ids.tobytes()
                    out += [raw[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]
                else:
                    out += [self._plain(p).tobytes() for p in group]
        return out

    def _encode_words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(words), 5000):
            out += [np.array(got.ids, np.uint32).tobytes() for got in self.tokenizer.encode_batch_fast(words[at : at + 5000], add_special_tokens=False)]
        return out

    def _ids(self, buf: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts laid end to end (``cuts``: where each begins) to all their ids and the place of each text's first id."""
        kind, low = classes(buf)
        space = kind == SPACE
        begins = ~space
        begins[1:] &= space[:-1]
        inner = cuts[(cuts > 0) & (cuts < len(buf))]
        begins[inner] = ~space[inner]
        word = np.flatnonzero(begins)
        if not len(word):
            return np.empty(0, np.uint32), np.zeros(len(cuts), np.int64)
        closes = ~space
        closes[:-1] &= space[1:] | begins[1:]
        word_end = np.flatnonzero(closes) + 1
        odd = np.zeros(len(word), bool)
        odd[np.searchsorted(word, np.flatnonzero(kind == OTHER), "right") - 1] = True

        # pieces of the plain words: where the class changes, and every digit
        change = np.empty(len(buf), bool)
        change[0] = True
        change[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        change |= begins
        change &= ~space
        if odd.any():
            inside = np.zeros(len(buf) + 1, np.int8)
            inside[word[odd]] += 1
            inside[word_end[odd]] -= 1
            inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
            change &= ~inside
            plain = ~space & ~inside
        else:
            plain = ~space
        start = np.flatnonzero(change)
        offsets = np.empty(len(start) + 1, np.int32)
        offsets[:-1] = np.cumsum(plain, dtype=np.int32)[start] - 1
        data = low[plain]
        offsets[-1] = len(data)
        pieces = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        rows = self.cache.lookup(pieces.dictionary.to_pylist(), self._encode_pieces)
        code = pieces.indices.to_numpy()
        if odd.any():
            others = _strings(buf, word[odd], word_end[odd]).dictionary_encode()
            at = word[odd]
            code = np.concatenate([code, others.indices.to_numpy() + len(rows)])
            rows += self.cache.lookup(others.dictionary.to_pylist(), self._encode_words, "\n")
            start = np.concatenate([start, at])
            order = np.argsort(start, kind="stable")
            start, code = start[order], code[order]
        ids, ends = gathered(rows, code)
        return ids, ends[np.searchsorted(start, cuts, "left")]

    def _portions(self, raws: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
        """(text, part of it) in portions of about ``portion`` bytes; longer texts are cut at ASCII white space."""
        part: list[tuple[int, bytes]] = []
        held = 0
        for i, raw in enumerate(raws):
            at = 0
            while True:
                end = len(raw)
                if end - at > self.portion:
                    cut = max(raw.rfind(b" ", at, at + self.portion), raw.rfind(b"\n", at, at + self.portion))
                    if cut <= at:
                        cut = min((x for x in (raw.find(b" ", at + self.portion), raw.find(b"\n", at + self.portion)) if x > 0), default=end)
                    end = cut
                part.append((i, raw[at:end] if at or end < len(raw) else raw))
                held += end - at
                if held >= self.portion:
                    yield part
                    part, held = [], 0
                at = end
                if at >= len(raw):
                    break
        if part:
            yield part

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text (unsigned 32-bit); null counts as empty."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        raws = []
        for i, t in enumerate(texts):
            if t and any(a in t for a in self.added):
                out[i].append(self._plain(t))
                t = None
            raws.append(t.encode("utf-8", "replace") if t else b"")
        for part in self._portions(raws):
            buf = np.frombuffer(b"".join(p for _, p in part), np.uint8)
            lengths = np.array([len(p) for _, p in part])
            cuts = np.concatenate([[0], np.cumsum(lengths)])
            ids, at = self._ids(buf, cuts) if len(buf) else (np.empty(0, np.uint32), np.zeros(len(cuts), np.int64))
            for k, (i, _) in enumerate(part):
                out[i].append(ids[at[k] : at[k + 1]])
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

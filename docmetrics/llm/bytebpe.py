"""Byte-level BPE by a sentencepiece model that is written directly from a rank file."""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordcache import WordCache, gathered, portions
from .wordids import OTHER, SPACE, classes

#: Characters of the texts that are encoded together.
PORTION = 2 << 20

#: Bytes are written as the characters from here on: letters without case, white space or composition.
FIRST_CHAR = 0x4E00


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 token, rank) in the order of their ranks, which must be 0, 1, 2, ..."""
    found = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                found[int(rank)] = base64.b64decode(token)
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks are not 0, 1, 2, ...")
    return [found[i] for i in range(len(found))]


def byte_mapped(token: bytes) -> str:
    return "".join(map(chr, (FIRST_CHAR + b for b in token)))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: length-delimited, varint or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised BPE model whose piece ids are the ranks and whose scores are the negative ranks.

    The normaliser is the identity: no dummy prefix, no white-space handling. The model must know an
    unknown piece; it comes last and never occurs, as all 256 bytes are pieces.
    """
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, _field(1, byte_mapped(t).encode()) + _field(2, float(-i)) + _field(3, normal)) for i, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    size = len(pieces)
    none = 2**64 - 1  # -1 as a varint
    trainer = _field(3, bpe) + _field(4, size) + _field(40, size - 1) + _field(41, none) + _field(42, none) + _field(43, none)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Encoder and decoder of one rank file and split pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.whole = {t: array("I", [i]).tobytes() for i, t in enumerate(self.tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.tokens))
        # white space as Unicode's White_Space property has it, whatever the library's \s is
        space = r"\t-\r \x85\xa0  -     　"
        own = pattern.replace(r"[^\s", f"[^{space}").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")
        self.split = regex.compile(own)
        self.crowded = regex.compile(f"[{space}] [{space}]").search
        self.cache = WordCache(250_000)
        self.mapped = {b: FIRST_CHAR + b for b in range(256)}

    def _matches(self, chunk: str) -> list[str]:
        """Matches of the pattern in a chunk; a word of Latin letters, with a space before it or not, is one."""
        word = chunk[1:] if chunk[:1] == " " else chunk
        return [chunk] if word.isalpha() and (word.isascii() or max(word) < "\u0250") else self.split.findall(chunk)

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Packed ids of chunks. A match of the pattern is itself where it is a token, else merged in the order of ranks."""
        whole, mapped = self.whole, self.mapped
        words = list(map(self._matches, chunks))
        ids: dict[str, bytes] = {}
        merge: list[str] = []
        spelled: list[str] = []
        for w in set().union(*words):
            raw = w.encode("utf-8", "surrogatepass")
            got = whole.get(raw)
            if got is None:
                merge.append(w)
                spelled.append(raw.decode("latin-1").translate(mapped))
            else:
                ids[w] = got
        if merge:
            ids.update((w, array("I", got).tobytes()) for w, got in zip(merge, self.model.encode(spelled, num_threads=1), strict=True))
        return [ids[found[0]] if len(found) == 1 else b"".join([ids[w] for w in found]) for found in words]

    @staticmethod
    def _turns(buf: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Where letters, digits and marks of ASCII and common Latin meet: matches end there. Chunks with anything else are left whole."""
        kind, _ = classes(buf)
        odd = (kind == OTHER) | ((kind == SPACE) & (buf != ord(" ")))
        plain = np.ones(len(start), bool)
        plain[np.searchsorted(start, np.flatnonzero(odd), "right") - 1] = False
        turns = np.zeros(len(buf), bool)
        turns[1:] = (kind[1:] != kind[:-1]) & (kind[1:] != SPACE) & (kind[:-1] != SPACE)
        return turns & np.repeat(plain, np.diff(np.append(start, len(buf)))) if len(start) else turns

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        No match of the pattern goes on over a space that follows or precedes a visible character, so
        a text is cut before such spaces, and chunks of plain letters, digits and marks where these meet. The chunks of a portion of texts are numbered in Arrow, and each distinct one is looked up once
        in a table; chunks that are new to a worker are encoded together. A text with a space between two white-space
        characters is matched as a whole.
        """
        out: list[bytes] = []
        for part in portions(texts, PORTION):
            whole = {i: t for i, t in enumerate(part) if self.crowded(t)}
            raws = [b"" if i in whole else t.encode("utf-8", "surrogatepass") for i, t in enumerate(part)]
            buf = np.frombuffer(b"".join(raws), np.uint8)
            cuts = np.cumsum([0, *map(len, raws)])
            begins = buf == ord(" ")
            begins[cuts[:-1][cuts[:-1] < len(buf)]] = True
            begins |= self._turns(buf, np.flatnonzero(begins))
            start = np.flatnonzero(begins)
            offsets = pa.array(np.append(start, len(buf)).astype(np.int32))
            chunks = pa.Array.from_buffers(pa.binary(), len(start), [None, offsets.buffers()[1], pa.py_buffer(buf)]).dictionary_encode()
            rows = self.cache.lookup([c.decode("utf-8", "surrogatepass") for c in chunks.dictionary.to_pylist()], self._chunks)
            ids, ends = gathered(rows, chunks.indices.to_numpy())
            at = ends[np.searchsorted(start, cuts, "left")]
            found = [ids[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
            for i, packed in zip(whole, self._chunks(list(whole.values())), strict=True):
                found[i] = packed
            out += found
        return out

    def encode_packed(self, text: str | None) -> bytes:
        return self.encode_batch([text])[0]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The bytes of the ids, by the inverse of the vocabulary."""
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


@lru_cache(maxsize=2)
def inverse(path: str) -> list[bytes]:
    return read_ranks(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = codec(path, pattern)
    for batch in batches:
        at = 0
        for part in portions((t.as_py() for t in batch.column(1)), PORTION):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(bpe.encode_batch(part), pa.binary())], ["id", "packed"])
            at += len(part)


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    get = inverse(path).__getitem__
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            raw = [None if x is None else b"".join(map(get, np.frombuffer(x, "<u4").tolist())) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], ["id", "packed", "decoded"])


def encode_documents(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, packed binary): byte-level BPE ids of every whole text, little-endian unsigned 32-bit, without special tokens.

    A null or empty text has no ids. Repeated rows are encoded as often as they come; null ids are
    kept; other columns are ignored; an empty table gives an empty result. ``ranks`` is the path of a
    rank file on the workers, ``pattern`` the split that precedes the merges.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _encode(it, ranks, pattern), "id long, packed binary").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, ranks: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, packed, decoded binary): the bytes of the ids by the inverse of the vocabulary. Null ids give null, no ids no bytes."""
    rows = encoded.select(F.col(id_col).alias("id"), "packed")
    return rows.mapInArrow(lambda it: _decode(it, ranks), "id long, packed binary, decoded binary").withColumnRenamed("id", id_col)


def round_trip_digests(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of encoding and decoding every document."""
    decoded = decode_documents(encode_documents(docs, ranks, pattern, id_col), ranks, id_col)
    n = (F.octet_length("packed") / 4).cast("long").alias("n_tokens")
    return decoded.select(id_col, n, F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

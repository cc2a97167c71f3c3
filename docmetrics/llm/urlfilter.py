"""URL filters: a memory-mapped sorted array of 64-bit digests, probed by binary search."""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import write_shared

MAGIC = b"DGSTARR2"
#: Most bytes of rules in one array; also what each executor maps at most, about.
MOST_BYTES = 2 << 30
_HOST = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host (after the first ``://`` to the next of ``/?#``, A-Z lower-cased) and path (then to ``?`` or ``#``)."""
    found = _HOST.search(url) if url else None
    return (found[1].translate(_UPPER), found[2]) if found else ("", "")


def digest_array(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """Rules (host, path, verdict) as a digest array.

    Layout, little-endian: magic, number of keys, number of path lengths, most labels and most bytes of a host,
    the path lengths that occur (u64), sorted keys (u64), offsets into the strings (u64, one more
    than keys), strings ``verdict \\t host path``. Equal rules collapse; of contradicting ones the last counts.
    The array is built in the driver's memory: more than ``MOST_BYTES`` of rules are refused.
    """
    last: dict[str, tuple[str, str]] = {}
    hosts, held = {""}, 0
    for host, path, verdict in rules:
        host = host.translate(_UPPER)
        held += len(host) + len(path) + 64
        if held > MOST_BYTES:
            raise ValueError(f"rules of more than {MOST_BYTES} bytes: build several arrays")
        last[host + path] = (verdict, path)
        hosts.add(host)
    entries = sorted((xxhash.xxh64_intdigest(key.encode()), key.encode(), v[0].encode()) for key, v in last.items())
    lengths = sorted({len(p.encode()) for _, p in last.values()})
    strings = [v + b"\t" + key for _, key, v in entries]
    offsets = np.cumsum([0, *map(len, strings)])
    head = MAGIC + struct.pack("<QQQQ", len(entries), len(lengths), 1 + max(h.count(".") for h in hosts), max(len(h.encode()) for h in hosts))
    return head + np.array(lengths, "<u8").tobytes() + np.array([e[0] for e in entries], "<u8").tobytes() + offsets.astype("<u8").tobytes() + b"".join(strings)


class DigestArray:
    """The memory-mapped file; pages of it are loaded as probes touch them."""

    def __init__(self, path: str):
        self.raw = np.memmap(path, np.uint8, "r")
        if self.raw[:8].tobytes() != MAGIC:
            raise ValueError(f"{path} is not a digest array")
        n, m, self.labels, self.host_bytes = struct.unpack("<QQQQ", self.raw[8:40].tobytes())
        at = 40
        self.lengths = self.raw[at : at + 8 * m].view("<u8").tolist()
        at += 8 * m
        self.keys = self.raw[at : at + 8 * n].view("<u8")
        at += 8 * n
        self.offsets = self.raw[at : at + 8 * (n + 1)].view("<u8")
        self.strings = self.raw[at + 8 * (n + 1) :]

    def probe(self, keys: list[bytes]) -> list[str | None]:
        """The verdict of each key, None where it is not stored. A digest that is found is confirmed by its string."""
        out: list[str | None] = [None] * len(keys)
        if not len(self.keys) or not keys:
            return out
        wanted = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
        at = np.searchsorted(self.keys, wanted, "left")
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == wanted[hit]
        for i in np.flatnonzero(hit).tolist():
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == wanted[i]:
                verdict, _, text = self.strings[int(self.offsets[j]) : int(self.offsets[j + 1])].tobytes().partition(b"\t")
                if text == keys[i]:
                    out[i] = verdict.decode()
                    break
                j += 1
        return out


@lru_cache(maxsize=4)
def _opened(path: str) -> DigestArray:
    return DigestArray(path)


def candidates(host: str, path: str, lengths: list[int], labels: int, host_bytes: int) -> list[bytes]:
    """Keys that could hold a rule for the url: the host and its parent domains, with path prefixes of stored lengths.

    Only parents with at most ``labels`` labels and ``host_bytes`` bytes, as no stored host has more: a host of very many
    labels so gives no more keys than any other.
    """
    raw, domains = path[: max(lengths, default=0)].encode("utf-8", "surrogatepass"), []
    cut = len(host)
    for _ in range(labels):
        cut = host.rfind(".", 0, cut)
        domain = host[cut + 1 :].encode("utf-8", "surrogatepass") if len(host) - cut - 1 <= host_bytes else None
        if domain is None or len(domain) > host_bytes:
            break
        domains.append(domain)
        if cut < 0:
            break
    return [d + raw[:n] for d in domains for n in lengths if n <= len(raw)]


def _judge(batches: Iterator[pa.RecordBatch], name: str, default: str) -> Iterator[pa.RecordBatch]:
    index = _opened(SparkFiles.get(name))
    for batch in batches:
        parts = [host_and_path(u) for u in batch.column(1).to_pylist()]
        keys, of = [], []
        for i, (host, path) in enumerate(parts):
            if host or path:
                own = candidates(host, path, index.lengths, index.labels, index.host_bytes)
                keys += own
                of += [i] * len(own)
        best: dict[int, tuple[int, str, str]] = {}
        for i, key, verdict in zip(of, keys, index.probe(keys), strict=True):
            if verdict is not None and (i not in best or len(key) > best[i][0]):
                best[i] = (len(key), key.decode("utf-8", "surrogatepass"), verdict)
        rule = [best[i][1] if i in best else None for i in range(len(parts))]
        verdict = [best[i][2] if i in best else default for i in range(len(parts))]
        arrays = [batch.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, ["id", "host", "path", "rule", "verdict"])


def ship_rules(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> str:
    """Writes a digest array to the shared folder, from where every executor fetches it once; returns its name there."""
    name = f"urlrules-{uuid.uuid4().hex}.bin"
    spark.sparkContext.addFile(write_shared(spark, name, digest_array(rules)))
    return name


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Verdicts on urls by rules (host, path prefix, 'allow' or 'block').

    A rule fits its host and all subdomains where the url's path starts with the rule's path. The
    longest rule (bytes of host and path) wins, the more specific host on a tie. Urls without a rule get
    ``default``: what is not in the array is not blocked. The rules travel as one file per executor,
    mapped into memory and probed by binary search over sorted 64-bit digests; a hit is confirmed by
    the stored string, so a collision of digests cannot give a verdict. The rows never shuffle.

    A host of very many labels is probed by its last ones only, as many as the longest stored host has.
    A null url, or one without ``://``, has empty host and path, no rule and the default verdict. Ids may be
    null or repeat; other columns are ignored; an empty table gives an empty result.

    Returns (id_col, host, path, rule, verdict).
    """
    name = ship_rules(pages.sparkSession, rules)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"))
    out = rows.mapInArrow(lambda it: _judge(it, name, default), "id long, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)

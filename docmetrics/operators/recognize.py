"""The boundary to recognisers: batches of documents in, readings out; errors are data."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import materialize
from .scoring import throughput

READING = "id string, text string, tables array<string>, time double, error boolean"


class Recognizer(Protocol):
    """Reads one document; ``read_batch`` may be given instead where a model takes many at once."""

    def read(self, doc: dict) -> tuple[str, list[str]]: ...


class SimulatedRecognizer:
    """Corrupts the true text by a hash of id, place and seed: the same reading every time and everywhere."""

    def __init__(self, rate: float = 0.05, seed: int = 0):
        self.rate, self.seed = rate, seed

    def read(self, doc: dict) -> tuple[str, list[str]]:
        text = doc["text"] or ""
        keep = [c for i, c in enumerate(text) if zlib.crc32(f"{self.seed}:{doc['id']}:{i}".encode()) / 2**32 >= self.rate]
        return "".join(keep), []


def recognize(docs: DataFrame, make: Callable[[], Recognizer], warm_up: dict | None = None, attempts: int = 1) -> DataFrame:
    """Readings of documents (id, text or content, ...) by a recogniser made once a task.

    A failure, after so many ``attempts``, gives an empty text and ``error``, never an exception. ``warm_up`` is read before timing begins.
    The number of partitions is the number of concurrent readers.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = make()
        if warm_up is not None:
            reader.read(warm_up)
        for frame in frames:
            rows = []
            docs_ = frame.to_dict("records")
            batch = getattr(reader, "read_batch", None)
            if batch:
                began = time.perf_counter()
                try:
                    got = [(*x, False) for x in batch(docs_)]
                except Exception:
                    got = [("", [], True)] * len(docs_)
                each = (time.perf_counter() - began) / max(1, len(docs_))
                rows = [(str(d["id"]), t, tables, each, e) for d, (t, tables, e) in zip(docs_, got, strict=True)]
            else:
                for d in docs_:
                    began = time.perf_counter()
                    for _ in range(attempts):
                        try:
                            text, tables = reader.read(d)
                            error = False
                            break
                        except Exception:
                            text, tables, error = "", [], True
                    rows.append((str(d["id"]), text, tables, time.perf_counter() - began, error))
            yield pd.DataFrame(rows, columns=["id", "text", "tables", "time", "error"])

    return docs.mapInPandas(run, READING)


def recognize_missing(docs: DataFrame, cache: DataFrame, make: Callable[[], Recognizer]) -> DataFrame:
    """Readings of the documents that a cache table lacks."""
    todo = docs.join(cache.select("id"), "id", "left_anti")
    return recognize(todo, make)


def embedder(make: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = 64) -> Callable:
    """A column function that embeds texts in batches by a model made once a worker: ``make`` returns a function of an array of texts to rows of floats."""
    return predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)


def hashed_trigrams(dim: int = 64) -> Callable[[np.ndarray], np.ndarray]:
    """A stand-in for an embedding model: counts of hashed character trigrams, of unit length."""

    def embed(texts: np.ndarray) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for i in range(max(0, len(text or "") - 2)):
                row[zlib.crc32(text[i : i + 3].encode("utf-8", "replace")) % dim] += 1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def concurrency_sweep(docs: DataFrame, make: Callable[[], Recognizer], levels: tuple[int, ...] = (1, 4, 16)) -> DataFrame:
    """Throughput at several numbers of concurrent readers: a row for each level, as in ``scoring.throughput``. Each level reads all documents once."""
    out = None
    for level in levels:
        began = time.perf_counter()
        got = materialize(recognize(docs.repartition(level), make), "sweep")
        wall = time.perf_counter() - began
        rows = got.select(F.lit(level).alias("workers"), F.col("time").alias("latency"), F.length("text").alias("tokens"), F.when(F.col("error"), "error").otherwise("stop").alias("finish"), F.lit(wall).alias("wall"))
        report = throughput(rows, ["workers"])
        out = report if out is None else out.unionByName(report)
    return out

"""Recall and memory of the pivot index at sizes that a test can't have rows for."""

import struct
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from docmetrics.llm import embeddings


def shares(a, b, k):
    return (a[:, :k, None] == b[:, None, :k]).any(2).sum(1)


@pytest.mark.parametrize("pivots", [256, 1024, 4096, 16_384])
def test_recall_at_the_threshold(pivots):
    r = np.random.default_rng(pivots)
    a, z, points = (embeddings._unit(r.normal(size=(n, 64))) for n in (1500, 1500, pivots))
    z = embeddings._unit(z - (z * a).sum(1)[:, None] * a)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * z
    lists = embeddings.lists_for(pivots)
    x, y = (embeddings.nearest_pivots(v, points, 2 * lists) for v in (a, b))
    assert np.mean((shares(x, y, lists) >= 1) & (shares(x, y, 2 * lists) >= 2)) >= 0.97


def test_reference_points_keep_apart():
    r = np.random.default_rng(4)
    sample = np.concatenate([r.normal(size=(1500, 8)), np.ones((400, 8)) + 0.01 * r.normal(size=(400, 8))])
    got = embeddings.reference_points(sample, 300)
    one_by_one: list = []
    for x in embeddings._unit(sample):
        if len(one_by_one) < 300 and all(x @ y < 0.7 for y in one_by_one):
            one_by_one.append(x)
    assert np.allclose(got, np.array(one_by_one))


def test_shared_counts():
    r = np.random.default_rng(5)
    left, right = r.integers(-1, 12, (40, 6)), r.integers(-1, 12, (50, 6))
    left, right = (np.array([np.where(np.arange(6) < len(u := np.unique(row)), np.resize(u, 6), -1) for row in side]) for side in (left, right))
    want = [[len((set(a) & set(b)) - {-1, 3}) for b in right.tolist()] for a in left.tolist()]
    assert embeddings._shared_counts(left, right, 3).tolist() == want


def test_memory_of_a_unit():
    """Two blocks of 16,384 vectors among 16,384 pivots, under 300 MB."""
    r = np.random.default_rng(6)
    n, lists = 32_768, embeddings.lists_for(16_384)
    near = r.integers(1, 16_384, (n, 2 * lists)).astype("<i4")
    near[:, 0] = 0
    x = r.normal(size=(n, 64)).astype("<f4")
    payload = [struct.pack("<qq", i, 1) + near[i].tobytes() + x[i].tobytes() for i in range(n)]
    meta = np.where(np.arange(n) % 2, 3, 1)
    table = pa.table({"unit": pa.array(np.zeros(n, np.int64)), "meta": pa.array(meta), "payload": pa.array(payload, pa.binary())})
    tracemalloc.start()
    embeddings._match(table, 0.93, 2 * lists, lists, 2, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6

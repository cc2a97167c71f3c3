"""Box joins against brute force: sizes over six orders of magnitude, dense pages, greedy matches."""

import random

import pytest
from pyspark.sql import functions as F

from docmetrics.operators import matching

SCHEMA = "id int, {} int, box struct<x1:double,y1:double,x2:double,y2:double>"


def boxes(r, n):
    out = []
    for i in range(n):
        w, h = (r.choice([0.0, 0.5, 10.0, 64.0, r.uniform(1, 300), 70_000.0 if i % 40 == 0 else 20.0]) for _ in range(2))
        x, y = (r.choice([r.uniform(-500, 500), float(r.randint(-8, 8) * 16)]) for _ in range(2))
        out.append((r.choice([1, 1, 2, 3]), i, (x, y, x + w, y + h)))
    return out + [(1, n, None), (2, n + 1, (0.0, None, 5.0, 5.0)), (2, n + 2, (5.0, 5.0, 1.0, 9.0)), (None, n + 3, (0.0, 0.0, 9.0, 9.0))]


def valid(b):
    return b is not None and None not in b and b[0] <= b[2] and b[1] <= b[3]


def meet(a, b):
    return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]


def iou(a, b):
    both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


@pytest.mark.parametrize("seed", [1, 2])
def test_overlapping(spark, seed):
    r = random.Random(seed)
    a, b = boxes(r, 220), boxes(r, 180)
    got = matching.overlapping(spark.createDataFrame(a, SCHEMA.format("p")), spark.createDataFrame(b, SCHEMA.format("q")))
    pairs = sorted((x["l"]["p"], x["r"]["q"]) for x in got.collect())
    want = sorted((i, j) for k, i, x in a for m, j, y in b if k is not None and k == m and valid(x) and valid(y) and meet(x, y))
    assert pairs == want and len(want) > 200
    assert matching.overlapping(spark.createDataFrame(a, SCHEMA.format("p")).where("false"), spark.createDataFrame(b, SCHEMA.format("q"))).collect() == []


def test_tall_boxes_make_few_rows(spark):
    tall = spark.createDataFrame([(1, 1, (0.0, 0.0, 64_000.0, 64_000.0)), (1, 2, (3.0, 3.0, 9.0, 9.0))], SCHEMA.format("p"))
    placed = matching._placed(tall, "box")
    levels = [(r[0], r[1]) for r in placed.select("_lx", "_ly").distinct().collect()]
    assert matching._cells(placed, "id", "box", "l", levels).count() <= 12


def test_a_page_of_20000_boxes(spark):
    """The pairs that meet in a cell stay a small multiple of the boxes."""
    n = F.col("id")
    page = spark.range(20_000).select(F.lit(1).alias("k"), n.cast("int").alias("p"), F.struct((n % 100 * 40).cast("double").alias("x1"), F.floor(n / 100).cast("double").alias("_"), F.lit(0.0).alias("z")).alias("s"))
    box = F.struct(F.col("s.x1").alias("x1"), (F.col("s._") * 12).alias("y1"), (F.col("s.x1") + 35).alias("x2"), (F.col("s._") * 12 + 10).alias("y2"))
    page = page.select(F.lit(1).alias("id"), "p", box.alias("box"))
    placed = matching._placed(page, "box")
    levels = [(r[0], r[1]) for r in placed.select("_lx", "_ly").distinct().collect()]
    a = matching._cells(placed, "id", "box", "l", levels)
    met = a.groupBy("_at", "_x", "_y").count().agg(F.max("count"), F.sum(F.col("count") * F.col("count"))).first()
    assert met[0] < 40 and met[1] < 20 * 20_000
    hits = matching.greedy_match(page.withColumnRenamed("p", "pred"), page.withColumnRenamed("p", "gt"))
    assert hits.count() == hits.where("pred = gt").count() == 20_000


@pytest.mark.parametrize("driven_by", ["pred", "gt"])
def test_greedy(spark, driven_by):
    r = random.Random(9)
    base = [(k, i, (x, y, x + 50, y + 20)) for k in (1, 2, None) for i, (x, y) in enumerate((r.uniform(0, 150), r.uniform(0, 80)) for _ in range(40))]
    shift = lambda b: (b[0] + r.uniform(-6, 6), b[1] + r.uniform(-3, 3), b[2] + r.uniform(-6, 6), b[3] + r.uniform(-3, 3))
    pred, gt = base, [(k, i, r.choice([b, shift(b)])) for k, i, b in base]
    want = set()
    for doc in (1, 2):
        p, g = ({i: b for k, i, b in side if k == doc} for side in (pred, gt))
        used = set()
        for i in sorted(p if driven_by == "pred" else g):
            other = g if driven_by == "pred" else p
            mine = (p if driven_by == "pred" else g)[i]
            best = max(((iou(mine, b), j) for j, b in other.items() if j not in used), default=(0, 0))
            if best[0] >= 0.5:
                used.add(best[1])
                want.add((doc, i, best[1]) if driven_by == "pred" else (doc, best[1], i))
    found = matching.greedy_match(spark.createDataFrame(pred, SCHEMA.format("pred")), spark.createDataFrame(gt, SCHEMA.format("gt")), driven_by)
    assert {(x["id"], x["pred"], x["gt"]) for x in found.collect()} == want

"""Order statistics of huge groups, field accuracy and choices by value against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from docmetrics.operators import quantiles, scoring


@pytest.mark.parametrize(("limit", "parts"), [(500_000, 64), (300, 8), (5, 4)])
def test_order_statistics(spark, limit, parts):
    """A third of the rows in one group of distinct doubles, a group of one repeated value, small ones, a null key, null and NaN values."""
    r = random.Random(limit)
    rows = [("big", r.gauss(0, 1e6), r.randrange(50)) for _ in range(4000)] + [("same", 7.5, 1)] * 3000
    rows += [(r.choice(["a", "b", None]), r.choice([r.random(), None, float("nan"), 1.0, -0.5]), r.randrange(3)) for _ in range(5000)]
    rows += [("none", None, None)]
    df = spark.createDataFrame(rows, "g string, v double, k long").repartition(6)
    places = {"low": quantiles.LOWER, "high": quantiles.UPPER, "p90": lambda n: F.floor(n * F.lit(0.9)), "first": lambda n: F.lit(0), "beyond": lambda n: n}
    wanted = {"v": places, "k": {"k_low": quantiles.LOWER, "k_last": lambda n: n - 1}}
    got = {x["g"]: x.asDict() for x in quantiles.order_statistics(df, ["g"], wanted, limit, parts).collect()}
    groups = {}
    for g, v, k in rows:
        groups.setdefault(g, ([], []))
        if v is not None:
            groups[g][0].append(v)
        if k is not None:
            groups[g][1].append(k)
    order = lambda v: (math.isnan(v), 0 if math.isnan(v) else v)
    want = {}
    for g, (v, k) in groups.items():
        if v or k:
            v, k, n = sorted(v, key=order), sorted(k), len(v)
            at = lambda p: v[p] if 0 <= p < n else None  # noqa: B023, E731
            want[g] = {"g": g, "low": at((n - 1) // 2), "high": at(n // 2), "p90": at(math.floor(n * 0.9)), "first": at(0), "beyond": None, "k_low": float(k[(len(k) - 1) // 2]), "k_last": float(k[-1])}
    assert str(sorted(got.items(), key=str)) == str(sorted(want.items(), key=str))


def test_a_huge_group_is_cut(spark):
    """A group of distinct doubles: what is left to rank after one round is a small part of it, by each wanted place."""
    df = spark.range(200_000).select(F.struct(F.lit("g").alias("b")).alias("g"), F.lit("").alias("path"), F.rand(3).alias("v"), F.lit(1).cast("long").alias("w"))
    targets = spark.createDataFrame([("m", 100_000), ("last", 199_999)], "name string, p long").select(F.struct(F.lit("g").alias("b")).alias("g"), F.lit("").alias("path"), "name", "p")
    kept, places = quantiles._narrowed(df, targets, 64)
    assert kept.groupBy("path").count().agg(F.max("count")).first()[0] < 2 * 200_000 / 64
    assert kept.count() < 4 * 200_000 / 64 and places.count() == 2


def test_no_groups(spark):
    df = spark.range(1001).select((F.col("id") * 37 % 1001).alias("v"))
    assert quantiles.order_statistics(df, [], {"v": {"m": quantiles.LOWER}}, 10, 4).collect()[0]["m"] == 500
    assert quantiles.order_statistics(df.where("false"), [], {"v": {"m": quantiles.LOWER}}).collect()[0]["m"] is None


def test_field_accuracy(spark):
    truth = spark.createDataFrame([("d1", "a", "1 0"), ("d1", "b", "2"), ("d2", "a", "x"), ("d2", "b", None), ("d2", "c", "z"), ("d3", "a", "q"), ("bad", "a", "1")], "id string, name string, value string")
    pred = spark.createDataFrame([("d1", "a", "10", True), ("d1", "x", None, None), ("d1", "y", "w", True), ("d2", "b", None, False), ("d2", "c", "Z", False), ("d4", "n", "1", False), ("bad", "a", "1", True)], "id string, name string, value string, grounded boolean")
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    got = scoring.field_accuracy(truth, pred, norm=bare, broken=spark.createDataFrame([("bad",), ("bad",)], "id string")).first().asDict()
    # d1: three predicted, one right; d2: two predicted of three; d3 lacks its only field; d4 is not in the truth
    assert got == {"fields": 8, "correct": 2, "ungrounded_ok": 0, "ungrounded_bad": 2, "grounded_bad": 2, "broken": 1}
    three = spark.createDataFrame([("d", "a", "1"), ("d", "b", "2")], "id string, name string, value string")
    said = spark.createDataFrame([("d", "a", "1", True), ("d", "x", None, True), ("d", "y", "5", True)], "id string, name string, value string, grounded boolean")
    r = scoring.field_accuracy(three, said).first()
    assert (r["fields"], r["correct"], r["grounded_bad"]) == (3, 1, 2)
    assert scoring.document_fields(three, said).first()["wrong"]
    assert not scoring.document_fields(three, three.withColumn("grounded", F.lit(True))).first()["wrong"]
    assert scoring.field_accuracy(three.where("false"), said.where("false")).first()["fields"] == 0


def test_choices_with_nulls(spark):
    df = spark.createDataFrame([("g", 0.9, "a", 1), ("g", None, "b", 0), ("h", None, "c", 2), ("h", None, "d", 1), ("m", -0.5, "e", 1), ("m", None, "f", 2)], "g string, v double, name string, o int")
    assert {(r["g"], r["name"], r["v"]) for r in scoring.argmin_by(df, ["g"], "v", "name", "o").collect()} == {("g", "a", 0.9), ("h", "d", None), ("m", "e", -0.5)}
    assert {(r["g"], r["name"], r["v"]) for r in scoring.argmax_by(df, ["g"], "v", "name", "o").collect()} == {("g", "a", 0.9), ("h", "d", 0.0), ("m", "f", 0.0)}

"""Interval joins, sketches and streams in turns against plain Python."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from docmetrics import plans
from docmetrics.operators import intervals, sketches
from docmetrics.streaming import joins, windows


@pytest.mark.parametrize(("width", "hot"), [(10.0, 50_000), (3.0, 20), (0.5, 7)])
def test_interval_join(spark, width, hot):
    """Lengths over five orders of magnitude, a key and a moment with a third of all rows, touching, empty, null and repeated intervals."""
    r = random.Random(hot)

    def side(n):
        out = []
        for i in range(n):
            s = r.choice([r.uniform(-50, 50), float(r.randint(-20, 20)), 5.0])
            out.append((i, r.choice([1, 1, 2, 3, None]), s, s + r.choice([0.0, 0.01, 1.0, 3.0, r.uniform(0, 30), 500.0 if i % 20 == 0 else 2.0])))
        return out + [(n, 2, None, 5.0), (n + 1, 2, 5.0, None), (n + 2, 2, 7.0, 3.0), (n + 3, 3, 1.0, 2.0), (n + 3, 3, 1.0, 2.0)]

    a, b = side(160), side(140)
    schema = "i long, k int, start double, end double"
    got = intervals.interval_join(spark.createDataFrame(a, schema).repartition(3), spark.createDataFrame(b, schema).repartition(2), ["k"], width=width, hot=hot)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    fine = lambda x: x[1] is not None and x[2] is not None and x[3] is not None and x[2] < x[3]
    want = sorted((x[0], y[0]) for x in a for y in b if fine(x) and fine(y) and x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    assert sorted((x["l"]["i"], x["r"]["i"]) for x in got.collect()) == want and len(want) > 500


def test_interval_join_edges(spark):
    df = spark.createDataFrame([(1, 0.0, 1e9)], "k int, start double, end double")
    assert intervals.interval_join(df, df, ["k"], width=1.0).count() == 1
    assert intervals.interval_join(df, df.where("false"), ["k"]).count() == 0
    spread = intervals._bucketed(df.select("k", F.struct("*").alias("_row"), F.col("start").alias("_start"), F.col("end").alias("_end"), intervals._level(F.col("start"), F.col("end"), 1.0).alias("_level")), "l", ["k"], 1.0, [0, 3])
    assert spread.count() <= intervals.SPREAD


def test_sketches_merge(spark):
    """Merged from parts, in any order, the estimates stay within their bounds of the exact results."""
    df = spark.range(60_000).select((F.col("id") % 7).alias("day"), F.when(F.col("id") % 3 > 0, "x").otherwise("y").alias("kind"), (F.col("id") * 7919 % 20_011).alias("user"), (F.col("id") * 104_729 % 60_013).cast("double").alias("v"), F.when(F.col("id") % 10 < 4, 1).otherwise(F.col("id") % 500 + 2).alias("item"))
    daily = sketches.sketched(df, ["day", "kind"], "user", "v", "item")
    once = sketches.merged(daily, ["kind"])
    for found in (once, sketches.merged(sketches.merged(daily, ["day", "kind"]), ["kind"])):
        for row in sketches.estimates(found, [0.1, 0.5, 0.99], 2).collect():
            mine = df.where(F.col("kind") == row["kind"])
            users = mine.select("user").distinct().count()
            assert row["n"] == mine.count() and abs(row["distinct"] - users) <= users * sketches.DISTINCT_ERROR
            for share, value in zip([0.1, 0.5, 0.99], row["value"], strict=True):
                assert abs(mine.where(F.col("v") <= value).count() / row["n"] - share) <= sketches.RANK_ERROR
            assert row["item"][0]["item"] == 1 and row["item"][0]["count"] >= mine.where("item = 1").count()
    assert sketches.estimates(sketches.merged(daily.where("false"), ["kind"]), [0.5], 1).collect() == []


def test_sketches_of_even_items(spark):
    """More items than the sketch tracks, none or one of which stands out: the first three are counted exactly; nulls are no items."""
    rows = [(i % 3, None if i // 3 % 2 else "x", None if i % 10 == 9 else i) for i in range(12_000)] + [(1, "x", 7)] * 30 + [(2, "x", None)] * 50 + [(2, None, 4000), (0, "y", 5), (0, "z", None)]
    df = spark.createDataFrame([(*r, float(r[0])) for r in rows], "day int, kind string, item long, v double").repartition(5)
    found = sketches.estimates(sketches.merged(sketches.sketched(df, ["day", "kind"], "item", "v", "item"), ["kind"]), [0.5], 3)
    assert {r["kind"]: len(r["item"]) for r in found.collect()} == {None: 0, "x": 1, "y": 1, "z": 0}
    got = {r["kind"]: [tuple(i) for i in r["item"]] for r in sketches.completed(found, df, ["kind"], "item", 3).collect()}
    assert got == {None: [(4000, 2), (3, 1), (4, 1)], "x": [(7, 31), (0, 1), (1, 1)], "y": [(5, 1)], "z": []}


DAY, NAN = datetime.datetime(2024, 1, 1), float("nan")


@pytest.mark.parametrize(
    "rows",
    [
        [(i, DAY, i // 2, "x" if i % 2 else "y", float(i % 97)) for i in range(8000)],
        [(i, DAY, i % 5, "x" if i % 2 else None, float(i)) for i in range(300)],
        [(i, DAY, i % 5, "x", 5.0) for i in range(300)],
        [(i, DAY, i % 5, "x", NAN if i % 2 else float(i)) for i in range(300)],
        [(i, None, None, "x", NAN if i % 2 else None) for i in range(300)],
    ],
    ids=["even users", "null kind", "one value", "some NaN", "nulls and NaN"],
)
def test_sketches_query(spark, tmp_path, rows):
    """One row a kind, and all true."""
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_type"]: tuple(r)[1:] for r in plans.QUERIES["qx20_sketches"](spark, str(tmp_path)).collect()}
    assert got == {kind: (sum(r[3] == kind for r in rows), True, True, True, True) for kind in {r[3] for r in rows}}


def at(hour, minute=0):
    return datetime.datetime(2024, 1, 1 + hour // 24, hour % 24, minute)


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "ts timestamp, value double"
    first = spark.createDataFrame([(at(0, 10), 1.0), (at(1, 10), 1.0), (at(9), 1.0)], schema)
    # the watermark is at 7:00: the first row is too late, the second is not, as its window is still open
    second = spark.createDataFrame([(at(0, 50), 1.0), (at(6, 30), 5.0), (at(7, 30), 5.0), (at(20), 1.0)], schema)
    out = joins.run_in_turns(spark, [first, second], lambda s: windows.tumbling(s, "1 hour", [], late="2 hours"), f"file://{tmp_path}/late")
    assert sorted((r["start"].hour, r["n"], r["total"]) for r in out.collect()) == [(0, 1, 1.0), (1, 1, 1.0), (7, 1, 5.0), (9, 1, 1.0)]


def test_stream_join_holds_state(spark, tmp_path):
    schema = "ts timestamp, user int, kind string"
    rows = [(at(1), 1, "a"), (at(1, 30), 1, "b"), (at(2), 1, "a"), (at(2), None, "a"), (at(2), None, "b")], [(at(2, 59), 1, "b"), (at(3), 1, "b"), (at(3, 1), 1, "b"), (at(3), 2, "b")]
    turns = [spark.createDataFrame(x, schema) for x in rows]
    both = lambda s: joins.follows(s.where("kind = 'a'"), s.where("kind = 'b'"), ["user"], "1 hour", "30 minutes").select("user", F.col("l.ts").alias("a"), F.col("r.ts").alias("b"))
    out = joins.run_in_turns(spark, turns, both, f"file://{tmp_path}/pairs")
    batch = both(turns[0].unionByName(turns[1]))
    got = sorted((r["a"], r["b"]) for r in out.where("user = 1").collect())
    assert got == sorted((r["a"], r["b"]) for r in batch.where("user = 1").collect()) == [(at(1), at(1, 30)), (at(2), at(2, 59)), (at(2), at(3))]

"""Sources, sinks, recogniser boundary, streams."""

import json

from pyspark.sql import functions as F

from docmetrics.operators import recognize, sampling
from docmetrics.sources import corpus, sinks
from docmetrics.streaming import service


def test_corpus(spark, tmp_path):
    doc = {"id": "card_01", "category": "card", "source": "rendered", "width": 10, "height": 5, "text": "ab\ncd", "lines": [{"text": "ab", "block": "text", "poly": [[0, 0], [2, 0], [2, 1], [0, 1]]}, {"text": "cd", "block": "text", "poly": [[0, 2], [2, 2], [2, 3], [0, 3]]}]}
    (tmp_path / "gt").mkdir()
    for k in ("01", "02"):
        (tmp_path / "gt" / f"card_{k}.json").write_text(json.dumps(doc | {"id": f"card_{k}", "category": "card" if k == "01" else "table"}, indent=1))
    truth = corpus.read_truth(spark, str(tmp_path / "gt"))
    m = corpus.build_manifest(truth)
    assert [(r["id"], r["chars"], r["lines"]) for r in m.collect()] == [("card_01", 4, 2), ("card_02", 4, 2)]
    m.write.json(str(tmp_path / "manifest"))
    samples = corpus.load_samples(spark, str(tmp_path / "manifest"), str(tmp_path / "gt"), ["card"]).collect()
    assert [(s["id"], s["gt_doc"]["text"]) for s in samples] == [("card_01", "ab\ncd")]
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "paddle__ko.json").write_text(json.dumps({"_meta": {"text": "x"}, "card_01": {"text": "ab", "tables": [], "time": 0.5, "error": False}}))
    r = corpus.read_results(spark, str(tmp_path / "out"))
    assert [tuple(x)[:4] for x in r.collect()] == [("paddle", "ko", "card_01", "ab")]
    both = corpus.with_truth_engine(r, truth)
    assert both.where("engine = 'gt'").count() == 2
    joined = corpus.truth_with_predictions(truth.select("id", "text"), r.select("id", "text"))
    assert {x["id"]: x["hyp"] for x in joined.collect()} == {"card_01": "ab", "card_02": ""}
    sinks.write_results(r, str(tmp_path / "saved"))
    assert spark.read.parquet(str(tmp_path / "saved")).where("engine = 'paddle'").count() == 1


def test_labels(spark, tmp_path):
    (tmp_path / "lab").mkdir()
    (tmp_path / "img").mkdir()
    (tmp_path / "lab" / "a.json").write_bytes(json.dumps({"annotations": [{"text": "가", "bbox": [1, 2, 3, 4]}, {"text": "XXX", "bbox": [0, 0, 1, 1]}]}, ensure_ascii=False).encode("cp949"))
    (tmp_path / "img" / "a.jpg").write_bytes(b"x")
    (tmp_path / "img" / "b.jpg").write_bytes(b"x")
    p = corpus.label_image_pairs(spark, str(tmp_path / "lab"), str(tmp_path / "img"))
    words = p.select(corpus.read_scene_words(F.col("label")).alias("w")).first()["w"]
    assert [(w["text"], w["ignore"]) for w in words] == [("가", False), ("XXX", True)]
    assert words[0]["poly"][2] == [4.0, 6.0]
    photo = json.dumps({"annotations": [{"polygons": [{"text": "a", "type": 1, "points": [[0, 0], [2, 3]]}, {"text": "b", "type": 0, "points": [[0, 0], [1, 1]]}]}]})
    w = spark.range(1).select(corpus.read_photo_words(F.lit(photo)).alias("w")).first()["w"]
    assert [(x["kind"], x["ignore"]) for x in w] == [("print", False), (None, True)]
    hand = json.dumps({"bbox": [{"data": "z", "x": [0, 1, 1, 0], "y": [0, 0, 2, 2]}]})
    w = spark.range(1).select(corpus.read_hand_words(F.lit(hand)).alias("w")).first()["w"]
    assert w[0]["poly"] == [[0, 0], [1, 0], [1, 2], [0, 2]] and w[0]["kind"] == "hand"


def test_reports(spark):
    a = spark.createDataFrame([("x", 0.5)], "engine string, cer double")
    b = spark.createDataFrame([("y", 3)], "engine string, pages int")
    lines = [r["line"] for r in sinks.markdown_report(sinks.union_reports([a, b])).orderBy("no", "line").collect()]
    assert lines == ["| engine | cer | pages |", "|---|---|---|", "| x | 0.500 | - |", "| y | - | 3 |"]
    page = spark.sql("select 'f.pdf' filename, 1 page, 0.12345D seconds, named_struct('text', 'a', 'warnings', array('w')) result")
    assert json.loads(sinks.document_json(page).first()["json"])["warnings"] == 1


def test_recogniser(spark):
    class Broken:
        def read(self, doc):
            raise ValueError(doc["id"])

    docs = spark.createDataFrame([("1", "hello world" * 20), ("2", None)], "id string, text string")
    a = {r["id"]: r["text"] for r in recognize.recognize(docs, recognize.SimulatedRecognizer).collect()}
    b = {r["id"]: r["text"] for r in recognize.recognize(docs.repartition(3), recognize.SimulatedRecognizer).collect()}
    assert a == b and 0 < len(a["1"]) < 220 and a["2"] == ""
    assert [r["error"] for r in recognize.recognize(docs, Broken).collect()] == [True, True]
    cache = spark.createDataFrame([("1",)], "id string")
    assert [r["id"] for r in recognize.recognize_missing(docs, cache, recognize.SimulatedRecognizer).collect()] == ["2"]


def test_sampling(spark):
    df = spark.range(100, numPartitions=7).select((F.col("id") * 37 % 101).alias("id"))
    want = sorted(r["id"] for r in df.collect())[2::5]
    assert sorted(r["id"] for r in sampling.every_kth(df, 5, 2).collect()) == want
    assert sampling.seeded_sample(df, 10, 3).collect() == sampling.seeded_sample(df.repartition(3), 10, 3).collect()


def test_service(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(10).select("id", (F.col("id") % 3 * 10).alias("size")).repartition(5).write.parquet(src)
    stream = service.intake(spark, src, "id long, size long", 1)
    run = service.run_jobs(stream, lambda b: b.withColumn("done", F.lit(True)), str(tmp_path / "sink"), str(tmp_path / "cp"))
    run.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "sink"))
    assert out.count() == 10 and out.select("batch").distinct().count() == len(spark.read.parquet(src).inputFiles())
    assert not service.progress(run)["active"]
    ok, refused = service.split_valid(spark.range(10).withColumn("size", F.col("id") % 2), F.when(F.col("size") == 0, 400).otherwise(200))
    assert ok.count() == refused.count() == 5
    assert service.round_robin(spark.range(9, numPartitions=1), 3).groupBy("server").count().where("count <> 3").count() == 0


def test_every_kth_of_wide_rows(spark):
    """Ties and nulls in the order column, wide rows, many partitions, adaptive execution on."""
    df = spark.range(20_000, numPartitions=32).select(F.when(F.col("id") % 50 != 0, F.col("id") * 37 % 701).alias("k"), F.col("id").alias("v"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 20).alias("text"))
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        parts = [sampling.every_kth(df, 3, shard, "k").select("k", "v", F.md5("text").alias("m")).collect() for shard in range(3)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [len(p) for p in parts] == [6667, 6667, 6666]
    assert sorted(r["v"] for p in parts for r in p) == list(range(20_000))
    ordered = sorted(((r["k"] is not None, r["k"]) for r in df.select("k").collect()))
    for shard, part in enumerate(parts):
        assert sorted((r["k"] is not None, r["k"]) for r in part) == ordered[shard::3]


def test_first_valid(spark):
    df = spark.range(50, numPartitions=5)
    assert [r["id"] for r in sampling.first_valid(df, 4, F.when(F.col("id") > 9, F.col("id") % 3 == 0)).collect()] == [12, 15, 18, 21]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("가", 1), ("b|c", 2)], "name string, n int").coalesce(1)
    sinks.write_csv(df, str(tmp_path / "csv"), bom=True)
    raw = next((tmp_path / "csv").glob("*.csv")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfname,n") and "가,1" in raw.decode("utf-8-sig")
    grid = spark.sql("select array(array('h', 'i'), array('a|b', null)) g, array(array('x')) one, cast(array() as array<array<string>>) none")
    got = grid.select(*(sinks.grid_markdown(F.col(c)).alias(c) for c in grid.columns)).first()
    assert tuple(got) == ("| h | i |\n|---|---|\n| a\\|b |  |", "| x |\n|---|", "")
    runs = spark.createDataFrame([("e", "d", "1", "x", [], 1.0, False), ("e", "d", "2", "y", [], 3.0, False), ("e", "d", "3", "", [], 9.0, True)], "engine string, dataset string, id string, text string, tables array<string>, time double, error boolean")
    sinks.write_run(runs, str(tmp_path / "run"), {"lang": "ko"})
    meta = spark.read.json(str(tmp_path / "run" / "runs")).first()
    assert (meta["n"], meta["errors"], meta["time_median"], meta["time_mean"], meta["opts"]["lang"]) == (3, 1, 2.0, 2.0, "ko")
    assert spark.read.parquet(str(tmp_path / "run" / "results")).count() == 3
    report = spark.createDataFrame([("b", 1), (None, 3), ("a", 2)], "name string, n int")
    assert [r["n"] for r in sinks.ordered_report(report, "name").collect()] == [2, 1, 3]


def test_pages_as_json_and_markdown(spark):
    page = spark.sql("select named_struct('text', 'a', 'lines', array('x')) p, 'f.pdf' f, 2 n, array(named_struct('name', 'total', 'value', '5')) fields")
    row = page.select(sinks.page_json(F.col("p")).alias("full"), sinks.page_json(F.col("p"), False).alias("short"), sinks.page_markdown(F.col("f"), F.col("n"), F.lit("receipt"), F.lit("vl"), F.lit(0), F.lit(" body "), F.col("fields")).alias("md")).first()
    assert json.loads(row["full"]) == {"text": "a", "lines": ["x"]} and json.loads(row["short"]) == {"text": "a"}
    assert row["md"] == "<!-- page 2 · file f.pdf · type receipt · engine vl · warnings 0 -->\nbody\n\n| field | value |\n|---|---|\n| total | 5 |"


def test_more_sources(spark, tmp_path):
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "p1.png").write_bytes(b"abc")
    (tmp_path / "img" / "note.txt").write_bytes(b"no")
    assert [(r["id"], r["size"], bytes(r["content"])) for r in corpus.read_images(spark, str(tmp_path / "img")).collect()] == [("p1", 3, b"abc")]
    (tmp_path / "t.json").write_text(json.dumps({"name": "d", "docs": ["a", "b"], "pages": ["x", "y"]}, indent=1))
    assert [tuple(r) for r in corpus.read_page_truth(spark, str(tmp_path / "t.json")).orderBy("page").collect()] == [("d", 0, "a", "x"), ("d", 1, "b", "y")]
    docs = spark.createDataFrame([("1", "rendered"), ("2", "photo")], "id string, source string")
    assert [r["id"] for r in corpus.originals(docs).collect()] == ["1"]
    cache = spark.createDataFrame([("1", "rendered")], docs.schema)
    path = str(tmp_path / "cache")
    cache.write.parquet(path)
    whole = corpus.extend_cache(cache, corpus.missing_from_cache(docs, cache), path)
    assert sorted(r["id"] for r in whole.collect()) == ["1", "2"] and corpus.missing_from_cache(docs, whole).count() == 0
    (tmp_path / "stages.csv").write_text("stage,calls,ms\ndetect,2,30\nnoise\nread,4,10,odd\nread,4,10\n")
    times = {r["stage"]: (r["calls"], r["share"]) for r in corpus.read_stage_times(spark, str(tmp_path / "stages.csv"), ["detect", "read"]).collect()}
    assert times == {"detect": (2.0, 0.75), "read": (4.0, 0.25)}


def test_admission_and_times(spark):
    status = spark.range(5).select(service.admission(F.col("id"), 30).alias("a")).select("a.*").collect()
    assert [tuple(r) for r in status] == [(200, None), (200, None), (503, 5), (503, 5), (503, 5)]
    job = spark.sql("select timestamp '2026-01-01 00:00:00' queued, timestamp '2026-01-01 00:00:01.5' started, timestamp '2026-01-01 00:00:03' done")
    assert tuple(service.job_times(job).select("queue_wait_ms", "elapsed_ms").first()) == (1500, 1500)
    dealt = service.round_robin(spark.range(8, numPartitions=8), 4).groupBy("server").count().collect()
    assert sorted(r["count"] for r in dealt) == [2, 2, 2, 2]


def test_embedding_and_sweep(spark):
    docs = spark.createDataFrame([(str(i), f"text number {i}") for i in range(20)], "id string, text string")
    embed = recognize.embedder(lambda: recognize.hashed_trigrams(16), 4)
    got = docs.select("id", "text", embed("text").alias("v")).collect()
    want = recognize.hashed_trigrams(16)([r["text"] for r in got])
    assert all(abs(a - b) < 1e-6 for r, w in zip(got, want, strict=True) for a, b in zip(r["v"], w, strict=True))
    sweep = {r["workers"]: (r["images"], r["images_per_s"] > 0) for r in recognize.concurrency_sweep(docs, recognize.SimulatedRecognizer, (1, 3)).collect()}
    assert sweep == {1: (20, True), 3: (20, True)}
    warmed = []

    class Slow:
        def read(self, doc):
            warmed.append(doc["id"])
            if doc["id"] == "warm":
                return "", []
            return ",".join(warmed[:1]), []

    assert {r["text"] for r in recognize.recognize(docs.limit(3).coalesce(1), Slow, {"id": "warm", "text": ""}).collect()} == {"warm"}


def test_events_without_repeats(spark, tmp_path):
    from docmetrics.streaming import windows

    src = str(tmp_path / "in")
    spark.sql("select id % 3 k, timestamp '2026-01-01 00:00:00' ts from range(9)").write.parquet(src)
    stream = spark.readStream.schema("k long, ts timestamp").parquet(src)
    windows.first_events(stream, ["k"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2]


def test_generated_records(spark):
    from docmetrics.functions import text
    from docmetrics.operators import extraction, generate

    inv = generate.invoices(spark, 200, 7)
    assert inv.select(F.size(extraction.invoice_errors(F.col("fields"))).alias("n")).where("n > 0").count() == 0
    rec = generate.receipts(spark, 200, 7)
    assert rec.select(F.size(extraction.receipt_errors(F.col("fields"))).alias("n")).where("n > 0").count() == 0
    assert all(r["fields"]["vat"] == round(r["fields"]["total"] / 11) for r in rec.collect())
    assert sorted(rec.collect()) == sorted(generate.receipts(spark, 200, 7).repartition(5).collect()) != sorted(generate.receipts(spark, 200, 8).collect())
    assert inv.where(F.col("fields.supplier.name") == F.col("fields.buyer.name")).count() == 0
    assert inv.where(~text.biz_number_valid(F.col("fields.buyer.biz_no"))).count() == 0
    assert generate.cards(spark, 5).where("fields.email like 'p%@example.com' and fields.mobile like '010-0000-%'").count() == 5


def test_what_counts(spark):
    from docmetrics.operators import scoring

    rows = spark.sql("select * from values (1, true, array(named_struct('ignore', false))), (2, false, array(named_struct('ignore', true))), (3, null, array(named_struct('ignore', false), named_struct('ignore', true))) as t(id, flipped, words)")
    assert [r["id"] for r in scoring.scorable(rows, words="words").collect()] == [3]
    out = spark.createDataFrame([(1, "ab" * 500, "stop", False), (2, "plain", "length", False), (3, "", "stop", True), (4, "fine", "stop", None)], "id int, text string, finish string, error boolean")
    assert sorted(tuple(r) for r in scoring.failures(out).collect()) == [(1, True, False, False), (2, False, True, False), (3, False, False, True)]
    ref = spark.createDataFrame([(1, "a", False), (1, "b", True), (1, "a", None)], "id int, word string, ignore boolean")
    hyp = spark.createDataFrame([(1, "a"), (1, "b")], "id int, word string")
    s = scoring.bag_scores(ref, hyp, ignore="ignore").first()
    assert (s["hit"], s["n_hyp"], s["n_ref"]) == (1, 2, 2)


def test_parents_and_retries(spark):
    docs = spark.createDataFrame([("a", None, "x"), ("b", "a", "y"), ("c", "zz", "x")], "id string, parent string, text string")
    assert [(r["id"], r["origin"]["text"]) for r in corpus.with_parent(docs).collect()] == [("b", "x")]
    assert [tuple(r) for r in corpus.copies_of(docs.select("id", "text"), "id", "text").collect()] == [("c", "a")]
    truth = spark.createDataFrame([(1, 0, "p"), (1, 1, "q")], "id int, pos int, want string")
    got = spark.createDataFrame([(1, 0, "p"), (1, 5, "r")], "id int, pos int, got string")
    assert sorted(tuple(r) for r in corpus.by_position(truth, got).collect()) == [(1, 0, "p", "p"), (1, 1, "q", "")]

    class Shaky:
        def __init__(self):
            self.calls = 0

        def read(self, doc):
            self.calls += 1
            if self.calls < 3:
                raise ValueError("not yet")
            return "read", []

    one = spark.createDataFrame([("1", "t")], "id string, text string")
    assert [r["error"] for r in recognize.recognize(one, Shaky, attempts=2).collect()] == [True]
    assert [r["text"] for r in recognize.recognize(one, Shaky, attempts=3).collect()] == ["read"]


def test_written_tables(spark):
    """Tables written by several threads at once, told within a block, deleted; the session's setting is as before."""
    import os
    from concurrent.futures import ThreadPoolExecutor

    from docmetrics import shared

    before = spark.conf.get(shared.CLEAN_UP, "false")
    with ThreadPoolExecutor(4) as pool:
        counts = list(pool.map(lambda n: shared.materialize(spark.range(n).groupBy((F.col("id") % 7).alias("k")).count(), "t", n).count(), (10, 100, 1000, 10_000)))
    assert counts == [7, 7, 7, 7] and spark.conf.get(shared.CLEAN_UP) == before
    with shared.written_tables() as outer:
        one = shared.materialize(spark.range(3), "one")
        with shared.written_tables() as inner:
            two = shared.materialize(spark.range(4), "two")
    shared.materialize(spark.range(5), "three")
    assert [t is x for t, x in zip(outer, (one, two), strict=True)] == [True, True] and len(inner) == 1
    shared.discard(one, spark.range(1))
    place = lambda t: t._docmetrics_path.removeprefix("file:")
    assert not os.path.exists(place(one)) and os.path.exists(place(two)) and two.count() == 4

"""JSON walks, damaged answers, pages of documents and result files."""

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from docmetrics.functions import jsontext
from docmetrics.operators import answers
from docmetrics.sources import pages, results, sinks


def walk(value):
    if isinstance(value, str):
        return [value]
    if isinstance(value, dict):
        value = [v for k, v in value.items() if k != "type"]
    return [s for v in value for s in walk(v)] if isinstance(value, list) else []


def nested(r, depth=0):
    kind = r.random()
    if depth > 4 or kind < 0.4:
        return r.choice(["", "a", 'q"uo"te', "back\\slash\\", "\\\"", "{[", "]}:,", "type", "é😀\n\t", "x\u0007", 1, -2.5, None, True])
    if kind < 0.7:
        return [nested(r, depth + 1) for _ in range(r.randint(0, 4))]
    return {r.choice(["type", "b", "a", "content", 'k"', "k:"]): nested(r, depth + 1) for _ in range(r.randint(0, 4))}


def test_json_strings(spark):
    r = random.Random(5)
    values = [nested(r) for _ in range(600)]
    texts = [json.dumps(v, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1])) for v in values] + [None, "", "{", "nope", '{"a": }', json.dumps({"t": ["x" * 100_000, "\\" * 50_000, "\"" * 50_000]})]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, j string").repartition(2).select("i", jsontext.json_strings(F.col("j")).alias("s"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    found = {x["i"]: x["s"] for x in got.collect()}
    assert [found[i] for i in range(600)] == [walk(v) for v in values]
    assert [found[600 + i] for i in range(5)] == [None] * 5 and found[605] == walk(json.loads(texts[605]))


def test_closed_is_json_wherever_it_is_cut(spark):
    whole = json.dumps({"id": 12, "name": 'a "b" \\ {é', "items": [{"x": -1.5e3, "y": None}, [True, False, "t"]], "z": {"w": "1"}, "last": 7})
    cuts = [whole[:n] for n in range(1, len(whole) + 1)]
    rows = spark.createDataFrame(list(enumerate(cuts)), "n int, j string").select("n", jsontext.closed(F.col("j")).alias("c")).collect()
    want = json.loads(whole)
    for r in rows:
        value = json.loads(r["c"])
        assert list(value) == list(want)[: len(value)] and all(value[k] == want[k] for k in list(value)[:-1])
    assert json.loads(max(rows, key=lambda r: r["n"])["c"]) == want


def test_parse_answers(spark):
    good = '{"a": 1, "b": "x", "more": [1]}'
    texts = [good, f"```json\n{good}\n```", f"It is {good}, I think.", None, "  ", "no", "[1]", '{"a": "one", "b": "x"}', '{"b": "x"}', '{"a": 2, "b": "y", "more": [1, {"c', '{"a": 2, "b": nul', '{"a": 1, "b": "x"} {"a": 2}']
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r for r in answers.parse_answers(rows, "a int, b string", ["a"]).collect()}
    assert [got[i]["_error"] for i in range(11)] == [None, None, None, "empty", "empty", "not json", "not json", "wrong type", "missing field", None, None]
    assert [got[i]["repaired"] for i in (0, 1, 2, 9, 10)] == [False, False, False, True, True]
    assert [tuple(got[i]["answer"]) for i in (0, 1, 2, 9, 10)] == [(1, "x")] * 3 + [(2, "y"), (2, None)]
    assert all(got[i]["answer"] is None for i in range(3, 9))
    parsed = answers.parse_answers(rows, "a int, b string", ["a"])
    assert {tuple(r) for r in answers.answer_fields(parsed).where("id = 9").collect()} == {(9, "a", "2"), (9, "b", "y")}
    assert answers.parse_answers(rows.where("false"), "a int", []).collect() == []


STUB = """
def pages(data):
    if data == b"bad":
        raise OSError("damaged")
    return [p.decode() for p in data.split(b"\\f")] if data else []
"""


def test_document_pages(spark, tmp_path):
    pages.register_pages(spark)
    (tmp_path / "stub_parser.py").write_text(STUB)
    spark.sparkContext.addPyFile(str(tmp_path / "stub_parser.py"))
    files = [(1, b"first page of text\r\n\fshort\f  " + b"y" * 12), (2, b"bad"), (3, b""), (4, None), (5, b"\f" * 9), (6, b"z" * 200)]
    spark.createDataFrame(files, "id int, content binary").createOrReplaceTempView("some_files")
    call = f"document_pages(content, 'stub_parser:pages', 4, 100, 10)"
    got = {(r["id"], r["page"]): (r["source"], r["text"], r["error"]) for r in spark.sql(f"SELECT id, p.* FROM some_files, LATERAL {call} p").collect()}
    assert got == {
        (1, 1): ("text", "first page of text", None), (1, 2): ("ocr", None, None), (1, 3): ("text", "y" * 12, None), (2, None): (None, None, "not opened: damaged"), (3, None): (None, None, "no pages"),
        (4, None): (None, None, "no data"), (5, None): (None, None, "more than 4 pages"), (6, None): (None, None, "more than 100 bytes"),
    }
    for wrong in ("document_pages(id, 'a:b')", "document_pages(content, 'nothing')", "document_pages(content, concat(string(id), ':x'))", "document_pages(content, 'a:b', -1)"):
        with pytest.raises(Exception):  # noqa: B017
            spark.sql(f"SELECT * FROM some_files, LATERAL {wrong} p").collect()


@pytest.mark.parametrize("split", [1, 7, 100, 1 << 20])
def test_results_by_stretches(tmp_path, split):
    """Whatever the split, every entry is read once: entries, keys and texts that look like marks, and the file's ends."""
    saved = {f"id{i}": {"text": f'line\n "k{i}": {{"' + "é" * (i % 40), "tables": ["<t>"] * (i % 3), "time": i / 4, "error": i % 5 == 0} for i in range(120)} | {"_meta": {"engine": "e", "n": 120}}
    path = tmp_path / "e__d.json"
    path.write_text(json.dumps(saved, ensure_ascii=False, indent=1), encoding="utf-8")
    reader = results.ResultReader(str(path), split, False)
    parts = reader.partitions()
    got = [row for p in parts for row in reader.read(p)]
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in got] == [(k, v["text"], v["tables"], v["time"], v["error"]) for k, v in saved.items() if k != "_meta"]
    assert (len(parts) > 1) == (split < path.stat().st_size)
    assert [json.loads(x[0]) for p in parts for x in results.ResultReader(str(path), split, True).read(p)] == [saved["_meta"]]


def test_results_round_trip(spark, tmp_path):
    results.register_results(spark)
    path = f"{tmp_path}/out"
    df = spark.range(500).select(F.concat(F.lit('k"\n'), "id").alias("id"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("t\n \""), "id")).alias("text"), F.array(F.lit("<t>")).alias("tables"), (F.col("id") / 8).alias("time"), (F.col("id") % 10 == 0).alias("error")).repartition(4)
    df.write.format("result_files").mode("append").option("meta.engine", "x").save(path)
    back = spark.read.format("result_files").option("split", 2000).load(path)
    assert back.rdd.getNumPartitions() > 8
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    df.limit(3).write.format("result_files").mode("append").save(path)
    assert spark.read.format("result_files").load(path).count() == 503
    meta = [json.loads(r["meta"]) for r in spark.read.format("result_files").option("meta", "true").load(path).collect()]
    assert sorted((m.get("engine", ""), m["n"], m["errors"]) for m in meta) == sorted([("x", 500, 50), ("", 3, df.limit(3).where("error").count())])
    failing = df.select(F.when(F.col("time") < 62, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).alias("id"), "text")
    with pytest.raises(Exception):  # noqa: B017
        failing.write.format("result_files").mode("overwrite").save(path)
    assert spark.read.format("result_files").load(path).count() == 503
    df.limit(2).write.format("result_files").mode("overwrite").save(path)
    assert spark.read.format("result_files").load(path).count() == 2
    (tmp_path / "flat.json").write_text('{"a": {"text": "x"}, "b": null, "_meta": {}}')
    assert sorted(r["id"] for r in spark.read.format("result_files").load(f"{tmp_path}/flat.json").collect()) == ["a", "b"]


def test_workbooks(spark, tmp_path):
    grid = [["a", None, "1", "007", "-2.5"], [], ["<&> \"é\"\n  x\u0001", "", "1e5"] + [None] * 30 + ["last"]]
    rows = spark.createDataFrame([(1, grid), (2, None), (3, [])], "id int, grid array<array<string>>").select("id", sinks.workbook_bytes("grid").alias("book"))
    cells = {r["id"]: r["c"] and [tuple(x) for x in r["c"]] for r in rows.select("id", sinks.workbook_cells("book").alias("c")).collect()}
    assert cells == {1: [(0, 0, "a"), (0, 2, "1"), (0, 3, "007"), (0, 4, "-2.5"), (2, 0, '<&> "é"\n  x'), (2, 1, ""), (2, 2, "1e5"), (2, 33, "last")], 2: None, 3: []}
    assert [sinks.column_letters(n) for n in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert sinks.write_files(rows.where("book is not null").select(F.concat(F.lit("a/"), "id", F.lit(".xlsx")).alias("name"), F.col("book").alias("content")), f"file://{tmp_path}/books") == 2
    with zipfile.ZipFile(tmp_path / "books/a/1.xlsx") as z:
        assert z.testzip() is None and len(z.namelist()) == 5
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert '<c r="C1"><v>1</v></c>' in sheet and '<c r="D1" t="inlineStr">' in sheet and 'r="AH3"' in sheet

"""Golden cases and properties of the expressions."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docmetrics.functions import boxes, jsontext, metrics, text
from docmetrics.operators import documents, extraction, quantiles, retrieval, routing, rows, scoring, tables


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


C = F.col


@pytest.mark.parametrize(
    ("ref", "hyp", "chars", "words", "jamo"),
    [
        ("계란 10구 x1", "계란10구x1", 2 / 9, 1.0, 2 / 13),
        ("합계 54,600원", "합계 54,6002", 1 / 10, 0.5, 3 / 15),
        ("시설 점검과 내부 자료 정리", "시설 전검과 내부 자료 정리", 1 / 15, 1 / 5, 1 / 30),
    ],
)
def test_error_rates(spark, ref, hyp, chars, words, jamo):
    assert one(spark, metrics.cer(C("a"), C("b")), a=ref, b=hyp) == pytest.approx(chars)
    assert one(spark, metrics.wer(C("a"), C("b")), a=ref, b=hyp) == pytest.approx(words)
    assert one(spark, metrics.jamo_cer(C("a"), C("b")), a=ref, b=hyp) == pytest.approx(jamo)
    assert one(spark, metrics.word_distance_expr(C("a"), C("b")), a=ref, b=hyp) == metrics.sequence_distance(ref.split(), hyp.split())


def test_error_rates_of_empty_texts(spark):
    assert one(spark, metrics.cer(C("a"), C("b")), a="", b="") == 0.0
    assert one(spark, metrics.cer(C("a"), C("b")), a=" ", b="a") == 1.0
    assert one(spark, metrics.cer_raw(C("a"), C("b")), a="", b="a") is None
    assert one(spark, metrics.cer(C("a"), C("b")), a="a", b="abc") == 2.0


def test_composition(spark):
    decomposed = unicodedata.normalize("NFD", "가나다 é")
    assert one(spark, metrics.cer(C("a"), C("b")), a="가나다 é", b=decomposed) == 0.0
    assert one(spark, text.squash_symbols(C("a")), a="가 나,다_!") == "가나다"


@pytest.mark.parametrize(("raw", "fixed"), [("5S0", "550"), ("1O0", "100"), ("1OO0", "1OO0"), ("3,lB4", "3,lB4"), ("2.|5", "2.15"), ("SO", "SO")])
def test_digits(spark, raw, fixed):
    assert one(spark, text.fix_digits(C("a")), a=raw) == fixed


def test_rules(spark):
    assert one(spark, text.iso_dates(C("a")), a="2026. 3. 15. / 2026.03.05") == "2026-03-15 / 2026-03-05"
    assert one(spark, text.fix_phone(C("a")), a="02 000 1234, 031.123.4567") == "02-000-1234, 031-123-4567"
    assert one(spark, text.apply_rules(C("a")), a="1O0×2 – 02 000 1234") == "100x2 - 02-000-1234"
    assert one(spark, text.biz_number_valid(C("a")), a="220-81-62517") is True
    assert one(spark, text.biz_number_valid(C("a")), a="220-81-62518") is False
    assert one(spark, text.biz_number_valid(C("a")), a="12") is False
    assert one(spark, text.to_int(C("a")), a="1,234원") == 1234
    assert one(spark, text.to_int(C("a")), a="none") is None


def test_bags_and_answers(spark):
    assert one(spark, metrics.disagreement(C("a"), C("b")), a=" ", b="") == 0.0
    assert one(spark, metrics.disagreement(C("a"), C("b")), a="ab c", b="cb\na") == 0.0
    assert one(spark, metrics.disagreement(C("a"), C("b")), a="aab", b="b") == pytest.approx(1 - 2 / 4)
    assert one(spark, text.is_correct(C("a"), C("b")), a="02-000-5636", b="T 02-000-5636 [1]") is True
    assert one(spark, metrics.char_f1(C("a"), C("b")), a="abc", b="xyz") == 0.0
    assert one(spark, metrics.overflow(C("a"), C("b")), a="", b="abc") is True
    assert one(spark, text.grounded(C("a"), C("b")), a="1,234", b="1 234 won") is True
    assert one(spark, extraction.half_even(C("a") * 0.1), a=25) == 2
    assert one(spark, text.word_kind(C("a")), a="12:30") == "number"


def test_boxes(spark):
    b = lambda *v: boxes.box(*(F.lit(float(x)) for x in v))
    assert one(spark, boxes.iou(b(0, 0, 2, 2), b(1, 1, 3, 3))) == pytest.approx(1 / 7)
    assert one(spark, boxes.iou(b(0, 0, 0, 0), b(0, 0, 0, 0))) == 0.0
    assert one(spark, boxes.overlap_ratio(b(0, 0, 2, 2), b(0, 0, 1, 1))) == 1.0
    poly = F.array(*(F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((9, 9), (1, 2), (8, 1), (2, 8))))
    assert [list(p) for p in one(spark, boxes.order_corners(poly))] == [[1, 2], [8, 1], [9, 9], [2, 8]]
    assert one(spark, scoring.bucket(F.lit(1.0), [0.0, 0.5, 0.99, 1.01])) == 2


def test_row_grouping_keeps_the_first_member_as_measure(spark):
    lines = [("c", 0, 14), ("a", 0, 0), ("b", 20, 5), ("d", 20, 9)]
    arr = F.array(*(F.struct(F.lit(t).alias("text"), boxes.box(*(F.lit(float(v)) for v in (x, y, x + 10, y + 10))).alias("box")) for t, x, y in lines))
    got = one(spark, F.transform(rows.group_rows(arr), lambda r: F.array_join(F.transform(r, lambda m: m["text"]), "")))
    # by tops: a(0); b(5) overlaps a by 5, not more than half; d(9) joins b; c(14) overlaps b by 1, so begins a row
    assert got == ["a", "bd", "c"]


@given(st.lists(st.text(alphabet="ab ", max_size=12), max_size=12), st.integers(1, 20))
@settings(max_examples=25, deadline=None)
def test_chunks_lose_nothing_but_blank_ends(spark, lines, size):
    source = "\n".join(lines)
    got = one(spark, retrieval.chunks(F.lit(source), size))
    pieces = [p.split("\n") for p in got]
    all_lines = source.split("\n")
    while all_lines and all_lines[0] == "":  # blank lines before a chunk are dropped
        all_lines = all_lines[1:]
    at = 0
    for piece in pieces:
        while all_lines[at] == "" != piece[0]:
            at += 1
        assert all_lines[at : at + len(piece)] == piece
        at += len(piece)
        held = piece[0]
        for line in piece[1:]:
            assert len(held) + len(line) <= size  # every line that joined still fitted
            held += "\n" + line
        if at < len(all_lines):
            assert len(held) + len(all_lines[at]) > size or not "".join(all_lines[at:]).strip()
    assert not "".join(all_lines[at:]).strip()


@given(st.text(alphabet="abc", max_size=9), st.text(alphabet="abc", max_size=9))
@settings(max_examples=60, deadline=None)
def test_distances(a, b):
    assert metrics.sequence_distance(list(a), list(b)) == metrics.sequence_distance(list(b), list(a)) == metrics.text_distance(a, b)
    assert abs(len(a) - len(b)) <= metrics.text_distance(a, b) <= max(len(a), len(b))


def test_tables():
    t = "<table><thead><tr><th rowspan=2>a<th>b</tr></thead><tr><td>c</table>"
    assert tables.grid(t) == [["a", "b"], ["a", "c"]]
    assert tables.cell_texts(t) == ["a", "b", "c"]
    assert tables.table_similarity(t, t) == 1.0
    assert tables.table_similarity("", t) == 0.0
    assert tables.table_similarity("<table></table>", "<table></table>") == 1.0
    assert tables.table_similarity("<table></table>", t) == 0.0
    plain = "<table><tr><td>a</td><td>b</td></tr></table>"
    assert tables.table_similarity(plain.replace("<td>b</td>", ""), plain) == pytest.approx(1 - 1 / 3)
    assert tables.table_similarity(plain.replace(">b<", ">x<"), plain) == pytest.approx(1 - 1 / 3)
    assert tables.table_similarity(plain.replace(">b<", ">x<"), plain, True) == 1.0
    text_, html_, md = tables.markdown_text("# T\n**b** c\n<table><tr><td>x</td></tr></table>\n| h | i |\n|---|---|\n| 1 | 2 |\n-----\nend")
    assert text_ == "T\nb c\nx\nh\ni\n1\n2\nend"
    assert html_ == ["<table><tr><td>x</td></tr></table>"]
    assert md == ["<table><tr><th>h</th><th>i</th></tr><tr><td>1</td><td>2</td></tr></table>"]
    assert tables.block_text("<p>a<br/>b</p>") == "a\nb"


def test_json_strings(spark):
    j = F.lit('{"type": "t", "content": [{"type": "x", "content": "a"}, "b"]}')
    assert spark.range(1).select(jsontext.json_strings(j).alias("s")).first()["s"] == ["a", "b"]


def test_policy(spark):
    def pick(vlm, r1, d1, r2, d2):
        v = F.lit(vlm).cast("string")
        args = (F.lit("f"), F.lit("v"), v, *(F.lit(x).cast("double") for x in (r1, d1, r2, d2)))
        r = one(spark, routing.policy(*args))
        return r["source"], r["retried"]

    assert pick("m", 2, 0.1, 2, 0.0) == ("vl", False)
    assert pick("m", 5, 0.1, 2, 0.5) == ("vlm", True)
    assert pick("m", 2, 0.5, 2, 0.4) == ("vlm", True)
    assert pick("m", 2, 0.5, 5, 0.1) == ("vl", True)
    assert pick(None, 5, 0.1, None, None) == ("fast", False)
    assert pick(None, 2, 0.9, None, None) == ("vl", False)
    assert one(spark, routing.upright(F.lit(0.5), F.lit(0.6))) == 180
    assert one(spark, routing.upright(F.lit(0.9), F.lit(1.0))) == 0


def test_document_types(spark):
    kind = lambda s, n=5, w=100, h=100, r=(): one(spark, routing.document_type(F.lit(s), F.lit(n), F.lit(w), F.lit(h), F.array(*map(F.lit, r)).cast("array<int>"))["type"])
    assert kind("세금 계산서") == "invoice"
    assert kind("합계 100\n영수증") == "receipt"
    assert kind("a@b.kr", 5, 180, 100) == "card"
    assert kind("x", 10, 100, 100, (3, 3, 3, 1)) == "table"
    assert kind("x") == "document"


def test_small_functions(spark):
    assert one(spark, text.options(C("a")), a="x=1,y=2") == {"x": "1", "y": "2"}
    assert one(spark, text.report_number(C("a")), a=0.12345) == "0.123" and one(spark, text.report_number(F.lit(None).cast("double"))) == "-"
    assert one(spark, text.unknown_answer(C("a")), a="답은 모름") is True and one(spark, text.unknown_answer(F.lit(None).cast("string"))) is False
    assert one(spark, text.squash_amount(C("a")), a="1,234 원") == "1234"
    numbers = spark.range(10).withColumn("none", F.when(C("id") < 0, C("id")))
    assert [scoring.nearest_rank(numbers, [], "id", share).first()["rank"] for share in (0.0, 0.55, 0.9, 1.0)] == [0, 5, 9, 9]
    assert scoring.nearest_rank(numbers, [], "none", 0.9).first()["rank"] is None
    turned = F.struct(F.lit(180.0).alias("rotate_deg"), F.lit(None).cast("string").alias("shadow"))
    assert one(spark, boxes.rotation_kind(turned)) == "flipped"
    kinds = [(2.0, None), (-30.0, None), (None, "soft"), (None, None)]
    made = [F.struct(F.lit(d).cast("double").alias("rotate_deg"), F.lit(s).cast("string").alias("shadow")) for d, s in kinds]
    assert [one(spark, boxes.rotation_kind(m)) for m in made] == ["small rotation", "large rotation", "perspective and shadow", "perspective"]
    square = F.array(*(F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (2, 0))))
    assert one(spark, boxes.projective(square, [2, 0, 1, 0, 2, 1, 0.5, 0, 1])) == [[1.0, 1.0], [2.5, 0.5]]
    assert one(spark, documents.table_lines(F.struct(F.array(F.lit("h")).alias("header"), F.array(F.array(F.lit("a"), F.lit("b"))).alias("rows")))) == ["h", "a", "b"]


def test_questions_and_cards(spark):
    d = F.struct(*(F.lit(v).cast("string").alias(k) for k, v in {"company": "acme", "name": "kim", "dept": None, "title": "x", "tel": "02", "mobile": None, "email": "a@b", "address": None}.items()))
    card = one(spark, extraction.flatten_card(d))
    assert [(r["name"], r["value"]) for r in card] == [("company", "acme"), ("name", "kim"), ("dept", None), ("title", "x"), ("tel", "02"), ("mobile", None), ("email", "a@b"), ("address", None)]
    made = one(spark, extraction.questions(F.lit("card"), {"card": [("who?", "name"), ("where?", "address")], "other": [("what?", "title")]}, d))
    assert [(r["question"], r["answer"]) for r in made] == [("who?", "kim")]
    rows_ = spark.createDataFrame([("a", 1, "kept"), ("a", 2, "length"), ("a", 3, "kept"), ("a", 4, "kept"), ("b", 1, "kept")], "id string, no int, reason string")
    assert sorted((r["id"], r["no"]) for r in extraction.first_per_document(rows_).collect()) == [("a", 1), ("a", 3), ("b", 1)]
    invoice = extraction.flatten_invoice(F.from_json(F.lit('{"supplier": {"biz_no": "1"}, "items": [{"name": "n", "qty": 2}]}'), "supplier struct<biz_no:string,name:string,ceo:string>, buyer struct<biz_no:string,name:string,ceo:string>, date string, supply_total bigint, tax_total bigint, total bigint, items array<struct<name:string,qty:bigint,price:bigint,supply:bigint,tax:bigint>>"))
    got = {r["name"]: r["value"] for r in one(spark, invoice)}
    assert got["supplier.biz_no"] == "1" and got["items[0].qty"] == "2" and got["items[0].tax"] is None and len(got) == 15


def test_receipts_are_repaired(spark):
    box = lambda x, y: F.struct(*(F.lit(float(v)).alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), (x, y, x + 50, y + 10), strict=True)))
    lines = [("가게", 0, 0), ("123-45-67891", 0, 20), ("02 123 4567", 0, 40), ("2026-01-02 10:30", 0, 60), ("빵 x 2", 0, 80), ("1,0O0원", 100, 82), ("합 계", 0, 100), ("1,OO0", 100, 101)]
    arr = F.array(*(F.struct(F.lit(t).alias("text"), box(x, y).alias("box")) for t, x, y in lines))
    r = one(spark, extraction.receipt_fields(arr))
    assert (r["store"], r["biz_no"], r["tel"], r["date"]) == ("가게", "123-45-67891", "02-123-4567", "2026-01-02 10:30")
    assert [(i["name"], i["qty"], i["amount"]) for i in r["items"]] == [("빵", 2, 1000)]
    assert one(spark, extraction.receipt_fields(arr, repair=False))["tel"] is None


def naive_tree_distance(a, b):
    """Ordered tree edit distance by the plain recursion over forests."""
    from functools import lru_cache

    def freeze(t):
        return (t.tag, t.spans, t.content, tuple(map(freeze, t.children)))

    def cost(x, y):
        return tables._rename(tables.Tree(x[0], x[1], x[2]), tables.Tree(y[0], y[1], y[2]))

    @lru_cache(maxsize=None)
    def distance(f, g):
        if not f and not g:
            return 0.0
        options = []
        if f:
            options.append(distance(f[:-1] + f[-1][3], g) + 1)
        if g:
            options.append(distance(f, g[:-1] + g[-1][3]) + 1)
        if f and g:
            options.append(distance(f[:-1], g[:-1]) + distance(f[-1][3], g[-1][3]) + cost(f[-1], g[-1]))
        return min(options)

    return distance((freeze(a),), (freeze(b),))


def test_tree_distance_against_recursion():
    import random

    r = random.Random(5)

    def tree(depth):
        kids = [tree(depth - 1) for _ in range(r.randrange(3))] if depth else []
        return tables.Tree(r.choice(("tr", "td", "table")), (1, r.randint(1, 2)), r.choice(("", "ab", "ac")), kids)

    for _ in range(150):
        a, b = tree(2), tree(2)
        assert tables.tree_distance(a, b) == pytest.approx(naive_tree_distance(a, b))
    inner = "<table><tr><td><p>a</p></td></tr></table>"
    assert tables.table_similarity(inner, inner.replace("</tr>", "<td><p>b</p></td></tr>")) == pytest.approx(0.8)


def test_coverage_and_histograms(spark):
    texts = spark.createDataFrame([("가나 a",), ("가가b",), (None,)], "text string")
    known = spark.createDataFrame([("가",), ("a",), ("a",)], "ch string")
    r = scoring.dictionary_coverage(texts, known, 1).first()
    assert (r["kinds"], r["characters"], r["dictionary"], r["hangul"], r["lost_kinds"], r["lost"], r["lost_share"]) == (4, 6, 2, 1, 2, 2, pytest.approx(1 / 3))
    assert [(t["n"], t["ch"]) for t in r["top"]] == [(1, "b")]
    labels = spark.createDataFrame([("x",), ("y",), ("x",), ("z",)], "label string")
    assert [tuple(t) for t in scoring.histogram(labels, "label").collect()] == [("x", 2, 1), ("y", 1, 2), ("z", 1, 3)]
    m = spark.createDataFrame([("f", ["a", "b"], ["b", "c"]), ("f", ["a"], ["a"])], "name string, t array<string>, p array<string>")
    hits = scoring.field_hits(m.select("name", scoring.set_match(C("t"), C("p")).alias("match"))).first()
    assert (hits["hit"], hits["want"], hits["got"], hits["precision"], hits["recall"]) == (2, 3, 3, pytest.approx(2 / 3), pytest.approx(2 / 3))
    empty = spark.createDataFrame([], "g string, v double")
    assert quantiles.order_statistics(empty, ["g"], {"v": {"m": quantiles.LOWER}}).collect() == []
    some = spark.createDataFrame([(None, 1.0), (None, 4.0), ("a", None)], "g string, v double")
    med = scoring.with_median(some.groupBy("g").count(), some, ["g"], "v", "m")
    assert {(x["g"], x["m"]) for x in med.collect()} == {(None, 2.5), ("a", None)}
    q = spark.range(5).select(C("id").alias("qid"), F.array(F.lit(1.0)).alias("qvec"))
    near = retrieval.top_k(q, q.select(C("qid").alias("cid"), C("qvec").alias("cvec")), 2)
    assert sorted(tuple(x) for x in near.collect()) == sorted((i, c, 1.0, c + 1) for i in range(5) for c in (0, 1))

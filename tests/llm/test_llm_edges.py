"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docmetrics.llm import bytebpe, embeddings, exactdedup, minhash, packing, pii, suffixdedup, toxicity, urlfilter, warczip

LONG = " ".join(f"word{i % 9000} tail" for i in range(60_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta"),
    (2, None),
    (3, ""),
    (4, "alpha beta gamma delta epsilon zeta"),
    (5, LONG),
    (5, LONG),
    (None, "no id here at all, mail a@b.example"),
    (None, None),
    (6, "   \n\t "),
    (7, "x" * 500),
    (8, "😀 é ΑΣ İ \u0000 <|endoftext|> call +1 (407) 555-7710"),
]
#: Names that operators use inside.
CLASH = ("id", "rep", "component", "_id", "_text", "_h", "keep_id", "kept", "fp", "raw", "deal", "score", "grp", "key", "packed", "spans", "_kept", "_gone", "hashes", "digest", "v", "fine")


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    df = df.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASH)})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (8, None, None), (5, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")


WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

DOCUMENT_OPERATORS = {
    "pii": lambda d, _: pii.find_personal_data(d),
    "redact": lambda d, _: pii.redact_documents(d),
    "packing": lambda d, _: packing.pack_documents(d, WORD),
    "suffix": lambda d, _: suffixdedup.remove_repeats(d),
    "exact": lambda d, _: exactdedup.exact_duplicates(d, keep="max"),
    "minhash": lambda d, _: minhash.near_duplicates(d, percent=85),
    "bpe": lambda d, _: bytebpe.round_trip_digests(d, BYTE, public_tokenizers.PATTERN),
    "toxicity": lambda d, labels: toxicity.toxicity(d, labels),
}


@pytest.mark.parametrize("name", DOCUMENT_OPERATORS)
def test_document_operators(name, odd, empty, labels):
    run = DOCUMENT_OPERATORS[name]
    assert run(empty, labels).collect() == []
    assert run(odd, labels.where("false")).count() >= len(ROWS)
    got = run(odd, labels).collect()
    assert len(got) == len(ROWS) or name == "packing"


def test_meanings(odd):
    exact = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exactdedup.exact_duplicates(odd, keep="max").collect()}
    assert exact >= {(1, 4, 2, False), (4, 4, 2, True), (2, 3, 3, False), (3, 3, 3, True), (None, 3, 3, False), (5, 5, 2, True)}
    near = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd, percent=85).collect()}
    assert near >= {(1, 2, 1, True), (4, 2, 1, False), (2, 0, 2, True), (3, 0, 3, True), (6, 0, 6, True), (7, 1, 7, True), (None, 0, None, True)}
    cut = suffixdedup.remove_repeats(odd).collect()
    long = [r for r in cut if r["doc_id"] == 5]
    assert len(long) == 2 and all(r["n_removed"] == r["n_bytes"] == len(LONG) and r["n_spans"] == 1 for r in long)
    assert [(r["n_bytes"], r["n_removed"]) for r in cut if r["doc_id"] == 7] == [(500, 500)]
    assert {r["n_bytes"] for r in cut if r["doc_id"] in (2, 3)} == {0}
    pieces = packing.pack_documents(odd, WORD).collect()
    assert [(r["start"], r["length"], list(r["ids"])) for r in pieces if r["doc_id"] in (2, 3)] == [(0, 1, [0])] * 2
    mail = [r for r in pii.find_personal_data(odd).collect() if r["doc_id"] is None]
    assert sorted(r["n_email"] for r in mail) == [0, 1]
    texts = {r["doc_id"]: r["text"] for r in pii.redact_documents(odd).where("doc_id is not null").collect()}
    assert texts[8].endswith("call [PHONE]") and texts[2] is None and texts[1] == ROWS[0][1]


def test_packing_deals_rows_evenly(spark):
    """Rows without an id, and rows that repeat one, are spread over the groups like others."""
    for key in (F.lit(None).cast("long"), F.lit(7).cast("long"), F.col("id")):
        for text in (F.lit("the same words in each row"), F.concat(F.lit("row "), F.col("id").cast("string"))):
            packed = packing.pack_documents(spark.range(0, 3000, 1, 3).select(key.alias("doc_id"), text.alias("text")), WORD, group=300, with_ids=False)
            groups = [r["count"] for r in packed.groupBy(F.shiftright("sequence_id", 32)).count().collect()]
            assert len(groups) == 10 and sum(groups) == 3000 and max(groups) < 400


def test_repeated_id_with_other_text(spark):
    df = spark.createDataFrame([(1, "a" * 300), (1, "b" * 10), (2, "a" * 300)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffixdedup.remove_repeats(df).collect()) == [(1, 10, 0), (1, 300, 300), (2, 300, 300)]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages(stage, spark, odd, empty, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    run = dict(corpus_pipeline.STAGES)[stage]
    assert run(spark, empty, str(tmp_path)).collect() == []
    out = run(spark, odd, str(tmp_path))
    rows = out.collect()
    if stage != "packing":
        assert out.columns == odd.columns
        assert {r["doc_id"] for r in rows} >= ({4, 5, 8} if stage == "exact dedup" else {1, 5, 8})
    else:
        assert {r["doc_id"] for r in rows} == {r[0] for r in ROWS}


def test_urls(spark):
    rows = [(1, "http://a.COM/x"), (2, None), (3, ""), (None, "https://example.com/en/?q"), (4, "no scheme"), (5, "x://"), (6, "http://www.example.com/en/a#b"), (6, "http://Éa.net/es/" + "y" * 100_000), (7, "http://com"), (8, "http://example.com:80/en/"), (9, "http://" + "a." * 100_000 + "example.com/en/x"), (10, "http://" + "b" * 100_000 + ".net/es/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit(1), "id": F.lit(2), "rule": F.lit(3)})
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]
    got = {(r["page_id"], r["host"], r["rule"], r["verdict"]) for r in urlfilter.filter_urls(pages, rules).collect()}
    assert got == {
        (1, "a.com", "com/", "allow"), (2, "", None, "allow"), (3, "", None, "allow"), (None, "example.com", "example.com/en/", "block"), (4, "", None, "allow"), (5, "", None, "allow"),
        (6, "www.example.com", "www.example.com/en/", "allow"), (6, "Éa.net", "net/es/", "block"), (7, "com", None, "allow"), (8, "example.com:80", None, "allow"),
        (9, "a." * 100_000 + "example.com", "example.com/en/", "block"), (10, "b" * 100_000 + ".net", "net/es/", "block"),
    }
    assert urlfilter.filter_urls(pages.where("false"), rules).collect() == []
    assert urlfilter.filter_urls(pages, []).where("verdict = 'allow' and rule is null").count() == len(rows)


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [2.0, 0.1], 0), (4, [1.0, 0.0], 1), (5, None, 0), (6, [0.0, 0.0], 0), (7, [nan, 1.0], 0), (8, [inf, 1.0], 0), (9, [1.0, None], 0), (10, [1.0, 0.0], None), (11, [], 0), (12, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0), (13, [0.0, 1.0], 0), (13, [0.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(0) for c in ("id", "v", "rep", "size", "fine", "near", "unit")})
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicate_vectors(df).collect()}
    lone = {(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12)}
    assert got == lone | {(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (None, 0, None, True), (13, 1, 13, True)}
    assert embeddings.near_duplicate_vectors(df.where("false")).collect() == []


def test_pages(spark):
    rows = [(1, "http://a/", "<p>x</p>"), (2, None, None), (3, "u\r\nv", ""), (4, "w", "<p>x</p>"), (None, "z", "<p>x</p>"), (5, "long", "é" * 200_000), (5, "long", "é" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(0) for c in ("digest", "keeper", "bytes", "payload", "archive")})
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warczip.archive_round_trip(spark, pages).collect()), key=str)
    assert got == sorted([(1, 8, "revisit", 4), (2, 0, "revisit", 3), (3, 0, "response", None), (4, 8, "response", None), (None, 8, "revisit", 4), (5, 400_000, "response", None), (5, 400_000, "response", None)], key=str)
    assert warczip.archive_round_trip(spark, pages.where("false")).collect() == []
    few = {(r["page_id"], r["record_type"]) for r in warczip.archive_round_trip(spark, pages, least=9).collect()}
    assert few >= {(1, "response"), (4, "response"), (2, "response")}


def test_rows_not_ids_are_dropped(spark):
    """An id with several texts: nothing that no other row has is lost."""
    a, b = "one two three four five six seven", "other words that nothing else in here has"
    rows = [(3, a), (7, a), (7, b), (9, a), (9, "third text of its own kind, quite unlike the rest"), (9, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    largest = sorted(tuple(r) for r in exactdedup.drop_exact_duplicates(df, keep="max").collect())
    assert largest == sorted([(9, a), (9, rows[4][1]), (9, b)])
    smallest = sorted(tuple(r) for r in exactdedup.drop_exact_duplicates(df).collect())
    assert smallest == sorted([(3, a), (7, b), (9, rows[4][1])])
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, percent=85).collect())
    assert got == sorted([(3, 3, True), (7, 3, False), (7, 7, True), (9, 3, False), (9, 9, True), (9, 7, False)])
    assert sorted(tuple(r) for r in minhash.drop_near_duplicates(df).collect()) == smallest
    same = spark.createDataFrame([(7, a), (7, b), (8, b), (8, a + " eight")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(same, percent=60).collect())
    assert got == [(7, 7, True), (7, 7, True), (8, 7, False), (8, 7, False)]


def test_vectors_of_repeated_ids(spark):
    rows = [(5, [1.0, 0.0, 0.0], 0), (5, [0.0, 1.0, 0.0], 0), (5, [0.0, 0.0, 1.0], 0), (5, [-0.0, 0.02, 1.0], 0), (3, [0.0, 1.0, 0.01], 0), (8, [1.0, 0.01, 0.0], 0), (8, [1.0, 0.01, -0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicate_vectors(df).collect())
    assert got == [(3, 1, 3, True), (5, 1, 3, False), (5, 1, 5, True), (5, 1, 5, True), (5, 2, 5, True), (8, 2, 5, False), (8, 2, 5, False)]

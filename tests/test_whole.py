"""Queries over whole tables against brute force, on small tables with texts that are not ASCII."""

import random
import re
from collections import Counter, defaultdict
from statistics import mean, median

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docmetrics import plans
from docmetrics.functions import metrics
from docmetrics.functions.metrics import sequence_distance, text_distance
from docmetrics.operators import documents
from docmetrics.operators.tables import markdown_text, table_similarity

TURNS = [
    (1, 0, "user", "Grüße aus  Köln"),
    (1, 1, "assistant", "Gruße aus Koln"),
    (1, 2, "user", "plain words"),
    (1, 3, "assistant", "plain  word"),
    (2, 0, "user", "où est la gare ?"),
    (2, 1, "assistant", "la gare est là [1], où est la gare ? où est la gare ? où est la gare ?"),
    (2, 2, "user", "là"),
    (2, 3, "assistant", "¿dónde está?"),
    (2, 4, "user", "¿dónde está?"),
    (3, 0, "user", "ℕ 𝔸𝔹 é"),
    (3, 1, "assistant", ""),
    (3, 2, "user", ""),
    (3, 3, "user", "x"),
]


def norm(s):
    return re.sub(r"\s+", " ", s).strip(" ")


def bare(s):
    return re.sub(r"\s+", "", s)


def letters(s):
    return re.sub(r"[\s\W_]+", "", s)


def cer(r, h):
    return (1.0 if h else 0.0) if not r else sequence_distance(r, h) / len(r)


def similarity(a, b):
    x, y = letters(a), letters(b)
    return (0.0 if y else 1.0) if not x else max(0.0, 1 - sequence_distance(x, y) / len(x))


def shared(a, b):
    return sum((Counter(a) & Counter(b)).values())


def char_f1(g, p):
    hit = shared(g, p)
    return 2 * hit / (len(g) + len(p)) if hit else 0.0


def pairs():
    by = {(c, k): (role, norm(x)) for c, k, role, x in TURNS}
    return [(c, k, role, by[c, k - 1][1], x) for (c, k), (role, x) in by.items() if (c, k - 1) in by]


def over(r, h):
    return len(bare(h)) > 2 * max(1, len(bare(r)))


def by_role(f, total=False):
    groups = defaultdict(list)
    for p in pairs():
        for role in (p[2], None) if total else (p[2],):
            groups[role].append(p)
    return {(role, *f(g)) for role, g in groups.items()}


def rounded(rows):
    return {tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in rows}


def by_pair(f):
    return {(c, k, f(r, h)) for c, k, _, r, h in pairs()}


def summary(g):
    scores = [cer(r, h) for *_, r, h in g]
    words = [cer(r.split(), h.split()) for *_, r, h in g]
    tables = [k % 5 / 5 for _, k, *_ in g if k % 2 == 0]
    upright = [cer(r, h) for c, k, _, r, h in g if (c + k) % 4]
    return len(g), mean(scores), mean(words), mean(tables) if tables else None, median(scores), mean(upright), sum(x > 0.5 for x in scores), sum(over(r, h) for *_, r, h in g)


def disagreement(r, h):
    x, y = bare(r), bare(h)
    return 1 - 2 * shared(x, y) / (len(x) + len(y)) if x or y else 0.0


def correct(r, h):
    g, p = bare(r), bare(re.sub(r"\[[0-9]+\]", "", h))
    return g in p or (2 * len(p) >= len(g) and p in g)


WANT = {
    "q04_turn_cer": lambda: by_pair(cer),
    "q05_turn_cer_rollup": lambda: by_role(lambda g: (len(g), mean(cer(r, h) for *_, r, h in g)), True),
    "q10_char_disagreement": lambda: by_pair(disagreement),
    "q11_overflow_flags": lambda: by_pair(over),
    "q41_answer_correct": lambda: by_pair(correct),
    "q42_answer_char_f1": lambda: by_pair(lambda r, h: char_f1(bare(r), bare(re.sub(r"\[[0-9]+\]", "", h)))),
    "q65_page_summary": lambda: by_role(summary),
    "q66_similarity": lambda: by_pair(similarity),
    "q69_word_accuracy": lambda: by_role(lambda g: (len(g), mean(float(bare(r) == bare(h)) for *_, r, h in g), mean(min(1.0, cer(r, h)) for *_, r, h in g))),
}


@pytest.fixture(scope="module")
def conversations(tmp_path_factory):
    folder = tmp_path_factory.mktemp("whole")
    pd.DataFrame(TURNS, columns=["conv_id", "turn", "role", "text"]).to_parquet(folder / "conversations.parquet")
    return str(folder)


@pytest.mark.parametrize("name", WANT)
def test_turns(name, spark, conversations):
    got = [tuple(r) for r in plans.QUERIES[name](spark, conversations).collect()]
    assert len(got) == len(set(got))
    assert rounded(got) == rounded(WANT[name]())


def words(r, n, alphabet="aeéßñ日𝔸 "):
    return "".join(r.choice(alphabet) for _ in range(n))


def test_all_items(spark, tmp_path):
    r = random.Random(6)
    items = [(k, words(r, r.randint(0, 9))) for k in range(40)]
    items += [(k + 40, items[k][1]) for k in range(0, 40, 7)]  # copies far behind, beyond any window of ids
    pd.DataFrame(items, columns=["item_id", "text"]).to_parquet(tmp_path / "benchmark.parquet")
    want = set()
    for i, a in items:
        near = sorted((sequence_distance(a, b), j) for j, b in items if j != i)[:3]
        want |= {(i, j, d, k) for k, (d, j) in enumerate(near, 1)}
    got = plans.QUERIES["q06_benchmark_topk"](spark, str(tmp_path)).select("item_id", "other", "distance", "rank").collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_text_distance():
    r = random.Random(84)
    for _ in range(400):
        a = words(r, r.randint(0, 90))
        b = "".join(r.choice("aé日𝔸 ") if r.random() < 0.2 else c for c in a if r.random() > 0.1) if r.random() < 0.6 else words(r, r.randint(0, 90))
        assert text_distance(a, b) == sequence_distance(a, b)


def test_whole_documents(spark, tmp_path):
    r = random.Random(85)
    docs = [
        (1, "Grüße\nan **alle** <b>hier</b> 𝔸", "de"),
        (2, "", "fr"),
        (3, "<table><tr><td>a</td></tr></table>\nund mehr", "de"),
        (4, "| a | b |\n|---|---|\n| 1 | é |", "es"),
        (5, "\n".join(words(r, 60, "aeéßñ日𝔸 *") + f" **{k}** <i>{k}</i>" for k in range(30)), "en"),
        (6, "plain words", "en"),
    ]
    pd.DataFrame(docs, columns=["doc_id", "text", "lang"]).to_parquet(tmp_path / "documents.parquet")
    want = set()
    for k, x, lang in docs:
        table = f"<table><tr><td>{lang}</td><td>{k}</td></tr></table>"
        text, html, other = markdown_text(f"# {x}\n{table}")
        found = html + other
        teds = mean(table_similarity(found[i] if i < len(found) else "", table) for i in range(2))
        want.add((k, cer(norm(f"{x}\n{lang}\n{k}"), norm(text)), teds, len(found)))
    got = [tuple(x) for x in plans.QUERIES["q84_document_scores"](spark, str(tmp_path)).collect()]
    assert len(got) == len(docs) and rounded(got) == rounded(want)
    assert max(x[1] for x in got) > 0


def test_documents_without_tables(spark):
    odd = "a\x1cb \u3000c\x85d e\u0301"
    rows = [(1, "# " + odd, odd, []), (2, None, None, None), (3, "", "", ["<table><tr><td>a</td></tr></table>"])]
    df = spark.createDataFrame(rows, "id int, markdown string, ref_text string, ref_tables array<string>")
    got = sorted(tuple(x) for x in documents.document_scores(df).collect())
    rate = df.select(metrics.cer(F.lit(odd), F.lit(markdown_text("# " + odd)[0]))).first()[0]
    assert got == [(1, rate, None, 0), (2, None, None, 0), (3, 0.0, 0.0, 0)]


def test_all_votes(spark, tmp_path):
    r = random.Random(33)
    items = [(k, words(r, r.randint(0, 30), "eethéß日𝔸x ")) for k in range(40)] + [(40, "ee"), (41, "thé the"), (42, "")]
    pd.DataFrame(items, columns=["item_id", "text"]).to_parquet(tmp_path / "benchmark.parquet")
    want = set()
    for k, x in items:
        readings = [x, x.replace("e", ""), x.replace("th", "t")]
        totals = [sum(similarity(a, b) for j, b in enumerate(readings) if j != i) for i, a in enumerate(readings)]
        best = max(range(3), key=lambda i: (round(totals[i], 9), -i))
        want.add((k, best, round(totals[best], 6)))
    got = [tuple(x) for x in plans.QUERIES["q33_candidate_vote"](spark, str(tmp_path)).select("item_id", "idx", "total").collect()]
    assert len(got) == len(items) and {(a, b, round(c, 6)) for a, b, c in got} == want


def edit_distance(a, b):
    """The plain table, cell by cell."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_sequence_distance():
    r = random.Random(7)
    for _ in range(300):
        a, b = ([r.choice("abcé") for _ in range(r.randrange(12))] for _ in range(2))
        assert sequence_distance(a, b) == edit_distance(a, b)


def test_error_rates_of_turns(spark, conversations):
    import unicodedata

    word = lambda r, h: edit_distance(r.split(), h.split()) / len(r.split()) if r else float(bool(h))
    nfd = lambda s: unicodedata.normalize("NFD", s)
    letters_ = lambda r, h: edit_distance(nfd(r), nfd(h)) / len(nfd(r)) if r else None
    for name, f in (("q07_wer_pairs", word), ("q08_jamo_cer", letters_)):
        assert rounded(tuple(r) for r in plans.QUERIES[name](spark, conversations).collect()) == rounded(by_pair(f)), name


def test_route_policy(spark, conversations):
    import zlib

    ratio = lambda s: len(s.encode()) / max(1, len(zlib.compress(s.encode())))
    counts = Counter()
    texts = {(c, k): x for c, k, _, x in TURNS}
    for (c, k), fast in texts.items():
        if (c, k - 1) not in texts:
            continue
        vl, vlm = texts[c, k - 1], texts.get((c, k - 2))
        d1 = disagreement(fast, vl)
        for threshold in (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 99.0):
            if ratio(vl) <= 4 and d1 <= threshold:
                got = ("vl", False)
            elif vlm is None:
                got = ("fast" if ratio(vl) > 4 else "vl", False)
            else:
                got = ("vlm" if ratio(vlm) <= 4 and (ratio(vl) > 4 or disagreement(fast, vlm) < d1) else "vl", True)
            counts[(threshold, *got)] += 1
            counts[(threshold, *got, "review")] += d1 > 0.05
    want = {(*k, n, counts[(*k, "review")]) for k, n in counts.items() if len(k) == 3}
    assert {tuple(r) for r in plans.QUERIES["q45_route_policy"](spark, conversations).collect()} == want


def boxes_of(r, n):
    return [(k, *(v := (r.randrange(5) * 10.0, r.randrange(4) * 10.0)), v[0] + r.choice((20.0, 30.0)), v[1] + r.choice((20.0, 30.0))) for k in range(n)]


def iou(a, b):
    both = max(0, min(a[3], b[3]) - max(a[1], b[1])) * max(0, min(a[4], b[4]) - max(a[2], b[2]))
    return both / ((a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) - both)


@pytest.mark.parametrize("driven_by", ["pred", "truth"])
def test_greedy_matches(spark, driven_by):
    """Against the plain loops, with many ties."""
    from docmetrics.functions.boxes import box
    from docmetrics.operators import matching

    r = random.Random(29)
    docs = [(i, boxes_of(r, r.randrange(7)), boxes_of(r, r.randrange(7))) for i in range(60)]
    want = set()
    for i, preds, truths in docs:
        first, second = (preds, truths) if driven_by == "pred" else (truths, preds)
        free = list(second)
        for a in first:
            best = max(free, key=lambda b: (iou(a, b), b[0]), default=None)
            if best and iou(a, best) >= 0.5:
                free.remove(best)
                want.add((i, a[0], best[0]) if driven_by == "pred" else (i, best[0], a[0]))
    frame = lambda at, name: spark.createDataFrame([(d[0], *b) for d in docs for b in d[at]], f"id int, {name} int, x1 double, y1 double, x2 double, y2 double").select("id", name, box("x1", "y1", "x2", "y2").alias("box"))
    got = [tuple(x) for x in matching.greedy_match(frame(1, "pred"), frame(2, "gt"), driven_by).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_parsers_as_queries(spark, tmp_path):
    """Queries over pages, documents and events that SQL cannot express, row by row against plain Python."""
    import hashlib
    import json
    import zlib

    pages = [(1, "u", "<p>Grüße</p>"), (2, "u", "<table><tr><td>a</td><td>é</td></tr></table>x<br/>y"), (3, "u", "")]
    pd.DataFrame(pages, columns=["page_id", "url", "html"]).to_parquet(tmp_path / "pages.parquet")
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    got = {r["page_id"]: (r["text"], r["html_tables"], r["md_tables"]) for r in plans.QUERIES["q48_markdown_to_text"](spark, str(tmp_path)).collect()}
    assert got == {1: (md5("Grüße\na\nb\n1\n2"), 0, 1), 2: (md5("a\né\nxy\na\nb\n1\n2"), 1, 1), 3: (md5("a\nb\n1\n2"), 0, 1)}
    got = {r["page_id"]: r["text"] for r in plans.QUERIES["q62_block_text"](spark, str(tmp_path)).collect()}
    assert got == {1: md5("Grüße"), 2: md5("a\né"), 3: md5("")}
    docs = [(1, "aé" * 400, "de"), (2, "kurz", "de"), (3, "", "de")]
    pd.DataFrame(docs, columns=["doc_id", "text", "lang"]).to_parquet(tmp_path / "documents.parquet")
    ratio = {k: len(x.encode()) / len(zlib.compress(x.encode())) for k, x, _ in docs}
    got = {r["doc_id"]: (r["ratio"], r["repeats"]) for r in plans.QUERIES["q44_compression_ratio"](spark, str(tmp_path)).collect()}
    assert got == {k: (round(v, 6), v > 4) for k, v in ratio.items()}
    pd.DataFrame([(1, "view", json.dumps({"k": 1})), (2, "é", "")], columns=["event_id", "event_type", "props"]).to_parquet(tmp_path / "events.parquet")
    got = {r["event_id"]: r["strings"] for r in plans.QUERIES["q63_json_strings"](spark, str(tmp_path)).collect()}
    assert got == {1: 'view|{"k": 1}', 2: "é|"}


def test_receipts_as_query(spark, tmp_path):
    rows = [(1, 1, 10, 3.0, 1234.5), (1, 2, 11, 1.0, 99.9), (2, 1, 12, 2.0, 1000000.0)]
    pd.DataFrame(rows, columns=["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]).to_parquet(tmp_path / "lineitem.parquet")
    got = {tuple(r) for r in plans.QUERIES["q78_receipt_extract"](spark, str(tmp_path)).collect()}
    assert got == {(1, "store", "123-45-67891", "02-123-4567", 1234, 2, 1333), (2, "store", "123-45-67891", "02-123-4567", 1234, 1, 1000000)}


def test_recognise_as_query(spark, sf_dir):
    got = plans.QUERIES["q81_recognize"](spark, sf_dir).collect()
    again = plans.QUERIES["q81_recognize"](spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and sorted(got, key=str) == sorted(again, key=str)

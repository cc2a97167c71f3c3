"""Periodic runs, collocations and speculative BPE against brute force, and their edge cases."""

import collections
import hashlib
import random
import re
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docmetrics.llm import collocations, periodicity, queries, wordbpe

WORD = public_tokenizers.path("word_bpe_49k.json")
CLASH = ("id", "runs", "collapsed", "n_words", "packed", "range", "trie", "phrase", "k", "f", "left", "right", "n", "rank", "score", "_best", "_part", "open")
LONG = " ".join(f"word{i % 9000} tail" for i in range(60_000))
ODD = [
    (1, "one two three"), (2, None), (3, ""), (4, " \t\r\n\v\f "), (5, LONG), (5, LONG), (None, "no id, " * 40), (None, None), (6, "x" * 500), (6, "other text of the id"),
    (7, "ba " * 500), (8, "😀 é ΑΣ İ \u0000 <|endoftext|>x<|ENDOFTEXT|> ﬁ ſ 日本語 ½ ́a"), (10, "a b " * 9), (20, "p q r s t u v w"), (30, "z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    df = df.withColumns({"lang": F.when(F.col("doc_id") > 4, F.lit("en")), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASH)})


def runs_by_brute_force(w, least=6, exponent=4):
    found = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i - start + q
            part = w[start : start + length]
            if i > start and length >= max(least, exponent * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                found.append((start, length, q))
            i += 1
    return sorted(found)


def rewritten(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def run_row(doc_id, text, plant=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    w = rewritten(doc_id, w) if plant and doc_id is not None else w
    runs = runs_by_brute_force(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2],
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def sequence(r):
    w = [r.randrange(r.choice([1, 2, 3, 5, 30])) for _ in range(r.randint(0, 100))]
    for _ in range(r.randint(0, 3)):
        if len(w) > 8:
            a, p = r.randrange(len(w) - 4), r.randint(1, 12)
            for i in range(a + p, min(len(w), a + r.randint(p, 9 * p + 8))):
                w[i] = w[a + (i - a) % p]
    return w


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (2, 3), (4, 5)])
def test_runs_of(least, exponent):
    r = random.Random(exponent)
    found = 0
    for _ in range(1500):
        w = sequence(r)
        want = runs_by_brute_force(w, least, exponent)
        assert periodicity.runs_of(w, least, exponent) == want
        found += len(want)
    assert found > 500
    assert periodicity.runs_of([3] * 50_000) == [(0, 50_000, 1)]
    assert periodicity.runs_of(list(range(700)) * 60) == [(0, 42_000, 700)]


def test_extensions_survive_equal_hashes(monkeypatch):
    """With hashes that are always equal the words themselves decide."""
    monkeypatch.setattr(periodicity, "MODULUS", 1)
    r = random.Random(3)
    for _ in range(300):
        w = sequence(r)
        assert periodicity.runs_of(w) == runs_by_brute_force(w)


def test_periodic_runs_query(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, "".join(f"w{x}" + r.choice([" ", "  ", "\n", "\t\x0b"]) for x in sequence(r))) for i in range(100, 500)] + ODD
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    short = [(i, t) for i, t in rows if t != LONG]
    assert sorted((tuple(x) for x in got.where("doc_id <> 5 or doc_id is null").collect()), key=str) == sorted((run_row(i, t) for i, t in short), key=str)
    assert got.where("doc_id = 5 and n_runs = 1 and start = 0 and length = 120000 and period = 18000").count() == 2


def phrases_by_brute_force(rows, least, top=2000):
    count = collections.defaultdict(collections.Counter)
    total = collections.Counter()
    for lang, text in rows:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    count[lang or "und"][tuple(w[i : i + k])] += 1
    out = []
    for lang, f in count.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        listed = []
        for p, a in candidates.items():
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items())
            if not inside:
                listed.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (score, a, p, left, right) in enumerate(sorted(listed)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("size", "shard", "top"), [(1 << 24, 1 << 24, 2000), (1500, 4000, 2000), (300, 700, 7)])
def test_collocations(spark, monkeypatch, size, shard, top):
    """One range and many ranges, so that prefixes lie on several borders; few and many shards."""
    monkeypatch.setattr(collocations, "RANGE", size)
    r = random.Random(size)
    names = ["a", "b", "The", "the", "zu", "é", "ß", "x1", "日本", "tail"] + [f"v{i}" for i in range(40)]
    rows = []
    for _ in range(300):
        words = [r.choice(names[: r.choice([4, 10, 50])]) + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(r.randint(0, 40))]
        rows.append((r.choice(["en", "de", None]), "".join(words)))
    rows += [("en", "the very same passage of words here")] * 60 + [("fr", "peu")] * 3 + [("de", None), (None, "")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    monkeypatch.setattr(collocations, "SHARD", shard)
    got = sorted(tuple(x) for x in collocations.collocations(df, least=10, top=top).collect())
    assert got == phrases_by_brute_force(rows, 10, top) and len(got) > 7


def test_trie_stretches():
    r = random.Random(2)
    tries = []
    for _ in range(5):
        texts = [" ".join(r.choice("abcdef") * r.randint(1, 2) for _ in range(r.randint(0, 30))) for _ in range(40)]
        tries.append(collocations.shard_trie(pa.array([r.choice(["x", "y"]) for _ in texts]), pa.array(texts)))
    spelled = lambda t: [(t.langs[g], *(t.vocabulary[int(w[i]) - 1].as_py() for w in t.words if w[i])) for i, g in enumerate(t.group.tolist())]
    whole = collocations.Trie.merged(tries)
    assert spelled(whole) == sorted(set().union(*map(spelled, tries)))
    sums = collections.Counter()
    for t in tries:
        sums.update(dict(zip(spelled(t), t.times.tolist(), strict=True)))
    assert whole.times.tolist() == [sums[p] for p in spelled(whole)]
    for cut in [(b"",), (b"x",), (b"xx",), (b"z",), (b"x", b"bb", b"c"), (b"y", b"c", b"zz"), spelled(whole)[77], spelled(whole)[-1]]:
        for t in tries:
            assert t.place(cut) == sum(p < cut for p in spelled(t))
    t = tries[0]
    for a, b in ((0, 7), (3, 90), (50, len(t.times))):
        back = collocations.Trie.unpacked(t.packed(a, b))
        assert spelled(back) == spelled(t)[a:b] and back.times.tolist() == t.times[a:b].tolist()


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    t.no_padding()
    t.no_truncation()
    return t


def test_word_bpe_query(spark, tmp_path):
    r = random.Random(4)
    letters = ["a", "B", "ç", "É", "İ", "Σ", "ς", " ", "  ", "\t", "\xa0", "　", "日", "é", "é", "'s", "'LL", "1", "²", "!", "...", "😀", "\x00", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "ſ", "ﬁ", "th", "ing", "tion"]
    rows = [(i, "".join(r.choice(letters) for _ in range(r.randint(0, 50)))) for i in range(100, 700)] + ODD
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_word_bpe(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    t = library()
    want = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_speculation_and_exact_merging():
    """Accepted proposals are what exact merging gives; exact merging is what the library gives; every vocabulary token is reachable."""
    s = wordbpe.Speculator(WORD)
    r = random.Random(6)
    words = ["".join(r.choice("abetinhoszrg") for _ in range(r.randint(1, 30))).encode() for _ in range(4000)] + [b"x" * 3000, b"ab" * 2000, "日本語".encode(), bytes([255, 0])]
    got = s.encode(words)
    assert 0 < s.exact < len(words)
    assert [list(memoryview(g).cast("I")) for g in got] == [s.merges.merge(w) for w in words]
    t = library()
    for w, ids in list(zip(words, got, strict=True))[:4003]:
        assert list(memoryview(ids).cast("I")) == t.encode(w.decode(), add_special_tokens=False).ids
    assert s.merges.reachable().sum() == len(s.merges.spelled)
    long = [s.merges._merge_long([*map(s.merges.symbols[0].__getitem__, w[:-1]), s.merges.symbols[1][w[-1]]]) for w in words[:500]]
    assert long == [s.merges.merge(w) for w in words[:500]]


def test_round_trip(odd):
    back = wordbpe.decode_documents(wordbpe.encode_documents(odd, WORD), WORD)
    assert back.columns == ["doc_id", "packed", "decoded"]
    texts = {(r["doc_id"], r["decoded"]) for r in back.collect()}
    assert {(1, "one</w> two</w> three</w>"), (2, ""), (3, ""), (4, ""), (None, "")} <= texts


@pytest.mark.parametrize("run", [periodicity.periodic_runs, lambda d: wordbpe.round_trip_digests(d, WORD)])
def test_rows_stay(odd, run):
    assert run(odd).count() == len(ODD)
    assert run(odd.where("false")).collect() == []


def test_collocations_edges(odd):
    assert collocations.collocations(odd.where("false")).collect() == []
    assert collocations.collocations(odd.where("doc_id < 5")).collect() == []
    got = {(r["lang"], r["phrase"], r["a"], r["n"]) for r in collocations.collocations(odd).collect()}
    assert {g for g in got if g[0] == "und"} == {("und", "no id", 40, 83)}
    assert any(g[0] == "en" and g[1] == "ba ba ba ba" and g[2] == 497 for g in got)

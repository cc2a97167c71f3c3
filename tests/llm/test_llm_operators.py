"""Operators against brute force, round trips and held-out accuracy."""

import base64
import collections
import hashlib
import io
import os
import random
import re
import struct
import zipfile
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

from docmetrics.llm import bytebpe, embeddings, minhash, packing, pii, queries, shared, suffixdedup, toxicity, urlfilter, warczip


def random_texts(n, seed, words=400, copies=0.4):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(words)]
    out = []
    for _ in range(n):
        text = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        if out and r.random() < copies:
            text = r.choice(out).split(" ")
            for _ in range(r.randint(0, 4)):
                if text:
                    text[r.randrange(len(text))] = r.choice(vocabulary)
        out.append(" ".join(text))
    return out


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 440)]
    got = {x["id"]: x["component"] for x in shared.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(441, links)
    assert got == {i: want[i] for a, b in links if a != b for i in (a, b)}


@pytest.mark.parametrize(("percent", "block"), [(85, 1024), (80, 1024), (85, 7)])
def test_near_duplicates(spark, percent, block):
    texts = random_texts(400, percent)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()) for w in (t.lower().split() for t in texts)]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = roots(len(sets), links)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, percent=percent, block=block).collect()}
    assert links and got == {i: (len(sets[i]), want[i], want[i] == i) for i in range(len(sets))}


def test_bayesian_bounds():
    bounds = minhash.least_matches(0.85, 192, 32, 1e-7)
    assert list(bounds) == [32, 64, 96, 128, 160, 192] and sorted(bounds.values()) == list(bounds.values())
    assert 0.6 < bounds[192] / 192 < 0.85
    assert minhash.banding(85) == (32, 6) and minhash.banding(80) == (38, 5)


def cut_by_brute_force(texts, length):
    counts = collections.Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if counts[t[p : p + length]] > 1:
                cover[p : p + length] = True
        kept = np.frombuffer(t, np.uint8)[~cover].tobytes()
        out.append((len(t), int(cover.sum()), int((np.diff(np.concatenate([[0], cover.astype(np.int8)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "gram", "hot", "claims"), [(20, None, 20_000, 4000), (20, 3, 20_000, 3), (25, 10, 2, 4000), (12, 12, 20_000, 4000)])
def test_suffix_dedup(spark, monkeypatch, length, gram, hot, claims):
    monkeypatch.setattr(suffixdedup, "CLAIMS", claims)
    r = random.Random(length)
    texts = []
    for _ in range(250):
        t = "".join(r.choice(["ab", "é", "c ", "aaaaaaaaaa", "hello world "]) for _ in range(r.randrange(60)))
        if texts and r.random() < 0.4:
            o = r.choice(texts)
            k = r.randrange(len(o) + 1)
            t += o[k : k + r.randrange(200)]
        texts.append(t)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffixdedup.remove_repeats(df, length=length, gram=gram, hot=hot).collect()}
    assert got == dict(enumerate(cut_by_brute_force([t.encode() for t in texts], length)))


def test_long_texts_in_chunks(monkeypatch):
    monkeypatch.setattr(suffixdedup, "CHUNK", 400)
    r = random.Random(3)
    text = bytes(r.choice(b"abcd") for _ in range(3000))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([text], pa.binary())], ["id", "raw"])
    seen = []
    for buf, ends, _, shift in suffixdedup._laid_out(batch, 30):
        first, last, _, _, _ = suffixdedup.anchors(buf, ends, 30, 10)
        for a, b in zip(first, last, strict=True):
            seen += range(a - shift[a], b - shift[a] + 1)
    assert sorted(seen) == list(range(len(text) - 29))


def test_deep_shallow_sort():
    r = random.Random(1)
    for _ in range(300):
        base = bytes(r.choice(b"ab") for _ in range(60))
        s = [base[: r.randrange(61)] + bytes(r.choice(b"ab") for _ in range(r.randrange(8))) for _ in range(r.randrange(30))]
        for shallow in (0, 1, 8, 32):
            assert suffixdedup.deep_shallow_sort(s, list(range(len(s))), shallow) == sorted(range(len(s)), key=s.__getitem__)


def test_vector_links(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(150, 24))
    near = base[r.integers(0, 150, 200)] + 0.12 * r.normal(size=(200, 24))
    crowd = base[3] + 0.05 * r.normal(size=(90, 24))
    x = np.concatenate([base, near, crowd]).astype(np.float32)
    labels = r.integers(0, 2, len(x))
    labels[-90:] = 1
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, labels, strict=True))]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    ok = (u @ u.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(ok, False)
    for block in (2048, 16):
        got = {g["vec_id"]: g for g in embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=block).collect()}
        found = sum(g["n_links"] for g in got.values())
        assert found >= 0.97 * ok.sum() and all(g["n_links"] <= ok[i].sum() for i, g in got.items())
        want = roots(len(x), np.argwhere(ok).tolist())
        assert sum(g["component_id"] != want[i] for i, g in got.items()) <= 5


def test_packing(spark):
    import tokenizers

    texts = random_texts(300, 5, copies=0) + ["Hello, wORLD's 1234!! ~ mark " * 500, "İ ΑΣ e\u0301 <|endoftext|>"]
    path = public_tokenizers.path("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, size=128).collect()
    by_doc = collections.defaultdict(list)
    for x in rows:
        by_doc[x["doc_id"]].append(x)
    for i, text in enumerate(texts):
        ids = t.encode(text, add_special_tokens=False).ids + [0]
        mine = sorted(by_doc[i], key=lambda x: x["piece"])
        assert [j for x in mine for j in x["ids"]] == ids
        assert [x["start"] for x in mine] == list(range(0, len(ids), 128))
        assert all(x["ids_crc32"] == zlib.crc32(struct.pack(f"<{x['length']}I", *x["ids"])) for x in mine)
    sequences = collections.defaultdict(list)
    for x in rows:
        sequences[x["sequence_id"]].append((x["offset"], x["length"]))
    for s in sequences.values():
        assert [o for o, _ in sorted(s)] == np.cumsum([0] + [n for _, n in sorted(s)])[:-1].tolist() and sum(n for _, n in s) <= 128
    assert len(sequences) <= 1.02 * sum(x["length"] for x in rows) / 128 + 1


def test_word_ids():
    import tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    r = random.Random(3)
    alphabet = "aAbBzZ 0129.,'!-_\n\t\r\xe9\xc9\xd7\u0130\u0131\u0149\u017f\u0178\u0153\u0301\u00a0\u2003\u4e2d\u0645\u0660\u2160\U0001f600<|>st\u03a3\u1e9e\u00df\u0141\u0142\u00aa\x00\x1f\x7f\x85\ud55c"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(10_000)]
    texts += [f"a<|endoftext|>b <|startoftext|> 'S we'LL {x}" for x in texts[:100]] + [None, "", " ", "x" * 5000, "Stra\u00dfe " * 3000, "\u4e2d" * 3000]
    for portion in (64, 1 << 20):
        got = packing.WordIds(path, room=500, portion=portion).batch(texts)
        assert [g.tolist() for g in got] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    with pytest.raises(ValueError):
        packing.WordIds(public_tokenizers.path("byte_bpe_50k.json"))


def test_packing_query(spark, sf_dir):
    """Every row of op2 on a whole table against the tokenizer, and the packing itself."""
    import tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = t.encode(d["text"] or "", add_special_tokens=False).ids + [0]
        want += [(d["doc_id"], k, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    got = queries.op2_packing(spark, sf_dir).collect()
    assert sorted((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in got) == sorted(want)
    sequences = collections.defaultdict(list)
    for x in got:
        sequences[x["sequence_id"]].append((x["offset"], x["length"]))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0] + [n for _, n in s])[:-1].tolist() and sum(n for _, n in s) <= 2048
    assert len(sequences) <= -(-sum(x[3] for x in want) // 2048) + 2


def test_best_two_fit_exchanges():
    bins, _, n = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert n == 2 and bins[0] == bins[2] == bins[3]  # 6 + 3 gives up the 3 for 2 + 2
    r = np.random.default_rng(1)
    for _ in range(50):
        lengths = r.integers(1, 60, r.integers(1, 200))
        bins, offsets, n = packing.best_two_fit(lengths, 64)
        assert (np.bincount(bins, lengths) <= 64).all() and len(np.unique(bins)) == n
        assert len({(b, o) for b, o in zip(bins, offsets, strict=True)}) == len(lengths)


def test_byte_bpe():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = bytebpe.ByteBpe(path, public_tokenizers.PATTERN)
    r = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "\u2003", "a", "Zz", "'s", "'ll", "9", "12", "é", "ñ", "日本", "한", "é", "😀", "!", "...", "_", "\u200b", "\x00", "ǅ", "Ⅷ", "²", "hello", " the"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(4000)] + random_texts(50, 1)
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_batch(texts)] == reference.encode_ordinary_batch(texts)
    assert all(bpe.decode_bytes(bpe.encode(t)) == t.encode() for t in texts[:500])


def base_by_brute_force(t):
    spans = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    spans += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, least, most in ((2, r"[0-9]([\x20-]?[0-9])+", 14, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            if least <= len(digits) <= most and (kind == 3 or pii.luhn(digits)):
                spans.append((kind, m.start(), m.end()))
    return sorted(spans)


def test_base_spans():
    r = random.Random(1)
    parts = ["a", "@", ".", "-", "_", "+", "1", "23", "4", "0", "255", "256", " ", "(", ")", "@b.c", "é", "x@y.z", "4111111111111111", "+1 407 555 7710 ", "1.2.3.4", "000000001"]
    for _ in range(20_000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(16)))
        assert sorted((s.kind, s.start, s.end) for s in pii.base_spans(t)) == base_by_brute_force(t), t


def test_added_spans():
    selector = pii.train()
    x, y, kinds = pii.training_set(1500, 77)
    p = selector.probability(x)
    for k in (0, 1, 3, 4, 5):
        chosen = (kinds == k) & (p >= selector.thresholds[k])
        assert chosen.sum() > 10 and y[chosen].mean() > 0.93
    clean = [t for t in random_texts(200, 9)] + ["version 10.2.3 of 2024-01-02, order 123456789, total 1.234.567"]
    assert all(not every for _, every in pii.find_batch(clean, selector))
    (base, every), = pii.find_batch(["ssn: 123-45-6789 mail a@b.com"], selector)
    assert pii.describe(every) == "ssn:5:16,email:22:29" and len(base) == 1
    assert pii.redact("mail a@b.com and 1.2.3.4", pii.base_spans("mail a@b.com and 1.2.3.4")) == "mail [EMAIL] and [IP]"


def documents_of(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def test_personal_data_held_out(spark, sf_dir):
    """Spans planted in real documents that gave no contexts: precision and recall by kind."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    around = pii.contexts(docs, n=100)
    assert 50 < len(around) <= 100 and around == pii.contexts(docs.repartition(7), n=100)
    selector = pii.train(around)
    others = tuple(t for _, t in documents_of(spark, sf_dir) if t and not any(a in t for a in around))
    x, y, kinds = pii.training_set(3000, 4321, around=others)
    chosen = selector.probability(x) >= np.array(selector.thresholds)[kinds]
    for k, least in ((0, 0.93), (1, 0.95), (3, 0.95), (4, 0.9), (5, 0.95), (6, 0.9)):
        own = kinds == k
        assert y[own & chosen].mean() > 0.95 and y[own & chosen].sum() >= least * y[own].sum(), pii.KINDS[k]


def test_personal_data_query(spark, sf_dir, tmp_path):
    """Every row of op1 on a whole table, with keys planted in every tenth text: base spans by brute force, and all keys."""
    r = random.Random(10)
    texts = dict(documents_of(spark, sf_dir))
    for i in sorted(texts)[::10]:
        words = (texts[i] or "").split(" ")
        words.insert(r.randrange(len(words) + 1), f'token = "{r.getrandbits(160):040x}"')
        texts[i] = " ".join(words)
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op1_pii(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    added = 0
    for r in got:
        text = texts[r["doc_id"]] or ""
        base = base_by_brute_force(text)
        counts = collections.Counter(k for k, _, _ in base)
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(counts[k] for k in range(4))
        listed = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted((a, k, b) for k, a, b in base)]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(listed) <= set(spans) and len(spans) == len(base) + r["n_added"]
        places = [tuple(map(int, x.split(":")[1:])) for x in spans]
        assert places == sorted(places) and all(0 <= a < b <= len(text) for a, b in places)
        more = {x for x in spans if x not in listed}
        tokens = {f"secret:{m.start(1)}:{m.end(1)}" for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', text)}
        assert tokens <= more
        added += len(tokens)
    assert added >= len(texts) // 10


def test_secrets():
    (_, every), (_, none) = pii.find_batch(['api_key = "sk_live_9aF3kd82Lq0Xz7Vb1Nc5" done', "commit 9aef1203bc77aa01ef93bc77aa01ef939aef1203 fixed it"], pii.train())
    assert pii.describe(every) == "secret:11:39" and not none
    assert pii.redact('api_key = "sk_live_9aF3kd82Lq0Xz7Vb1Nc5" done', every) == 'api_key = "[SECRET]" done'
    long = " ".join(f'token = "{i:040x}a"' for i in range(3000))
    assert len(pii.find_batch([long], pii.train())[0][1]) > 2000


def test_byte_bpe_query(spark, sf_dir):
    """Every row of op8 on a whole table against tiktoken."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, text in documents_of(spark, sf_dir):
        ids = reference.encode_ordinary(text or "")
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op8_byte_bpe(spark, sf_dir).collect()}
    assert got == want


def test_archive_query(spark, sf_dir, tmp_path):
    """Every row of op10 on a whole table with copies: lengths, digests and references by plain Python."""
    from pyspark.sql import functions as F

    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    copies = table.where("page_id % 7 = 0").withColumn("page_id", F.col("page_id") + 100_000)
    table.unionByName(copies).unionByName(copies.limit(3).withColumn("page_id", -F.col("page_id"))).write.parquet(str(tmp_path / "pages.parquet"))
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(str(tmp_path / "pages.parquet")).collect()]
    largest = {}
    for i, raw in sorted(pages):
        largest[raw] = i
    want = {i: (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if largest[raw] == i else "revisit", None if largest[raw] == i else largest[raw]) for i, raw in pages}
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in queries.op10_warc_zip(spark, str(tmp_path)).collect()}
    assert got == want and any(w[2] == "revisit" for w in want.values())


def test_added_cards():
    selector = pii.train()
    x, y, kinds = pii.training_set(1500, 77, cards=True)
    chosen = (kinds == 2) & (selector.probability(x) >= selector.thresholds[2])
    assert chosen.sum() > 10 and y[chosen].mean() > 0.93
    texts = ["card: 4111.1111.1111.1111 thanks", "credit card 4222222222222 was used", "visa 4111/1111/1111/1111", "card 4111 -1111 -1111 -1111"]
    for t, (base, every) in zip(texts, pii.find_batch(texts, selector), strict=True):
        assert not base and "[CARD]" in pii.redact(t, every) and not re.search("[0-9]", pii.redact(t, every))
    others = ["order 4222222222225 shipped", "version 4111.1111.1111.1112"]
    assert all(not every for _, every in pii.find_batch(others, selector))


def test_digest_array(tmp_path, monkeypatch):
    r = random.Random(2)
    rules = [(f"h{r.randrange(500)}.example", f"/{'x' * r.randrange(3)}", r.choice(("allow", "block"))) for _ in range(900)]
    path = tmp_path / "rules.bin"
    path.write_bytes(urlfilter.digest_array(rules))
    last = {h + p: v for h, p, v in rules}
    keys = [k.encode() for k in last] + [b"other", b""]
    assert urlfilter.DigestArray(str(path)).probe(keys) == [*last.values(), None, None]
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", lambda k: len(k))  # many collisions
    path.write_bytes(urlfilter.digest_array(rules))
    assert urlfilter.DigestArray(str(path)).probe(keys) == [*last.values(), None, None]


def test_zip64_directory():
    records = [("k", warczip.warc_record(1, "http://a/", b"<p>x</p>", 1, False)), ("k2", warczip.warc_record(2, None, b"", 1, True))]
    raw = warczip.archive_bytes([records])
    got = list(warczip.read_archive(io.BytesIO(raw), len(raw)))
    assert [(x.headers["warc-type"], x.payload) for x in got] == [("response", b"<p>x</p>"), ("revisit", None)]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", b"12345")
        z.comment = b"PK\x05\x06 in the comment"
    plain = out.getvalue()
    assert warczip.ZipDirectory(io.BytesIO(plain), len(plain)).range(warczip.ZipDirectory(io.BytesIO(plain), len(plain)).members["a"], 1, 3) == b"234"
    # the same member with all sizes and places in 64-bit fields
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 20) + b"a" + struct.pack("<HHQQ", 1, 16, 5, 5) + b"12345"
    extra = struct.pack("<HHQQQ", 1, 24, 5, 5, 0)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + b"a" + extra
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, len(local) + len(central), 1)
    wide = local + central + end64 + locator + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    directory = warczip.ZipDirectory(io.BytesIO(wide), len(wide))
    assert directory.range(directory.members["a"], 0, 5) == b"12345"
    for broken in (wide[:-1], b"", plain[:-40]):
        with pytest.raises(ValueError):
            warczip.ZipDirectory(io.BytesIO(broken), len(broken))


def test_grammar():
    lexicon, machine = toxicity.Lexicon(toxicity.seed_words(), {}), toxicity.grammar()
    score = lambda t: toxicity.clause_features(t, lexicon, machine)[0]
    assert score("all is well") == 0
    assert score("an idiot") > score("not an idiot") > 0
    assert score("an idiot") > score("he said that x was an idiot") > 0
    assert score("you are an idiot") > score("some kind of idiot")
    assert score("not that. idiot") == score("idiot")
    assert score("you are an utter idiot") > score("it is an idiot") > score("idiot") > 0
    assert score("i will kill you") > score("kill you") > score("i will not kill you") > 0
    assert score("we kill time") == score("i will") == score("du bist hier") == 0
    assert score("ich werde dich finden und vernichten. dich") == 0 < score("werde vernichten dich")
    stem = toxicity.Lexicon(toxicity.seed_words(), {"zorg": 3.0})
    both = lambda t: toxicity.clause_features(t, stem, machine)[0]
    assert both("a zorgblat here") == 0 < both("a zorgblat and a zorgfex")
    kept = toxicity.Lexicon({**toxicity.seed_words(), "zorg": (toxicity.VERB, 3.0)}, {})
    assert kept["you"][0] == toxicity.TARGET and kept["not"][0] == toxicity.NEGATION
    t = toxicity.compose(toxicity.Transducer({(0, "a"): (1, "b", 2.0)}), toxicity.Transducer({(0, "b"): (0, "c", 3.0)}), ["a", "x"])
    assert t.step(0, "a")[1:] == ("c", 6.0) and t.step(0, "x")[1:] == ("x", 1.0)


def test_toxicity_held_out(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i, text in enumerate(random_texts(3000, 8, copies=0)):
        words = text.split() + ["end"]
        toxic = r.random() < 0.15
        for _ in range(r.randint(2, 6) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(("zorgblat", "zorgfex", "zorgnim", "moron")))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in got)
    held = [(x["predicted"], labels[x["doc_id"]][1]) for x in got if x["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.97 and all(0 <= x["score"] <= 1 for x in got)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    got = con.execute(queries.ORACLE_SQL[name])
    cols = [d[0] for d in got.description]
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(str, got.fetchall())) == sorted(str(tuple(r[c] for c in cols)) for r in df.collect())


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir).collect()
    ids = {r["doc_id"] for r in out}
    assert 0.7 * docs.count() < len(ids) < docs.count()
    assert os.path.isdir(sf_dir) and all(r["length"] <= 2048 for r in out)


def test_pipeline_rows(spark, tmp_path):
    """Rows and texts of every stage against a brute-force version, on planted toxic texts, copies and personal data."""
    import corpus_pipeline
    import tokenizers

    r = random.Random(55)
    hidden = {"mail ann.lee@mail.org now": "mail [EMAIL] now", "host 10.1.2.3 up": "host [IP] up", "card 4111 1111 1111 1111 paid": "card [CARD] paid", "visa 4111/1111/1111/1111": "visa [CARD]", "ssn: 123-45-6789": "ssn: [SSN]"}
    texts = random_texts(300, 55)
    texts += [t for t in r.sample(texts, 30)]
    texts += [" ".join([*r.choices("abcdefgh", k=12), x, *r.choices("abcdefgh", k=12)]) for x in hidden for _ in range(4)]
    texts += ["long Grüße " * 1500]
    rude = [" ".join([*r.choices("abcdefgh", k=r.randint(0, 9)), "you are a stupid idiot and a worthless moron.", *r.choices("abcdefgh", k=r.randint(0, 9))]) for _ in range(40)]
    rows = [(t, t in rude) for t in texts + rude]
    r.shuffle(rows)
    table = [(i, t, "en", "web", len(t)) for i, (t, _) in enumerate(rows)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(bad)) for i, (_, bad) in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    want = [x for x in table if not rows[x[0]][1]]
    stages = [sorted(want)]
    last = {x[1]: x for x in sorted(want)}
    stages.append(sorted(last.values()))
    kept = stages[-1]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()) for w in (x[1].lower().split() for x in kept)]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    first = roots(len(sets), links)
    stages.append([x for i, x in enumerate(kept) if first[i] == i])
    clean = []
    for i, t, lang, source, _ in stages[-1]:
        for raw, new in hidden.items():
            t = t.replace(raw, new)
        clean.append((i, t, lang, source, len(t)))
    stages.append(clean)
    assert all(len(a) > len(b) for a, b in zip([table, *stages], stages[:3], strict=False)) and stages[2] != stages[3]

    at = docs
    for (name, stage), rows_wanted in zip(corpus_pipeline.STAGES, stages, strict=False):
        at = shared.materialize(stage(spark, at, str(tmp_path)), "rows")
        got = sorted(tuple(x) for x in at.collect())
        assert got == rows_wanted, name

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {x[0]: t.encode(x[1], add_special_tokens=False).ids + [0] for x in clean}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for x in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[x["doc_id"]].append((x["piece"], x["start"], x["length"], x["ids"]))
        sequences[x["sequence_id"]].append((x["offset"], x["length"]))
    assert pieces.keys() == tokens.keys() and max(map(len, pieces.values())) > 1
    for i, ids in tokens.items():
        assert sorted(pieces[i]) == [(k, s, len(ids[s : s + 2048]), ids[s : s + 2048]) for k, s in enumerate(range(0, len(ids), 2048))]
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0] + [n for _, n in s])[:-1].tolist() and sum(n for _, n in s) <= 2048

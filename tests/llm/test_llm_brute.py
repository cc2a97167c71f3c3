"""The composed grammar against a reader of its rules, and repeats of 200 bytes against brute force."""

import collections
import hashlib
import random

from docmetrics.llm import queries, toxicity
from docmetrics.llm.toxicity import COPULA, INSULT, MODAL, NEGATION, OTHER, REPORT, TARGET, THREAT, VERB


def behind(words, i, kind, reach, stops):
    """Place of the nearest word of a kind at most ``reach`` words before i with none of ``stops`` between."""
    for j in range(i - 1, max(-1, i - reach - 1), -1):
        if words[j] == kind:
            return j
        if words[j] in stops:
            return None
    return None


def read_clause(words):
    """(symbol out, factor) of each word by looking back from it: no states, no composition."""
    out, factors = list(words), [1.0] * len(words)
    for i, w in enumerate(words):
        if w == TARGET and (verb := behind(words, i, VERB, 2, (MODAL, TARGET))) is not None:
            out[i] = THREAT
            factors[i] = 1.5 if behind(words, verb, MODAL, 2, (VERB,)) is not None else 1.0
    for i, w in enumerate(out):
        if w == INSULT:
            stops = (TARGET, COPULA, INSULT)
            copula = behind(out, i, COPULA, 3, (TARGET, INSULT))
            if copula is not None:
                factors[i] *= 1.5 if behind(out, copula, TARGET, 2, stops) is not None else 1.25
            elif i and out[i - 1] in (INSULT, TARGET):
                factors[i] *= 1.25
    result = []
    for i, w in enumerate(out):
        if w in (INSULT, THREAT):
            negated, reported, aimed = (any(x == kind for x in out[max(0, i - reach) : i]) for kind, reach in ((NEGATION, 4), (REPORT, 12), (TARGET, 4)))
            factor = factors[i] * (0.25 if negated else 1) * (0.5 if reported else 1) * (1.25 if aimed else 1)
            result.append(((w, negated, reported, aimed), factor))
        else:
            result.append((w, factors[i]))
    return result


def test_composed_grammar():
    """Every clause of up to five words, and long random ones."""
    kinds = [OTHER, INSULT, TARGET, NEGATION, REPORT, COPULA, MODAL, VERB]
    r = random.Random(1)
    clauses = [[]]
    for _ in range(5):
        clauses += [c + [k] for c in clauses[-(8 ** len(clauses[-1])) :] for k in kinds]
    clauses += [[r.choice(kinds) for _ in range(r.randint(6, 40))] for _ in range(5000)]
    machine = toxicity.grammar()
    for words in clauses:
        state, got = 0, []
        for w in words:
            state, out, factor = machine.step(state, w)
            got.append((out, factor))
        want = read_clause(words)
        assert [o for o, _ in got] == [o for o, _ in want], words
        assert all(abs(a - b) < 1e-12 for (_, a), (_, b) in zip(got, want, strict=True)), words


def test_suffix_query_at_200_bytes(spark, tmp_path):
    """Passages around the limit that come again: within a text, across texts, overlapping, in runs, with many bytes a character."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij é") for _ in range(r.randint(1, 9)))
    fresh = lambda n: " ".join(word() for _ in range(n))
    passages = [fresh(60)[:n] for n in (190, 198, 199, 200, 201, 210, 260, 320)] + ["日本" * 40, "ab" * 150, "x" * 230]
    texts = ["", None, "short", "y" * 199, "z" * 200, "z" * 200]
    for _ in range(70):
        parts = [r.choice([fresh(r.randint(1, 30)), r.choice(passages), r.choice(passages)[r.randint(0, 20) :]]) for _ in range(r.randint(1, 6))]
        texts.append(r.choice(["", " "]).join(parts))
    texts += [texts[10]] * 5 + [texts[20][3:], texts[20][:-3]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    raws = [(t or "").encode() for t in texts]
    count = collections.Counter(x[i : i + 200] for x in raws for i in range(len(x) - 199))
    want = []
    for k, x in enumerate(raws):
        gone = bytearray(len(x))
        for i in range(len(x) - 199):
            if count[x[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans = sum(1 for i in range(len(x)) if gone[i] and (i == 0 or not gone[i - 1]))
        want.append((k, len(x), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    got = queries.op4_suffix_dedup(spark, str(tmp_path))
    assert sorted(tuple(row) for row in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == want
    assert sum(w[2] > 0 for w in want) > 40

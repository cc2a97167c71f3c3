"""Toxicity by a weighted finite-state pattern grammar over clauses."""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Word classes. BREAK ends a clause; OTHER is any other word. THREAT is no word class but what a threat's last word comes out as.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, BREAK, COPULA, MODAL, VERB = range(10)
WORD_CLASSES = (OTHER, INSULT, TARGET, NEGATION, REPORT, BREAK, COPULA, MODAL, VERB)

# General seed words of the classes in English, German, French and Spanish.
SEEDS = {
    INSULT: "idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown fool imbecile dumb garbage "
    "dummkopf trottel abschaum versager erbärmlich wertlos widerlich imbécile crétin minable ordure abruti débile estúpido imbécil basura patético inútil asqueroso",
    VERB: "kill hurt destroy beat burn punish töten umbringen verletzen vernichten tuer frapper détruire crever matar golpear destruir",
    MODAL: "will shall gonna must should i'll we'll werde werden wird vais allons va voy vamos",
    COPULA: "are is am be you're they're bist seid sind ist suis es êtes sommes sont eres sois son",
    TARGET: "you your yourself yours they them he him her people everyone dich dir euch dein toi vous ils elles usted ustedes vosotros ellos ellas",
    NEGATION: "not no never isn't aren't wasn't don't won't nicht kein keine nie niemals pas jamais aucun aucune nunca jamás ningún ninguna",
    REPORT: "said says wrote writes claimed claims quoted quotes reported called alleged sagte schrieb behauptete zitierte dit écrit affirmé cité dijo escribió afirmó citó",
}
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[.!?;:\n]")
STEMS = (3, 4, 5, 6)
#: At most so many labelled rows are used to learn from, chosen by a hash of their id, and so many learned words and stems kept.
LABELLED_ROWS, LEXICON_SIZE = 12_000, 100_000


# ---------------------------------------------------------------- transducers


@dataclass
class Transducer:
    """A deterministic transducer: (state, symbol) to (next state, symbol out, weight factor).

    Symbols without an arc pass through unchanged and lead to ``fall[state]``.
    """

    arcs: dict = field(default_factory=dict)
    fall: dict = field(default_factory=dict)

    def step(self, state, symbol):
        arc = self.arcs.get((state, symbol))
        return arc if arc is not None else (self.fall.get(state, state), symbol, 1.0)


def compose(first: Transducer, second: Transducer, symbols: list) -> Transducer:
    """The transducer that feeds the output of ``first`` to ``second``: weights multiply, states pair up."""
    out, todo, seen = Transducer(), [(0, 0)], {(0, 0): 0}
    while todo:
        pair = todo.pop()
        for s in symbols:
            a, mid, w1 = first.step(pair[0], s)
            b, last, w2 = second.step(pair[1], mid)
            if (a, b) not in seen:
                seen[(a, b)] = len(seen)
                todo.append((a, b))
            out.arcs[seen[pair], s] = (seen[(a, b)], last, w1 * w2)
    return out


def scope(trigger: int, affected: tuple, factor: float, reach: int, mark) -> Transducer:
    """For ``reach`` words after ``trigger``, affected symbols come out marked and weighted by ``factor``."""
    t = Transducer()
    for state in range(reach + 1):
        t.arcs[state, trigger] = (reach, trigger, 1.0)
        t.arcs[state, BREAK] = (0, BREAK, 1.0)
        t.fall[state] = max(0, state - 1)
        for s in affected if state else ():
            t.arcs[state, s] = (max(0, state - 1), mark(s), factor)
    return t


def threats() -> Transducer:
    """Modal + verb + target, or verb + target: the target comes out as a threat, with other words between.

    One other word may stand between modal and verb, and one between verb and target. A verb without a target is no match.
    """
    t = Transducer(fall={0: 0, "modal": "modal2", "modal2": 0, "verb": "verb2", "verb2": 0, "aimed": "aimed2", "aimed2": 0})
    for state in ("modal", "modal2", "verb", "verb2", "aimed", "aimed2", 0):
        t.arcs[state, BREAK] = (0, BREAK, 1.0)
        t.arcs[state, MODAL] = ("modal", MODAL, 1.0)
        after_modal = state in ("modal", "modal2")
        t.arcs[state, VERB] = ("aimed" if after_modal else "verb", VERB, 1.0)
    for state, factor in (("verb", 1.0), ("verb2", 1.0), ("aimed", 1.5), ("aimed2", 1.5)):
        t.arcs[state, TARGET] = (0, THREAT, factor)
    return t


def insults() -> Transducer:
    """Target or not, copula and insult ("you are an utter idiot"), or insult beside insult: stronger than an insult that stands alone."""
    t = Transducer(fall={0: 0, "target": "target2", "target2": 0, "copula": "copula2", "copula2": "copula3", "copula3": 0, "aimed": "aimed2", "aimed2": "aimed3", "aimed3": 0, "insult": 0})
    for state in list(t.fall):
        t.arcs[state, BREAK] = (0, BREAK, 1.0)
        t.arcs[state, TARGET] = ("target", TARGET, 1.0)
        t.arcs[state, COPULA] = ("aimed" if state in ("target", "target2") else "copula", COPULA, 1.0)
        factor = 1.5 if str(state).startswith("aimed") else 1.25 if str(state).startswith("copula") or state in ("insult", "target") else 1.0
        t.arcs[state, INSULT] = ("insult", INSULT, factor)
    return t


def matches() -> Transducer:
    """Insults and threats as matches without marks: (class, negated, reported, aimed)."""
    return Transducer({(0, s): (0, (s, False, False, False), 1.0) for s in (INSULT, THREAT)})


@lru_cache(maxsize=1)
def grammar() -> Transducer:
    """Threats, insults, negation, reported speech and address, composed: the last three rewrite the matches of the first two in their scope.

    Matches come out as (class, negated, reported, aimed).
    """
    every = tuple((s, n, r, False) for s in (INSULT, THREAT) for n in (False, True) for r in (False, True))
    parts = [
        threats(),
        insults(),
        matches(),
        scope(NEGATION, every, 0.25, 4, lambda s: (s[0], True, s[2], s[3])),
        scope(REPORT, every, 0.5, 12, lambda s: (s[0], s[1], True, s[3])),
        scope(TARGET, every, 1.25, 4, lambda s: (s[0], s[1], s[2], True)),
    ]
    return reduce(lambda a, b: compose(a, b, list(WORD_CLASSES)), parts)


# ---------------------------------------------------------------- lexicon


class Lexicon(dict):
    """Word to (class, weight, stem or null): a weighted acceptor of whole words and stems, with a table of words seen."""

    def __init__(self, words: dict[str, tuple[int, float]], stems: dict[str, float]):
        super().__init__()
        self.words, self.stems = words, stems

    def __missing__(self, word: str) -> tuple[int, float, str | None]:
        if len(self) > 150_000:
            self.clear()
        known = self.words.get(word)
        got = (*known, None) if known else None
        if got is None:
            for n in STEMS:
                if len(word) > n and (w := self.stems.get(word[:n])) is not None and (got is None or w > got[1]):
                    got = (INSULT, w, word[:n])
        if got is None:
            got = (BREAK, 0.0, None) if len(word) == 1 and not word.isalnum() else (OTHER, 0.0, None)
        self[word] = got
        return got


FEATURES = ("total", "most", "clauses", "dense", "softened", "distinct")


def clause_features(text: str | None, lexicon: Lexicon, machine: Transducer) -> list[float]:
    """What the grammar finds in a text: per clause, the weights of its matches in their scopes.

    A stem counts where two or more different words of the text have it: one alone may be chance.
    """
    if not text:
        return [0.0] * len(FEATURES)
    tokens = _TOKEN.findall(text.lower())
    found = [lexicon[t] for t in tokens]
    hits = [i for i, f in enumerate(found) if f[0] == INSULT or f[0] == VERB]
    if not hits:
        return [0.0] * len(FEATURES)
    forms: dict[str, set[str]] = defaultdict(set)
    for i in hits:
        if found[i][2]:
            forms[found[i][2]].add(tokens[i])
    for i in hits:
        if found[i][2] and len(forms[found[i][2]]) < 2:
            found[i] = (OTHER, 0.0, None)
    clauses: list[float] = []
    softened, done, distinct = 0.0, -1, set()
    for hit in hits:
        if hit <= done or found[hit][0] == OTHER:
            continue
        at = hit
        while at > 0 and found[at - 1][0] != BREAK:
            at -= 1
        state, weight, verb = 0, 0.0, 0.0
        while at < len(found) and found[at][0] != BREAK:
            kind, w, _ = found[at]
            state, out, factor = machine.step(state, kind)
            verb = w if kind == VERB else verb
            if isinstance(out, tuple):
                w = verb if out[0] == THREAT else w  # a threat weighs what its verb does
                weight += w * factor
                softened += w * (out[1] or out[2])
                distinct.add(tokens[at])
            at += 1
        done = at
        if weight:
            clauses.append(weight)
    if not clauses:
        return [0.0] * len(FEATURES)
    total = sum(clauses)
    return [math.log1p(total), max(clauses) / 4, math.log1p(len(clauses)), min(4.0, 25 * total / len(found)), math.log1p(softened), math.log1p(len(distinct))]


@dataclass
class Model:
    words: dict
    stems: dict
    weights: list[float]

    def lexicon(self) -> Lexicon:
        return Lexicon(self.words, self.stems)

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = features @ np.array(self.weights[1:]) + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


# ---------------------------------------------------------------- learning


def _places(tokens: list[str], seeds: dict[str, tuple[int, float]]) -> dict[str, tuple[int, bool]]:
    """For each word of three letters or more: the least hash of its pairs of neighbours, and whether it mostly stands as a threat's verb does."""
    least: dict[str, int] = {}
    verb: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    kind = lambda i: seeds[tokens[i]][0] if 0 <= i < len(tokens) and tokens[i] in seeds else OTHER
    for i, w in enumerate(tokens):
        if len(w) > 2:
            near = zlib.crc32(f"{tokens[i - 1] if i else ''} {tokens[i + 1] if i + 1 < len(tokens) else ''}".encode("utf-8", "replace"))
            least[w] = min(least.get(w, near), near)
            verb[w][0] += kind(i - 1) == MODAL or kind(i + 1) == TARGET and kind(i - 1) not in (COPULA, TARGET)
            verb[w][1] += 1
    return {w: (near, 2 * verb[w][0] > verb[w][1]) for w, near in least.items()}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to lines (feature, toxic, place or null, as verb, documents).

    A feature is a word, or a stem with a star that two or more different words of the text have. Toxic rows give a line each with
    the least hash of the feature's neighbours, by which copies of a text are known; of other rows documents are counted.
    """
    lines: list[tuple[str, int, bool]] = []
    clean: dict[str, int] = defaultdict(int)
    seeds = seed_words()

    def flush() -> pa.RecordBatch:
        names = [f for f, _, _ in lines] + list(clean)
        marks = [1] * len(lines) + [0] * len(clean)
        near = [h for _, h, _ in lines] + [None] * len(clean)
        verb = [v for _, _, v in lines] + [False] * len(clean)
        n = [1] * len(lines) + list(clean.values())
        lines.clear()
        clean.clear()
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(marks, pa.int32()), pa.array(near, pa.int64()), pa.array(verb, pa.bool_()), pa.array(n, pa.int64())], ["feature", "toxic", "near", "verb", "n"])

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            tokens = _TOKEN.findall((text.as_py() or "").lower())
            words = {w for w in tokens if len(w) > 2}
            stems: dict[str, list[str]] = defaultdict(list)
            for w in words:
                for n in STEMS:
                    if len(w) > n:
                        stems[w[:n]].append(w)
            shared = {s: ws for s, ws in stems.items() if len(ws) > 1}
            if toxic:
                places = _places(tokens, seeds)
                lines += [(w, *places[w]) for w in words]
                lines += [(s + "*", min(places[w][0] for w in ws), False) for s, ws in shared.items()]
            else:
                for f in words:
                    clean[f] += 1
                for f in shared:
                    clean[f + "*"] += 1
            if len(lines) + len(clean) > 400_000:
                yield flush()
    yield flush()


def _featurize(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    lexicon, machine = model.lexicon(), grammar()
    for batch in batches:
        rows = [clause_features(t.as_py(), lexicon, machine) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "features"])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> list[float]:
    """Weights (constant first) of a ridge-penalised logistic regression, by Newton's method with halving."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[0] = 1e-6

    def loss(v):
        z = a @ v
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * penalty @ (v * v)

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty), a.T @ (p - y) + penalty * w)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w.tolist()


def seed_words() -> dict[str, tuple[int, float]]:
    return {w: (kind, 2.0 if kind in (INSULT, VERB) else 0.0) for kind, ws in SEEDS.items() for w in ws.split()}


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", rows: int = LABELLED_ROWS, support: int = 4, odds: float = 3.9) -> Model:
    """Lexicon weights and calibration from at most about ``rows`` labelled rows, taken by a hash of their id.

    Two thirds of them give the lexicon: words, and stems that two words of a text share, whose documents are toxic far more
    often than others: log odds of ``odds`` or more with at least ``support`` toxic documents, copies of a text counted
    once. A word that mostly follows a modal or precedes a target is learned as a verb of threats, others as insults; seeds keep their
    class and gain weight at most. The shortest stem that is good enough stands for the longer ones. The last third calibrates the
    features of the grammar. Rows whose label or id is null are not used; an id with both labels counts as toxic. Without toxic or
    other rows the seeds score alone, with fixed weights. Of learned words and stems the
    ``LEXICON_SIZE`` with the largest odds are kept.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(toxic_col).cast("int").alias("toxic")).where("_id is not null and toxic in (0, 1)")
    n = known.count()
    every = max(1, -(-n // rows))
    known = known.where(F.pmod(F.xxhash64(F.lit(9), "_id"), F.lit(every)) == 0).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "_id")
    part = F.pmod(F.xxhash64(F.lit(10), "_id"), F.lit(3))

    counted = sample.where(part != 0).select("text", "toxic").mapInArrow(_count, "feature string, toxic int, near long, verb boolean, n long")
    by = counted.groupBy("feature", "toxic", "near").agg(F.sum("n").alias("n"), F.max("verb").alias("verb"))
    toxic = F.col("toxic") == 1
    by = by.groupBy("feature").agg(F.count_if(toxic).alias("hits"), F.count_if(toxic & F.col("verb")).alias("verbs"), F.sum(F.when(~toxic, F.col("n")).otherwise(0)).alias("clean"))
    totals = {r["toxic"]: r["n"] for r in sample.where(part != 0).groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    words, stems = seed_words(), {}
    default = [-4.0, 2.0, 1.0, 0.5, 0.5, -0.5, 0.5]
    if not n1 or not n0:
        return Model(words, stems, default)
    weight = F.log((F.col("hits") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    good = by.where(F.col("hits") >= support).withColumn("w", weight).where(F.col("w") >= odds).orderBy(F.desc("w"), "feature").limit(LEXICON_SIZE).select("feature", "w", "hits", "verbs").collect()
    for f, w in sorted((r["feature"], r["w"]) for r in good):
        if f.endswith("*"):
            stem = f[:-1]
            if not any(stem[:k] in stems for k in STEMS if k < len(stem)):
                stems[stem] = min(w, 8.0)
    for r in good:
        f, w = r["feature"], min(r["w"], 8.0)
        if not f.endswith("*") and not any(f[:k] in stems for k in STEMS if k < len(f)):
            kind, least = words.get(f, (VERB if 2 * r["verbs"] > r["hits"] else INSULT, 0.0))
            if kind in (INSULT, VERB):
                words[f] = (kind, max(w, least))
    model = Model(words, stems, default)
    rest = sample.where(part == 0).select("text", "toxic").mapInArrow(lambda it: _featurize(it, model), "toxic int, features array<double>").collect()
    y = np.array([r["toxic"] for r in rest], float)
    if len(y) and 0 < y.mean() < 1:
        model.weights = fit_logistic(np.array([r["features"] for r in rest]), y)
    return model


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    lexicon, machine = model.lexicon(), grammar()
    for batch in batches:
        rows = [clause_features(t.as_py(), lexicon, machine) for t in batch.column(1)]
        p = model.probability(np.array(rows, np.float64).reshape(len(rows), len(FEATURES)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], ["id", "score"])


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score): the probability that a whole text is toxic.

    Null and empty texts score as a text without matches. Null ids are kept, repeated rows are scored as often
    as they come, other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _score(it, model), "id long, score double").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, unchanged and where they lie.

    Null and empty texts score as a text without matches and so stay; null ids and repeated rows are judged row by row; an empty table
    gives an empty result.
    """
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, machine = model.lexicon(), grammar()
        for batch in batches:
            rows = [clause_features(t.as_py(), lexicon, machine) for t in batch.column(place)]
            p = model.probability(np.array(rows, np.float64).reshape(len(rows), len(FEATURES)))
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(keep, docs.schema)


def held_out(id_col: str = "doc_id"):
    """Rows that no model is learned from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted), learned from labels of rows that are not held out."""
    model = learn(docs, labels.where(~held_out(id_col)), id_col, text_col)
    scored = score_documents(docs, model, id_col, text_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

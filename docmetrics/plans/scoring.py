"""Queries over pairs of texts and their scores."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import metrics, text
from ..operators import neighbours, retrieval, routing, scoring
from ..shared import scratch
from ..sources import corpus, sinks
from .registry import ORACLE_SQL, query, r6

#: Thresholds at which a policy is replayed.
THRESHOLDS = (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 99.0)
_NORM = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_TURNS = f"""p AS (SELECT conv_id, turn, role, {_NORM.format("text")} AS hyp, lag({_NORM.format("text")}) OVER (PARTITION BY conv_id ORDER BY turn) AS ref FROM conversations),
  a AS (SELECT * FROM p WHERE ref IS NOT NULL)"""


def _distance(a: str, b: str) -> str:
    """SQL for the edit distance in characters: DuckDB's counts bytes, so the characters of a pair (at most 127 different ones) are put as single bytes."""
    seen = f"array_to_string(list_distinct(string_split({a} || {b}, '')), '')"
    one = lambda x: f"translate({x}, {seen}, array_to_string(list_transform(range(1, 128), lambda i: chr(CAST(i AS INT))), ''))"
    return f"levenshtein({one(a)}, {one(b)})"


def _decomposed(a: str) -> str:
    """SQL for Latin letters with a mark as letter and mark."""
    for c in map(chr, range(0xC0, 0x180)):
        if (parts := unicodedata.normalize("NFD", c)) != c:
            a = f"replace({a}, '{c}', '{parts}')"
    return a


def _words_as_bytes(a: str, lone: int) -> str:
    """SQL for a text with a byte for each word: shared ones by their number, all others alike, as they equal nothing on the other side."""
    return f"array_to_string(list_transform(string_split({a}, ' '), lambda w: chr(CAST(CASE WHEN list_position(shared, w) > 0 THEN list_position(shared, w) + 2 ELSE {lone} END AS INT))), '')"


_SHARED_WORDS = "list_intersect(string_split(ref, ' '), string_split(hyp, ' ')) AS shared"
_WER = f"CASE WHEN ref = '' THEN CASE WHEN hyp = '' THEN 0.0 ELSE 1.0 END WHEN hyp = '' THEN 1.0 ELSE CAST(levenshtein({_words_as_bytes('ref', 1)}, {_words_as_bytes('hyp', 2)}) AS DOUBLE) / len(string_split(ref, ' ')) END"
_CER = f"CASE WHEN ref = '' THEN CASE WHEN hyp = '' THEN 0.0 ELSE 1.0 END ELSE CAST({_distance('ref', 'hyp')} AS DOUBLE) / length(ref) END"


def _turns(t):
    """Each turn against the one before, normalised."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = t("conversations").select("conv_id", "turn", "role", text.normalize(F.col("text")).alias("hyp"))
    return n.withColumn("ref", F.lag("hyp").over(w)).where("ref is not null")


def _cer(keep_space=True):
    return metrics.cer(F.col("ref"), F.col("hyp"), keep_space, compose=False)


@query(f"WITH {_TURNS} SELECT conv_id, turn, round({_CER}, 6) AS cer FROM a")
def q04_turn_cer(t, spark):
    return _turns(t).select("conv_id", "turn", r6(_cer()).alias("cer"))


@query(f"WITH {_TURNS} SELECT role, count(*) AS n, round(avg({_CER}), 6) AS cer FROM a GROUP BY ROLLUP (role)")
def q05_turn_cer_rollup(t, spark):
    rows = scoring.category_means(_turns(t).withColumn("cer", _cer()), ["role"], ["cer"])
    return rows.select("role", "n", r6("cer").alias("cer"))


@query(f"""WITH p AS (SELECT a.item_id, b.item_id AS other, {_distance("a.text", "b.text")} AS d FROM benchmark a JOIN benchmark b ON a.item_id <> b.item_id)
  SELECT item_id, other, CAST(d AS INT) AS distance, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY d, other) AS k FROM p) WHERE k <= 3""")
def q06_benchmark_topk(t, spark):
    """The three nearest of all other items by edit distance, the lowest id on ties; a distance is counted once for both items of a pair."""
    return neighbours.nearest_texts(t("benchmark"), 3, "item_id")


@query(f"WITH {_TURNS}, x AS (SELECT *, {_SHARED_WORDS} FROM a) SELECT conv_id, turn, round({_WER}, 6) AS wer FROM x")
def q07_wer_pairs(t, spark):
    """Word error rates of turns."""
    return _turns(t).select("conv_id", "turn", r6(metrics.wer(F.col("ref"), F.col("hyp"), compose=False)).alias("wer"))


@query(f"WITH {_TURNS}, x AS (SELECT conv_id, turn, {_decomposed('ref')} AS ref, {_decomposed('hyp')} AS hyp FROM a) SELECT conv_id, turn, round({_CER}, 6) AS jamo_cer FROM x")
def q08_jamo_cer(t, spark):
    """Error rates over decomposed characters of turns."""
    return _turns(t).select("conv_id", "turn", r6(metrics.jamo_cer(F.col("ref"), F.col("hyp"))).alias("jamo_cer"))


@query("""WITH w AS (SELECT doc_id, unnest(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS word FROM documents),
  r AS (SELECT doc_id AS id, word, count(*) AS r FROM w GROUP BY ALL), h AS (SELECT doc_id - 1 AS id, word, count(*) AS h FROM w GROUP BY ALL),
  s AS (SELECT sum(least(coalesce(r, 0), coalesce(h, 0))) AS hit, sum(coalesce(h, 0)) AS n_hyp, sum(coalesce(r, 0)) AS n_ref FROM r FULL JOIN h USING (id, word))
  SELECT CAST(hit AS BIGINT) AS hit, CAST(n_hyp AS BIGINT) AS n_hyp, CAST(n_ref AS BIGINT) AS n_ref, round(hit / n_hyp, 6) AS precision, round(hit / n_ref, 6) AS recall, round(2 * (hit / n_hyp) * (hit / n_ref) / (hit / n_hyp + hit / n_ref), 6) AS f1 FROM s""")
def q09_word_bag_f1(t, spark):
    words = t("documents").select(F.col("doc_id").alias("id"), F.explode(F.split(text.normalize(F.col("text"), compose=False), " ")).alias("word"))
    s = scoring.bag_scores(words, words.withColumn("id", F.col("id") - 1))
    return s.select("hit", "n_hyp", "n_ref", *(r6(c).alias(c) for c in ("precision", "recall", "f1")))


_SHARED = "list_sum(list_transform(list_distinct(string_split({a}, '')), lambda c: least(length({a}) - length(replace({a}, c, '')), length({b}) - length(replace({b}, c, '')))))"
_BARE = r"regexp_replace({}, '\s+', '', 'g')"


@query(f"""WITH {_TURNS}, x AS (SELECT conv_id, turn, {_BARE.format("ref")} AS x, {_BARE.format("hyp")} AS y FROM a)
  SELECT conv_id, turn, round(CASE WHEN length(x) + length(y) = 0 THEN 0.0 WHEN x = '' THEN 1.0 ELSE 1 - 2 * {_SHARED.format(a="x", b="y")} / (length(x) + length(y)) END, 6) AS disagreement FROM x""")
def q10_char_disagreement(t, spark):
    return _turns(t).select("conv_id", "turn", r6(metrics.disagreement(F.col("ref"), F.col("hyp"))).alias("disagreement"))


@query(f"""WITH {_TURNS} SELECT conv_id, turn, length({_BARE.format("hyp")}) > 2 * greatest(1, length({_BARE.format("ref")})) AS over FROM a""")
def q11_overflow_flags(t, spark):
    return _turns(t).select("conv_id", "turn", metrics.overflow(F.col("ref"), F.col("hyp"), False).alias("over"))


@query(f"""WITH {_TURNS}, w AS (SELECT *, {_SHARED_WORDS} FROM a), s AS (SELECT *, {_CER} AS cer, {_WER} AS wer, turn % 5 / 5 AS teds, (conv_id + turn) % 4 = 0 AS flipped, length({_BARE.format("hyp")}) > 2 * greatest(1, length({_BARE.format("ref")})) AS over FROM w)
  SELECT role, count(*) AS n, round(avg(cer), 6) AS cer, round(avg(wer), 6) AS wer, round(avg(teds) FILTER (WHERE turn % 2 = 0), 6) AS teds, round(median(cer), 6) AS cer_median, round(avg(cer) FILTER (WHERE NOT flipped), 6) AS cer_upright,
  count(*) FILTER (WHERE cer > 0.5) AS failed, count(*) FILTER (WHERE over) AS overflow FROM s GROUP BY role""")
def q65_page_summary(t, spark):
    rows = _turns(t).select("role", _cer().alias("cer"), metrics.wer(F.col("ref"), F.col("hyp"), compose=False).alias("wer"), F.when(F.col("turn") % 2 == 0, F.col("turn") % 5 / 5).alias("teds"), ((F.col("conv_id") + F.col("turn")) % 4 == 0).alias("flipped"), metrics.overflow(F.col("ref"), F.col("hyp"), False).alias("over"))
    s = scoring.page_summary(rows, ["role"])
    return s.select("role", "n", *(r6(c).alias(c) for c in ("cer", "wer", "teds", "cer_median", "cer_upright")), "failed", "overflow")


@query(f"""WITH {_TURNS}, x AS (SELECT conv_id, turn, regexp_replace(ref, '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS x, regexp_replace(hyp, '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS y FROM a)
  SELECT conv_id, turn, round(CASE WHEN x = '' THEN CASE WHEN y = '' THEN 1.0 ELSE 0.0 END ELSE greatest(0.0, 1 - {_distance('x', 'y')} / length(x)) END, 6) AS similarity FROM x""")
def q66_similarity(t, spark):
    return _turns(t).select("conv_id", "turn", r6(metrics.similarity(F.col("ref"), F.col("hyp"), False)).alias("similarity"))


@query(rf"""WITH c AS (SELECT item_id, text, 0 AS idx FROM benchmark UNION ALL SELECT item_id, replace(text, 'e', ''), 1 FROM benchmark UNION ALL SELECT item_id, replace(text, 'th', 't'), 2 FROM benchmark),
  q AS (SELECT item_id, idx, regexp_replace(text, '[^\p{{L}}\p{{N}}]+', '', 'g') AS x FROM c),
  s AS (SELECT a.item_id, a.idx, sum(CASE WHEN a.x = '' THEN CASE WHEN b.x = '' THEN 1.0 ELSE 0.0 END ELSE greatest(0.0, 1 - {_distance("a.x", "b.x")} / length(a.x)) END) AS total FROM q a JOIN q b ON a.item_id = b.item_id AND a.idx <> b.idx GROUP BY ALL)
  SELECT item_id, CAST(idx AS INT) AS idx, round(total, 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(total, 9) DESC, idx) AS k FROM s) WHERE k = 1""")
def q33_candidate_vote(t, spark):
    """The reading closest to the others, the first on ties, of every item."""
    readings = [F.col("text"), F.replace("text", F.lit("e"), F.lit("")), F.replace("text", F.lit("th"), F.lit("t"))]
    c = t("benchmark").select("item_id", F.posexplode(F.array(*readings)).alias("idx", "text"))
    return scoring.vote(c, "item_id").select("item_id", "idx", r6("total").alias("total"))


@query("""WITH m AS (SELECT l_partkey AS part, l_suppkey AS engine, avg(l_discount) AS cer FROM lineitem GROUP BY ALL), e AS (SELECT part, engine, CASE WHEN (part + engine) % 7 > 0 THEN cer END AS cer FROM m)
  SELECT part, arg_min(engine, struct_pack(m := cer IS NULL, c := coalesce(cer, 0), e := engine)) AS engine, round(min(cer), 6) AS cer FROM e GROUP BY part""")
def q34_engine_argmin(t, spark):
    """The engine of the least error; engines without one come last."""
    e = t("lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("engine")).agg(F.avg("l_discount").alias("cer"))
    e = e.withColumns({"cer": F.when((F.col("part") + F.col("engine")) % 7 > 0, F.col("cer")), "ord": F.col("engine")})
    return scoring.argmin_by(e, ["part"], "cer", "engine", "ord").select("part", "engine", r6("cer").alias("cer"))


@query("""WITH m AS (SELECT l_orderkey, l_linestatus AS engine, avg(l_discount) AS cer, round(avg(l_tax) - 0.02, 9) AS conf FROM lineitem GROUP BY ALL),
  e AS (SELECT l_orderkey, engine, cer, CASE WHEN l_orderkey % 5 > 0 OR engine = 'F' THEN conf END AS conf FROM m),
  b AS (SELECT l_orderkey, min(cer) AS bound, arg_max(cer, struct_pack(c := coalesce(conf, 0), e := CASE WHEN engine = 'F' THEN 1 ELSE 0 END)) AS chosen FROM e GROUP BY 1)
  SELECT count(*) AS n, round(avg(bound), 6) AS bound, round(avg(chosen), 6) AS chosen FROM b""")
def q35_oracle_bound(t, spark):
    """Mean of the best engine of every document, and of the one with the largest confidence; an engine without one counts as 0."""
    e = t("lineitem").groupBy("l_orderkey", F.col("l_linestatus").alias("engine")).agg(F.avg("l_discount").alias("cer"), F.round(F.avg("l_tax") - 0.02, 9).alias("conf"))
    e = e.withColumn("conf", F.when((F.col("l_orderkey") % 5 > 0) | (F.col("engine") == "F"), F.col("conf")))
    best = scoring.argmax_by(e.withColumn("ord", F.when(F.col("engine") == "F", 0).otherwise(1)), ["l_orderkey"], "conf", "engine", "ord").select("l_orderkey", "engine")
    chosen = e.join(best, ["l_orderkey", "engine"]).select("l_orderkey", F.col("cer").alias("chosen"))
    b = e.groupBy("l_orderkey").agg(F.min("cer").alias("bound")).join(chosen, "l_orderkey")
    return b.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("bound")).alias("bound"), r6(F.avg("chosen")).alias("chosen"))


@query("""SELECT CASE WHEN l_discount < 0.02 THEN 0 WHEN l_discount < 0.05 THEN 1 WHEN l_discount < 0.08 THEN 2 ELSE 3 END AS bucket, count(*) AS n, round(avg(l_tax), 6) AS error,
  round(avg(CASE WHEN l_tax = 0 THEN 1 ELSE 0 END), 6) AS perfect FROM lineitem WHERE l_discount >= 0 AND l_discount < 1.01 GROUP BY 1""")
def q26_bucket_calibration(t, spark):
    c = scoring.calibration(t("lineitem"), [0.0, 0.02, 0.05, 0.08, 1.01], "l_discount", "l_tax")
    return c.select("bucket", "n", r6("error").alias("error"), r6("perfect").alias("perfect"))


@query("""SELECT l.quality AS want, CASE WHEN d.n_chars > 1000 THEN 1 ELSE 0 END AS got, count(*) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY ALL""")
def q36_confusion(t, spark):
    j = t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id")
    return scoring.confusion(j.select(F.col("quality").alias("want"), (F.col("n_chars") > 1000).cast("int").alias("got")))


def _judged(t):
    j = t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id")
    return j.select(F.col("doc_id").alias("id"), F.col("quality").alias("want"), (F.col("n_chars") > 1000).cast("int").alias("got"))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE quality = (n_chars > 1000)::INT) AS correct, round(avg((quality = (n_chars > 1000)::INT)::INT), 6) AS accuracy FROM labels JOIN documents USING (doc_id)""")
def q67_accuracy(t, spark):
    return scoring.accuracy(_judged(t)).select("n", "correct", r6("accuracy").alias("accuracy"))


@query("""SELECT doc_id AS id, quality AS want, (n_chars > 1000)::INT AS got FROM labels JOIN documents USING (doc_id) WHERE quality <> (n_chars > 1000)::INT""")
def q92_wrong_keys(t, spark):
    return scoring.wrong_keys(_judged(t))


@query("""WITH g AS (SELECT * FROM (VALUES ('english', 'en'), ('romance', 'fr'), ('romance', 'es'), ('all', 'en'), ('all', 'fr'), ('all', 'es'), ('all', 'de')) v(name, lang))
  SELECT name AS "group", count(*) AS n, count(*) FILTER (WHERE toxic = 1 AND quality = 0) AS caught, count(*) FILTER (WHERE quality = 0) AS wrong, count(*) FILTER (WHERE toxic = 1 AND quality <> 0) AS false_alarms
  FROM labels JOIN documents USING (doc_id) JOIN g USING (lang) GROUP BY 1""")
def q56_flags_by_group(t, spark):
    """How well one label finds the other, over named groups of languages that overlap."""
    j = t("labels").join(t("documents").select("doc_id", "lang"), "doc_id")
    j = scoring.in_groups(j.withColumns({"flag": F.col("toxic") == 1, "bad": F.col("quality") == 0}), {"english": ["en"], "romance": ["fr", "es"], "all": ["en", "fr", "es", "de"]}, "lang")
    return scoring.flag_counts(j, "flag", "bad", ["group"])


@query("""SELECT event_type, round(avg(value) FILTER (WHERE day(ts) <= 10), 6) AS early, round(avg(value) FILTER (WHERE day(ts) > 10 AND day(ts) <= 20), 6) AS middle,
  round(avg(value) FILTER (WHERE day(ts) > 20), 6) AS late FROM events GROUP BY event_type""")
def q37_variant_pivot(t, spark):
    day = F.dayofmonth("ts")
    e = t("events").withColumn("part", F.when(day <= 10, "early").when(day <= 20, "middle").otherwise("late"))
    p = scoring.variant_pivot(e, "event_type", "part", ["early", "middle", "late"], "value")
    return p.select("event_type", *(r6(c).alias(c) for c in ("early", "middle", "late")))


@query("""SELECT l_returnflag, round(avg(l_extendedprice), 4) AS before, round(avg(l_extendedprice * (1 - l_discount)), 4) AS after, round(avg(l_extendedprice * (1 - l_discount)) - avg(l_extendedprice), 4) AS delta FROM lineitem GROUP BY 1""")
def q68_before_after(t, spark):
    rows = t("lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return scoring.compare(rows, "l_returnflag", "l_extendedprice", "net").select("l_returnflag", *(F.round(c, 4).alias(c) for c in ("before", "after", "delta")))


@query("""WITH q AS (SELECT vec_id AS qid, label AS want, embedding AS v FROM embeddings WHERE vec_id % 20 = 0),
  s AS (SELECT qid, e.vec_id AS cid, e.label, want, list_cosine_similarity(CAST(q.v AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS sim FROM q JOIN embeddings e ON e.vec_id <> q.qid),
  r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 12) DESC, cid) AS rank FROM s)
  SELECT qid, cid, round(sim, 6) AS sim, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3""")
def q39_cosine_topk(t, spark):
    """The stated query set, every 20th vector, against all others."""
    return _hits(t).select("qid", "cid", r6("sim").alias("sim"), "rank")


def _hits(t):
    e = t("embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return neighbours.nearest_join(q, e.select(F.col("vec_id").alias("cid"), F.col("embedding").alias("cvec")), 3, others=True)


@query("""WITH s AS (SELECT q.vec_id AS qid, e.vec_id AS cid, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS sim FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 12) DESC, cid) AS rank FROM s)
  SELECT qid, cid, round(sim, 6) AS sim, CAST(rank AS INT) AS rank FROM r WHERE rank <= 2""")
def q96_all_nearest(t, spark):
    """The two nearest of all other vectors, for every vector: a join of two sides of any size."""
    e = t("embeddings")
    hits = neighbours.nearest_join(e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")), e.select(F.col("vec_id").alias("cid"), F.col("embedding").alias("cvec")), 2, others=True)
    return hits.select("qid", "cid", r6("sim").alias("sim"), "rank")


@query("""WITH q AS (SELECT vec_id AS qid, label AS want, embedding AS v FROM embeddings WHERE vec_id % 20 = 0),
  s AS (SELECT qid, e.vec_id AS cid, e.label, want, list_cosine_similarity(CAST(q.v AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS sim FROM q JOIN embeddings e ON e.vec_id <> q.qid),
  r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 12) DESC, cid) AS rank FROM s),
  f AS (SELECT qid, min(rank) FILTER (WHERE label = want) AS rank FROM r WHERE rank <= 3 GROUP BY qid)
  SELECT count(*) AS n, round(avg(coalesce(rank = 1, false)::INT), 6) AS hit_at_1, round(avg((rank IS NOT NULL)::INT), 6) AS hit_at_k FROM f""")
def q40_hit_at_k(t, spark):
    e = t("embeddings")
    hits = _hits(t).join(e.select(F.col("vec_id").alias("cid"), F.col("label").alias("hit")), "cid")
    truth = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("want"))
    r = retrieval.hit_rates(retrieval.hit_ranks(hits, truth))
    return r.select("n", r6("hit_at_1").alias("hit_at_1"), r6("hit_at_k").alias("hit_at_k"))


_BOTH = f"""WITH {_TURNS}, x AS (SELECT conv_id, turn, {_BARE.format("ref")} AS g, {_BARE.format(r"regexp_replace(hyp, '\[[0-9]+\]', '', 'g')")} AS p FROM a)"""


@query(f"{_BOTH} SELECT conv_id, turn, contains(p, g) OR (2 * length(p) >= length(g) AND contains(g, p)) AS correct FROM x")
def q41_answer_correct(t, spark):
    return _turns(t).select("conv_id", "turn", text.is_correct(F.col("ref"), F.col("hyp"), False).alias("correct"))


@query(f"""{_BOTH} SELECT conv_id, turn, round(CASE WHEN g = '' OR p = '' OR {_SHARED.format(a="g", b="p")} = 0 THEN 0.0 ELSE 2 * {_SHARED.format(a="g", b="p")} / (length(g) + length(p)) END, 6) AS f1 FROM x""")
def q42_answer_char_f1(t, spark):
    return _turns(t).select("conv_id", "turn", r6(metrics.char_f1(F.col("ref"), F.col("hyp"))).alias("f1"))


@query()
def q45_route_policy(t, spark):
    """Which of three readings (a turn, the one before, the one before that) a policy takes at seven thresholds."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = t("conversations").select("conv_id", "turn", F.col("text").alias("fast"), F.lag("text").over(w).alias("vl"), F.lag("text", 2).over(w).alias("vlm")).where("vl is not null")
    p = p.withColumns({"r1": metrics.compression_ratio("vl"), "r2": metrics.compression_ratio("vlm"), "d1": metrics.disagreement(F.col("fast"), F.col("vl")), "d2": metrics.disagreement(F.col("fast"), F.col("vlm"))})
    p = p.select("*", F.explode(F.array(*(F.lit(x) for x in THRESHOLDS))).alias("threshold"))
    chosen = routing.policy(*(F.col(c) for c in ("fast", "vl", "vlm", "r1", "d1", "r2", "d2", "threshold")))
    return p.select("threshold", chosen.alias("c"), routing.review(F.col("d1")).alias("review")).groupBy("threshold", "c.source", "c.retried").agg(F.count(F.lit(1)).alias("n"), F.count_if("review").alias("reviewed"))


@query("""SELECT event_type, count(*) AS images, round(median(value), 6) AS latency_median, round(list_sort(list(value))[CAST(floor(count(*) * 0.9) AS INT) + 1], 6) AS latency_p90,
  CAST(sum(event_id % 100) AS BIGINT) AS tokens, count(*) FILTER (WHERE event_id % 7 = 0) AS cut, round(count(*) / max(user_id + 1), 6) AS images_per_s, round(avg(event_id % 10 / 10), 6) AS cer_mean, round(median(event_id % 10 / 10), 6) AS cer_median FROM events GROUP BY event_type""")
def q55_throughput(t, spark):
    e = t("events").select("event_type", F.col("value").alias("latency"), (F.col("event_id") % 100).alias("tokens"), F.when(F.col("event_id") % 7 == 0, "length").otherwise("stop").alias("finish"), (F.col("user_id") + 1).cast("double").alias("wall"), (F.col("event_id") % 10 / 10).alias("cer"))
    r = scoring.throughput(e, ["event_type"], cer="cer")
    return r.select("event_type", "images", r6("latency_median").alias("latency_median"), r6("latency_p90").alias("latency_p90"), "tokens", "cut", *(r6(c).alias(c) for c in ("images_per_s", "cer_mean", "cer_median")))


@query(f"""WITH {_TURNS} SELECT role, count(*) AS n, round(avg(({_BARE.format("ref")} = {_BARE.format("hyp")})::INT), 6) AS accuracy, round(avg(least(1.0, {_CER})), 6) AS cer FROM a GROUP BY role""")
def q69_word_accuracy(t, spark):
    bare = lambda c: text.normalize(F.col(c), False, False)
    s = _turns(t).select("role", (bare("ref") == bare("hyp")).cast("int").alias("ok"), F.least(F.lit(1.0), _cer()).alias("cer"))
    return s.groupBy("role").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("ok")).alias("accuracy"), r6(F.avg("cer")).alias("cer"))


@query("""WITH s AS (SELECT event_type AS stage, count(*) AS calls, round(sum(value), 4) AS ms FROM events GROUP BY 1) SELECT stage, CAST(calls AS DOUBLE) AS calls, ms, round(ms / (SELECT sum(ms) FROM s), 6) AS share FROM s""")
def q70_stage_share(t, spark):
    """Times by stage, written as CSV and read back."""
    s = t("events").groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("ms"))
    path = scratch(spark, "stages")
    sinks.write_csv(s, path)
    found = corpus.read_stage_times(spark, path, ["view", "signup", "click", "error", "purchase"])
    return found.select("stage", "calls", "ms", r6("share").alias("share"))


@query("""WITH p AS (SELECT conv_id, turn, CAST(length(text) AS DOUBLE) AS a, lag(CAST(length(text) AS DOUBLE)) OVER w AS b, lag(CAST(length(text) AS DOUBLE), 2) OVER w AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  d AS (SELECT *, abs(a - b) / a AS d1, abs(a - c) / a AS d2, (conv_id + turn) % 6 AS r1, (conv_id * turn) % 6 AS r2 FROM p WHERE b IS NOT NULL AND a > 0),
  s AS (SELECT th AS threshold, CASE WHEN r1 <= 4 AND d1 <= th THEN 'vl' WHEN c IS NULL THEN CASE WHEN r1 > 4 THEN 'fast' ELSE 'vl' END WHEN r2 <= 4 AND (r1 > 4 OR d2 < d1) THEN 'vlm' ELSE 'vl' END AS source,
    NOT ((r1 <= 4 AND d1 <= th) OR c IS NULL) AS retried, d1 > 0.05 AS review FROM d, (SELECT unnest([0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 99.0]::DOUBLE[]) AS th))
  SELECT threshold, source, retried, count(*) AS n, count(*) FILTER (WHERE review) AS reviewed FROM s GROUP BY ALL""")
def q88_threshold_sweep(t, spark):
    """The policy at seven thresholds, over all turns, with differences by length and made-up repetition."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    size = F.length("text").cast("double")
    p = t("conversations").select("conv_id", "turn", size.alias("a"), F.lag(size).over(w).alias("b"), F.lag(size, 2).over(w).alias("c")).where("b is not null and a > 0")
    p = p.withColumns({"d1": F.abs(F.col("a") - F.col("b")) / F.col("a"), "d2": F.abs(F.col("a") - F.col("c")) / F.col("a"), "r1": (F.col("conv_id") + F.col("turn")) % 6, "r2": (F.col("conv_id") * F.col("turn")) % 6})
    p = p.select("*", F.explode(F.array(*(F.lit(x) for x in THRESHOLDS))).alias("threshold"))
    chosen = routing.policy(*(F.col(c).cast("string") for c in "abc"), *(F.col(c) for c in ("r1", "d1", "r2", "d2", "threshold")))
    return p.select("threshold", chosen.alias("c"), routing.review(F.col("d1")).alias("review")).groupBy("threshold", "c.source", "c.retried").agg(F.count(F.lit(1)).alias("n"), F.count_if("review").alias("reviewed"))


@query(f"""WITH {_TURNS}, x AS (SELECT role, turn, ref, hyp, {_BARE.format("ref")} AS g, {_BARE.format(r"regexp_replace(hyp, '\[[0-9]+\]', '', 'g')")} AS p, contains(hyp, 'not') AS unknown FROM a),
  r AS (SELECT *, NOT unknown AND (contains(p, g) OR (2 * length(p) >= length(g) AND contains(g, p))) AS correct, CASE WHEN unknown OR g = '' OR p = '' OR {_SHARED.format(a="g", b="p")} = 0 THEN 0.0 ELSE 2 * {_SHARED.format(a="g", b="p")} / (length(g) + length(p)) END AS f1 FROM x)
  SELECT role, count(*) AS n, round(avg((turn % 4 = 1)::INT), 6) AS hit_at_1, round(avg((turn % 4 <> 0)::INT), 6) AS hit_at_k, round(avg((turn % 2 = 0 OR contains({_BARE.format("hyp")}, g))::INT), 6) AS in_chunks, round(avg(correct::INT), 6) AS correct, round(avg(f1), 6) AS f1,
    round(avg(unknown::INT), 6) AS unknown, round(avg((NOT correct AND NOT unknown)::INT), 6) AS wrong FROM r GROUP BY role""")
def q93_answer_report(t, spark):
    """Every turn as an answer to the one before: rates by role. Turns with 'not' stand for answers that do not know."""
    rank = F.when(F.col("turn") % 4 != 0, F.col("turn") % 4)
    pred = F.when(F.contains(F.col("hyp"), F.lit("not")), text.UNKNOWN).otherwise(F.col("hyp"))
    found = F.array(F.col("hyp"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("x "), "ref")).otherwise(""))
    rows = _turns(t).select("role", rank.alias("rank"), F.col("ref").alias("answer"), pred.alias("pred"), retrieval.answer_in_chunks(F.col("ref"), found).alias("in_chunks"))
    r = retrieval.answer_report(rows, ["role"], True)
    return r.select("role", "n", *(r6(c).alias(c) for c in ("hit_at_1", "hit_at_k", "in_chunks", "correct", "f1", "unknown", "wrong")))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE event_id % 11 = 0) AS errors, round(avg(value) FILTER (WHERE event_id % 11 <> 0), 6) AS time_mean, round(median(value) FILTER (WHERE event_id % 11 <> 0), 6) AS time_median FROM events GROUP BY 1""")
def q94_latency(t, spark):
    """Median and mean time of what did not fail, by kind."""
    e = t("events").select("event_type", F.col("value").alias("time"), (F.col("event_id") % 11 == 0).alias("error"))
    r = scoring.latency_summary(e, ["event_type"])
    return r.select("event_type", "n", "errors", r6("time_mean").alias("time_mean"), r6("time_median").alias("time_median"))

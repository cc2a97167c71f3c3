"""Aggregations of scores into reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import compression_ratio, similarity
from .quantiles import LOWER, UPPER, order_statistics
from .sampling import numbered


def category_means(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Means and counts by group and overall (ROLLUP): the overall mean is over rows, not over groups."""
    return rows.rollup(*by).agg(F.count(F.lit(1)).alias("n"), *(F.avg(v).alias(v) for v in values))


def _joined(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Left join by columns in which null equals null; without columns both have one row."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    other = right.select(*(F.col(c).alias(f"_by_{c}") for c in by), *(c for c in right.columns if c not in by))
    on = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    return left.join(other, on, "left").drop(*(f"_by_{c}" for c in by))


def with_median(summary: DataFrame, rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``summary`` with the exact median of a value by group."""
    middle = order_statistics(rows, by, {value: {"_low": LOWER, "_high": UPPER}}).select(*by, ((F.col("_low") + F.col("_high")) / 2).alias(name))
    return _joined(summary, middle, by)


def page_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Summary of scored pages (cer, wer, flipped, teds, over): count, mean, median, mean without flipped pages, failures, overflows."""
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.avg("cer").alias("cer"),
        F.avg("wer").alias("wer"),
        F.avg(F.when(~F.col("flipped"), F.col("cer"))).alias("cer_upright"),
        F.avg("teds").alias("teds"),
        F.count_if(F.col("cer") > 0.5).alias("failed"),
        F.count_if("over").alias("overflow"),
    ]
    return with_median(rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs), rows, by or [], "cer", "cer_median")


def latency_summary(rows: DataFrame, by: list[str], time: str = "time", error: str = "error") -> DataFrame:
    """Median and mean time an item of the items without error, by run, with the numbers of items and errors."""
    fine = rows.where(~F.coalesce(F.col(error), F.lit(False)))
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(error).alias("errors"), F.avg(F.when(~F.coalesce(F.col(error), F.lit(False)), F.col(time))).alias("time_mean"))
    return with_median(counts, fine, by, time, "time_median")


def scorable(rows: DataFrame, flipped: str | None = "flipped", words: str | None = None) -> DataFrame:
    """Rows that count: not flipped and, where ``words`` names an array of words, with at least one that is not to be ignored."""
    kept = rows.where(~F.coalesce(F.col(flipped), F.lit(False))) if flipped else rows
    return kept.where(F.exists(words, lambda w: ~F.coalesce(w["ignore"], F.lit(False)))) if words else kept


def failures(rows: DataFrame, text: str = "text", finish: str = "finish", error: str = "error", key: str = "id") -> DataFrame:
    """(key, loop, cut, error) of readings that repeat themselves, were cut short or failed."""
    marks = rows.select(key, (compression_ratio(text) > 4).alias("loop"), (F.col(finish) == "length").alias("cut"), F.coalesce(F.col(error), F.lit(False)).alias("error"))
    return marks.where("loop or cut or error")


def bag_scores(ref: DataFrame, hyp: DataFrame, key: str = "id", item: str = "word", ignore: str | None = None) -> DataFrame:
    """Micro precision, recall and F1 of bags of items: (key, item) rows of either side. Rows of ``ref`` whose column ``ignore`` is true are left out."""
    ref = ref.where(~F.coalesce(F.col(ignore), F.lit(False))) if ignore else ref
    left = ref.groupBy(key, item).agg(F.count(F.lit(1)).alias("r"))
    right = hyp.groupBy(key, item).agg(F.count(F.lit(1)).alias("h"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    both = left.join(right, [key, item], "full").select(zero("r").alias("r"), zero("h").alias("h"))
    s = both.agg(zero(F.sum(F.least("r", "h"))).alias("hit"), zero(F.sum("h")).alias("n_hyp"), zero(F.sum("r")).alias("n_ref"))
    p, r = F.col("hit") / F.greatest(F.lit(1), "n_hyp"), F.col("hit") / F.greatest(F.lit(1), "n_ref")
    s = s.withColumn("precision", p).withColumn("recall", r)
    return s.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.lit(1e-9), F.col("precision") + F.col("recall")))


def bucket(value: Column, edges: list[float]) -> Column:
    """Number of the half-open bucket [edges[i], edges[i+1]) of a value, null outside."""
    out = F.when(value < edges[0], None)
    for i, top in enumerate(edges[1:]):
        out = out.when(value < top, i)
    return out


def calibration(rows: DataFrame, edges: list[float], score: str = "score", error: str = "cer") -> DataFrame:
    """By bucket of confidence: count, mean error, share without error."""
    b = rows.withColumn("bucket", bucket(F.col(score), edges)).where("bucket is not null")
    return b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(error).alias("error"), F.avg((F.col(error) == 0).cast("int")).alias("perfect"))


def compare(rows: DataFrame, by: str, before: str, after: str) -> DataFrame:
    """Means of two variants by group, with their difference."""
    return rows.groupBy(by).agg(F.avg(before).alias("before"), F.avg(after).alias("after")).withColumn("delta", F.col("after") - F.col("before"))


def variant_pivot(rows: DataFrame, row: str, variant: str, values: list[str], metric: str) -> DataFrame:
    return rows.groupBy(row).pivot(variant, values).agg(F.avg(metric))


def confusion(rows: DataFrame, want: str = "want", got: str = "got") -> DataFrame:
    return rows.groupBy(want, got).agg(F.count(F.lit(1)).alias("n"))


def accuracy(rows: DataFrame, want: str = "want", got: str = "got") -> DataFrame:
    """Count, right ones, accuracy. The keys of the wrong ones are rows of ``wrong_keys``, as there may be very many."""
    right = F.col(want).eqNullSafe(F.col(got))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("correct"), F.avg(right.cast("int")).alias("accuracy"))


def wrong_keys(rows: DataFrame, want: str = "want", got: str = "got", key: str = "id") -> DataFrame:
    """(key, want, got) of the wrong rows."""
    return rows.where(~F.col(want).eqNullSafe(F.col(got))).select(key, want, got)


def histogram(rows: DataFrame, label: str, top: int | None = None) -> DataFrame:
    """Counts by label, the most frequent first (labels in their order on ties), only the first ``top`` where given: (label, n, rank).

    Without ``top`` the labels are ranked by ranges of counts, however many there are; the first ``top`` are taken in every task before they meet.
    """
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    if top is None:
        return numbered(counts, [F.desc("n"), F.col(label)], "_at").select(label, "n", (F.col("_at") + 1).cast("int").alias("rank")).orderBy("rank")
    return counts.orderBy(F.desc("n"), label).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), label)))


def character_counts(texts: DataFrame, text: str = "text", ch: str = "ch") -> DataFrame:
    """(ch, n): characters of the texts but white space. Counted where the texts lie first, so a task sends a row for each distinct one, and only these are looked at."""
    counts = texts.select(F.explode(F.split(text, "")).alias(ch)).groupBy(ch).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(~F.col(ch).rlike(r"(?U)^\s*$"))


def dictionary_coverage(texts: DataFrame, dictionary: DataFrame, top: int = 15, text: str = "text", ch: str = "ch") -> DataFrame:
    """One row on what a dictionary of characters lacks of those in the texts.

    Kinds and number of characters used, size of the dictionary and how many of it are Hangul syllables, kinds, number and share of
    characters lost, and the ``top`` most frequent ones lost as an array of (n, ch).
    """
    known = dictionary.select(ch).distinct()
    used = character_counts(texts, text, ch).join(known.withColumn("_in", F.lit(True)), ch, "left")
    lost = F.col("_in").isNull()
    summary = used.agg(F.count(F.lit(1)).alias("kinds"), F.coalesce(F.sum("n"), F.lit(0)).alias("characters"), F.count_if(lost).alias("lost_kinds"), F.coalesce(F.sum(F.when(lost, F.col("n"))), F.lit(0)).alias("lost"))
    size = known.agg(F.count(F.lit(1)).alias("dictionary"), F.count_if(F.col(ch).rlike("^[가-힣]$")).alias("hangul"))
    first = used.where(lost).orderBy(F.desc("n"), ch).limit(top).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(ch).alias("ch")))), lambda x: F.struct((-x["m"]).alias("n"), x["ch"].alias("ch"))).alias("top"))
    row = summary.crossJoin(F.broadcast(size)).crossJoin(F.broadcast(first))
    return row.withColumn("lost_share", F.try_divide(F.col("lost").cast("double"), F.col("characters").cast("double")))


def missing_characters(texts: DataFrame, dictionary: DataFrame, text: str = "text", ch: str = "ch") -> DataFrame:
    """Characters of the texts that a dictionary lacks, with their counts."""
    return character_counts(texts, text, ch).join(dictionary.select(ch).distinct(), ch, "left_anti")


def argmin_by(rows: DataFrame, by: list[str], value: str, name: str, order: str) -> DataFrame:
    """The name with the least value in each group; on ties the first in ``order``. A null value is the last choice."""
    best = F.min(F.struct(F.col(value).isNull().alias("_none"), F.col(value).alias("_value"), F.col(order).alias("_order"), F.col(name).alias("_name")))
    return rows.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b._name").alias(name), F.col("b._value").alias(value))


def argmax_by(rows: DataFrame, by: list[str], value: str, name: str, order: str, empty: float = 0.0) -> DataFrame:
    """The name with the largest value in each group; on ties the first in ``order``. A null value (an empty reading) counts as ``empty``."""
    flipped = rows.withColumn("_v", -F.coalesce(F.col(value), F.lit(empty)))
    return argmin_by(flipped, by, "_v", name, order).select(*by, name, (-F.col("_v")).alias(value))


def vote(candidates: DataFrame, key: str, idx: str = "idx", text: str = "text") -> DataFrame:
    """Of the readings of each item, the one most similar to all others, the first on ties: (key, idx, total)."""
    others = candidates.select(key, F.col(text).alias("_other"), F.col(idx).alias("_j"))
    similar = similarity(F.col(text), F.col("_other"), False)
    totals = candidates.join(others, key).where(F.col(idx) != F.col("_j")).groupBy(key, idx).agg(F.sum(similar).alias("total"))
    w = Window.partitionBy(key).orderBy(F.desc(F.round("total", 9)), idx)
    return totals.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(key, idx, "total")


def nearest_rank(rows: DataFrame, by: list[str], value: str, share: float, name: str = "rank") -> DataFrame:
    """The value at place int(n * share) of each group's sorted values, counted from 0 (not interpolated), the last where that is beyond."""
    return order_statistics(rows, by, {value: {name: lambda n: F.least(F.floor(n * F.lit(share)), n - 1)}})


def throughput(rows: DataFrame, by: list[str], latency: str = "latency", tokens: str = "tokens", finish: str = "finish", cer: str | None = None) -> DataFrame:
    """Counts, wall time (column ``wall``: the longest of a group), rates, latency median and p90, cut outputs; mean and median of ``cer`` where given.

    All order statistics are found together, and no group of rows is gathered in one task.
    """
    aggs = [F.count(F.lit(1)).alias("images"), F.max("wall").alias("wall_s"), F.sum(tokens).alias("tokens"), F.count_if(F.col(finish) == "length").alias("cut")]
    out = rows.groupBy(*by).agg(*aggs, *([F.avg(cer).alias("cer_mean")] if cer else []))
    places = {latency: {"_low": LOWER, "_high": UPPER, "latency_p90": lambda n: F.floor(n * F.lit(0.9))}} | ({cer: {"_cer_low": LOWER, "_cer_high": UPPER}} if cer else {})
    found = order_statistics(rows, by, places)
    middles = [((F.col("_low") + F.col("_high")) / 2).alias("latency_median")] + ([((F.col("_cer_low") + F.col("_cer_high")) / 2).alias("cer_median")] if cer else [])
    out = _joined(out, found.select(*by, "latency_p90", *middles), by)
    per_s = lambda c: F.try_divide(F.col(c).cast("double"), F.col("wall_s"))
    return out.withColumn("images_per_s", per_s("images")).withColumn("tokens_per_s", per_s("tokens"))


def document_fields(truth: DataFrame, pred: DataFrame, key: str = "id", norm: Callable[[Column], Column] | None = None, broken: DataFrame | None = None) -> DataFrame:
    """Extracted fields of each document against its truth: (key, name, value) and (key, name, value, grounded).

    A predicted field is right where the truth has its name and, after ``norm``, its value (null equals null); a name that the
    truth lacks is never right. Wrong and right values are told apart by whether they occur in the text; a null value is not
    judged by that, and counts with the wrong ones that do. ``broken`` (key): documents whose answer could not be read; they are left out on both sides.

    Returns (key, predicted, wanted, correct, ungrounded_ok, ungrounded_bad, grounded_bad, fields, wrong): ``fields`` is the number
    of predicted fields, or of true ones where these are more, and ``wrong`` says whether any field is wrong or
    their numbers differ.
    """
    norm = norm or (lambda c: c)
    got = pred.select(F.col(key), "name", norm(F.col("value")).alias("got"), F.coalesce("grounded", F.lit(False)).alias("grounded"), F.lit(True).alias("_p"))
    want = truth.select(F.col(key), "name", norm(F.col("value")).alias("want"), F.lit(True).alias("_t"))
    if broken is not None:
        got, want = (side.join(broken.select(key).distinct(), key, "left_anti") for side in (got, want))
    both = got.join(want, [key, "name"], "full")
    p, t = (F.coalesce(c, F.lit(False)) for c in ("_p", "_t"))
    ok = p & t & F.col("got").eqNullSafe(F.col("want"))
    made_up = p & F.col("got").isNotNull() & ~F.coalesce("grounded", F.lit(False))
    counts = {"predicted": p, "wanted": t, "correct": ok, "ungrounded_ok": made_up & ok, "ungrounded_bad": made_up & ~ok, "grounded_bad": p & ~made_up & ~ok}
    docs = both.groupBy(key).agg(*(F.count_if(c).alias(name) for name, c in counts.items()))
    differ = (F.col("correct") < F.col("predicted")) | (F.col("predicted") != F.col("wanted"))
    return docs.withColumns({"fields": F.greatest("predicted", "wanted"), "wrong": differ})


def field_accuracy(truth: DataFrame, pred: DataFrame, key: str = "id", norm: Callable[[Column], Column] | None = None, broken: DataFrame | None = None) -> DataFrame:
    """Sums of ``document_fields`` over all documents, with the number of broken ones: those are skipped and counted.

    Fields that a document lacks count as wrong, by document: too many in one do not make up for too few in another.
    """
    docs = document_fields(truth, pred, key, norm, broken)
    names = ("fields", "correct", "ungrounded_ok", "ungrounded_bad", "grounded_bad")
    total = docs.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names))
    return total.crossJoin(F.broadcast(broken.agg(F.countDistinct(key).alias("broken")))) if broken is not None else total


def set_match(truth: Column, pred: Column) -> Column:
    """Struct of hits, wanted and got of two arrays taken as sets."""
    return F.struct(F.size(F.array_intersect(truth, pred)).alias("hit"), F.size(F.array_distinct(truth)).alias("want"), F.size(F.array_distinct(pred)).alias("got"))


def field_hits(matches: DataFrame, name: str = "name", match: str = "match") -> DataFrame:
    """Hits, wanted and got of ``set_match`` structs, summed by field, with precision and recall."""
    total = matches.groupBy(name).agg(*(F.sum(f"{match}.{c}").alias(c) for c in ("hit", "want", "got")))
    return total.withColumns({"precision": F.try_divide(F.col("hit"), F.col("got")), "recall": F.try_divide(F.col("hit"), F.col("want"))})


def flag_counts(rows: DataFrame, flagged: str, wrong: str, by: list[str] | None = None) -> DataFrame:
    """How well a warning finds wrong rows, over all or by group."""
    f, w = F.col(flagged), F.col(wrong)
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(f & w).alias("caught"), F.count_if(w).alias("wrong"), F.count_if(f & ~w).alias("false_alarms")]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def in_groups(rows: DataFrame, groups: dict[str, list[str]], category: str = "category", group: str = "group") -> DataFrame:
    """Each row once for every named group that lists its category."""
    named = F.array_compact(F.array(*(F.when(F.col(category).isin(*members), F.lit(name)) for name, members in groups.items())))
    return rows.withColumn(group, F.explode(named))

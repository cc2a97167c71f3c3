"""Joins of predicted and true boxes within documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import iou, overlap_ratio

#: Side of the smallest cells; those of the next level are ``SPREAD`` times as wide (high), up to ``TOP``.
CELL, SPREAD, TOP = 16.0, 4, 14


def _level(length: Column) -> Column:
    """The smallest level whose cells are at least as long as a box's side, so that the side touches two of them at most."""
    ratio = length / F.lit(CELL)
    return F.when(ratio <= 1, 0).otherwise(F.least(F.lit(TOP), F.ceil(F.log(float(SPREAD), ratio)))).cast("int")


def _placed(rows: DataFrame, box: str) -> DataFrame:
    b = F.col(box)
    whole = b["x1"].isNotNull() & b["y1"].isNotNull() & (b["x2"] >= b["x1"]) & (b["y2"] >= b["y1"])
    return rows.where(whole).withColumns({"_lx": _level(b["x2"] - b["x1"]), "_ly": _level(b["y2"] - b["y1"])})


def _cells(rows: DataFrame, key: str, box: str, name: str, others: list[tuple[int, int]]) -> DataFrame:
    """A row for every cell in which a box can meet one of the other side: on each axis at the coarser of the two boxes' levels."""
    met = F.array(*(F.struct(F.greatest(F.col("_lx"), F.lit(x)).alias("x"), F.greatest(F.col("_ly"), F.lit(y)).alias("y")) for x, y in others))
    at = rows.withColumn("_at", F.explode(F.array_distinct(met)))
    side = lambda axis: F.lit(CELL) * F.pow(F.lit(float(SPREAD)), F.col(f"_at.{axis}"))
    cell = lambda corner: F.floor(F.col(box)[corner] / side(corner[0]))
    at = at.withColumns({"_x1": cell("x1"), "_y1": cell("y1"), "_x": F.explode(F.sequence(cell("x1"), cell("x2")))})
    at = at.withColumn("_y", F.explode(F.sequence(cell("y1"), cell("y2"))))
    own = F.struct(*(F.col(c) for c in rows.columns if c not in ("_lx", "_ly")))
    return at.select(key, "_at", "_x", "_y", own.alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("_lx", "_ly", "_x1", "_y1")))


def overlapping(left: DataFrame, right: DataFrame, key: str = "id", left_box: str = "box", right_box: str = "box") -> DataFrame:
    """Pairs of boxes of one document that overlap or touch, each once: (key, l struct, r struct).

    Boxes lie in grids whose cells are as wide and as high as the boxes, each axis at a level of its own: a line that is long and low lies in
    long, low cells. A box is in four cells at most of its own grid and of each coarser one that a box of the other side has; a pair meets at the
    coarser levels of the two, as an equi-join on document and cell, in the first cell of both. So a tall box does not make many rows, a
    dense page is cut into cells of a few boxes, and which levels there are is all the driver sees. Boxes with a null corner or a negative side overlap nothing.
    """
    sides = {"l": _placed(left, left_box), "r": _placed(right, right_box)}
    levels = {name: sorted((r[0], r[1]) for r in side.select("_lx", "_ly").distinct().collect()) for name, side in sides.items()}
    if not levels["l"] or not levels["r"]:
        return left.select(key, F.struct("*").alias("l")).join(right.select(F.col(key), F.struct("*").alias("r")), key).where("false")
    a = _cells(sides["l"], key, left_box, "l", levels["r"])
    b = _cells(sides["r"], key, right_box, "r", levels["l"])
    pairs = a.join(b, [key, "_at", "_x", "_y"])
    same = lambda column, name: F.col(column) == F.greatest(f"{name}_l", f"{name}_r")
    once = same("_at.x", "_lx") & same("_at.y", "_ly") & same("_x", "_x1") & same("_y", "_y1")
    p, q = F.col(f"l.{left_box}"), F.col(f"r.{right_box}")
    meet = (p["x1"] <= q["x2"]) & (q["x1"] <= p["x2"]) & (p["y1"] <= q["y2"]) & (q["y1"] <= p["y2"])
    return pairs.where(once & meet).select(key, "l", "r")


def best_match(pred: DataFrame, truth: DataFrame, threshold: float = 0.5, key: str = "id") -> DataFrame:
    """For every predicted box its true box of the largest IoU if that is ``threshold`` or more, else null; the first true box wins ties.

    ``pred`` (key, pred, box), ``truth`` (key, gt, box); returns (key, pred, gt, iou).
    """
    pairs = overlapping(pred, truth, key).select(key, F.col("l.pred").alias("pred"), F.col("r.gt").alias("gt"), iou(F.col("l.box"), F.col("r.box")).alias("iou"))
    best = pairs.where(F.col("iou") >= threshold).groupBy(key, "pred").agg(F.max(F.struct("iou", (-F.col("gt")).alias("m"))).alias("best"))
    best = best.select(key, "pred", (-F.col("best.m")).alias("gt"), F.col("best.iou").alias("iou"))
    return pred.select(key, "pred").join(best, [key, "pred"], "left")


def _take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, a, b) by key and in the order of choice to those taken: a pair whose a or b is used up is passed over."""
    key, used_a, used_b = object(), set(), set()
    for batch in batches:
        kept = []
        for i, (k, x, y) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            if k != key:
                key, used_a, used_b = k, set(), set()
            if x not in used_a and y not in used_b:
                used_a.add(x)
                used_b.add(y)
                kept.append(i)
        yield batch.take(pa.array(kept, pa.int64()))


def greedy_match(pred: DataFrame, truth: DataFrame, driven_by: str = "pred", threshold: float = 0.5, key: str = "id") -> DataFrame:
    """One-to-one matches (key, pred, gt) of IoU ``threshold`` or more, taken greedily in the order of one side.

    By predictions: each takes the unused true box of the largest IoU, the last of equal ones. By truth: each
    true box takes the best unused prediction, the highest number of equal ones. Only pairs above the
    threshold are looked at: a pair below is never taken and uses nothing up. They are sorted within each document and taken as they
    come, so a task holds the numbers that one document has used up.
    """
    pairs = overlapping(pred, truth, key).select(key, F.col("l.pred").alias("pred"), F.col("r.gt").alias("gt"), iou(F.col("l.box"), F.col("r.box")).alias("iou"))
    first, second = ("pred", "gt") if driven_by == "pred" else ("gt", "pred")
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in (key, first, second)}
    ordered = pairs.where(F.col("iou") >= threshold).repartition(key).sortWithinPartitions(key, first, F.desc("iou"), F.desc(second))
    taken = ordered.select(key, first, second).mapInArrow(_take, ", ".join(f"`{c}` {t}" for c, t in kinds.items()))
    return taken.select(key, F.col("pred").cast("long").alias("pred"), F.col("gt").cast("long").alias("gt"))


def detection_counts(pred: DataFrame, truth: DataFrame, driven_by: str = "pred", threshold: float = 0.5, key: str = "id") -> DataFrame:
    """(key, hits, n_pred, n_gt) of every document on either side."""
    hits = greedy_match(pred, truth, driven_by, threshold, key).groupBy(key).agg(F.count(F.lit(1)).alias("hits"))
    n = pred.groupBy(key).agg(F.count(F.lit(1)).alias("n_pred")).join(truth.groupBy(key).agg(F.count(F.lit(1)).alias("n_gt")), key, "full")
    return n.join(hits, key, "left").select(key, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("hits", "n_pred", "n_gt")))


def detection_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of summed counts; empty sides give 0."""
    s = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("hits", "n_pred", "n_gt")))
    s = s.withColumn("precision", F.col("hits") / F.greatest(F.lit(1), "n_pred")).withColumn("recall", F.col("hits") / F.greatest(F.lit(1), "n_gt"))
    return s.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.lit(1e-9), F.col("precision") + F.col("recall")))


def assign_pieces(anchor: DataFrame, other: DataFrame, threshold: float = 0.5, key: str = "id") -> DataFrame:
    """Lines of another engine put to the anchor line they overlap most (intersection over the smaller area; the first of equal ones).

    ``anchor`` (key, line, box), ``other`` (key, piece, text, box); returns (key, line, text): the pieces of a
    line from left to right, in their order where they begin alike.
    """
    pairs = overlapping(other, anchor, key)
    pairs = pairs.select(key, F.col("l.piece").alias("piece"), F.col("l.text").alias("text"), F.col("l.box.x1").alias("x"), F.col("r.line").alias("line"), overlap_ratio(F.col("l.box"), F.col("r.box")).alias("ratio"))
    w = Window.partitionBy(key, "piece").orderBy(F.desc("ratio"), "line")
    best = pairs.where(F.col("ratio") >= threshold).withColumn("k", F.row_number().over(w)).where("k = 1")
    parts = F.array_sort(F.collect_list(F.struct("x", "piece", "text")))
    return best.groupBy(key, "line").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))

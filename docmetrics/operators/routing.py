"""Which reading to trust: document types, verification, policies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import squash_check

REPEAT_RATIO = 4.0
RETRY = 0.3
REVIEW = 0.05
FLIP_SCORE = 0.8

# Patterns of contact details and words of document types.
EMAIL = r"(?U)[\w.+-]+@[\w-]+\.[\w.]+"
PHONE = r"(?U)0\d{1,2}\s?[-–.)]\s?\d{3,4}\s?[-–.]\s?\d{4}"
INVOICE, SUPPLIER, BUYER, TOTAL = "세금계산서", "공급자", "공급받는자", "합계"
RECEIPT = "거래일시|영수증|부가세|승인번호"


def document_type(text: Column, n_lines: Column, width: Column, height: Column, row_sizes: Column) -> Column:
    """Struct (type, reason) by the first rule that fits; ``row_sizes`` has the number of lines of each row."""
    flat = F.regexp_replace(text, r"(?U)\s+", "")
    ratio = width / height
    wide = F.filter(row_sizes, lambda n: n >= 3)
    n_cells = F.aggregate(wide, F.lit(0), lambda a, b: a + b)
    kind = lambda t, r: F.struct(F.lit(t).alias("type"), F.lit(r).alias("reason"))
    return (
        F.when(F.contains(flat, F.lit(INVOICE)) | (F.contains(flat, F.lit(SUPPLIER)) & F.contains(flat, F.lit(BUYER))), kind("invoice", "invoice words"))
        .when(F.contains(flat, F.lit(TOTAL)) & flat.rlike(RECEIPT), kind("receipt", "total and receipt words"))
        .when((text.rlike(EMAIL) | text.rlike(PHONE)) & (n_lines <= 12) & ratio.between(1.4, 2.0), kind("card", "contact, few lines, card shape"))
        .when((F.size(wide) >= 3) & (n_cells >= 0.6 * n_lines), kind("table", "rows of three cells or more"))
        .otherwise(kind("document", "no rule"))
    )


def policy(fast: Column, vl: Column, vlm: Column, ratio_vl: Column, diff_vl: Column, ratio_vlm: Column, diff_vlm: Column, threshold: Column | float = RETRY) -> Column:
    """Struct (text, source, retried): the precise reading unless it repeats itself or differs too much from the fast one.

    Then the third reading is tried and taken if it does not repeat and the second did or was farther off; without
    a third reading, the fast one stands in for one that repeats.
    """
    threshold = F.lit(threshold) if not isinstance(threshold, Column) else threshold
    pick = lambda t, s, r: F.struct(t.alias("text"), F.lit(s).alias("source"), F.lit(r).alias("retried"))
    repeats = ratio_vl > REPEAT_RATIO
    better = (ratio_vlm <= REPEAT_RATIO) & (repeats | (diff_vlm < diff_vl))
    return (
        F.when(~repeats & (diff_vl <= threshold), pick(vl, "vl", False))
        .when(vlm.isNull(), F.when(repeats, pick(fast, "fast", False)).otherwise(pick(vl, "vl", False)))
        .when(better, pick(vlm, "vlm", True))
        .otherwise(pick(vl, "vl", True))
    )


def upright(score: Column, flipped_score: Column) -> Column:
    """0 or 180: the turned reading counts only where the first is unsure and the turned one is surer."""
    return F.when((score < FLIP_SCORE) & (flipped_score > score), 180).otherwise(0)


def field_warnings(fields: Column, main: Column, other: Column) -> Column:
    """Warnings on extracted values: ``fields`` is an array of (name, value, is_number).

    Missing values, values that the precise text lacks, and values that the fast text lacks. Takes composed texts.
    """
    a, b = squash_check(main, False), squash_check(other, False)

    def judge(f: Column) -> Column:
        v = squash_check(f["value"], False)
        problem = (
            F.when(f["value"].isNull(), "not found")
            .when(f["is_number"] | (v == ""), None)
            .when(~F.contains(a, v), "not in the text")
            .when(~F.contains(b, v), "engines differ")
        )
        return F.struct(f["name"].alias("field"), f["value"].alias("value"), problem.alias("problem"))

    return F.filter(F.transform(fields, judge), lambda w: w["problem"].isNotNull())


def review(diff: Column) -> Column:
    """Whether a page should be looked at."""
    return diff > REVIEW

"""Text expressions: normalisation, repair rules, token extraction. Patterns carry (?U) so that classes are Unicode-aware."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Look-alike symbols and what they are unified to, position by position.
SIMILAR_FROM = "–—−‐×，．：‘’“”"
SIMILAR_TO = "----x,.:''\"\""
# Letters read in place of digits, by digit.
DIGIT_LIKE = (("OoD", "0"), ("Il|", "1"), ("S", "5"), ("B", "8"))
# Patterns of phone numbers with loose separators, of dates with points, of number-like tokens, of citations.
PHONE_PARTS = r"(?U)\b(0\d{1,2})[ .](\d{3,4})[ .](\d{4})\b"
DOTTED_DATE = r"(?U)\b(20\d{2})\. ?(\d{1,2})\. ?(\d{1,2})\.?(?!\d)"
NUMBER_TOKEN = r"[0-9][0-9,.:-]*[0-9]|[0-9]"
CITATION = r"\[[0-9]+\]"
# Patterns of marks that Markdown and model outputs carry.
THOUGHT = r"(?s)<think>.*?</think>"
GROUNDING = r"(?s)<\|ref\|>.*?<\|/ref\|><\|det\|>.*?<\|/det\|>"
FENCE = r"(?m)^```\w*\s*$"
IMAGE = r"!\[[^\]]*\]\([^)]*\)"
COMMENT = r"(?s)<!--.*?-->"
HEADING = r"(?m)^#{1,6}\s+"
BOLD = r"\*\*(.+?)\*\*|__(.+?)__"
TAG = r"<[^>]+>"
# The word by which an answer says that it does not know.
UNKNOWN = "모름"
# Weights of the check digit of a business number.
BIZ_WEIGHTS = (1, 3, 7, 1, 3, 7, 1, 3, 5)


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; ASCII texts pass as they are."""
    return text.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFC", s))


def compose_text(text: Column) -> Column:
    """``nfc`` to which ASCII texts do not even travel: they are composed as they are."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, text).otherwise(nfc(F.when(~ascii_only, text)))


@F.pandas_udf(T.StringType())
def nfd(text: pd.Series) -> pd.Series:
    """Canonical decomposition (Hangul syllables to their letters)."""
    return text.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFD", s))


def collapse(text: Column) -> Column:
    """White-space runs to one space, ends stripped."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize(text: Column, keep_space: bool = True, compose: bool = True) -> Column:
    """Composed text with single spaces, or with none."""
    text = compose_text(text) if compose else text
    return collapse(text) if keep_space else F.regexp_replace(text, r"(?U)\s+", "")


def squash_symbols(text: Column, compose: bool = True) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(compose_text(text) if compose else text, r"(?U)[\s\W_]+", "")


def squash_spaces(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")


def squash_amount(text: Column) -> Column:
    """Without white space, commas and the won sign word."""
    return F.regexp_replace(text, r"(?U)[\s,원]", "")


def squash_check(text: Column, compose: bool = True) -> Column:
    """Without white space and commas, en dash as hyphen: the form in which extracted values are looked up."""
    return F.translate(F.regexp_replace(compose_text(text) if compose else text, r"(?U)[\s,]", ""), "–", "-")


def fix_symbols(text: Column) -> Column:
    return F.translate(text, SIMILAR_FROM, SIMILAR_TO)


def fix_digits(text: Column) -> Column:
    """Letters between digits, commas or points that stand for a digit. One pass is a fixed point."""
    for letters, digit in DIGIT_LIKE:
        text = F.regexp_replace(text, rf"(?U)(?<=[\d,.])[{letters}](?=[\d,.])", digit)
    return text


def fix_phone(text: Column) -> Column:
    """Phone numbers with points or spaces between their parts, joined by hyphens."""
    return F.regexp_replace(text, PHONE_PARTS, "$1-$2-$3")


def iso_dates(text: Column) -> Column:
    """Dates written with points as yyyy-mm-dd."""
    marked = F.regexp_replace(text, DOTTED_DATE, "$1-\u00010$2-\u00010$3")
    return F.regexp_replace(marked, r"\u00010?(\d{2})(?!\d)", "$1")


def apply_rules(text: Column) -> Column:
    return fix_phone(fix_digits(fix_symbols(text)))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\D", "")


def biz_number_valid(number: Column) -> Column:
    """Whether ten digits (others are ignored) carry the right check digit; null counts as wrong."""
    d = digits_of(F.coalesce(number, F.lit("")))
    digit = lambda i: F.substring(d, i + 1, 1).try_cast("int")
    total = sum((digit(i) * w for i, w in enumerate(BIZ_WEIGHTS)), F.floor(digit(8) * 5 / 10))
    return (F.length(d) == 10) & F.coalesce(F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)) == digit(9), F.lit(False))


def to_int(text: Column) -> Column:
    """The digits of a text as a number, null where there are none."""
    return digits_of(text).try_cast("bigint")


def number_tokens(text: Column) -> Column:
    """Distinct number-like tokens in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(NUMBER_TOKEN), F.lit(0)))


def first_match(text: Column, pattern: str) -> Column:
    """The first match of a pattern or null."""
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def composed(df: DataFrame, *names: str) -> DataFrame:
    """The frame with its text columns composed: needed before expressions that look into texts from lambdas, where no UDF can run."""
    return df.withColumns({n: compose_text(F.col(n)) for n in names})


def new_items(output: Column, source: Column, truth: Column) -> Column:
    """What an output makes up: struct of words whose letters and digits occur in neither text, and of such numbers. Takes composed texts."""
    pool = F.concat(squash_symbols(source, False), F.lit("|"), squash_symbols(truth, False))
    words = F.array_distinct(F.split(normalize(output, compose=False), " "))
    made_up = F.filter(words, lambda w: (squash_symbols(w, False) != "") & ~F.contains(pool, squash_symbols(w, False)))
    numbers = F.array_except(F.array_except(number_tokens(output), number_tokens(source)), number_tokens(truth))
    return F.struct(made_up.alias("words"), numbers.alias("numbers"))


def grounded(value: Column, text: Column, compose: bool = True) -> Column:
    """Whether a value occurs in a text, white space and commas aside; null does."""
    squash = lambda c: F.replace(normalize(c, keep_space=False, compose=compose), F.lit(","), F.lit(""))
    return F.coalesce(F.contains(squash(text), squash(value)), value.isNull())


def without_citations(text: Column) -> Column:
    return F.regexp_replace(text, CITATION, "")


def is_correct(gold: Column, pred: Column, compose: bool = True) -> Column:
    """Whether an answer holds the gold text, or is a part of it of at least half its length."""
    g = normalize(gold, keep_space=False, compose=compose)
    p = normalize(without_citations(pred), keep_space=False, compose=compose)
    return F.contains(p, g) | ((2 * F.length(p) >= F.length(g)) & F.contains(g, p))


def strip_markup(text: Column) -> Column:
    """Markdown and markup marks taken off: fences, images, comments, headings, bold, tags, thoughts, grounding."""
    for pattern in (THOUGHT, GROUNDING, FENCE, IMAGE, COMMENT, HEADING):
        text = F.regexp_replace(text, pattern, "")
    return F.regexp_replace(F.regexp_replace(text, BOLD, "$1$2"), TAG, "")


def unknown_answer(pred: Column, marker: str = UNKNOWN) -> Column:
    """Whether an answer says that it does not know; a missing answer does not."""
    return F.coalesce(F.contains(pred, F.lit(marker)), F.lit(False))


def word_kind(text: Column) -> Column:
    """'hangul', 'number' or 'other'."""
    return F.when(text.rlike("[가-힣]"), "hangul").when(text.rlike(r"(?U)^[\d\s.,:/()-]+$"), "number").otherwise("other")


def options(text: Column) -> Column:
    """key=value pairs, comma-separated, as a map."""
    return F.str_to_map(text, F.lit(","), F.lit("="))


def report_number(value: Column) -> Column:
    """Three decimals, '-' for null."""
    return F.when(value.isNotNull(), F.format_string("%.3f", value.cast("double"))).otherwise("-")

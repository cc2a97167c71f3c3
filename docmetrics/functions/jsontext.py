"""JSON texts as expressions: their strings in order, and cut-off objects mended."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .metrics import bind

# Control characters never stand unescaped in JSON: they hide escaped backslashes and quotes, so that a string is what lies between two quotes.
_BACKSLASH, _QUOTE = "\u0001", "\u0002"
_KEY = r'"[^"]*+"\s*+:'


def _hidden(json: Column) -> Column:
    return F.replace(F.replace(json, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))


def _shown(json: Column) -> Column:
    return F.replace(F.replace(json, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))


def _walked(hidden: Column, skip: str) -> Column:
    """Strings outside of everything under ``skip``, by a fold over strings, keys and brackets with their depth."""
    state = F.struct(F.lit(0).alias("depth"), F.lit(-1).alias("under"), F.lit(False).alias("next"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        opens, closes = x.isin("{", "["), x.isin("}", "]")
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        under = F.when((s["under"] < 0) & s["next"] & opens, s["depth"]).when(closes & (depth == s["under"]), -1).otherwise(s["under"])
        value = x.startswith('"') & ~x.endswith(":") & (s["under"] < 0) & ~s["next"]
        return F.struct(depth.alias("depth"), under.alias("under"), x.rlike(f'^"{skip}"\\s*:$').alias("next"), F.when(value, F.concat(s["out"], F.array(x))).otherwise(s["out"]).alias("out"))

    return F.aggregate(F.regexp_extract_all(hidden, F.lit(rf'({_KEY}|"[^"]*+"|[\[\]{{}}])'), F.lit(1)), state, step, lambda s: s["out"])


def json_strings(json: Column, skip: str = "type") -> Column:
    """All strings of a JSON text depth first in the order of the text, keys and what stands under the key ``skip`` left out.

    Null where the text is null or no JSON. One pass of a pattern where ``skip`` has plain values only, else a fold.
    """
    plain = rf'"{skip}"\s*+:\s*+"[^"]*+"|{_KEY}|("[^"]*+")'

    def strings(hidden: Column) -> Column:
        found = F.filter(F.regexp_extract_all(hidden, F.lit(plain), F.lit(1)), lambda x: x != "")
        quoted = F.when(hidden.rlike(rf'"{skip}"\s*+:\s*+[\[{{]'), _walked(hidden, skip)).otherwise(found)
        return F.from_json(F.concat(F.lit("["), _shown(F.array_join(quoted, ",")), F.lit("]")), "array<string>")

    return F.when(F.try_parse_json(json).isNotNull(), bind(_hidden(json), strings))


def _open_brackets(structure: Column) -> Column:
    """The brackets that are open at the end, in their order."""
    close = lambda s: F.substring(s, F.lit(1), F.greatest(F.length(s) - 1, F.lit(0)))
    return F.aggregate(F.split(structure, ""), F.lit(""), lambda s, c: F.when(c.isin("{", "["), F.concat(s, c)).when(c.isin("}", "]"), close(s)).otherwise(s))


def closed(json: Column) -> Column:
    """A JSON text that was cut off, closed: an open string ends, a key without a value, a comma and part of a number or word go, brackets are closed.

    A text that is whole stays as it is.
    """

    def structure(s: Column) -> Column:
        quotes = F.length(s) - F.length(F.replace(s, F.lit('"'), F.lit("")))
        text = F.when(quotes % 2 == 1, F.concat(F.regexp_replace(s, r"\\[^\u0001\u0002]{0,4}$", ""), F.lit('"'))).otherwise(s)
        return bind(text, finished)

    def finished(text: Column) -> Column:
        brackets = F.regexp_replace(F.regexp_replace(text, r'"[^"]*+"', ""), r"[^\[\]{}]", "")
        return bind(F.struct(text.alias("t"), _open_brackets(brackets).alias("o")), ended)

    def ended(s: Column) -> Column:
        whole = s["o"] == ""
        tail = F.regexp_replace(F.regexp_replace(s["t"], r"(?<=[:,\[\s])(?:t|tr|tru|f|fa|fal|fals|n|nu|nul|-?(?:\d+[.eE][-+]?)?)$", ""), r"[,\s]+$", "")
        tail = F.when(s["o"].endswith("{"), F.regexp_replace(F.regexp_replace(tail, r',?\s*"[^"]*+"\s*:\s*$', ""), r'(?<=[{,])\s*"[^"]*+"$', "")).otherwise(tail)
        tail = F.regexp_replace(tail, r"[,\s]+$", "")
        return F.when(whole, s["t"]).otherwise(F.concat(tail, F.translate(F.reverse(s["o"]), "{[", "}]")))

    return _shown(bind(_hidden(json), structure))

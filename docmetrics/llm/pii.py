"""Personal data: generators propose spans, boosted trees judge them, calibrated thresholds select redactions."""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordcache import portions

#: Kinds in the order in which they are listed. The first four have base patterns, whose matches always stay.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret")
BASE = 4


@dataclass(frozen=True)
class Span:
    kind: int
    start: int
    end: int


# ---------------------------------------------------------------- base patterns

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern, found from their @: the local part goes back to the match before at most."""
    end = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            end = m.end()
            yield start, end


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns, per kind leftmost and not overlapping; those that fail their test are dropped."""
    out = [Span(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        # a match can only begin where a run of digits does: inside a run it would end the same way
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 or int(p.lstrip("0")[:4] or "0") <= 255 for p in m[0].split(".")):
                out.append(Span(1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(Span(2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append(Span(3, m.start(), m.end()))
    return out


# ---------------------------------------------------------------- generators

_SPELLED = re.compile(
    r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\bdot\b|\.) ?[A-Za-z0-9-]{1,63}){1,4}"
    r"|[A-Za-z0-9._%+-]{1,64} at [A-Za-z0-9-]{1,63}(?: (?:\(dot\)|\[dot\]|dot) [A-Za-z0-9-]{1,63}){1,4}"
)
_NUMBER = re.compile(r"(?<![\w.])\(?[0-9](?:[ ().\-/]{0,2}[0-9]){7,18}(?![\w])")
_IPV6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){1,6}:(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4}(?![\w:])")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b")
# what a long run of letters and digits may hold, and how values are assigned to names of secrets
_RUN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/=.-")
_DIGITS = re.compile(r"[0-9]+")
_SIGN = re.compile(r"[:=]")
_SECRET_NAME = re.compile(r"(?i)(?:passw(?:or)?[dt]|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|contraseña|mot de passe|clave|jeton|schlüssel)\"?\s{0,3}\Z")
_VALUE = re.compile(r"\s{0,3}[\"']?([^\s\"',;]{6,256})")


def _mixed_runs(text: str) -> Iterator[tuple[int, int]]:
    """Runs of 16 to 512 letters, digits and signs with at least a letter and a digit, found from their digits."""
    done = 0
    for m in _DIGITS.finditer(text):
        start, end = m.span()
        if start < done:
            continue
        while end < len(text) and text[end] in _RUN:
            end += 1
        while start > done and text[start - 1] in _RUN:
            start -= 1
        done = end
        if 16 <= end - start <= 512 and any(c.isalpha() for c in text[start:end]):
            yield start, end


def _assigned(text: str) -> Iterator[tuple[int, int]]:
    """Values that follow a name of a secret and a sign, found from the sign."""
    for m in _SIGN.finditer(text):
        if _SECRET_NAME.search(text, max(0, m.start() - 24), m.start()) and (value := _VALUE.match(text, m.end())):
            yield value.span(1)


def candidates(text: str) -> list[Span]:
    """Spans that might be personal data beyond the base patterns; they may overlap each other and base spans."""
    out: list[Span] = []
    if "(at)" in text or "[at]" in text or "dot" in text:
        out += [Span(0, m.start(), m.end()) for m in _SPELLED.finditer(text)]
    if "::" in text or text.count(":") >= 7:
        out += [Span(1, m.start(), m.end()) for m in _IPV6.finditer(text)]
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            n = len(_DIGIT.findall(m[0]))
            if 13 <= n <= 19:
                out.append(Span(2, m.start(), m.end()))
            if 8 <= n <= 13:
                out.append(Span(3, m.start(), m.end()))
            if n == 9:
                out.append(Span(4, m.start(), m.end()))
        out += [Span(5, m.start(), m.end()) for m in _IBAN.finditer(text)]
        out += [Span(6, a, b) for a, b in _mixed_runs(text)]
    out += [Span(6, a, b) for a, b in _assigned(text)]
    return out


# ---------------------------------------------------------------- features

# Cue words near a span, by kind, and cues of other numbers, in English, German, French and Spanish.
CUES = (
    ("email", "e-mail", "mail", "contact", "write", "correo", "courriel", "kontakt"),
    ("ip", "address", "host", "server", "adresse", "dirección"),
    ("card", "visa", "mastercard", "amex", "credit", "payment", "karte", "carte", "tarjeta"),
    ("phone", "tel", "call", "mobile", "cell", "fax", "telefon", "téléphone", "teléfono", "handy"),
    ("ssn", "social", "security", "sozialversicherung", "sécurité", "seguridad"),
    ("iban", "account", "bank", "transfer", "konto", "compte", "cuenta"),
    ("token", "key", "secret", "password", "passwd", "pwd", "bearer", "api", "auth", "passwort", "schlüssel", "passe", "jeton", "contraseña", "clave"),
)
OTHER_CUES = ("version", "order", "invoice", "sku", "price", "ref", "no", "item", "page", "total", "build", "id", "isbn", "part", "date", "$", "€", "nr", "bestellung", "rechnung", "commande", "pedido", "commit", "sha", "checksum", "hash", "digest", "revision", "uuid", "file")
# Beginnings of keys that services give out.
KEY_PREFIXES = ("sk_live_", "sk-", "ghp_", "gho_", "xoxb-", "AKIA", "AIza", "eyJ", "glpat-")
WINDOW = 40
_WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?|[$€]")
_LETTERS = re.compile(r"[A-Za-z]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def iban_ok(text: str) -> bool:
    raw = text.replace(" ", "")
    moved = raw[4:] + raw[:4]
    return moved.isalnum() and moved.isascii() and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def features(text: str, span: Span) -> list[float]:
    """Format and context of a span as numbers."""
    s = text[span.start : span.end]
    digits = "".join(c for c in s if "0" <= c <= "9")
    n, d = len(s), len(digits)
    letters = sum(c.isalpha() for c in s)
    groups = re.findall(r"[0-9]+", s) or [""]
    separators = [c for c in s if not c.isalnum()]
    before, after = text[max(0, span.start - WINDOW) : span.start], text[span.end : span.end + WINDOW // 2]
    near = [w.lower() for w in _WORDS.findall(before)][-5:]
    behind = [w.lower() for w in _WORDS.findall(after)][:2]
    counts = [digits.count(c) for c in set(digits)]
    entropy = -sum(c / d * math.log2(c / d) for c in counts) if d else 0.0
    own, others = CUES[span.kind], OTHER_CUES
    distance = next((i for i, w in enumerate(reversed(near)) if w in own), 9)
    other_distance = next((i for i, w in enumerate(reversed(near)) if w in others), 9)
    prev, follow = before[-1:], after[:1]
    lead = before.rstrip(" \"'")[-1:]
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:], strict=False))
    return [
        *(float(span.kind == k) for k in range(len(KINDS))),
        n,
        d,
        d / n,
        letters / n,
        len(separators),
        len(set(separators)),
        len(groups),
        max(map(len, groups)),
        min(map(len, groups)),
        float(s.startswith("(")),
        float(luhn(digits)) if 13 <= d <= 19 else -1.0,
        float(iban_ok(s)) if span.kind == 5 else -1.0,
        float("at" in s.lower()) + float("dot" in s.lower()) + 2 * float("(at)" in s or "[at]" in s),
        entropy,
        max(counts) / d if d else 0.0,
        float(distance),
        float(other_distance),
        float(any(w in own for w in behind)),
        float(prev.isalnum()),
        float(prev in "=#$€/"),
        float(follow.isalnum()),
        float(follow in "%€$/"),
        float("://" in before.rpartition(" ")[2]),
        float([len(g) for g in groups] == [3, 2, 4]),
        float([len(g) for g in groups] in ([3, 3, 4], [1, 3, 3, 4])),
        float([len(g) for g in groups] in ([4, 4, 4, 4], [4, 6, 5])),
        sum(c in "0123456789abcdefABCDEF" for c in s) / n,
        sum("A" <= c <= "Z" for c in s) / n,
        len(set(s)) / n,
        turns / n,
        float(s.startswith(KEY_PREFIXES)),
        float(prev != "" and prev in "\"'"),
        float(lead != "" and lead in "=:"),
        float(_UUID.fullmatch(s) is not None),
        float(max(map(len, _LETTERS.findall(s)), default=0)),
        float(re.fullmatch(r"(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}.*|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2}.*", s) is not None),
    ]


# ---------------------------------------------------------------- boosted trees


class BoostedTrees:
    """Gradient boosting of depth-limited trees for a yes-or-no target, on binned features."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
        width = max(map(len, edges)) + 1
        place = binned + np.arange(x.shape[1]) * width  # of a row's bin of each feature in a histogram of all features
        no_cut = np.arange(width) >= np.array([len(e) for e in edges])[:, None]
        self.start = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
        score = np.full(len(y), self.start)
        nodes = 2 ** (self.depth + 1) - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            feature, cut, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
            at = np.zeros(len(y), np.int64)
            for node in range(nodes):
                rows = np.flatnonzero(at == node)
                if not len(rows):
                    continue
                total = g[rows].sum(), h[rows].sum()
                value[node] = -self.rate * total[0] / (total[1] + self.ridge)
                if node >= nodes // 2 or len(rows) < 20:
                    continue
                where = place[rows].ravel()
                gs, hs = (np.bincount(where, np.repeat(v[rows], x.shape[1]), no_cut.size).reshape(no_cut.shape).cumsum(1) for v in (g, h))
                gain = gs**2 / (hs + self.ridge) + (total[0] - gs) ** 2 / (total[1] - hs + self.ridge) - total[0] ** 2 / (total[1] + self.ridge)
                gain[no_cut | (hs < 1e-3) | (total[1] - hs < 1e-3)] = 0
                f, k = divmod(int(gain.argmax()), width)
                if gain[f, k] > 1e-3:
                    feature[node], cut[node] = f, edges[f][k]
                    at[rows] = np.where(binned[rows, f] <= k, 2 * node + 1, 2 * node + 2)
            self.trees.append((feature, cut, value))
            score = score + value[at]
        return self

    def decision(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                below = x[rows, np.maximum(f, 0)] <= cut[at]
                at = np.where(f < 0, at, 2 * at + np.where(below, 1, 2))
            out += value[at]
        return out


@dataclass
class Selector:
    """Trees, their calibration (probability = sigmoid(a + b * decision)) and a threshold for each kind; cards have trees of their own."""

    trees: BoostedTrees
    a: float
    b: float
    thresholds: list[float]
    cards: Selector | None = None

    def probability(self, x: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(self.a + self.b * self.trees.decision(x), -30, 30)))
        if self.cards and len(x):
            own = x[:, 2] == 1  # the kind is among the features
            p[own] = self.cards.probability(x[own])
        return p


# ---------------------------------------------------------------- training on candidates planted in documents

#: At most so many documents give the contexts that candidates are planted in, and so many characters of each.
CONTEXT_DOCUMENTS, CONTEXT_SIZE = 300, 3000


def contexts(docs: DataFrame, text_col: str = "text", n: int = CONTEXT_DOCUMENTS, size: int = CONTEXT_SIZE) -> tuple[str, ...]:
    """Stretches of ``size`` characters from the middle of ``n`` documents, the same ones wherever they lie: those of the least hashes.

    One pass: only texts under a hash that lets through about four times ``n`` rows are looked at, copies of one put together
    in each task before the hashes and stretches are shuffled. Where that leaves fewer than ``n`` different texts, the bound is raised.
    """
    text = F.col(text_col)
    share = 4 * n / max(1, docs.count())
    middle = F.substr("t", F.greatest(F.lit(1), F.floor((F.length("t") - size) / 2)).cast("int"), F.lit(size))
    rows = docs.where(F.length(text) > 100).select(F.xxhash64(text).alias("h"), text.alias("t"))
    while True:
        some = rows if share >= 1 else rows.where(F.col("h") < int(share * 2**64) - 2**63)
        found = some.groupBy("h").agg(F.min(middle).alias("t")).orderBy("h").limit(n).collect()
        if len(found) == n or share >= 1:
            return tuple(r["t"] for r in found)
        share *= 16


def _check_digit(digits: str) -> str:
    return next(str(c) for c in range(10) if luhn(digits + str(c)))


def _iban(r: random.Random) -> str:
    country, body = r.choice(("DE", "FR", "ES", "GB")), "".join(r.choice("0123456789") for _ in range(18))
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{country}{98 - number % 97:02d}{body}"


def _word(r: random.Random) -> str:
    return "".join(r.choice(("an", "er", "ti", "lo", "ka", "ve", "mu", "so", "ch", "ei", "on", "qu")) for _ in range(r.randint(1, 4)))


def _secret(r: random.Random) -> str:
    pick = lambda n, of: "".join(r.choice(of) for _ in range(n))
    hexes, mixed = "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    form = r.randrange(8)
    if form < 4:
        s = pick(r.choice((32, 40, 40, 64)), hexes)
        return s.upper() if r.random() < 0.2 else s
    if form < 6:
        return pick(r.randint(20, 44), mixed)
    if form == 6:
        return r.choice(KEY_PREFIXES) + pick(r.randint(16, 36), mixed)
    return pick(r.randint(8, 14), mixed + "!#%&*") + r.choice("0123456789")


def _made_up(r: random.Random, kind: int | None = None, around: tuple[str, ...] = ()) -> tuple[str, str, int, int]:
    """A text, the part of it in question, whether that part is personal data, and of which kind. The rest is taken from ``around``."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def filler() -> str:
        if not around or r.random() < 0.2:
            return " ".join(_word(r) for _ in range(r.randint(3, 9)))
        words = r.choice(around).split(" ")
        at = r.randrange(len(words))
        return " ".join(words[at : at + r.randint(3, 9)])

    kind = r.choice((0, 1, 2, 3, 4, 5, 6, 8)) if kind is None else kind
    yes = r.random() < 0.5
    cue = r.random() < 0.75
    if kind == 0:
        at, dot = r.choice((("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), (" (at) ", ".")))
        s = f"{_word(r)}{r.choice(('.', '_', ''))}{_word(r)}{at}{_word(r)}{dot}{r.choice(('com', 'org', 'net', 'de', 'fr'))}"
        if not yes:
            s = f"{_word(r)} at {_word(r)}. {_word(r)}" if r.random() < 0.6 else f"{_word(r)} at {_word(r)} dot {_word(r)}"
    elif kind == 1:
        s = ":".join(f"{r.randrange(65536):x}" for _ in range(8)) if r.random() < 0.6 else f"{r.randrange(65536):x}:{r.randrange(65536):x}::{r.randrange(65536):x}"
        if not yes:
            s = ":".join(f"{r.randrange(60):02d}" for _ in range(8)) if r.random() < 0.5 else f"{r.randrange(24)}:{r.randrange(60):02d}::{r.randrange(60):02d}"
    elif kind == 2:
        body = r.choice("3456") + d(14)
        s = body + _check_digit(body)
        if not yes:
            s = d(r.randint(13, 18))
            cue = cue and r.random() < 0.1
        form = r.randrange(3)
        s = s if form == 0 else r.choice(" -").join(s[i : i + 4] for i in range(0, len(s), 4))
        yes = yes and (cue or form > 0)
    elif kind == 3:
        a, b, c = d(3), d(3), d(4)
        s = r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"0{d(3)} {d(7)}", f"0{d(2)}/{d(8)}"))
        if not yes:
            s = r.choice((d(8), d(10), d(12), f"{d(4)}-{d(2)}-{d(2)}", f"20{d(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)} {r.randint(10, 23)}", f"{d(2)}.{d(3)}.{d(3)}", f"{d(5)}/{d(4)}", f"{d(3)} {d(2)} {d(1)} {d(2)} {d(3)}"))
            cue = cue and r.random() < 0.05
        yes = yes and (cue or s.startswith("("))
    elif kind == 4:
        s = f"{d(3)}-{d(2)}-{d(4)}"
        if not yes:
            s = r.choice((d(9), f"{d(3)} {d(3)} {d(3)}", f"{d(4)}-{d(5)}"))
            cue = cue and r.random() < 0.1
        yes = yes and cue
    elif kind == 5:
        s = _iban(r)
        if not yes:
            s = s[:2] + f"{(int(s[2:4]) + r.randint(1, 60)) % 100:02d}" + s[4:]
        s = " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if r.random() < 0.5 else s
    elif kind == 7:  # cards that the base pattern misses: 13 digits, or groups parted by dots, slashes or two separators
        body = r.choice("3456") + d(11 if (form := r.randrange(4)) == 0 else 14)
        s = body + _check_digit(body)
        if not yes:
            s = r.choice((d(len(s)), body + str((int(s[-1]) + r.randint(1, 9)) % 10)))
            cue = cue and r.random() < 0.5
        mark = ("", ".", "/", r.choice((" -", "- ", ". ", "  ")))[form]
        s = mark.join(s[i : i + 4] for i in range(0, len(s), 4))
        yes = yes and (cue or form > 0)
    elif kind == 8:
        s = _secret(r)
        if not yes:
            hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
            s = r.choice((hexes(40), hexes(64), f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}", f"{_word(r)}_{_word(r)}-{d(8)}.{r.choice(('png', 'pdf', 'html'))}", f"{_word(r)}{_word(r)}.{_word(r)}/{_word(r)}/{d(4)}", f"{_word(r)}-{_word(r)}-{_word(r)}-{d(2)}"))
            cue = False
        yes = yes and (cue or s.startswith(KEY_PREFIXES))
    else:
        yes, cue = False, False
        s = r.choice((d(9), d(11), d(13), d(16), f"{d(4)} {d(4)} {d(4)}", f"{d(3)}.{d(3)}.{d(3)}", f"{d(6)}-{d(6)}"))
    k = {7: 2, 6: 3, 8: 6}.get(kind, kind)
    if cue and (yes or r.random() < 0.2):
        name = r.choice(CUES[k])
        if kind == 8:
            name = r.choice((name, name.upper(), f"api_{name}", f"{name}"))
            hint, close = r.choice(((f'{name} = "', '"'), (f"{name}: ", ""), (f"{name}=", ""), (f"{name} '", "'"), (f'"{name}": "', '"')))
        else:
            hint, close = name + r.choice((": ", " ", " = ")), ""
    else:
        hint, close = (r.choice(OTHER_CUES) + r.choice((": ", " ", " #")) if r.random() < 0.5 else ""), ""
    return f"{filler()} {hint}{s}{close}{r.choice((' ', '. ', ', ', ' '))}{filler()}", s, int(yes), k


def training_set(n: int, seed: int, cards: bool = False, around: tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, truth and kinds of the candidates that the generators find where ``n`` made-up parts are planted in ``around``.

    Candidates elsewhere in the text are left out: nobody has said what they are. ``cards``: of card candidates
    only, with cards that the base pattern misses in every other text.
    """
    r = random.Random(seed)
    x, y, kinds = [], [], []
    for i in range(n):
        text, part, yes, kind = _made_up(r, 7 if cards and i % 2 else None, around)
        at = text.find(part)
        base = base_spans(text)
        for c in candidates(text):
            if any(b.start < c.end and c.start < b.end for b in base) or cards and c.kind != 2 or c.end <= at or at + len(part) <= c.start:
                continue
            x.append(features(text, c))
            own = yes and c.kind == kind
            y.append(int(own and c.start <= at and at + len(part) <= c.end + 1 or own and c.start == at and c.end == at + len(part)))
            kinds.append(c.kind)
    return np.array(x, float), np.array(y, float), np.array(kinds)


@lru_cache(maxsize=2)
def train(around: tuple[str, ...] = (), n: int = 6000, seed: int = 5, precision: float = 0.98) -> Selector:
    """Trees from ``n`` made-up parts planted in stretches of documents; calibration and thresholds from other such texts.

    A kind's threshold is the least one from which on its spans are right in ``precision`` of the cases.
    """
    selector = _trained(n, seed, precision, False, around)
    selector.cards = _trained(n, seed, precision, True, around)
    selector.thresholds[2] = selector.cards.thresholds[2]
    return selector


def _trained(n: int, seed: int, precision: float, cards: bool, around: tuple[str, ...]) -> Selector:
    x, y, _ = training_set(n, seed, cards, around)
    trees = BoostedTrees().fit(x, y)
    x, y, kinds = training_set(n // 2, seed + 1, cards, around)
    z = trees.decision(x)
    a, b = 0.0, 1.0
    for _ in range(50):  # Platt's two parameters by Newton steps
        p = 1 / (1 + np.exp(-np.clip(a + b * z, -30, 30)))
        w = p * (1 - p) + 1e-9
        grad = np.array([(p - y).sum(), ((p - y) * z).sum() + 1e-3 * b])
        hess = np.array([[w.sum(), (w * z).sum()], [(w * z).sum(), (w * z * z).sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    selector = Selector(trees, a, b, [1.1] * len(KINDS))
    p = selector.probability(x)
    for k in range(len(KINDS)):
        own = np.flatnonzero(kinds == k)
        order = own[np.argsort(-p[own])]
        if len(order):
            right = np.cumsum(y[order]) / np.arange(1, len(order) + 1)
            good = np.flatnonzero(right >= precision)
            if len(good):
                selector.thresholds[k] = max(0.5, float(p[order[good[-1]]]))
    return selector


# ---------------------------------------------------------------- detection


def find_batch(texts: list[str], selector: Selector) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text; added spans overlap neither base spans nor each other."""
    base = [base_spans(t) for t in texts]
    rows: list[tuple[int, Span]] = []
    for i, t in enumerate(texts):
        found = candidates(t)
        if found:
            taken = sorted((s.start, s.end) for s in base[i])
            starts = [s for s, _ in taken]
            ends = np.maximum.accumulate([e for _, e in taken]) if taken else []
            for c in found:
                k = int(np.searchsorted(starts, c.end, "left")) if taken else 0
                if not k or ends[k - 1] <= c.start:
                    rows.append((i, c))
    added: list[list[tuple[float, Span]]] = [[] for _ in texts]
    for at in range(0, len(rows), 20_000):
        part = rows[at : at + 20_000]
        p = selector.probability(np.array([features(texts[i], c) for i, c in part], float))
        for (i, c), q in zip(part, p.tolist(), strict=True):
            if q >= selector.thresholds[c.kind]:
                added[i].append((-q, c))
    out = []
    for own, more in zip(base, added, strict=True):
        chosen: list[Span] = []
        taken: list[tuple[int, int]] = []  # in order and apart, so only the neighbours of a place can overlap
        for _, c in sorted(more, key=lambda m: (m[0], m[1].start, -m[1].end, m[1].kind)):
            at = bisect_left(taken, (c.start, c.end))
            if (at == 0 or taken[at - 1][1] <= c.start) and (at == len(taken) or c.end <= taken[at][0]):
                taken.insert(at, (c.start, c.end))
                chosen.append(c)
        out.append((own, own + chosen))
    return out


def describe(spans: list[Span]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in sorted(spans, key=lambda s: (s.start, s.kind, s.end)))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first."""
    out, at = [], 0
    run: list[int] | None = None
    for s in sorted(spans, key=lambda s: (s.start, s.kind, s.end)):
        if run and s.start < run[1]:
            run[1] = max(run[1], s.end)
            continue
        if run:
            out += [text[at : run[0]], f"[{KINDS[run[2]].upper()}]"]
            at = run[1]
        run = [s.start, s.end, s.kind]
    if run:
        out += [text[at : run[0]], f"[{KINDS[run[2]].upper()}]"]
        at = run[1]
    return "".join(out) + text[at:]


FOUND = "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _find(batches: Iterator[pa.RecordBatch], selector: Selector) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in FOUND.split(", ")]
    for batch in batches:
        at = 0
        for part in portions((t.as_py() for t in batch.column(1)), 2 << 20):
            found = find_batch(part, selector)
            counts = [pa.array([sum(s.kind == k for s in base) for base, _ in found], pa.int64()) for k in range(BASE)]
            digests = pa.array([hashlib.sha256(describe(base).encode()).hexdigest() for base, _ in found], pa.string())
            every = pa.array([describe(spans) for _, spans in found], pa.string())
            added = pa.array([len(spans) - len(base) for base, spans in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), *counts, digests, every, added], names)
            at += len(part)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", selector: Selector | None = None) -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): personal data of whole texts.

    Base patterns are counted and always stay. Generators propose further spans (spelled-out
    addresses, IPv6, national phone numbers, grouped card numbers, social security numbers, IBANs, keys and passwords);
    boosted trees judge their format and context, and thresholds calibrated per kind select what is added.
    ``selector``: by default trained on the driver, in a few seconds, on made-up candidates planted in stretches of at most
    ``CONTEXT_DOCUMENTS`` of the documents (``contexts``: a pass of its own over the table).

    Null and empty texts have no spans. Null ids are kept, repeated rows are judged as often as they come, other
    columns are ignored; an empty table gives an empty result. Rows that are judged never shuffle.
    """
    selector = selector or train(contexts(docs, text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _find(it, selector), FOUND).withColumnRenamed("id", id_col)


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", selector: Selector | None = None) -> DataFrame:
    """``docs`` with all found spans replaced by their kind in brackets and, if it has one, ``length_col`` renewed.

    Spans are those of ``find_personal_data``; of overlapping ones the first gives the kind. Other columns, null texts and
    texts without spans stay as they are; null ids and repeated rows are kept; an empty table gives an empty result. Rows never shuffle.
    """
    selector = selector or train(contexts(docs, text_col))
    place = docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in portions((t.as_py() for t in batch.column(place)), 2 << 20):
                rows = batch.slice(at, len(part))
                new = [redact(t, spans) if spans else t for t, (_, spans) in zip(part, find_batch(part, selector), strict=True)]
                null = rows.column(place).is_null().to_pylist()
                column = pa.array([None if n else t for t, n in zip(new, null, strict=True)], pa.string())
                columns = [column if i == place else c for i, c in enumerate(rows.columns)]
                yield pa.RecordBatch.from_arrays(columns, rows.schema.names)
                at += len(part)

    out = docs.mapInArrow(cut, docs.schema)
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.char_length(text_col)).cast(docs.schema[length_col].dataType))
    return out

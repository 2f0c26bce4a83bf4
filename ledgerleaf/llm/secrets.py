"""Secret scan: fixed patterns, and guess costs of credential-context values.

The fixed patterns give base spans of three kinds: assign, access and hex (see
_ASSIGN, _ACCESS and _HEX; matches too short are dropped after matching, so that
matching stays leftmost and non-overlapping).

On top of them, every value that follows a credential word is measured by
dynamic programming: the cheapest way to write it as words (also with look-alike
characters and capitals), dates, repeats, keyboard walks and brute-force spans,
where the cost of a way is the sum of the logarithms of the guesses of its parts
and a charge for each part after the first.  Every span of each kind takes part:

* word: a dictionary word of 3 letters or more, at its rank; the dictionary is
  COMMON_WORDS, then the whole words of a vocabulary file in the order of their
  merges, which is by frequency (both are parameters);
* date: a year, or a date with year, month and day in either order;
* repeat: a unit of 1 to REPEAT_UNIT characters, two or more times;
* walk: three or more keys of which each touches the one before.

A value ends at its closing quote, or unquoted at a space, quote, comma, semicolon or
bracket.  One of at least MIN_VALUE characters that costs at least MIN_COST (log10 of
guesses) adds a span of kind "guess"; base spans always stay.

Null and empty texts and empty tables have no spans.  Positions are code points,
ends exclusive.  Very long texts and values are taken whole; of the starts of a repeat
or a walk only those that can still win are kept, so the program stays near linear in
the length of a value.  Repeated rows each give a row; other columns are ignored by
scan_secrets() and kept by redact(), whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .tokens import vocabulary

KINDS = ("assign", "access", "hex", "guess")
#: The cost lies above that of words, dates, repeats and walks, and below that of
#: nearly all random values of MIN_VALUE characters, of digits alone too.
MIN_VALUE, MIN_COST = 8, 6.0

_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of 16 or more: the same as all runs with the shorter ones dropped.
_HEX = re.compile(r"[0-9a-f]{16,}")
_CONTEXT = re.compile(
    r"""(?i:passwords?|passwd|passphrase|pwd|secrets?|tokens?|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth)"""
    r"""["']?\x20*(?:[:=]|\x20is\x20)\x20*(?:"([!#-~]+)"|'([!-&(-~]+)'|["']?([!#-&*+.-:=?-Z\\^-z|~-]+))""",
    re.ASCII,
)
_HINT = re.compile(r"(?i:pass|pwd|secret|token|key|credential|auth)", re.ASCII)

#: Common password words, most frequent first (a parameter of the operator).
COMMON_WORDS = (
    "password love secret admin welcome dragon monkey letmein master sunshine princess football baseball shadow michael "
    "superman batman trustno iloveyou login hello freedom whatever starwars computer internet summer winter spring autumn "
    "charlie jordan hunter killer soccer hockey ranger buster thomas robert daniel andrew joshua ginger pepper cookie "
    "cheese orange banana purple yellow silver golden diamond phoenix thunder tigger maggie jessica ashley amanda nicole "
    "matthew jennifer test user guest root default changeme server access private public example token system manager "
    "the and for you are with this that from have not but all can was one our out day get has him his how man new now "
    "old see two way who boy did its let put say she too use may home good time year work life girl money house"
).split()

_LOOKALIKE = str.maketrans("@4310$57!8", "aaeiosstib")
_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_MONTH, _DAY, _YEAR = "(?:0[1-9]|1[0-2])", "(?:0[1-9]|[12][0-9]|3[01])", "(?:19|20)[0-9][0-9]"
_DATES = tuple(re.compile(f"(?=({d}))") for d in (_YEAR, rf"{_YEAR}([-/.]?){_MONTH}\2{_DAY}", rf"{_DAY}([-/.]?){_MONTH}\2{_YEAR}"))
#: Characters of the unit of a repeat at most.
REPEAT_UNIT = 32

#: log10 of the charge for each part after the first: it is of one of five kinds.
_PART = math.log10(5)
_DATE_COST, _YEAR_COST, _SEPARATED = math.log10(365 * 60), math.log10(60), 0.6
_WALK, _TURN = math.log10(47), math.log10(4.6)

#: Row and place of each key; keys touch in a row, and with those above and below.
_KEYS = {c: (r, i) for r, row in enumerate(_ROWS) for i, c in enumerate(row)}


def step(a: str, b: str) -> tuple[int, int] | None:
    """How a walk goes from key a to key b, or None if they do not touch."""
    if a not in _KEYS or b not in _KEYS:
        return None
    (r, i), (s, j) = _KEYS[a], _KEYS[b]
    touching = (-1, 1) if s == r else (0, 1) if s == r - 1 else (-1, 0) if s == r + 1 else ()
    return (s - r, j - i) if j - i in touching else None


def _brute(c: str) -> float:
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() and c.isascii() else math.log10(33)


class _Starts:
    """Starts of parts whose cost is that of the way to the start and the logarithm of
    the length: those that no other start beats for any end still to come."""

    def __init__(self, least: int):
        self.least, self.kept = least, []

    def add(self, at: int, cost: float) -> None:
        """at: greater than all before."""
        kept = self.kept
        while kept and kept[-1][1] >= cost:  # a nearer start that costs no more
            kept.pop()
        if not any(cost - c >= math.log10((at - a) / self.least + 1) - 1e-12 for a, c in kept):
            kept.append((at, cost))

    def best(self, end: int) -> tuple[float, int]:
        return min((c + math.log10(end - a), a) for a, c in self.kept)


def words_of_vocabulary(path: str) -> list[str]:
    """Whole words of 3 letters or more of a vocabulary file with word ends, in order
    of their merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model.get("end_of_word_suffix") or ""
    found = [t.removesuffix(end) for t in sorted(model["vocab"], key=model["vocab"].get) if t.endswith(end)]
    return [w for w in found if len(w) >= 3 and w.isascii() and w.isalpha()]


class GuessCost:
    """Minimum-cost segmentation of values; words are ranked by their order."""

    def __init__(self, words=COMMON_WORDS):
        self.ranks: dict[str, float] = {}
        for w in words:
            self.ranks.setdefault(w, math.log10(len(self.ranks) + 1))
        self.longest = max(map(len, self.ranks), default=0)

    def word_cost(self, value: str, low: str, plain: str, a: int, b: int) -> float | None:
        """The cost of value[a:b] as a word; low and plain are its small form and the
        form without look-alikes."""
        costs = [self.ranks[w] + extra for w, extra in ((low[a:b], 0.0), (plain[a:b], math.log10(2))) if w in self.ranks]
        if not costs:
            return None
        caps = sum(c.isupper() for c in value[a:b])
        case = 0.0 if not caps else math.log10(2) if caps == b - a or value[a].isupper() and caps == 1 else math.log10(math.comb(b - a, caps) + 1)
        return min(costs) + case

    def best(self, value: str) -> tuple[float, list[tuple[int, int, str]]]:
        """log10 of the guesses of the cheapest way, and its parts."""
        n, low = len(value), value.lower()
        if len(low) != n:  # a capital whose small form is longer
            low = value
        plain = low.translate(_LOOKALIKE)
        dates: dict[int, list[tuple[int, float]]] = {}
        for k, pattern in enumerate(_DATES):
            for m in pattern.finditer(value):
                dates.setdefault(m.end(1), []).append((m.start(1), (_DATE_COST if k else _YEAR_COST) + (_SEPARATED if k and m[2] else 0.0)))
        single = [_brute(c) for c in value]
        sums = [0.0, *accumulate(single)]
        cost, brute, run = [0.0] * (n + 1), [math.inf] * (n + 1), [0] * (n + 1)
        came: list[tuple[int, str]] = [(0, "")] * (n + 1)
        letters = 0  # characters before the end that may belong to a word
        same = [0] * (min(REPEAT_UNIT, n // 2) + 1)  # characters equal to the one a unit before
        repeats: list[dict[int, _Starts]] = [{} for _ in same]
        walk, turns, last = None, [0] * (n + 1), None  # turns[i]: turns at keys before i

        def before(a: int) -> float:
            return cost[a] + (_PART if a else 0.0)

        for b in range(1, n + 1):
            # brute force: run says where the span that ends here began
            go, begin = brute[b - 1], before(b - 1)
            brute[b], run[b] = (go, run[b - 1]) if go <= begin else (begin, b - 1)
            brute[b] += single[b - 1]
            found = [(brute[b], run[b], "brute")]
            found += [(before(a) + c, a, "date") for a, c in dates.get(b, ())]
            letters = letters + 1 if plain[b - 1].isalpha() or low[b - 1].isalpha() else 0
            for a in range(max(b - letters, b - self.longest), b - 2):
                if (c := self.word_cost(value, low, plain, a, b)) is not None:
                    found.append((before(a) + c, a, "word"))
            for u in range(1, min(len(same) - 1, b - 1) + 1):
                if value[b - 1] != value[b - 1 - u]:
                    same[u] = 0
                    if repeats[u]:
                        repeats[u] = {}
                    continue
                same[u] += 1
                if same[u] >= u:
                    starts = repeats[u].setdefault(b % u, _Starts(2 * u))
                    starts.add(b - 2 * u, before(b - 2 * u))
                    c, a = starts.best(b)
                    found.append((c - math.log10(u) + sums[b] - sums[b - u], a, "repeat"))
            now = step(low[b - 2], low[b - 1]) if b > 1 else None
            turns[b] = turns[b - 1] + (now is not None and last is not None and now != last)
            if now is None:
                walk, chain = None, b - 1
            elif b - chain >= 3:
                walk = walk or _Starts(3)
                walk.add(b - 3, before(b - 3) - _TURN * turns[b - 1])
                c, a = walk.best(b)
                found.append((c + _WALK + _TURN * turns[b], a, "walk"))
            last = now
            cost[b], *came[b] = min(found)
        parts, at = [], n
        while at:
            a, kind = came[at]
            parts.append((a, at, kind))
            at = a
        return cost[n], parts[::-1]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if ("=" in text or ":" in text) and _HINT.search(text):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def guess_spans(text: str, model: GuessCost, min_value: int = MIN_VALUE, min_cost: float = MIN_COST) -> list[tuple[str, int, int, float]]:
    if not _HINT.search(text):
        return []
    out = []
    for m in _CONTEXT.finditer(text):
        value = m[m.lastindex]
        if m.lastindex == 3:
            value = value.rstrip(".!?:")
        if len(value) >= min_value and (cost := model.best(value)[0]) >= min_cost:
            out.append(("guess", m.start(m.lastindex), m.start(m.lastindex) + len(value), cost))
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


_ROW = T.StructType(
    [
        T.StructField("n_assign", T.LongType()),
        T.StructField("n_access", T.LongType()),
        T.StructField("n_hex", T.LongType()),
        T.StructField("n_guess", T.LongType()),
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("max_guesses_log10", T.DoubleType()),
        T.StructField("redacted", T.StringType()),
    ]
)
_EMPTY = hashlib.sha256(b"").hexdigest()


def scan(texts: list[str], model: GuessCost, mask: str | None = None) -> list[dict]:
    out = []
    for text in texts:
        base, more = base_spans(text), guess_spans(text, model)
        if not base and not more:
            out.append({"n_assign": 0, "n_access": 0, "n_hex": 0, "n_guess": 0, "base_sha256": _EMPTY, "spans": ""})
            continue
        kinds = [k for k, _, _ in base]
        row = {f"n_{k}": kinds.count(k) for k in KINDS[:3]} | {"n_guess": len(more)}
        spans = base + [s[:3] for s in more]
        row |= {"base_sha256": hashlib.sha256(_joined(base).encode()).hexdigest(), "spans": _joined(spans)}
        row["max_guesses_log10"] = max((s[3] for s in more), default=None)
        if mask is not None:
            kept, at = [], 0
            for a, b in sorted((a, b) for _, a, b in spans):
                if b > at:
                    kept += [text[at : max(a, at)]] + [mask] * (a >= at)
                    at = b
            row["redacted"] = "".join(kept) + text[at:]
        out.append(row)
    return out


_MODELS: dict[tuple, GuessCost] = {}


def _model(words: tuple[str, ...], path: str | None) -> GuessCost:
    """One model for each dictionary and Python worker."""
    if (words, path) not in _MODELS:
        _MODELS[words, path] = GuessCost([*words, *(words_of_vocabulary(path) if path else ())])
    return _MODELS[words, path]


def scanned(text: Column, words=COMMON_WORDS, vocabulary_path: str | None = None, mask: str | None = None) -> Column:
    """A struct column of the findings; `redacted` is set where there are any and
    a mask is given."""
    words = tuple(words)

    def make():
        model = _model(words, vocabulary_path)
        return lambda texts: scan(texts, model, mask)

    return common.per_text(make, _ROW)(text)


def scan_secrets(df: DataFrame, words=COMMON_WORDS, vocabulary_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess, max_guesses_log10."""
    common.prepare(df.sparkSession)
    rows = common.id_and_text(df, id_col, text_col).select("doc_id", scanned(F.col("text"), words, vocabulary_path).alias("r"))
    return rows.select("doc_id", *[f"r.{c}" for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "max_guesses_log10")])


def redact(df: DataFrame, mask: str = "[SECRET]", text_col: str = "text", words=COMMON_WORDS, vocabulary_path: str | None = None) -> DataFrame:
    """df with every found span replaced by the mask; null texts stay null."""
    common.prepare(df.sparkSession)
    clean = F.coalesce(scanned(common.text_of(text_col), words, vocabulary_path, mask)["redacted"], F.col(f"`{text_col}`"))
    return df.withColumn(text_col, clean)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(common.table(spark, sf_dir, "documents"), vocabulary_path=vocabulary("word_bpe_49k.json"))

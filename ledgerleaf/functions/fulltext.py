"""Full-text search: lexemes of documents and AND queries over them.

The "simple" configuration lower-cases words; "english" also drops stop words
and strips suffixes by the published Porter algorithm; "german", "french" and
"spanish" drop a few stop words and strip endings by the published light (for French
minimal) stemmers of the University of Neuchatel.  The words of a document
are those of its keys, strings, numbers and booleans, found after lower-casing (İ is
i, one letter).  A query of stop words alone matches nothing.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError

WORD = r"[A-Za-z0-9À-ɏ]+"
_WORD = re.compile(WORD)

#: Common English stop words.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it "
    "its itself they them their theirs themselves what which who whom this that these those am is are was were be been "
    "being have has had having do does did doing a an the and but if or because as until while of at by for with about "
    "against between into through during before after above below to from up down in out on off over under again further "
    "then once here there when where why how all any both each few more most other some such no nor not only own same so "
    "than too very s t can will just don should now".split()
)

_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(w: str) -> str:
    """c and v for each letter; y after a consonant is a vowel."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _short(w: str) -> bool:
    return _shape(w).endswith("cvc") and w[-1] not in "wxy"


@lru_cache(maxsize=50_000)
def stem(w: str) -> str:
    """The Porter stem of a lower-case word."""
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and "v" in _shape(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and "v" in _shape(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            cut += "e"
        elif len(cut) > 1 and cut[-1] == cut[-2] and _shape(cut)[-1] == "c" and cut[-1] not in "lsz":
            cut = cut[:-1]
        elif _measure(cut) == 1 and _short(cut):
            cut += "e"
        w = cut
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for old, new in sorted(table, key=lambda p: -len(p[0])):
            if w.endswith(old):
                if _measure(w[: -len(old)]) > 0:
                    w = w[: -len(old)] + new
                break
    for old in sorted(_STEP4, key=lambda x: -len(x)):
        if w.endswith(old):
            base = w[: -len(old)]
            if _measure(base) > 1 and (old != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or _measure(base) == 1 and not _short(base):
            w = base
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def _german(w: str) -> str:
    w = w.translate(str.maketrans("äàáâöòóôïìíîüùúû", "aaaaooooiiiiuuuu"))
    ends = "bdfghklmnt"
    if len(w) > 5 and w.endswith("ern"):
        w = w[:-3]
    elif len(w) > 4 and w.endswith(("em", "en", "er", "es")):
        w = w[:-2]
    elif len(w) > 3 and (w.endswith("e") or w[-1] == "s" and w[-2] in ends):
        w = w[:-1]
    if len(w) > 5 and w.endswith("est"):
        return w[:-3]
    if len(w) > 4 and (w.endswith(("er", "en")) or w.endswith("st") and w[-3] in ends):
        return w[:-2]
    return w


def _french(w: str) -> str:
    if len(w) < 6:
        return w
    if w.endswith("x"):
        return w[:-2] + "l" if w.endswith("aux") else w[:-1]
    for end in "sreé":
        if w.endswith(end):
            w = w[:-1]
    return w[:-1] if w[-1] == w[-2] else w


def _spanish(w: str) -> str:
    if len(w) < 5:
        return w
    w = w.translate(str.maketrans("àáâäòóôöèéêëùúûüìíîï", "aaaaooooeeeeuuuuiiii"))
    if w[-1] in "oae":
        return w[:-1]
    if w.endswith("eses"):
        return w[:-2]
    if w.endswith("ces"):
        return w[:-3] + "z"
    return w[:-2] if w[-1] == "s" and w[-2] in "oae" else w


#: Stemmers and fixed stop words by configuration.
_LANGUAGES = {
    "english": (stem, STOP_WORDS),
    "german": (_german, frozenset("der die das und oder ist sind war ein eine einer eines im in den dem des von zu mit auf für nicht auch es er sie wir ihr ich als an bei".split())),
    "french": (_french, frozenset("le la les un une des du de et ou est sont au aux en dans pour par sur ne pas ce cette il elle nous vous je que qui se".split())),
    "spanish": (_spanish, frozenset("el la los las un una de del y o es son en con por para no se que lo su al como más pero este esta".split())),
}
CONFIGS = ("simple", *_LANGUAGES)


def known_config(config: str) -> str:
    """The configuration, or QueryError: words of other languages cannot be stemmed here."""
    if config not in CONFIGS:
        raise QueryError(f"no text search configuration {config}; there are {', '.join(CONFIGS)}")
    return config


def lexemes_of(text: str, config: str = "english") -> list[str]:
    """Distinct lexemes of a text, in order of their first place."""
    known_config(config)
    words = _WORD.findall(text.replace("İ", "i").lower())
    if config in _LANGUAGES:
        stemmed, stops = _LANGUAGES[config]
        words = [stemmed(w) for w in words if w not in stops]
    return list(dict.fromkeys(words))


def lexemes(text: Column, config: str = "english") -> Column:
    """Distinct lexemes of a text column; "simple" needs no Python."""
    known_config(config)
    if config == "simple":
        return F.array_distinct(F.regexp_extract_all(F.lower(F.translate(F.coalesce(text, F.lit("")), "İ", "i")), F.lit(WORD), 0))

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([lexemes_of(t or "", config) for t in texts.to_pylist()], pa.list_(pa.string()))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<string>")(text)


def searchable(doc: Column) -> Column:
    """The text of a document that is searched: its JSON, keys included.  An escape is a
    space: JSON escapes no letter or digit, and that of a line end would join `n` to a word."""
    return F.regexp_replace(F.to_json(doc), r"\\(u[0-9A-Fa-f]{4}|.)", " ")


def matches(text: Column, query: str, config: str = "english", kept: Column | None = None) -> Column:
    """Whether the text has every lexeme of the query; kept: its lexemes, if a column has them."""
    wanted = lexemes_of(query, config)
    if not wanted:
        return F.lit(False)
    found = lexemes(text, config) if kept is None else kept
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), found)) == 0

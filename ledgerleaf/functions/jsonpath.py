"""JSON paths and reads of VARIANT columns by path.

A path is dotted text ("a.b[0].c"), or a sequence of segments.  Empty segments
are dropped and nothing is escaped.  A segment of digits addresses an array
index or, on objects, a key of that name.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

Path = str | Sequence[str]


def parse(path: Path) -> tuple[str, ...]:
    """The segments of a path."""
    if isinstance(path, str):
        return tuple(s for s in re.split(r"[.\[\]]", path) if s)
    return tuple(str(s) for s in path if str(s))


def _step(segment: str, as_index: bool) -> str:
    if as_index:
        return f"[{int(segment)}]"
    return f"['{segment}']" if '"' in segment else f'["{segment}"]'


def variant_paths(segments: Sequence[str]) -> list[str]:
    """The forms a path can take: index steps first, then keys."""
    ways = [(True, False) if s.isdigit() else (False,) for s in segments]
    return ["$" + "".join(_step(s, w) for s, w in zip(segments, way)) for way in product(*ways)]


def value(doc: Column, path: Path, kind: str = "variant") -> Column:
    """The value at a path, null where there is none.  JSON null is a variant
    null for kind "variant" and null for others."""
    segments = parse(path)
    if not segments:
        return doc if kind == "variant" else F.variant_get(doc, "$", kind)
    return reduce(lambda a, b: F.coalesce(a, b), [F.variant_get(doc, p, kind) for p in variant_paths(segments)])


def text(doc: Column, path: Path) -> Column:
    """The value as text: strings bare, objects and arrays as compact JSON."""
    return value(doc, path, "string")


def number(doc: Column, path: Path) -> Column:
    """The text of the value as a double; text that is no number raises."""
    return text(doc, path).cast("double")

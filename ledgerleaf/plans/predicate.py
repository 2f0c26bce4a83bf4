"""Predicates over documents, compiled to Columns.

Three-valued logic is kept: a comparison with a missing path is null, so neither
it nor its negation selects the row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fulltext, json_values, jsonpath
from ..functions.jsonpath import Path

#: Escapes of POSIX advanced regular expressions that Java spells otherwise.
_POSIX = (("\\m", "\\b(?=\\w)"), ("\\M", "\\b(?<=\\w)"), ("\\y", "\\b"), ("\\Y", "\\B"))


@dataclass(frozen=True)
class Source:
    """How predicates read a document: its variant column, and native columns
    that stand for some paths (they reach the scan as pushed filters)."""

    doc: Column
    promoted: dict[tuple[str, ...], Column] = field(default_factory=dict)
    search: Column | None = None
    #: Kept lexemes, their configuration, and the types of the native columns.
    lexemes: tuple[Column, str] | None = None
    kinds: dict[tuple[str, ...], T.DataType] = field(default_factory=dict)

    def fits(self, path: Path, literal: Any) -> bool:
        """Whether a native column holds values of the JSON type of a literal; unknown
        types are taken to."""
        kind = self.kinds.get(jsonpath.parse(path))
        if kind is None or literal is None:
            return True
        if isinstance(literal, bool):
            return isinstance(kind, T.BooleanType)
        if isinstance(literal, (int, float)):
            return isinstance(kind, T.NumericType)
        return not isinstance(literal, str) or not isinstance(kind, (T.NumericType, T.BooleanType, T.VariantType))

    def native(self, path: Path) -> Column | None:
        return self.promoted.get(jsonpath.parse(path))

    def value(self, path: Path) -> Column:
        return jsonpath.value(self.doc, path)

    def text(self, path: Path) -> Column:
        own = self.native(path)
        return jsonpath.text(self.doc, path) if own is None else own.cast("string")

    def number(self, path: Path) -> Column:
        own = self.native(path)
        return jsonpath.number(self.doc, path) if own is None else own.try_cast("double")

    def searched(self) -> Column:
        return fulltext.searchable(self.doc) if self.search is None else self.search


class Predicate:
    """Base of predicates; the class methods build them."""

    def compile(self, source: Source) -> Column:
        raise NotImplementedError

    @staticmethod
    def eq(path: Path, value: Any) -> Predicate:
        return _Compare("eq", path, value)

    @staticmethod
    def ne(path: Path, value: Any) -> Predicate:
        return _Not(_Compare("eq", path, value))

    @staticmethod
    def gt(path: Path, value: float) -> Predicate:
        return _Compare("gt", path, value)

    @staticmethod
    def ge(path: Path, value: float) -> Predicate:
        return _Compare("ge", path, value)

    @staticmethod
    def lt(path: Path, value: float) -> Predicate:
        return _Compare("lt", path, value)

    @staticmethod
    def le(path: Path, value: float) -> Predicate:
        return _Compare("le", path, value)

    @staticmethod
    def between(path: Path, low: float, high: float) -> Predicate:
        return _Compare("between", path, (low, high))

    @staticmethod
    def is_in(path: Path, values: list) -> Predicate:
        return _Or(tuple(_Compare("eq", path, v) for v in values))

    @staticmethod
    def contains(path: Path, value: Any) -> Predicate:
        return _Compare("contains", path, value)

    @staticmethod
    def exists(path: Path) -> Predicate:
        return _Compare("exists", path, None)

    @staticmethod
    def regex(path: Path, pattern: str) -> Predicate:
        return _Compare("regex", path, pattern)

    @staticmethod
    def iregex(path: Path, pattern: str) -> Predicate:
        return _Compare("regex", path, f"(?i){pattern}")

    @staticmethod
    def full_text(query: str, language: str = "english") -> Predicate:
        return _FullText(query, language)

    @staticmethod
    def both(*parts: Predicate) -> Predicate:
        return _And(parts)

    @staticmethod
    def either(*parts: Predicate) -> Predicate:
        return _Or(parts)

    def negate(self) -> Predicate:
        return _Not(self)

    def __and__(self, other: Predicate) -> Predicate:
        return _And((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return _Or((self, other))

    def __invert__(self) -> Predicate:
        return _Not(self)


@dataclass(frozen=True)
class _Compare(Predicate):
    op: str
    path: Path
    literal: Any

    def compile(self, source: Source) -> Column:
        if self.op == "exists":
            own = source.native(self.path)
            return (source.value(self.path) if own is None else own).isNotNull()
        if self.op == "eq":
            own = source.native(self.path)
            if own is not None and not isinstance(self.literal, (list, dict)):
                if not source.fits(self.path, self.literal):  # JSON values of two types are never equal
                    return F.when(own.isNotNull(), F.lit(False))
                return own.isNull() if self.literal is None else own == F.lit(self.literal)
            return json_values.equals(source.value(self.path), self.literal)
        if self.op == "contains":
            return json_values.contains(source.value(self.path), self.literal)
        if self.op == "regex":
            pattern = reduce(lambda p, e: p.replace(*e), _POSIX, self.literal)
            return source.text(self.path).rlike(pattern)
        number = source.number(self.path)
        if self.op == "between":
            return number.between(*map(float, self.literal))
        x = F.lit(float(self.literal))
        return {"gt": number > x, "ge": number >= x, "lt": number < x, "le": number <= x}[self.op]


@dataclass(frozen=True)
class _FullText(Predicate):
    query: str
    language: str

    def compile(self, source: Source) -> Column:
        kept = source.lexemes[0] if source.lexemes and source.lexemes[1] == self.language else None
        return fulltext.matches(source.searched(), self.query, self.language, kept)


@dataclass(frozen=True)
class _Not(Predicate):
    part: Predicate

    def compile(self, source: Source) -> Column:
        return ~self.part.compile(source)


@dataclass(frozen=True)
class _And(Predicate):
    parts: tuple[Predicate, ...]

    def compile(self, source: Source) -> Column:
        return reduce(lambda a, b: a & b, [p.compile(source) for p in self.parts], F.lit(True))


@dataclass(frozen=True)
class _Or(Predicate):
    parts: tuple[Predicate, ...]

    def compile(self, source: Source) -> Column:
        if not self.parts:
            return F.lit(False)
        return reduce(lambda a, b: a | b, [p.compile(source) for p in self.parts])

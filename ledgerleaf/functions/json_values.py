"""Equality and containment of JSON values against literals.

VARIANT has no equality, so the literal's own type decides which test is
compiled; a guard on the stored type keeps "12.5" apart from 12.5.  Numbers
compare by value whatever their scale, objects whatever their key order.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _guarded(v: Column, right_type: Column, test: Column) -> Column:
    """test where the type is right, false elsewhere, null for SQL null."""
    return F.when(v.isNull(), F.lit(None).cast("boolean")).when(right_type, F.coalesce(test, F.lit(False))).otherwise(F.lit(False))


def equals(v: Column, literal: object) -> Column:
    """Deep, type-strict equality of a variant and a JSON literal."""
    kind = F.schema_of_variant(v)
    if literal is None:
        return F.when(v.isNull(), F.lit(None).cast("boolean")).otherwise(F.is_variant_null(v))
    if isinstance(literal, bool):
        return _guarded(v, kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean") == F.lit(literal))
    if isinstance(literal, (int, Decimal)) and abs(literal) < 10**19:
        return _guarded(v, kind.rlike(_NUMBER), F.try_variant_get(v, "$", "decimal(38,18)") == F.lit(str(literal)).cast("decimal(38,18)"))
    if isinstance(literal, (int, float, Decimal)):
        return _guarded(v, kind.rlike(_NUMBER), F.try_variant_get(v, "$", "double") == F.lit(float(literal)))
    if isinstance(literal, str):
        return _guarded(v, kind == "STRING", F.try_variant_get(v, "$", "string") == F.lit(literal))
    if isinstance(literal, (list, tuple)):
        items = F.try_variant_get(v, "$", "array<variant>")
        tests = [F.size(items) == len(literal)] + [F.coalesce(equals(F.get(items, F.lit(i)), x), F.lit(False)) for i, x in enumerate(literal)]
        return _guarded(v, kind.startswith("ARRAY"), _all(tests))
    if isinstance(literal, dict):
        fields = F.try_variant_get(v, "$", "map<string,variant>")
        tests = [F.size(fields) == len(literal)] + [F.coalesce(equals(F.try_element_at(fields, F.lit(k)), x), F.lit(False)) for k, x in literal.items()]
        return _guarded(v, kind.startswith("OBJECT"), _all(tests))
    raise TypeError(f"not a JSON value: {literal!r}")


def _some(items: Column, test: Callable[..., Column], literal: object) -> Column:
    """Whether the test holds for some item."""
    more = (False,) if test is contains else ()
    return F.exists(items, lambda x: F.coalesce(test(x, literal, *more), F.lit(False)))


def contains(v: Column, literal: object, top: bool = True) -> Column:
    """Whether the variant contains the literal: objects key by key, arrays each
    element in some element; at the top an array contains a bare scalar."""
    kind = F.schema_of_variant(v)
    if isinstance(literal, dict):
        fields = F.try_variant_get(v, "$", "map<string,variant>")
        tests = [F.coalesce(contains(F.try_element_at(fields, F.lit(k)), x, False), F.lit(False)) for k, x in literal.items()]
        return _guarded(v, kind.startswith("OBJECT"), _all(tests))
    items = F.try_variant_get(v, "$", "array<variant>")
    if isinstance(literal, (list, tuple)):
        tests = [_some(items, contains, e) for e in literal]
        return _guarded(v, kind.startswith("ARRAY"), _all(tests))
    same = equals(v, literal)
    if not top:
        return same
    return F.when(kind.startswith("ARRAY"), _some(items, equals, literal)).otherwise(same)

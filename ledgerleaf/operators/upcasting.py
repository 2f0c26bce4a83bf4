"""Event upcasting: chains of upcasters from (type, version) to later ones.

Upcasters map a body Column to a Column (they stay in the plan), a Python object to
an object (neighbouring ones run as one Arrow function over a batch), or take fields
from a table by a key of the body (a left join).  The distinct (type, version) pairs
of a log are few and named by its folders; each one's chain is resolved on the driver
with a check for cycles and compiled into one branch of a CASE.  Version 0 registers
a wildcard for its type: it is used where no exact upcaster is, once for each type.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import UpcastingCycle, UpcastingFailed

Key = tuple[str, int]


@dataclass(frozen=True)
class Lookup:
    """Fields of a body taken from a table of one row a key; a body whose key has no row
    gets nulls."""

    table: DataFrame
    key: str
    path: str
    fields: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Upcaster:
    source: Key
    target: Key
    body: Callable[[Any], Any] | Lookup
    native: bool = False


class UpcasterRegistry:
    def __init__(self) -> None:
        self._by_source: dict[Key, Upcaster] = {}

    def register(self, source: Key, target: Key, body: Callable[[Any], Any], native: bool = False) -> UpcasterRegistry:
        """native: body maps a variant Column to a Column of JSON text or variant;
        otherwise a Python value to a Python value."""
        self._by_source[source] = Upcaster(source, target, body, native)
        return self

    def register_lookup(self, source: Key, target: Key, table: DataFrame, key: str, path: str, fields: dict[str, str]) -> UpcasterRegistry:
        """Sets fields (name -> column of the table) of the row whose key equals the
        value at path (a JSON path such as $.customer_id)."""
        self._by_source[source] = Upcaster(source, target, Lookup(table, key, path, tuple(fields.items())), True)
        return self

    def upcaster(self, source: Key, target: Key, native: bool = False) -> Callable:
        """Decorator form of register()."""

        def wrap(f: Callable) -> Callable:
            self.register(source, target, f, native)
            return f

        return wrap

    def describe(self) -> list[tuple[Key, Key]]:
        return sorted((u.source, u.target) for u in self._by_source.values())

    def find_path(self, start: Key, end: Key) -> list[Key] | None:
        """The shortest way from start to end, both included."""
        came: dict[Key, Key | None] = {start: None}
        queue = deque([start])
        while queue:
            at = queue.popleft()
            if at == end:
                way = [at]
                while (at := came[at]) is not None:
                    way.append(at)
                return way[::-1]
            nxt = self._by_source.get(at)
            if nxt is not None and nxt.target not in came:
                came[nxt.target] = at
                queue.append(nxt.target)
        return None

    def chain(self, start: Key) -> list[Upcaster]:
        """All upcasters that apply from start on, in order."""
        out, at, seen, wild = [], start, {start}, set()
        while True:
            step = self._by_source.get(at)
            if step is None and at[0] not in wild:
                step = self._by_source.get((at[0], 0))
                wild.add(at[0])
            if step is None:
                return out
            out.append(step)
            at = step.target
            if at in seen:
                raise UpcastingCycle(f"{start} comes back to {at}")
            seen.add(at)

    def apply_one(self, typ: str, version: int, body: Any) -> tuple[str, int, Any]:
        """Upcasts a single event in Python."""
        for step in self.chain((typ, version)):
            if step.native:
                raise UpcastingFailed("a native upcaster needs a DataFrame")
            try:
                body = step.body(body)
            except Exception as e:
                raise UpcastingFailed(f"{step.source} to {step.target}: {e}") from e
            typ, version = step.target
        return typ, version, body

    def apply(self, events: DataFrame, typ: str = "event_type", version: str = "event_version", body: str = "body", pairs: Iterable[Key] | None = None) -> DataFrame:
        """events with body (variant), type and version brought up to date.  pairs: the
        types and versions that occur, or more; without them a job looks."""
        if not self._by_source:
            return events
        types, columns = {k[0] for k in self._by_source}, events.columns
        if pairs is None:
            pairs = [(r[0], r[1]) for r in events.where(F.col(typ).isin(sorted(types))).select(typ, version).distinct().collect()]  # a few pairs
        new_type, new_version, new_body = F.col(typ), F.col(version), F.col(body)
        for pair in sorted({tuple(p) for p in pairs if p[0] in types}):
            steps = self.chain(pair)
            if not steps:
                continue
            here = (F.col(typ) == pair[0]) & (F.col(version) == pair[1])
            # only the rows of this pair enter the chain
            value, python = F.when(here, F.col(body)), []
            for step in steps:
                if not step.native:
                    python.append(step)
                    continue
                value, python = self._python(python, value), []
                if isinstance(step.body, Lookup):
                    events, value = self._looked_up(events, step.body, value)
                else:
                    value = step.body(value)
            new_body = F.when(here, self._python(python, value)).otherwise(new_body)
            new_type = F.when(here, F.lit(steps[-1].target[0])).otherwise(new_type)
            new_version = F.when(here, F.lit(steps[-1].target[1])).otherwise(new_version)
        return events.withColumns({body: new_body, typ: new_type, version: new_version.cast("int")}).select(*[F.col(f"`{c}`") for c in columns])

    @staticmethod
    def _looked_up(events: DataFrame, step: Lookup, value: Column) -> tuple[DataFrame, Column]:
        """events with the row of the table beside each, and the value with its fields."""
        n = len(events.columns)
        kept, key = f"__body_{n}", f"__key_{n}"
        names = {column: f"__{n}_{i}" for i, (_, column) in enumerate(step.fields)}
        table = step.table.select(F.col(f"`{step.key}`").cast("string").alias(key), *[F.col(f"`{c}`").alias(a) for c, a in names.items()])
        events = events.withColumn(kept, value)
        events = events.join(table, F.try_variant_get(F.col(kept), step.path, "string") == F.col(key), "left")
        return events, with_fields(F.col(kept), {field: F.col(names[column]) for field, column in step.fields})

    @staticmethod
    def _python(steps: list[Upcaster], value: Column) -> Column:
        """value after Python upcasters, all in one pass over a batch."""
        if not steps:
            return value

        def one(text: str | None) -> str | None:
            if text is None:
                return None
            found = json.loads(text)
            for step in steps:
                try:
                    found = step.body(found)
                except Exception as e:
                    raise UpcastingFailed(f"{step.source} to {step.target}: {e}") from e
            return json.dumps(found)

        def run(texts: pa.Array) -> pa.Array:
            return pa.array([one(t) for t in texts.to_pylist()], pa.string())

        run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
        return F.try_parse_json(F.arrow_udf(run, "string")(F.to_json(value)))


class LegacyUpcasters:
    """Upcasters of a body by type, each to the next version; one that raises ends the
    chain where it was, without a word."""

    def __init__(self) -> None:
        self._by_source: dict[Key, Callable[[Any], Any]] = {}

    def register(self, typ: str, version: int, body: Callable[[Any], Any]) -> LegacyUpcasters:
        self._by_source[typ, version] = body
        return self

    def apply_one(self, typ: str, version: int, body: Any) -> tuple[int, Any]:
        while (step := self._by_source.get((typ, version))) is not None:
            try:
                body = step(body)
            except Exception:  # noqa: BLE001  by definition
                break
            version += 1
        return version, body

    def apply(self, events: DataFrame) -> DataFrame:
        """events with event_version and body brought up to date, a batch at a time."""
        kind = pa.struct([("version", pa.int32()), ("body", pa.string())])

        def run(types: pa.Array, versions: pa.Array, bodies: pa.Array) -> pa.Array:
            out = []
            for typ, version, body in zip(types.to_pylist(), versions.to_pylist(), bodies.to_pylist()):
                version, found = self.apply_one(typ, version, None if body is None else json.loads(body))
                out.append({"version": version, "body": json.dumps(found)})
            return pa.array(out, kind)

        run.__annotations__ = {"types": pa.Array, "versions": pa.Array, "bodies": pa.Array, "return": pa.Array}
        types, names = sorted({t for t, _ in self._by_source}), events.columns
        found = F.when(F.col("event_type").isin(types), F.arrow_udf(run, "version int, body string")("event_type", "event_version", F.to_json("body")))
        rows = events.withColumn("__found", found)
        new = {"event_version": F.coalesce("__found.version", "event_version"), "body": F.coalesce(F.try_parse_json("__found.body"), "body")}
        return rows.withColumns(new).select(*[F.col(f"`{c}`") for c in names])


def with_fields(value: Column, fields: dict[str, Column | str | int | float | bool | None]) -> Column:
    """A native upcaster's body: the object with fields set (variants have no setter)."""
    kept = F.try_variant_get(value, "$", "map<string,variant>")
    new = {k: (v if isinstance(v, Column) else F.lit(v)) for k, v in fields.items()}
    entries = [F.variant_get(F.to_variant_object(F.struct(v.alias("x"))), "$.x", "variant") for v in new.values()]
    added = F.map_from_arrays(F.array(*map(F.lit, new)), F.array(*entries))
    old = F.map_filter(kept, lambda k, _: ~k.isin(list(new)))
    return F.when(value.isNotNull(), F.to_variant_object(F.map_concat(old, added)))

"""Document queries: an immutable specification, compiled to one DataFrame plan.

A Collection is a DataFrame with a document column.  DocumentQuery adds filters,
includes (left joins), projections, aggregates, order and pages to it; compile()
only builds the plan, so Catalyst prunes columns and pushes filters as it can.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NotFound, QueryError, TenantRequired
from ..functions import jsonpath
from ..functions.jsonpath import Path
from .predicate import Predicate, Source

DOCS = "docs"


@dataclass(frozen=True)
class Collection:
    """Documents: frame, the names of its envelope columns, and which native
    columns stand for which paths."""

    frame: DataFrame
    id_col: str = "id"
    doc_col: str = "doc"
    deleted_col: str | None = "deleted_at"
    tenant_col: str | None = None
    promoted: dict[str, str] = field(default_factory=dict)
    search_col: str | None = None
    #: A column of kept lexemes and their configuration.
    lexemes_col: tuple[str, str] | None = None

    @staticmethod
    def from_table(frame: DataFrame, id_col: str) -> Collection:
        """A relational table as documents: each row is an object of its columns,
        and each column is promoted, so filters and projections on it never build
        the object."""
        doc = F.to_variant_object(F.struct(*[F.col(f"`{c}`") for c in frame.columns]))
        return Collection(frame.withColumn("doc", doc), id_col, "doc", None, None, {c: c for c in frame.columns})

    @staticmethod
    def from_json(frame: DataFrame, id_col: str, json_col: str, promoted: dict[str, str] | None = None) -> Collection:
        """A column of JSON text as documents."""
        return Collection(frame.withColumn("doc", F.parse_json(F.col(f"`{json_col}`"))), id_col, "doc", None, None, promoted or {})


@dataclass(frozen=True)
class Include:
    frame: DataFrame
    path: Path
    key: str
    alias: str
    doc_col: str | None


@dataclass(frozen=True)
class Spec:
    filters: tuple[Predicate, ...] = ()
    includes: tuple[Include, ...] = ()
    fields: tuple[tuple[str, str | None, Path], ...] = ()
    aggregates: tuple[tuple[str, str, Path | None], ...] = ()
    groups: tuple[tuple[str | None, Path], ...] = ()
    order: tuple[tuple[str | None, Path, bool, bool], ...] = ()
    limit: int | None = None
    offset: int | None = None
    deleted: str = "hide"
    tenant: str | None = None


class SlowLog:
    """Queries that took longer than the threshold, with their plans if asked for."""

    def __init__(self, threshold_s: float = 0.5, explain: bool = False):
        self.threshold_s, self.explain, self.entries = threshold_s, explain, []

    def note(self, frame: DataFrame, seconds: float) -> None:
        if seconds >= self.threshold_s:
            plan = frame._jdf.queryExecution().simpleString() if self.explain else None
            self.entries.append({"seconds": seconds, "plan": plan})


@dataclass(frozen=True)
class DocumentQuery:
    collection: Collection
    spec: Spec = Spec()
    slow_log: SlowLog | None = None

    def _with(self, **changes: object) -> DocumentQuery:
        return replace(self, spec=replace(self.spec, **changes))

    # --- building ---------------------------------------------------------
    def filter(self, predicate: Predicate) -> DocumentQuery:
        return self._with(filters=(*self.spec.filters, predicate))

    def filter_if(self, condition: bool, make: Callable[[], Predicate]) -> DocumentQuery:
        return self.filter(make()) if condition else self

    def full_text_search(self, query: str, language: str = "english") -> DocumentQuery:
        return self.filter(Predicate.full_text(query, language))

    def include(self, table: DataFrame | Collection, path: Path, foreign_key: str, alias: str) -> DocumentQuery:
        """LEFT JOIN table AS alias ON alias.foreign_key = the text at path."""
        if isinstance(table, Collection):
            found = Include(table.frame, path, foreign_key, alias, table.doc_col)
        else:
            found = Include(table, path, foreign_key, alias, "doc" if "doc" in table.columns else None)
        return self._with(includes=(*self.spec.includes, found))

    def select_fields(self, fields: Sequence[tuple[str, Path]]) -> DocumentQuery:
        return self._with(fields=tuple((a, None, p) for a, p in fields), aggregates=())

    def select_field(self, alias: str, path: Path) -> DocumentQuery:
        if self.spec.aggregates:
            return self
        return self._with(fields=(*self.spec.fields, (alias, None, path)))

    def select_from(self, source: str, alias: str, path: Path) -> DocumentQuery:
        return self._with(fields=(*self.spec.fields, (alias, source, path)))

    def _aggregate(self, kind: str, alias: str, path: Path | None) -> DocumentQuery:
        return self._with(aggregates=(*self.spec.aggregates, (kind, alias, path)))

    def count(self, alias: str = "count") -> DocumentQuery:
        return self._aggregate("count", alias, None)

    def sum(self, path: Path, alias: str) -> DocumentQuery:
        return self._aggregate("sum", alias, path)

    def avg(self, path: Path, alias: str) -> DocumentQuery:
        return self._aggregate("avg", alias, path)

    def min(self, path: Path, alias: str) -> DocumentQuery:
        return self._aggregate("min", alias, path)

    def max(self, path: Path, alias: str) -> DocumentQuery:
        return self._aggregate("max", alias, path)

    def group_by(self, path: Path) -> DocumentQuery:
        return self._with(groups=(*self.spec.groups, (None, path)))

    def group_by_from(self, source: str, path: Path) -> DocumentQuery:
        return self._with(groups=(*self.spec.groups, (source, path)))

    def order_by(self, path: Path, descending: bool = False) -> DocumentQuery:
        return self._with(order=(*self.spec.order, (None, path, False, descending)))

    def order_by_number(self, path: Path, descending: bool = False) -> DocumentQuery:
        return self._with(order=(*self.spec.order, (None, path, True, descending)))

    def order_by_from(self, source: str, path: Path, descending: bool = False) -> DocumentQuery:
        return self._with(order=(*self.spec.order, (source, path, False, descending)))

    def order_by_number_from(self, source: str, path: Path, descending: bool = False) -> DocumentQuery:
        return self._with(order=(*self.spec.order, (source, path, True, descending)))

    def limit(self, n: int) -> DocumentQuery:
        return self._with(limit=max(0, n))

    def offset(self, n: int) -> DocumentQuery:
        return self._with(offset=max(0, n))

    def page(self, number: int, size: int) -> DocumentQuery:
        number, size = max(1, number), max(1, size)
        return self._with(limit=size, offset=(number - 1) * size)

    def include_deleted(self) -> DocumentQuery:
        return self._with(deleted="include")

    def only_deleted(self) -> DocumentQuery:
        return self._with(deleted="only")

    def for_tenant(self, tenant: str) -> DocumentQuery:
        return self._with(tenant=tenant)

    # --- compiling --------------------------------------------------------
    def _source(self) -> Source:
        c = self.collection
        column = lambda name: F.col(f"{DOCS}.`{name}`")
        promoted = {jsonpath.parse(p): column(name) for p, name in c.promoted.items()}
        kept = (column(c.lexemes_col[0]), c.lexemes_col[1]) if c.lexemes_col else None
        kinds = {jsonpath.parse(p): c.frame.schema[name].dataType for p, name in c.promoted.items()}
        return Source(column(c.doc_col), promoted, column(c.search_col) if c.search_col else None, kept, kinds)

    def _reader(self, source: str | None) -> Source:
        if source is None or source == DOCS:
            return self._source()
        for inc in self.spec.includes:
            if inc.alias == source:
                if inc.doc_col:
                    return Source(F.col(f"{source}.`{inc.doc_col}`"))
                return Source(F.lit(None), {(c,): F.col(f"{source}.`{c}`") for c in inc.frame.columns}, kinds={(f.name,): f.dataType for f in inc.frame.schema})
        raise QueryError(f"no include has the alias {source}")

    def _base(self) -> DataFrame:
        c, s = self.collection, self.spec
        frame = c.frame.alias(DOCS)
        if c.tenant_col:
            if s.tenant is None:
                raise TenantRequired("this collection holds several tenants")
            frame = frame.where(F.col(f"{DOCS}.`{c.tenant_col}`") == s.tenant)
        if c.deleted_col and s.deleted != "include":
            gone = F.col(f"{DOCS}.`{c.deleted_col}`").isNotNull()
            frame = frame.where(gone if s.deleted == "only" else ~gone)
        own = self._source()
        for p in s.filters:  # before the joins: they read the documents alone
            frame = frame.where(p.compile(own))
        for inc in s.includes:
            key = F.col(f"{inc.alias}.`{inc.key}`")
            native = own.native(inc.path)
            same = key == native if native is not None else key.cast("string") == own.text(inc.path)
            frame = frame.join(inc.frame.alias(inc.alias), same, "left")
        return frame

    def to_df(self, keys: bool = False) -> DataFrame:
        """Columns under their aliases; keys adds the group keys of aggregates."""
        s, frame = self.spec, self._base()
        if s.aggregates or s.groups:
            return self._paged(self._aggregated(frame, keys))
        order = [self._order(*o) for o in s.order]
        if order:
            frame = frame.orderBy(*order)
        if s.fields:
            columns = [self._field(source, path).alias(alias) for alias, source, path in s.fields]
        else:
            columns = [F.col(f"{DOCS}.`{self.collection.id_col}`"), F.col(f"{DOCS}.`{self.collection.doc_col}`")]
        # the page is taken on the sorted rows, then the projection is free
        return self._paged(frame).select(*columns)

    def to_json_df(self) -> DataFrame:
        """One JSON text column: the object of the selection."""
        if not (self.spec.fields or self.spec.aggregates or self.spec.groups):
            return self.to_df().select(F.to_json(F.col(self.collection.doc_col)).alias("json"))
        frame = self.to_df()
        return frame.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in frame.columns]), {"ignoreNullFields": "false"}).alias("json"))

    def _field(self, source: str | None, path: Path) -> Column:
        reader = self._reader(source)
        own = reader.native(path)
        return reader.value(path) if own is None else own

    def _order(self, source: str | None, path: Path, numeric: bool, descending: bool) -> Column:
        reader = self._reader(source)
        own = reader.native(path)
        is_number = own is not None and isinstance(reader.kinds.get(jsonpath.parse(path)), T.NumericType)
        key = own if numeric and is_number else reader.number(path) if numeric else reader.text(path)
        return key.desc_nulls_first() if descending else key.asc_nulls_last()

    def _aggregated(self, frame: DataFrame, keys: bool) -> DataFrame:
        s = self.spec
        names = [f"{jsonpath.parse(p)[-1]}" for _, p in s.groups]
        if len(set(names)) < len(names):
            names = [f"key_{i}" for i in range(len(names))]
        groups = [self._reader(source).text(path).alias(f"__key_{i}") for i, (source, path) in enumerate(s.groups)]
        made = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
        own = self._source()
        found = [F.count(F.lit(1)).alias(a) if kind == "count" else made[kind](own.number(path)).alias(a) for kind, a, path in s.aggregates]
        frame = frame.groupBy(*groups).agg(*(found or [F.count(F.lit(1)).alias("count")]))
        if s.order:
            at = {(source, jsonpath.parse(p)): f"__key_{i}" for i, (source, p) in enumerate(s.groups)}
            order = []
            for source, path, numeric, descending in s.order:
                name = at.get((source, jsonpath.parse(path)))
                if name is None:
                    raise QueryError("an aggregate can only be ordered by its group keys")
                key = F.col(name).cast("double") if numeric else F.col(name)
                order.append(key.desc_nulls_first() if descending else key.asc_nulls_last())
            frame = frame.orderBy(*order)
        aliases = [a for _, a, _ in s.aggregates] or ["count"]
        shown = [F.col(f"__key_{i}").alias(n) for i, n in enumerate(names)] if keys else []
        return frame.select(*shown, *aliases)

    def _paged(self, frame: DataFrame) -> DataFrame:
        if self.spec.offset:
            frame = frame.offset(self.spec.offset)
        return frame if self.spec.limit is None else frame.limit(self.spec.limit)

    # --- running ----------------------------------------------------------
    def _timed(self, frame: DataFrame, run: Callable[[DataFrame], list[Row]]) -> list[Row]:
        began = time.monotonic()
        rows = run(frame)
        if self.slow_log is not None:
            self.slow_log.note(frame, time.monotonic() - began)
        return rows

    def fetch_all(self) -> list[Row]:
        return self._timed(self.to_df(), lambda f: f.collect())

    def fetch_first(self) -> Row | None:
        return next(iter(self._timed(self.to_df(), lambda f: f.take(1))), None)

    fetch_optional = fetch_first

    def fetch_one(self) -> Row:
        row = self.fetch_first()
        if row is None:
            raise NotFound("no document matches")
        return row

    def explain(self) -> str:
        return self.to_df()._jdf.queryExecution().explainString(self.collection.frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


class CompiledQuery:
    """A query that is written once and run on any collection: subclasses build
    it in configure()."""

    def configure(self, query: DocumentQuery) -> DocumentQuery:
        raise NotImplementedError

    def on(self, collection: Collection) -> DocumentQuery:
        return self.configure(DocumentQuery(collection))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by name; columns missing on a side are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

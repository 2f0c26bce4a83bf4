"""The store: documents, events, snapshots and control data in one commit log."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import context as ctx
from .errors import TenantNotFound
from .session import configure
from .functions import fulltext
from .promoted import Promoted, promote
from .sources.commitlog import FAN, Change, CommitLog, Facts, Part, State

_S, _L, _I, _B, _TS, _V = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType(), T.VariantType()


def _schema(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


DOCS = _schema(tenant_id=_S, id=_S, doc=_V, version=_I, created_at=_TS, updated_at=_TS, deleted_at=_TS, created_by=_S, last_modified_by=_S, op=_S)
EVENTS = _schema(global_seq=_L, stream_id=_S, stream_seq=_I, event_type=_S, body=_V, headers=_V, causation_id=_S, correlation_id=_S, event_version=_I, tenant_id=_S, user_id=_S, is_tombstone=_B, created_at=_TS, retention_class=_S)
TABLES = {
    "docs": DOCS,
    "events": EVENTS,
    "idempotency": _schema(tenant_id=_S, key=_S),
    "snapshots": _schema(tenant_id=_S, stream_id=_S, version=_I, body=_S, created_at=_TS),
    "streams": _schema(tenant_id=_S, stream_id=_S, archived_at=_TS, archived_by=_S, archive_reason=_S, retention_class=_S, rev=_L),
    "dlq": _schema(id=_L, name=_S, tenant_id=_S, global_seq=_L, event_type=_S, body=_S, error=_S, failed_at=_TS),
    "views": _schema(view=_S, tenant_id=_S, key=_S, count=_L, sum=T.DoubleType(), upto=_L),
}


#: Keys that the facts of a folder name at most; folders with more are searched.
MAX_KEYS = 1000
#: Rows of a file of a merged folder, the order of its rows and the column with a Bloom filter.
FILE_ROWS = 1_000_000
ORDER = {"events": ("global_seq", "stream_id"), "docs": ("id", "id"), "idempotency": ("key", "key"), "streams": ("stream_id", "stream_id"), "snapshots": ("stream_id", "stream_id"), "views": ("key", "key"), "dlq": ("id", "name")}


def key_of(tenant: str | None, name: object) -> str:
    """How facts name a stream, a document or an idempotency key of a tenant."""
    return f"{tenant or ''}|{name}"


def may_hold(key: str) -> Callable[[Facts], bool]:
    """Whether a folder may hold rows of a key: those that name no keys may."""
    return lambda facts: "keys" not in facts or key in facts["keys"]


def merged_facts(found: list[Facts]) -> Facts:
    """The facts of the rows of several folders together."""
    out: Facts = {}
    if all("n" in f for f in found):
        out["n"] = sum(f["n"] for f in found)
    for name, best in (("lo", min), ("hi", max), ("t_lo", min), ("t_hi", max)):
        if all(name in f for f in found):
            out[name] = best(f[name] for f in found)
    if len(classes := {f.get("class") for f in found}) == 1 and None not in classes:
        out["class"] = classes.pop()
    if all("keys" in f for f in found):
        keys: dict[str, int] = {}
        for f in found:
            for k, v in f["keys"].items():
                keys[k] = max(v, keys.get(k, v))
        if len(keys) <= MAX_KEYS:
            out["keys"] = keys
    if all("archived" in f for f in found):
        archived = sorted({k for f in found for k in f["archived"]})
        if len(archived) <= MAX_KEYS:
            out["archived"] = archived
    if all("types" in f for f in found):
        out["types"] = sorted({tuple(t) for f in found for t in f["types"]})
    if len(columns := {tuple(f.get("columns", ())) for f in found}) == 1:
        out["columns"] = list(columns.pop())
    return out


def now() -> datetime:
    return datetime.now(timezone.utc)


class Metrics:
    """Counters and gauges by name and tenant, rendered as Prometheus text."""

    def __init__(self, prefix: str = "ledgerleaf"):
        self.prefix, self.values, self.gauges = prefix, {}, set()

    def add(self, name: str, by: float = 1, tenant: str | None = None) -> None:
        self.values[name, tenant] = self.values.get((name, tenant), 0) + by

    def set(self, name: str, value: float, tenant: str | None = None) -> None:
        self.gauges.add(name)
        self.values[name, tenant] = value

    def render(self) -> str:
        lines = []
        for name in sorted({n for n, _ in self.values}):
            lines.append(f"# TYPE {self.prefix}_{name} {'gauge' if name in self.gauges else 'counter'}")
            for (n, tenant), v in sorted(self.values.items(), key=lambda x: (x[0][0], x[0][1] or "")):
                if n == name:
                    label = f'{{tenant="{tenant}"}}' if tenant else ""
                    lines.append(f"{self.prefix}_{n}{label} {v:g}")
        return "\n".join(lines) + "\n"


class LiveCache:
    """Scalars of ad-hoc SQL, kept for a time to live; shared() is one for a process."""

    _shared: LiveCache | None = None

    @classmethod
    def shared(cls, spark: SparkSession, ttl_s: float = 1.0) -> LiveCache:
        """The cache of this process; the session and the time to live given last hold."""
        if LiveCache._shared is None:
            LiveCache._shared = cls(spark, ttl_s)
        LiveCache._shared.spark, LiveCache._shared.ttl_s = spark, ttl_s
        return LiveCache._shared

    def __init__(self, spark: SparkSession, ttl_s: float = 1.0):
        self.spark, self.ttl_s, self._kept = spark, ttl_s, {}

    def scalar(self, key: str, sql: str) -> Any:
        at, value = self._kept.get(key, (None, None))
        if at is None or time.monotonic() - at >= self.ttl_s:
            row = self.spark.sql(sql).first()
            value = None if row is None else row[0]
            self._kept[key] = (time.monotonic(), value)
        return value

    def invalidate(self, key: str) -> None:
        self._kept.pop(key, None)


class Breadcrumbs:
    """Notes of what was done, drawn as a Mermaid sequence."""

    def __init__(self) -> None:
        self.steps: list[tuple[str, str, str]] = []

    def note(self, source: str, target: str, what: str) -> None:
        self.steps.append((source, target, what))

    def mermaid(self) -> str:
        clean = lambda s: s.replace("\n", " ").replace(";", ",")
        return "\n".join(["sequenceDiagram"] + [f"    {clean(a)}->>{clean(b)}: {clean(w)}" for a, b, w in self.steps])


@dataclass
class Store:
    """Everything under one root path.

    Tenancy: "single"; "schema_per_tenant", each tenant a log of its own under a
    folder of its namespace; "conjoined", one log with a tenant column that every
    read filters by."""

    spark: SparkSession
    root: str
    mode: str = ctx.SINGLE
    resolver: Callable[[], str | None] | None = None
    defaults: ctx.Context = field(default_factory=ctx.Context)
    archive_redirect: bool = False
    promoted: tuple[Promoted, ...] = ()
    search: str | None = None
    auto_merge: bool = True

    def __post_init__(self) -> None:
        configure(self.spark)
        if self.search is not None:
            fulltext.known_config(self.search)
        #: The tables of this store: documents carry the columns kept for them at write.
        self.tables = TABLES | {"docs": T.StructType([*DOCS.fields, *self._kept_fields()])}
        self.metrics, self.crumbs = Metrics(), Breadcrumbs()
        self._logs: dict[str, CommitLog] = {}
        self.inline_handlers: list = []
        self.schemas: dict[str, tuple[int, dict]] = {}

    def tenant(self, given: str | None = None) -> str | None:
        found = given or self.defaults.tenant or (self.resolver() if self.resolver else None)
        return ctx.required_tenant(self.mode, found)

    def log(self, tenant: str | None = None) -> CommitLog:
        name = ctx.tenant_schema(self.tenant(tenant)) if self.mode == ctx.SCHEMA_PER_TENANT else "main"
        if name not in self._logs:
            if self.mode == ctx.SCHEMA_PER_TENANT and not self.tenant_exists(tenant):
                raise TenantNotFound(f"no namespace {name}; call ensure_tenant() first")
            self._logs[name] = CommitLog(self.spark, f"{self.root}/{name}", self.tables)
        return self._logs[name]

    def scan(self, table: str, tenant: str | None = None, wanted: Callable[[Facts], bool] | None = None, state: State | None = None) -> DataFrame:
        """The only way to a table: applies the tenant's namespace or filter; folders
        that hold nothing wanted are not opened."""
        frame = self.log(tenant).read(table, state, wanted)
        own = self.row_tenant(tenant)
        return frame.where(frame.tenant_id == own) if own is not None else frame

    def row_tenant(self, tenant: str | None = None) -> str | None:
        """What the tenant column of this tenant's rows holds."""
        return self.tenant(tenant) if self.mode == ctx.CONJOINED else None

    def commit(self, make: Callable, tenant: str | None = None) -> State:
        state = self.log(tenant).commit(make)
        if self.auto_merge:
            self.merge(tenant, state)
        return state

    def merge(self, tenant: str | None = None, state: State | None = None) -> int:
        """Merges small folders of tables that have FAN of a kind; the number of merges."""
        log, done = self.log(tenant), 0
        state = state or log.state()
        for table, folders in state.tables.items():
            if len(folders) < FAN or table not in ORDER:
                continue
            by, looked_up = ORDER[table]

            def make(frame: DataFrame, found: list[Facts], by: str = by, looked_up: str = looked_up) -> Part:
                facts = merged_facts(found)
                n = facts.get("n") or frame.count()
                arranged = frame.repartitionByRange(-(-n // FILE_ROWS) or 1, by).sortWithinPartitions(by)
                return Part(arranged, facts | {"n": n}, {f"parquet.bloom.filter.enabled#{looked_up}": "true"})

            done += log.merge(table, make)
        if done:
            self.metrics.add("folder_merges", done, self.row_tenant(tenant))
        return done

    def frame(self, rows: list[tuple], table: str) -> DataFrame:
        """Rows of JSON text for variant columns, as a frame of the table's schema."""
        from pyspark.sql import functions as F

        schema = TABLES[table]
        text = T.StructType([T.StructField(f.name, _S if f.dataType == _V else f.dataType) for f in schema])
        found = self.spark.createDataFrame(rows, text)
        found = found.select(*[F.parse_json(f.name).alias(f.name) if f.dataType == _V else f.name for f in schema])
        return self.with_kept(found) if table == "docs" else found

    def part(self, rows: list[tuple], table: str, key: str) -> Part:
        """Rows with facts: how many, and the keys they have in the column `key`."""
        names = TABLES[table].names
        tenant, at = names.index("tenant_id"), names.index(key)
        keys = {key_of(r[tenant], r[at]): 0 for r in rows}
        facts: Facts = {"n": len(rows)} | ({"keys": keys} if len(keys) <= MAX_KEYS else {})
        return Part(self.frame(rows, table), facts | (self.kept_facts() if table == "docs" else {}))

    # --- columns kept for documents -------------------------------------------
    def _kept_fields(self) -> list[T.StructField]:
        fields = [T.StructField(p.column, p.data_type()) for p in self.promoted]
        return fields + ([T.StructField("docs_search", T.ArrayType(_S))] if self.search else [])

    def kept_facts(self) -> Facts:
        names = [f"{p.path}>{p.column}:{p.kind}:{p.transform}" for p in self.promoted] + ([f"search:{self.search}:lower-cased words"] if self.search else [])  # a change of lexemes needs a backfill
        return {"columns": names} if names else {}

    def with_kept(self, docs: DataFrame) -> DataFrame:
        """Documents with their promoted columns and lexemes."""
        from pyspark.sql import functions as F

        docs = promote(docs, list(self.promoted))
        if self.search:
            docs = docs.withColumn("docs_search", fulltext.lexemes(fulltext.searchable(F.col("doc")), self.search))
        return docs

    def backfill(self, tenant: str | None = None) -> int:
        """Rewrites the folders of documents that were written with other kept columns;
        the number of folders."""
        wanted, seen = self.kept_facts().get("columns", []), {}

        def change(state: State) -> Change | None:
            old = [f for f in state.tables.get("docs", []) if state.facts.get(f, {}).get("columns", []) != wanted]
            seen["n"] = len(old)
            if not old:
                return None
            log, found = self.log(tenant), [state.facts.get(f, {}) for f in old]
            frame = log.read_folders("docs", old).select(*DOCS.names)
            return Change(swap={"docs": (old, [Part(self.with_kept(frame), merged_facts(found) | {"level": max(f.get("level", 0) for f in found), "columns": wanted})])})

        self.commit(change, tenant)
        return seen["n"]

    def set_archive_redirect(self, on: bool, tenant: str | None = None) -> None:
        """Whether events of archived streams are accepted and go cold; kept in the log."""
        self.commit(lambda s: Change(set={"archive_redirect": on}), tenant)

    def publish(self, prefix: str = "", tenant: str | None = None) -> list[str]:
        """Temporary views of the store's tables as they are now, for SQL: versions as docs,
        the present documents as docs_current, and the others under their names."""
        made = []
        for table in self.tables:
            self.scan(table, tenant).createOrReplaceTempView(f"{prefix}{table}")
            made.append(f"{prefix}{table}")
        docs = self.documents() if tenant is None else self.documents().for_tenant(tenant)
        docs.current().createOrReplaceTempView(f"{prefix}docs_current")
        return [*made, f"{prefix}docs_current"]

    # --- tenants ---------------------------------------------------------------
    def _tenants(self) -> CommitLog:
        return CommitLog(self.spark, f"{self.root}/_tenants", {})

    def tenant_exists(self, tenant: str | None) -> bool:
        return tenant is not None and f"tenant:{tenant}" in self._tenants().state().values

    def ensure_tenant(self, tenant: str) -> str:
        """Registers a tenant's namespace; any number of callers may race."""
        name = ctx.tenant_schema(tenant)
        self._tenants().commit(lambda s: None if f"tenant:{tenant}" in s.values else Change(set={f"tenant:{tenant}": name}))
        return name

    def drop_tenant(self, tenant: str, data: bool = True) -> None:
        """Forgets a tenant and, unless told otherwise, removes its folder."""
        name = ctx.tenant_schema(tenant)
        self._tenants().commit(lambda s: Change(set={f"tenant:{tenant}": None}))
        self._logs.pop(name, None)
        if data and self.mode == ctx.SCHEMA_PER_TENANT:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def list_tenants(self) -> list[str]:
        return sorted(k.removeprefix("tenant:") for k in self._tenants().state().values)

    # --- aliases, schemas, health ------------------------------------------------
    def resolve_stream_alias(self, alias: str, tenant: str | None = None) -> str:
        """The stream of an alias; a new one is made on first use."""
        key = f"alias:{self.row_tenant(tenant) or ''}:{alias}"
        state = self.commit(lambda s: None if key in s.values else Change(set={key: str(uuid.uuid4())}), tenant)
        return state.values[key]

    def register_schema(self, event_type: str, version: int, schema: dict, tenant: str | None = None) -> None:
        key = f"schema:{event_type}"

        def put(state):
            kept = state.values.get(key, {})
            return Change(set={key: kept | {str(version): schema}})

        self.commit(put, tenant)

    def observe(self, tenant: str | None = None) -> Metrics:
        """Gauges of the log, of projections and subscriptions, from its state alone."""
        state, own = self.log(tenant).state(), self.row_tenant(tenant)
        head = state.values.get("global_seq", 0)
        self.metrics.set("log_version", state.version, own)
        self.metrics.set("events_head", head, own)
        context = self.spark.sparkContext
        memory = context._jvm.java.lang.Runtime.getRuntime()
        self.metrics.set("driver_memory_used_bytes", memory.totalMemory() - memory.freeMemory())
        self.metrics.set("executors", context._jsc.sc().getExecutorMemoryStatus().size())
        self.metrics.set("active_jobs", len(context.statusTracker().getActiveJobsIds()))
        for table, folders in state.tables.items():
            self.metrics.set(f"{table}_folders", len(folders), own)
        for kind, name in (("checkpoint:", "projection"), ("sub_last:", "subscription")):
            for key, value in state.values.items():
                if key.startswith(kind):
                    who = "".join(c if c.isalnum() else "_" for c in key.split(":", 2)[2])
                    self.metrics.set(f"{name}_lag_{who}", max(head - value, 0), own)
        return self.metrics

    def healthy(self) -> bool:
        return self.spark.range(1).count() == 1

    def documents(self):
        from .operators.documents import Documents

        return Documents(self)

    def events(self):
        from .operators.events import Events

        return Events(self)

    def session(self, context: ctx.Context | None = None):
        from .operators.documents import DocumentSession

        return DocumentSession(self, self.defaults.merged(context))

    def session_builder(self) -> SessionBuilder:
        return SessionBuilder(self)


class StoreBuilder:
    """The options of a store, written as a chain."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._root, self._options = spark, root, {}

    def _with(self, **options: Any) -> StoreBuilder:
        self._options |= options
        return self

    def tenancy(self, mode: str, resolver: Callable[[], str | None] | None = None) -> StoreBuilder:
        return self._with(mode=mode, resolver=resolver)

    def defaults(self, context: ctx.Context) -> StoreBuilder:
        return self._with(defaults=context)

    def promote(self, *fields: Promoted) -> StoreBuilder:
        return self._with(promoted=(*self._options.get("promoted", ()), *fields))

    def search(self, config: str) -> StoreBuilder:
        return self._with(search=config)

    def archive_redirect(self, on: bool = True) -> StoreBuilder:
        return self._with(archive_redirect=on)

    def build(self) -> Store:
        return Store(self._spark, self._root, **self._options)


class SessionBuilder:
    """The context of a session, written as a chain; build() refuses a missing tenant."""

    def __init__(self, store: Store):
        self._store, self._context = store, ctx.Context()

    def _with(self, **values: Any) -> SessionBuilder:
        self._context = self._context.merged(ctx.Context(**values))
        return self

    def tenant(self, name: str) -> SessionBuilder:
        return self._with(tenant=name)

    def user(self, id_: str) -> SessionBuilder:
        return self._with(user_id=id_)

    def headers(self, **headers: Any) -> SessionBuilder:
        return self._with(headers=headers)

    def causation(self, id_: str) -> SessionBuilder:
        return self._with(causation_id=id_)

    def correlation(self, id_: str) -> SessionBuilder:
        return self._with(correlation_id=id_)

    def with_archived(self) -> SessionBuilder:
        return self._with(include_archived=True)

    def build(self):
        self._store.tenant(self._context.tenant)
        return self._store.session(self._context)

"""The event log: appends, reads, archive.

global_seq is given at commit, so it is dense and no reader can miss a late
number; stream_seq follows the head of the stream over hot and cold events.

A folder of events is of one retention class and its facts name its sequence numbers
and streams, so the head of the log is a control value, the head of a stream and the
next batch come from the few folders that can hold them, and hot reads open no cold
folder.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..context import Context
from ..errors import IdempotencyConflict, SchemaViolation, StreamArchived, StreamVersionConflict
from ..functions.json_schema import violations
from ..plans import event_ops as ev
from ..sources.commitlog import Change, Facts, Part, State
from ..store import MAX_KEYS, Store, key_of, may_hold, merged_facts, now
from .upcasting import UpcasterRegistry

ANY, NO_STREAM = None, 0
#: Counters of refused appends.
_REFUSED = {StreamVersionConflict: "append_conflicts", IdempotencyConflict: "idempotency_conflicts", SchemaViolation: "schema_violations", StreamArchived: "archived_writes_refused"}
TOMBSTONE = "$tombstone"
IDEMPOTENCY = "idempotency_key"
#: Events on the driver at once, about, however large a batch is.
SLICE = 10_000


@dataclass(frozen=True)
class Event:
    typ: str
    body: Any
    version: int = 1


@dataclass
class Envelope:
    """An event as handlers see it."""

    global_seq: int
    stream_id: str
    stream_seq: int
    typ: str
    body: Any
    headers: dict
    causation_id: str | None
    correlation_id: str | None
    event_version: int
    tenant_id: str | None
    user_id: str | None
    created_at: datetime


def _plain(events: DataFrame) -> DataFrame:
    return events.select("global_seq", "stream_id", "stream_seq", "event_type", F.to_json("body").alias("b"), F.to_json("headers").alias("h"), "causation_id", "correlation_id", "event_version", "tenant_id", "user_id", "created_at")


def _envelope(r: Row) -> Envelope:
    seq, stream, at, typ, body, headers, *rest = r
    return Envelope(seq, stream, at, typ, json.loads(body) if body else None, json.loads(headers) if headers else {}, *rest)


def envelopes(events: DataFrame) -> list[Envelope]:
    """A bounded frame of events as envelopes, in the frame's order."""
    return [_envelope(r) for r in _plain(events).collect()]


def _aware(at: datetime) -> datetime:
    return at if at.tzinfo else at.astimezone(timezone.utc)


def _utc(at: datetime) -> str:
    """Spark gives times without a zone, in that of this machine."""
    return _aware(at).astimezone(timezone.utc).isoformat()


@dataclass
class Events:
    store: Store
    tenant: str | None = None
    archived: bool = False
    upcasters: UpcasterRegistry = field(default_factory=UpcasterRegistry)

    def for_tenant(self, tenant: str) -> Events:
        return replace(self, tenant=tenant)

    def with_archived(self) -> Events:
        return replace(self, archived=True)

    def hot_only(self) -> Events:
        return replace(self, archived=False)

    def with_upcasters(self, registry: UpcasterRegistry) -> Events:
        return replace(self, upcasters=registry)

    # --- reads -------------------------------------------------------------------
    def _own(self, facts: Facts) -> bool:
        """Folders with events of the classes that are read."""
        return self.archived or facts.get("class") != ev.COLD

    def frame(self, wanted: Callable[[Facts], bool] = lambda facts: True, state: State | None = None) -> DataFrame:
        return ev.visible(self.store.scan("events", self.tenant, lambda f: self._own(f) and wanted(f), state), self.archived)

    def _pairs(self, wanted: Callable[[Facts], bool], state: State) -> list | None:
        """The types and versions in folders, or None if one does not name its own."""
        log = self.store.log(self.tenant)
        found = [state.facts.get(f, {}).get("types") for f in log.folders("events", state, lambda f: self._own(f) and wanted(f))]
        return None if None in found else [tuple(t) for types in found for t in types]

    def window(self, last: int, limit: int | None, state: State) -> int | None:
        """A sequence number up to which there are `limit` events after `last`, as far as
        the folders' facts tell; None: there may be fewer, or all are wanted."""
        if limit is None or self.store.row_tenant(self.tenant) is not None:
            return None
        log = self.store.log(self.tenant)
        found = [state.facts.get(f, {}) for f in log.folders("events", state, self._own)]
        if any("hi" not in f or "n" not in f for f in found):
            return None
        found, n = sorted((f for f in found if f["hi"] > last), key=lambda f: f["hi"]), 0
        for f in found:
            dense = f["n"] == f["hi"] - f["lo"] + 1  # it has every number of its range
            n += f["hi"] - max(last, f["lo"] - 1) if dense else f["n"] if f["lo"] > last else 0
            if n >= limit:
                return f["hi"] - (n - limit if dense else 0)
        return None

    def after(self, last: int, limit: int | None = None, state: State | None = None) -> DataFrame:
        """Global order, upcast; only the folders of the next `limit` events are read."""
        state = state or self.store.log(self.tenant).state()
        found, wanted = self._window(last, limit, state)
        return self.upcasters.apply(ev.after(found, last, limit), pairs=self._pairs(wanted, state))

    def _window(self, last: int, limit: int | None, state: State) -> tuple[DataFrame, Callable[[Facts], bool]]:
        """Events up to window(), and which folders hold them."""
        upto = self.window(last, limit, state)

        def wanted(facts: Facts) -> bool:
            return facts.get("hi", last + 1) > last and (upto is None or facts.get("lo", upto) <= upto)

        found = self.frame(wanted, state)
        if upto is not None:
            found = found.where(F.col("global_seq") <= upto)
        return found, wanted

    def in_order(self, last: int, limit: int, state: State) -> Iterator[Envelope]:
        """The next `limit` events; of many, the driver gets ranges of about SLICE by turns."""
        if limit <= SLICE:
            yield from envelopes(self.after(last, limit, state).orderBy("global_seq"))
            return
        found, wanted = self._window(last, limit, state)
        found = found.where(F.col("global_seq") > last)
        parts = -(-found.count() // SLICE) or 1
        rows = _plain(self.upcasters.apply(found, pairs=self._pairs(wanted, state))).repartitionByRange(parts, "global_seq").sortWithinPartitions("global_seq")
        yield from islice(map(_envelope, rows.toLocalIterator()), limit)

    def fetch_after(self, last: int, limit: int) -> list[Envelope]:
        return envelopes(self.after(last, limit).orderBy("global_seq"))

    def stream(self, stream_id: str, after: int | None = None, limit: int | None = None, ascending: bool = True) -> DataFrame:
        key = key_of(self.store.row_tenant(self.tenant), stream_id)
        return ev.stream(self.frame(may_hold(key)), str(stream_id), after, limit, ascending)

    def read_stream(self, stream_id: str) -> list[tuple[int, Event]]:
        """(stream_seq, event), as stored: not upcast."""
        return [(e.stream_seq, Event(e.typ, e.body, e.event_version)) for e in envelopes(self.stream(stream_id))]

    def read_stream_envelopes(self, stream_id: str) -> list[Envelope]:
        """Upcast."""
        return envelopes(self.upcasters.apply(self.stream(stream_id)).orderBy("stream_seq"))

    def head_sequence(self) -> int:
        """The last sequence number that is visible; of folders that name theirs, only
        the facts are read."""
        state = self.store.log(self.tenant).state()
        found = [state.facts.get(f, {}) for f in self.store.log(self.tenant).folders("events", state, self._own)]
        if self.store.row_tenant(self.tenant) is None and all("hi" in f and ("class" in f or self.archived) for f in found):
            return max((f["hi"] for f in found), default=0)
        return ev.head_sequence(self.frame(state=state)).first()[0]

    def stream_head(self, state: State, stream: str) -> int:
        """The last stream_seq over hot and cold events; 0 for a new stream.  A job runs
        only for folders that are too large to name their streams."""
        own, log = self.store.row_tenant(self.tenant), self.store.log(self.tenant)
        key = key_of(own, stream)
        facts = [state.facts.get(f, {}) for f in state.tables.get("events", [])]
        head = max((f["keys"][key] for f in facts if key in f.get("keys", ())), default=0)
        if any("keys" not in f for f in facts):
            known = log.read("events", state, lambda f: "keys" not in f).where(F.col("stream_id") == stream)
            if own is not None:
                known = known.where(F.col("tenant_id") == own)
            head = max(head, known.agg(F.coalesce(F.max("stream_seq"), F.lit(0))).first()[0])
        return head

    # --- appends -----------------------------------------------------------------
    def append(self, stream_id: str, events: list[Event], expected: int | None = ANY, context: Context | None = None, idempotency_key: str | None = None) -> int:
        """Appends and returns the new head of the stream.  expected: ANY,
        NO_STREAM or the present head."""
        about = self.store.defaults.merged(context)
        if idempotency_key is not None:
            about = replace(about, headers=about.headers | {IDEMPOTENCY: idempotency_key})
        if self.tenant:
            about = replace(about, tenant=self.tenant)
        seen = {}

        def change(state: State) -> Change:
            out = Change()
            seen["head"] = self.stage(state, [(str(stream_id), events, expected, about)], out)
            return out

        began = time.monotonic()
        try:
            self.store.commit(change, about.tenant)
        except (StreamVersionConflict, IdempotencyConflict, SchemaViolation, StreamArchived) as e:
            self.store.metrics.add(_REFUSED[type(e)], 1, self.tenant)
            raise
        self.store.metrics.add("events_appended", len(events), self.tenant)
        self.store.metrics.add("appends", 1, self.tenant)
        self.store.metrics.add("append_seconds", time.monotonic() - began, self.tenant)
        return seen["head"]

    def builder(self, stream_id: str) -> AppendBuilder:
        return AppendBuilder(self, str(stream_id))

    def stage(self, state: State, calls: list[tuple], out: Change, raw: dict | None = None) -> int:
        """Checks the calls (stream, events, expected, context) against a state and
        adds their rows to a change; returns the head of the last stream."""
        at, rows, keys, streams = now(), [], [], []
        tenant = calls[-1][3].tenant
        own, log = self.store.row_tenant(tenant), self.store.log(tenant)
        seq, heads = state.values.get("global_seq", 0), {}
        reader = self if self.tenant == tenant else replace(self, tenant=tenant)
        for stream, events, expected, about in calls:
            cold = self._guard(state, stream, own)
            if stream not in heads:
                heads[stream] = reader.stream_head(state, stream)
            if expected is not None and heads[stream] != expected:
                raise StreamVersionConflict(f"{stream}: expected {expected}, the head is {heads[stream]}")
            if heads[stream] == 0 and not any(s[1] == stream for s in streams):
                streams.append((own, stream, None, None, None, ev.HOT, state.version + 1))
            key = about.headers.get(IDEMPOTENCY)
            if key is not None:
                name, wide = key_of(own, key), [f for f in log.folders("idempotency", state) if "keys" not in state.facts.get(f, {})]
                kept = any(name in state.facts.get(f, {}).get("keys", ()) for f in log.folders("idempotency", state))
                if not kept and wide:
                    kept = bool(log.read_folders("idempotency", wide).where((F.col("key") == str(key)) & F.col("tenant_id").eqNullSafe(F.lit(own))).take(1))
                if (own, str(key)) in keys or kept:
                    raise IdempotencyConflict(str(key))
                keys.append((own, str(key)))
            for e in events:
                schemas = state.values.get(f"schema:{e.typ}")
                if schemas and (wrong := violations(e.body, schemas[str(max(map(int, schemas)))])):
                    raise SchemaViolation(f"{e.typ}: {'; '.join(wrong)}")
                seq, heads[stream] = seq + 1, heads[stream] + 1
                rows.append((seq, stream, heads[stream], e.typ, json.dumps(e.body), json.dumps(about.headers), about.causation_id, about.correlation_id, e.version, own, about.user_id, e.typ == TOMBSTONE, at, ev.COLD if cold else ev.HOT))
        if rows:
            out.add["events"] = [self._part(found) for c in (ev.HOT, ev.COLD) if (found := [r for r in rows if r[13] == c])]
            out.set["global_seq"] = seq
            for handler in self.store.inline_handlers:  # a handler that raises stops the commit
                handler([Envelope(r[0], r[1], r[2], r[3], json.loads(r[4]), json.loads(r[5]), r[6], r[7], r[8], r[9], r[10], r[12]) for r in rows], out)
        if keys:
            out.add["idempotency"] = self.store.part(keys, "idempotency", "key")
        if streams:
            out.add["streams"] = self.store.part(streams, "streams", "stream_id")
            out.add["streams"].facts["archived"] = []
        return heads[calls[-1][0]]

    def _part(self, rows: list[tuple]) -> Part:
        """New events of one retention class, with their facts."""
        keys: dict[str, int] = {}
        for r in rows:
            keys[key_of(r[9], r[1])] = max(r[2], keys.get(key_of(r[9], r[1]), 0))
        times = [r[12].isoformat() for r in rows]
        facts: Facts = {"n": len(rows), "lo": rows[0][0], "hi": rows[-1][0], "class": rows[0][13], "t_lo": min(times), "t_hi": max(times), "types": sorted({(r[3], r[8]) for r in rows})}
        return Part(self.store.frame(rows, "events"), facts | ({"keys": keys} if len(keys) <= MAX_KEYS else {}))

    def append_frame(self, events: DataFrame) -> int:
        """Appends many events at once; returns how many.  events: stream_id, event_type,
        body (variant), order (a column they are numbered by; ties by stream) and, if it
        is to be kept, created_at.  Expected heads, keys and schemas are not checked and
        archived streams are not refused: this is for imports."""
        own, log = self.store.row_tenant(self.tenant), self.store.log(self.tenant)
        spark, aside = self.store.spark, f"_import/{uuid.uuid4().hex}"
        scratch = f"{log.root}/{aside}"
        at = F.col("created_at") if "created_at" in events.columns else F.current_timestamp()
        sorted_ = events.select("stream_id", "event_type", "body", at.alias("created_at"), "order").repartitionByRange("order", "stream_id").sortWithinPartitions("order", "stream_id")
        sorted_.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}).write.parquet(scratch)
        rows = spark.read.parquet(scratch)
        counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"), F.min("created_at").alias("a"), F.max("created_at").alias("b")).orderBy("part").collect()  # a row for each partition
        types = sorted((r[0], 1) for r in rows.select("event_type").distinct().collect())  # a few
        n, found = 0, []
        for r in counts:
            found.append((r.part, n - r["first"] + 1))
            n += r.n
        bases = spark.createDataFrame(found, "part int, base long")
        placed = rows.join(F.broadcast(bases), "part").withColumn("place", F.col("row") + F.col("base"))
        placed = placed.withColumn("at", F.row_number().over(Window.partitionBy("stream_id").orderBy("place")))

        def change(state: State) -> Change | None:
            if not n:
                return None
            last = state.values.get("global_seq", 0)
            heads = ev.stream_heads(log.read("events", state).where(F.col("tenant_id").eqNullSafe(F.lit(own))))
            made = placed.join(heads, "stream_id", "left").withColumns({c: F.lit(None).cast("string") for c in ("causation_id", "correlation_id", "user_id")})
            made = made.withColumns({"global_seq": F.col("place") + last, "stream_seq": (F.coalesce("head", F.lit(0)) + F.col("at")).cast("int"), "headers": F.parse_json(F.lit("{}")), "event_version": F.lit(1), "tenant_id": F.lit(own).cast("string"), "is_tombstone": F.col("event_type") == TOMBSTONE, "retention_class": F.lit(ev.HOT)})
            facts: Facts = {"n": n, "lo": last + 1, "hi": last + n, "class": ev.HOT, "t_lo": _utc(min(r.a for r in counts)), "t_hi": _utc(max(r.b for r in counts)), "types": types, "level": 1}
            part = Part(made.repartitionByRange("global_seq").sortWithinPartitions("global_seq"), facts, {"parquet.bloom.filter.enabled#stream_id": "true"})
            known = log.read("streams", state).where(F.col("tenant_id").eqNullSafe(F.lit(own))).select("stream_id")
            new = made.select("stream_id").distinct().join(known, "stream_id", "left_anti")
            names = {c: F.lit(None).cast(t) for c, t in (("tenant_id", "string"), ("archived_at", "timestamp"), ("archived_by", "string"), ("archive_reason", "string"))}
            new = new.withColumns(names | {"tenant_id": F.lit(own).cast("string"), "retention_class": F.lit(ev.HOT), "rev": F.lit(state.version + 1).cast("long")})
            return Change(add={"events": part, "streams": Part(new, {"archived": [], "level": 1})}, set={"global_seq": last + n})

        try:
            self.store.commit(change, self.tenant)
            self.store.metrics.add("events_imported", n, self.tenant)
        finally:
            log.files.delete(aside)
        return n

    def append_tombstone(self, stream_id: str, reason: str) -> int:
        return self.append(stream_id, [Event(TOMBSTONE, {"reason": reason})])

    # --- streams and archive --------------------------------------------------------
    def _streams(self, state: State | None = None) -> DataFrame:
        frame = self.store.log(self.tenant).read("streams", state)
        return ev.latest(frame, ["tenant_id", "stream_id"], "rev")

    def stream_state(self, stream_id: str, state: State | None = None):
        own, log = self.store.row_tenant(self.tenant), self.store.log(self.tenant)
        folders = log.folders("streams", state, may_hold(key_of(own, stream_id)))
        if not folders:
            return None
        rows = log.read_folders("streams", folders).where((F.col("stream_id") == str(stream_id)) & F.col("tenant_id").eqNullSafe(F.lit(own)))
        return rows.orderBy(F.desc("rev")).first()

    def is_archived(self, stream_id: str) -> bool:
        row = self.stream_state(stream_id)
        return row is not None and (row.archived_at is not None or (row.retention_class or "").lower() == ev.COLD)

    def _guard(self, state: State, stream: str, own: str | None) -> bool:
        """Refuses writes to archived streams; with the redirect on they go cold."""
        facts = [state.facts.get(f, {}) for f in state.tables.get("streams", [])]
        if all("archived" in f and key_of(own, stream) not in f["archived"] for f in facts):
            return False  # it never was
        row = self.stream_state(stream, state)
        if row is None or row.archived_at is None and (row.retention_class or "").lower() != ev.COLD:
            return False
        if state.values.get("archive_redirect", self.store.archive_redirect):
            return True
        raise StreamArchived(stream)

    def _mark(self, stream_id: str, by: str | None, reason: str | None, cold: bool) -> None:
        own = self.store.row_tenant(self.tenant)

        def change(state: State) -> Change:
            row = (own, str(stream_id), now() if cold else None, by, reason, ev.COLD if cold else ev.HOT, state.version + 1)
            part = self.store.part([row], "streams", "stream_id")
            part.facts["archived"] = [key_of(own, stream_id)] if cold else []
            return Change(add={"streams": part})

        self.store.commit(change, self.tenant)

    def archive_stream(self, stream_id: str, by: str | None = None, reason: str | None = None) -> None:
        self._mark(stream_id, by, reason, True)

    def reactivate_stream(self, stream_id: str) -> None:
        self._mark(stream_id, None, None, False)

    def archive_before(self, before: datetime, stream_id: str | None = None, dry_run: bool = False) -> int:
        """Moves events older than `before` to the cold class; returns their number.
        All columns are kept, and only folders with such events are written anew."""
        own, seen = self.store.row_tenant(self.tenant), {}
        old = (F.col("retention_class") == ev.HOT) & (F.col("created_at") < F.lit(before))
        if stream_id is not None:
            old = old & (F.col("stream_id") == str(stream_id))
        if own is not None:
            old = old & (F.col("tenant_id") == own)
        old = F.coalesce(old, F.lit(False))
        holds = may_hold(key_of(own, stream_id)) if stream_id is not None else lambda facts: True

        def touched(facts: Facts) -> bool:
            return facts.get("class") != ev.COLD and holds(facts) and ("t_lo" not in facts or datetime.fromisoformat(facts["t_lo"]) < _aware(before))

        def change(state: State) -> Change | None:
            log = self.store.log(self.tenant)
            folders = log.folders("events", state, touched)
            frame = log.read_folders("events", folders)
            sums = {bool(r[0]): r for r in frame.groupBy(old.alias("old")).agg(F.count(F.lit(1)), F.min("global_seq"), F.max("global_seq"), F.min("created_at"), F.max("created_at")).collect()}
            seen["n"] = sums[True][1] if True in sums else 0
            if dry_run or not seen["n"]:
                return None
            about = merged_facts([state.facts.get(f, {}) for f in folders])
            level = max(state.facts.get(f, {}).get("level", 0) for f in folders)
            parts = []
            for moved, r in sums.items():
                kind = ev.COLD if moved else ev.HOT if "class" in about else None
                facts = about | {"n": r[1], "lo": r[2], "hi": r[3], "t_lo": _utc(r[4]), "t_hi": _utc(r[5]), "level": level} | ({"class": kind} if kind else {})
                rows = frame.where(old if moved else ~old)
                parts.append(Part(rows.withColumn("retention_class", F.lit(ev.COLD)) if moved else rows, facts))
            return Change(swap={"events": (folders, parts)})

        self.store.commit(change, self.tenant)
        if not dry_run:
            self.store.metrics.add("events_archived", seen["n"], self.tenant)
        return seen["n"]

    def archive_in_batches(self, before: datetime, streams: int = 100, max_batches: int | None = None) -> int:
        """Moves old events of some streams at a time, and marks streams without hot events
        left as archived; returns the number of events.  A stopped run goes on where it was."""
        total, done = 0, 0
        while max_batches is None or done < max_batches:
            wanted = [r.stream_id for r in ev.archive_candidates(self.hot_only().frame(), F.lit(before), streams).collect()]  # `streams` rows at most
            if not wanted:
                break
            for stream in wanted:
                total += self.archive_before(before, stream)
                if not self.hot_only().stream(stream, limit=1).take(1):
                    self.archive_stream(stream, "archive", "no hot events left")
            done += 1
        return total

    def archive_status(self) -> DataFrame:
        return ev.retention_counts(self.store.scan("events", self.tenant))


class AppendBuilder:
    """Events and options of one append, written as a chain."""

    def __init__(self, events: Events, stream_id: str):
        self._events, self._stream = events, stream_id
        self._items, self._expected, self._context, self._key = [], ANY, Context(), None

    def event(self, typ: str, body: Any, version: int = 1) -> AppendBuilder:
        self._items.append(Event(typ, body, version))
        return self

    def expect(self, version: int | None) -> AppendBuilder:
        self._expected = version
        return self

    def headers(self, **headers: Any) -> AppendBuilder:
        self._context = self._context.merged(Context(headers=headers))
        return self

    def causation(self, id_: str) -> AppendBuilder:
        self._context = replace(self._context, causation_id=id_)
        return self

    def correlation(self, id_: str) -> AppendBuilder:
        self._context = replace(self._context, correlation_id=id_)
        return self

    def user(self, id_: str) -> AppendBuilder:
        self._context = replace(self._context, user_id=id_)
        return self

    def idempotency_key(self, key: str) -> AppendBuilder:
        self._key = key
        return self

    def send(self) -> int:
        return self._events.append(self._stream, self._items, self._expected, self._context, self._key)


Handler = Callable[[list[Envelope], Change], None]

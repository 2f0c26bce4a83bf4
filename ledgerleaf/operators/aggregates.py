"""Aggregates, their repository and snapshots."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationFailed
from ..plans import event_ops as ev
from ..sources.commitlog import Change
from ..store import key_of, may_hold, now
from . import folds
from .events import Envelope, Event, Events, envelopes


class Aggregate:
    """A state folded from events; subclasses write new(), apply()."""

    def __init__(self) -> None:
        self.state: Any = self.new()
        self.version = 0

    def new(self) -> Any:
        return {}

    def apply(self, state: Any, typ: str, body: Any) -> Any:
        raise NotImplementedError

    def hydrate(self, state: Any, version: int) -> None:
        self.state, self.version = state, version

    def fold(self, found: list[Envelope]) -> None:
        for e in found:
            self.state, self.version = self.apply(self.state, e.typ, e.body), e.stream_seq


class AggregateRepository:
    def __init__(self, events: Events, validator: Callable[[Any], str | None] | None = None):
        self.events, self.validator = events, validator

    def load(self, stream_id: str, kind: type[Aggregate]) -> Aggregate:
        agg = kind()
        agg.fold(self.events.read_stream_envelopes(stream_id))
        return agg

    def load_with_snapshot(self, stream_id: str, kind: type[Aggregate]) -> Aggregate:
        """From the snapshot on; only later events are read."""
        agg = kind()
        store, tenant = self.events.store, self.events.tenant
        row = store.scan("snapshots", tenant, may_hold(key_of(store.row_tenant(tenant), stream_id))).where(F.col("stream_id") == str(stream_id)).orderBy(F.desc("version")).first()
        if row is not None:
            agg.hydrate(json.loads(row.body), row.version)
        rest = self.events.stream(stream_id).where(F.col("stream_seq") > agg.version)
        agg.fold(envelopes(self.events.upcasters.apply(rest).orderBy("stream_seq")))
        return agg

    def _validate(self, state: Any) -> None:
        if self.validator is not None and (wrong := self.validator(state)):
            raise ValidationFailed(wrong)

    def commit(self, stream_id: str, expected: int | None, events: list[Event]) -> int:
        return self.events.append(stream_id, events, expected)

    def commit_for_aggregate(self, stream_id: str, agg: Aggregate, events: list[Event]) -> int:
        return self.commit(stream_id, agg.version, events)

    def commit_and_snapshot(self, stream_id: str, agg: Aggregate, events: list[Event], every: int) -> int:
        """Commits after the validator saw the present state; writes a snapshot
        when the head passes a multiple of `every`."""
        self._validate(agg.state)
        head = self.commit_for_aggregate(stream_id, agg, events)
        for e in events:
            agg.state = agg.apply(agg.state, e.typ, e.body)
        before, agg.version = agg.version, head
        if head // every > before // every:
            save_snapshots(self.events, [(str(stream_id), head, agg.state)])
        return head


def save_snapshots(events: Events, found: list[tuple[str, int, Any]]) -> None:
    own, at = events.store.row_tenant(events.tenant), now()
    rows = [(own, s, v, json.dumps(b), at) for s, v, b in found]
    events.store.metrics.add("snapshots_written", len(rows), events.tenant)
    events.store.commit(lambda state: Change(add={"snapshots": events.store.part(rows, "snapshots", "stream_id")}), events.tenant)


class Snapshotter:
    """Finds streams far ahead of their snapshot, folds and saves them, all on the
    executors; the version of a snapshot is the last stream_seq it folded."""

    def __init__(self, events: Events, kind: type[Aggregate], threshold: int = 100, batch: int = 100):
        self.events, self.kind, self.threshold, self.batch = events, kind, threshold, batch

    def _latest(self) -> DataFrame:
        return ev.latest(self.events.store.scan("snapshots", self.events.tenant), ["tenant_id", "stream_id"])

    def candidates(self) -> DataFrame:
        return ev.snapshot_candidates(ev.stream_heads(self.events.frame()), self._latest(), self.threshold, self.batch)

    def metrics(self) -> dict[str, int]:
        return ev.snapshot_gap(ev.stream_heads(self.events.frame()), self._latest(), self.threshold).first().asDict()

    def tick_once(self) -> int:
        """Streams that got a snapshot."""
        store, tenant, kind = self.events.store, self.events.tenant, self.kind
        wanted = [r.stream_id for r in self.candidates().collect()]  # `batch` rows at most
        if not wanted:
            return 0
        own = F.lit(store.row_tenant(tenant)).cast("string")
        log = self.events.upcasters.apply(self.events.frame().where(F.col("stream_id").isin(wanted)))
        snaps = self._latest().select("stream_id", "version", "body")
        rest = folds.tail(log, snaps)
        made = folds.fold_frame(rest, lambda: kind().new(), lambda s, t, b: kind().apply(s, t, b), state="snapshot")
        rows = made.select(own.alias("tenant_id"), "stream_id", "version", F.col("state").alias("body"), F.current_timestamp().alias("created_at"))
        store.commit(lambda state: Change(add={"snapshots": rows}), tenant)
        return len(wanted)

    def run_until_idle(self) -> int:
        total = 0
        while n := self.tick_once():
            total += n
        return total

"""Subscriptions: filtered push of events in global order, with acknowledgement,
consumer groups, pause and backpressure."""

from __future__ import annotations

import queue
import threading
import time
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import functions as F

from ..errors import LeaseMismatch
from ..operators.events import Envelope, Events, envelopes
from ..plans import event_ops as ev
from ..plans.event_ops import SubscriptionFilter
from ..sources.commitlog import Change, State

AUTO, MANUAL = "auto", "manual"


@dataclass
class Options:
    start_from: int = 0
    batch: int = 500
    max_in_flight: int = 1024
    channel: int = 1024
    poll_s: float = 0.25
    ack: str = AUTO
    group: str | None = None
    lease_s: float = 30.0


@dataclass
class Subscription:
    """The consumer's end; iterate, or call receive()."""

    subscriptions: Subscriptions
    name: str
    options: Options
    channel: queue.Queue = field(default_factory=queue.Queue)
    stopped: threading.Event = field(default_factory=threading.Event)
    owner: str = field(default_factory=lambda: uuid.uuid4().hex)

    def receive(self, timeout: float | None = None) -> Envelope | None:
        try:
            return self.channel.get(timeout=timeout)
        except queue.Empty:
            return None

    def ack(self, event: Envelope) -> None:
        """LeaseMismatch if another worker has taken this group over."""
        owner = self.owner if self.options.group is not None else None
        self.subscriptions.checkpoint(self.name, event.global_seq, self.options.group, owner=owner)

    def stop(self) -> None:
        self.stopped.set()


class Subscriptions:
    def __init__(self, events: Events):
        self.events = events

    def _log(self):
        return self.events.store.log(self.events.tenant)

    def _key(self, kind: str, name: str, group: str | None = None) -> str:
        return f"sub_{kind}:{self.events.store.row_tenant(self.events.tenant) or ''}:{name}" + (f":{group}" if group else "")

    def _put(self, values: dict[str, Any]) -> None:
        self._log().commit(lambda s: Change(set=values))

    # --- records -----------------------------------------------------------------
    def checkpoint(self, name: str, seq: int, group: str | None = None, change: Change | None = None, state: State | None = None, owner: str | None = None) -> None:
        """Never moves back.  With a change, the checkpoint joins that commit; state is the
        one the change is made on.  With an owner, only the one that holds the group's
        lease may move it."""
        key = self._key("last", name, group)
        if change is not None:
            change.set[key] = max(seq, self.last(name, group, state))
            return

        def move(s: State) -> Change | None:
            if owner is not None and s.values.get(self._key("lease", name, group), {}).get("owner") != owner:
                raise LeaseMismatch(f"{name}:{group}")
            return Change(set={key: seq}) if s.values.get(key, 0) < seq else None

        self._log().commit(move)

    def last(self, name: str, group: str | None = None, state: State | None = None) -> int:
        return (state or self._log().state()).values.get(self._key("last", name, group), 0)

    def pause(self, name: str) -> None:
        self._put({self._key("paused", name): True})

    def resume(self, name: str) -> None:
        self._put({self._key("paused", name): None})

    def set_group_max_in_flight(self, name: str, group: str, most: int | None) -> None:
        self._put({self._key("in_flight", name, group): most})

    def group_lag(self, name: str, group: str) -> int:
        return max(self.events.with_archived().head_sequence() - self.last(name, group), 0)

    def names(self) -> list[str]:
        """All subscriptions that any record knows."""
        own = self.events.store.row_tenant(self.events.tenant) or ""
        prefix = [f"sub_{k}:{own}:" for k in ("filter", "last", "paused")]
        found = {k.removeprefix(p).split(":")[0] for k in self._log().state().values for p in prefix if k.startswith(p)}
        return sorted(found)

    def groups(self, name: str) -> list[str]:
        prefix = [f"{self._key(k, name)}:" for k in ("last", "lease", "in_flight")]
        return sorted({k.removeprefix(p) for k in self._log().state().values for p in prefix if k.startswith(p)})

    def reset(self, name: str, to: int = 0, group: str | None = None) -> None:
        self._put({self._key("last", name, group): to})

    def status(self, name: str, group: str | None = None) -> dict[str, Any]:
        values, last = self._log().state().values, self.last(name, group)
        held = values.get(self._key("lease", name, group))
        head = self.events.with_archived().head_sequence()
        return {"name": name, "group": group, "last_seq": last, "head": head, "lag": max(head - last, 0), "paused": bool(values.get(self._key("paused", name))), "filter": values.get(self._key("filter", name)), "max_in_flight": values.get(self._key("in_flight", name, group)) if group else None, "leased_by": held["owner"] if held and held["until"] > time.time() else None}

    def _lease(self, sub: Subscription) -> bool:
        key, seen = self._key("lease", sub.name, sub.options.group), {}

        def change(state: State) -> Change | None:
            held = state.values.get(key)
            seen["ok"] = not held or held["owner"] == sub.owner or held["until"] <= time.time()
            if not seen["ok"] or held and held["owner"] == sub.owner and held["until"] > time.time() + sub.options.lease_s / 2:
                return None
            return Change(set={key: {"owner": sub.owner, "until": time.time() + sub.options.lease_s}})

        self._log().commit(change)
        return seen["ok"]

    # --- running -----------------------------------------------------------------
    def subscribe(self, name: str, wanted: SubscriptionFilter | None = None, options: Options | None = None) -> Subscription:
        """Starts a thread that pushes into a bounded channel."""
        options, wanted = options or Options(), wanted or SubscriptionFilter()
        self._put({self._key("filter", name): {"event_types": wanted.event_types, "stream_ids": wanted.stream_ids, "stream_prefix": wanted.stream_prefix}})
        sub = Subscription(self, name, options, queue.Queue(maxsize=options.channel))
        threading.Thread(target=self._run, args=(sub, wanted), daemon=True).start()
        return sub

    def poll(self, name: str, wanted: SubscriptionFilter, cursor: int, batch: int, most: int) -> list[Envelope]:
        """One batch; events are not upcast here."""
        state = self._log().state()
        head, want, found = state.values.get("global_seq", 0), min(batch, most), []
        size = want
        while cursor < head and len(found) < want:  # a window of the log at a time, each wider
            upto = self.events.window(cursor, size, state)

            def holds(facts: dict, cursor: int = cursor, upto: int | None = upto) -> bool:
                return facts.get("hi", cursor + 1) > cursor and (upto is None or facts.get("lo", upto) <= upto)

            frame = self.events.frame(holds, state)
            frame = frame if upto is None else frame.where(F.col("global_seq") <= upto)
            found += envelopes(ev.subscription_batch(frame, wanted, cursor, want - len(found), most).orderBy("global_seq"))
            cursor, size = head if upto is None else upto, size * 4
        return found

    def _run(self, sub: Subscription, wanted: SubscriptionFilter) -> None:
        o, cursor = sub.options, None
        while not sub.stopped.is_set():
            state = self._log().state()
            if state.values.get(self._key("paused", sub.name)):
                sub.stopped.wait(o.poll_s)
                continue
            if o.group is not None and not self._lease(sub):
                cursor = None
                sub.stopped.wait(o.poll_s)
                continue
            if cursor is None:
                cursor = self.last(sub.name, o.group, state) if o.group is not None else o.start_from
            most = state.values.get(self._key("in_flight", sub.name, o.group), o.max_in_flight) if o.group else o.max_in_flight
            if o.ack == MANUAL and cursor - max(self.last(sub.name, o.group, state), o.start_from) > most:
                sub.stopped.wait(o.poll_s)
                continue
            found = self.poll(sub.name, wanted, cursor, o.batch, most)
            for e in found:
                while not sub.stopped.is_set():
                    try:
                        sub.channel.put(e, timeout=0.1)
                        break
                    except queue.Full:
                        continue
            if found:
                self.events.store.metrics.add("subscription_events", len(found), self.events.tenant)
                cursor = found[-1].global_seq
                if o.ack == AUTO:
                    try:
                        self.checkpoint(sub.name, cursor, o.group, owner=sub.owner if o.group is not None else None)
                    except LeaseMismatch:  # another worker goes on from the last checkpoint
                        cursor = None
            else:
                sub.stopped.wait(o.poll_s)

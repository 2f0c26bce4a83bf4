from __future__ import annotations

import datetime as dt
import threading

import pytest

from ledgerleaf import errors
from ledgerleaf.context import Context, tenant_schema
from ledgerleaf.operators.aggregates import Aggregate, AggregateRepository, Snapshotter
from ledgerleaf.operators.documents import BatchWriter, set_path
from ledgerleaf.operators.events import NO_STREAM, Event
from ledgerleaf.store import Store


class Counter(Aggregate):
    def new(self):
        return {"n": 0}

    def apply(self, state, typ, body):
        return {"n": state["n"] + 1}


def test_documents(store):
    d = store.documents()
    assert d.upsert("a", {"email": "x", "n": {"k": 1}}) == 1
    assert d.put("a", {"email": "y", "n": {"k": 1}}, 1) == 2
    with pytest.raises(errors.DocVersionConflict):
        d.put("a", {}, 1)
    assert d.patch("a", "n.j.deep", 5) == 3
    assert d.get("a") == ({"email": "y", "n": {"k": 1, "j": {"deep": 5}}}, 3)
    assert d.get_field("a", "n.k") == 1
    assert d.update("a", lambda doc: doc | {"z": 1}, 3) == 4
    with pytest.raises(errors.NotFound):
        d.update("none", lambda doc: doc)
    d.soft_delete("a")
    assert d.get("a") is None and d.get_field("a", "z") == 1
    assert d.query().fetch_all() == [] and len(d.query().only_deleted().fetch_all()) == 1
    d.restore("a")
    assert d.get("a")[1] == 6 and d.history().count() == 5


def test_set_path():
    assert set_path({"a": {"b": 1}}, "a.c", 2) == {"a": {"b": 1, "c": 2}}
    assert set_path({"a": [1, 2]}, "a[1]", 9) == {"a": [1, 9]}
    assert set_path(None, "x.y", 1) == {"x": {"y": 1}}


def test_batch_writer(store):
    d = store.documents()
    w = BatchWriter(d).upsert("1", {"v": 0}).upsert("1", {"v": 1}).upsert("2", {"v": 2})
    assert w.flush() == {"upserted": 2, "updated": 0, "conflicts": 0, "deleted": 0}
    found = w.update_expected("1", {"v": 5}, 1).update_expected("2", {"v": 6}, 9).delete("2").flush()
    assert found == {"upserted": 0, "updated": 1, "conflicts": 1, "deleted": 1}
    assert d.get("1") == ({"v": 5}, 2) and d.get("2") is None
    assert d.upsert("2", {"v": 7}) >= 1


def test_session_is_atomic(store):
    s = store.session(Context(headers={"a": 1}))
    assert s.load("x") is None
    s.store_doc("x", {"q": 1})
    s.append_events("s", [Event("A", {})], NO_STREAM, Context(headers={"b": 2}))
    s.snapshot("s", 1, {"n": 1})
    s.save_changes()
    assert s.load("x") == {"q": 1}
    assert store.events().read_stream_envelopes("s")[0].headers == {"a": 1, "b": 2}
    s.store_doc("y", {})
    s.append_events("s", [Event("A", {})], NO_STREAM)
    with pytest.raises(errors.StreamVersionConflict):
        s.save_changes()
    assert store.documents().get("y") is None


def test_events(store):
    e = store.events()
    assert e.append("s", [Event("E1", {"k": 1}), Event("E2", {"k": 2})], NO_STREAM) == 2
    with pytest.raises(errors.StreamVersionConflict):
        e.append("s", [Event("E3", {})], 1)
    assert e.builder("s").event("E3", {"k": 3}).expect(2).headers(req="r").causation("c").correlation("d").user("u").send() == 3
    last = e.read_stream_envelopes("s")[-1]
    assert (last.stream_seq, last.headers, last.causation_id, last.correlation_id, last.user_id) == (3, {"req": "r"}, "c", "d", "u")
    e.builder("p").event("Ping", {}).idempotency_key("k-123").send()
    with pytest.raises(errors.IdempotencyConflict):
        e.builder("q").event("Ping", {}).idempotency_key("k-123").send()
    assert [x.global_seq for x in e.fetch_after(1, 10)] == [2, 3, 4]
    store.register_schema("Typed", 1, {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}}})
    with pytest.raises(errors.SchemaViolation):
        e.append("t", [Event("Typed", {"n": "x"})])
    assert e.append("t", [Event("Typed", {"n": 3})]) == 1
    assert e.append_tombstone("t", "gone") == 2
    assert store.resolve_stream_alias("al") == store.resolve_stream_alias("al")


def test_archive(store):
    e = store.events()
    e.append("s", [Event("Demo", {"n": i}) for i in range(5)])
    later = dt.datetime.now(dt.timezone.utc) + dt.timedelta(seconds=1)
    assert e.archive_before(later, "s", dry_run=True) == 5
    assert e.archive_before(later, "s") == 5
    assert e.read_stream("s") == [] and len(e.with_archived().read_stream("s")) == 5
    e.archive_stream("s", "me", "old")
    with pytest.raises(errors.StreamArchived):
        e.append("s", [Event("X", {})])
    store.archive_redirect = True
    assert e.append("s", [Event("Cold", {})]) == 6
    store.archive_redirect = False
    e.reactivate_stream("s")
    assert e.append("s", [Event("HotResume", {"n": 99})]) == 7
    assert {r.retention_class: r.n for r in e.archive_status().collect()} == {"cold": 6, "hot": 1}


def test_inline_projection_stops_the_append(store):
    def refuse(found, change):
        if any(x.typ == "Bad" for x in found):
            raise ValueError("no")
        change.set["seen"] = len(found)

    store.inline_handlers.append(refuse)
    e = store.events()
    e.append("s", [Event("Good", {})])
    with pytest.raises(ValueError, match="no"):
        e.append("s", [Event("Bad", {})])
    assert e.head_sequence() == 1 and store.log().state().values["seen"] == 1


def test_aggregates_and_snapshots(store):
    e = store.events()
    e.append("s", [Event("Inc", {}) for _ in range(3)])
    repo = AggregateRepository(e, lambda state: "full" if state["n"] >= 5 else None)
    agg = repo.load("s", Counter)
    assert (agg.state, agg.version) == ({"n": 3}, 3)
    assert repo.commit_and_snapshot("s", agg, [Event("Inc", {})], 2) == 4
    assert repo.load_with_snapshot("s", Counter).state == {"n": 4}
    repo.commit_and_snapshot("s", agg, [Event("Inc", {})], 2)
    with pytest.raises(errors.ValidationFailed):
        repo.commit_and_snapshot("s", agg, [Event("Inc", {})], 2)
    e.append("long", [Event("Inc", {}) for _ in range(150)])
    snap = Snapshotter(e, Counter, threshold=100)
    assert snap.metrics() == {"candidates": 1, "max_gap": 150}
    assert snap.run_until_idle() == 1 and snap.metrics()["candidates"] == 0
    assert repo.load_with_snapshot("long", Counter).state == {"n": 150}


def test_tenants(spark, tmp_path):
    st = Store(spark, str(tmp_path / "c"), mode="conjoined")
    with pytest.raises(errors.TenantRequired):
        st.documents().upsert("a", {})
    a, b = st.documents().for_tenant("A"), st.documents().for_tenant("B")
    a.upsert("x", {"t": "a"})
    b.upsert("x", {"t": "b"})
    assert a.get("x")[0] == {"t": "a"} and b.get("x") == ({"t": "b"}, 1)
    st = Store(spark, str(tmp_path / "s"), mode="schema_per_tenant")
    with pytest.raises(errors.TenantNotFound):
        st.documents().for_tenant("Acme-1").upsert("x", {})
    threads = [threading.Thread(target=st.ensure_tenant, args=("Acme-1",)) for _ in range(8)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert st.list_tenants() == ["Acme-1"] and tenant_schema("Acme-1") == "tenant_acme_1"
    assert st.documents().for_tenant("Acme-1").upsert("x", {}) == 1
    st.drop_tenant("Acme-1")
    assert st.list_tenants() == []

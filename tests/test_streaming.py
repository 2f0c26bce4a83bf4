from __future__ import annotations

import time

import pytest

from ledgerleaf import errors
from ledgerleaf.operators.events import Event
from ledgerleaf.operators.upcasting import UpcasterRegistry
from ledgerleaf.plans.event_ops import SubscriptionFilter
from ledgerleaf.sources.commitlog import Change
from ledgerleaf.streaming.projections import CustomProjection, Daemon, FunctionProjection, Projection, ViewProjection, read_view
from ledgerleaf.streaming.source import _Reader, read_stream
from ledgerleaf.streaming.subscriptions import MANUAL, Options, Subscriptions


def orders(store):
    e = store.events()
    e.append("o", [Event("OrderPlaced", {"customer": c, "amount": a}) for c, a in (("a", 10), ("a", 20), ("b", 5), ("a", 7))])
    return e


def test_view_projection(store):
    e = orders(store)
    d = Daemon(e, batch=3).register("totals", ViewProjection("totals", "customer", "amount", ["OrderPlaced"]))
    assert d.run_until_idle("totals") == 4
    want = {"a": (3, 37.0), "b": (1, 5.0)}
    assert {r.key: (r["count"], r["sum"]) for r in read_view(e, "totals").collect()} == want
    d.rebuild("totals")
    assert read_view(e, "totals").count() == 0
    d.replay("totals")
    assert {r.key: (r["count"], r["sum"]) for r in read_view(e, "totals").collect()} == want


def test_daemon_failures(store):
    e = store.events()
    e.append("s", [Event("Ok", {}), Event("Boom", {}), Event("Ok", {})])

    def handle(event, values):
        if event.typ == "Boom":
            raise ValueError("boom")
        values["n"] = values.get("n", 0) + 1

    d = Daemon(e, backoff_base_s=60).register("p", FunctionProjection(handle))
    assert d.tick_once("p") == ("processed", 3)
    assert store.log().state().values["n"] == 2
    row = d.dlq("p").first()
    assert (row.global_seq, row.error) == (2, "boom") and d.status("p")["dlq"] == 1
    e.append("s", [Event("Ok", {})])
    assert d.tick_once("p") == ("backoff", 0)
    d.resume("p")
    d.pause("p")
    assert d.tick_once("p") == ("paused", 0)
    d.resume("p")
    assert d.tick_once("p") == ("processed", 1) and d.tick_once("p") == ("idle", 0)
    d.dlq_requeue(row.id)
    assert d.checkpoint("p") == 1 and d.dlq("p").count() == 0
    other = Daemon(e).register("p", d.projections["p"])
    assert other.tick_once("p") == ("leased_by_other", 0)
    d.release("p")
    assert other.tick_once("p")[0] == "processed" and "p" in other.names()


def test_custom_and_multi(store):
    e = store.events()
    e.append("s", [Event("Set", {"key": "k", "val": "1"}), Event("Set", {"key": "k", "val": "2"}), Event("Other", {})])
    c = CustomProjection()

    @c.on("Set", args=("key", "val"))
    def put(values, key, val):
        values[f"kv:{key}"] = val

    Daemon(e).register("kv", c).run_until_idle("kv")
    assert store.log().state().values["kv:k"] == "2"


def test_upcasting(store):
    reg = UpcasterRegistry()

    @reg.upcaster(("OrderPlaced", 1), ("OrderPlaced", 2))
    def add_currency(body):
        return body | {"currency": "USD"}

    reg.register(("OrderPlaced", 2), ("OrderPlaced", 3), lambda b: b | {"customer_label": b["customer_id"].upper()})
    e = store.events().with_upcasters(reg)
    e.append("s", [Event("OrderPlaced", {"order_id": "o", "customer_id": "abc123"})])
    found = e.read_stream_envelopes("s")[0]
    assert (found.event_version, found.body["currency"], found.body["customer_label"]) == (3, "USD", "ABC123")
    assert e.read_stream("s")[0][1].version == 1
    assert reg.find_path(("OrderPlaced", 1), ("OrderPlaced", 3)) == [("OrderPlaced", v) for v in (1, 2, 3)]
    assert reg.apply_one("OrderPlaced", 2, {"customer_id": "x"})[1:] == (3, {"customer_id": "x", "customer_label": "X"})
    reg.register(("A", 1), ("A", 2), lambda b: b).register(("A", 2), ("A", 1), lambda b: b)
    with pytest.raises(errors.UpcastingCycle):
        reg.chain(("A", 1))


def test_subscriptions(store):
    e = orders(store)
    e.append("p", [Event("Ping", {})])
    subs = Subscriptions(e)
    sub = subs.subscribe("x", SubscriptionFilter(event_types=["Ping"]), Options(poll_s=0.1, ack=MANUAL))
    event = sub.receive(60)
    assert event.typ == "Ping" and subs.last("x") == 0
    sub.ack(event)
    sub.stop()
    assert subs.last("x") == 5
    first = subs.subscribe("g", None, Options(poll_s=0.1, group="w"))
    assert first.receive(60).global_seq == 1
    second = subs.subscribe("g", None, Options(poll_s=0.1, group="w"))
    assert second.receive(3) is None
    for _ in range(100):
        if subs.group_lag("g", "w") == 0:
            break
        time.sleep(0.1)
    first.stop(), second.stop()
    assert subs.group_lag("g", "w") == 0


def test_streaming_source_agrees_with_batch(spark, store):
    e = orders(store)
    q = read_stream(spark, f"{store.root}/main").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [(r.global_seq, r.event_type) for r in spark.sql("select * from seen order by global_seq").collect()]
    assert got == [(x.global_seq, x.typ) for x in e.fetch_after(0, 100)]


def test_bounded_source_delivers_the_whole_log(spark, store, tmp_path):
    """Two availableNow runs over a log longer than max_events, and later batches of one reader."""
    e = orders(store)

    def seen():
        stream = read_stream(spark, f"{store.root}/main", max_events=2)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted(r.global_seq for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = [x.global_seq for x in e.fetch_after(0, 100)]
    assert len(first) > 2 and seen() == first
    reader = _Reader({"path": f"{store.root}/main", "maxeventspertrigger": "2"})
    assert reader.latestOffset() == {"seq": first[-1]}
    e.append("more", [Event("Ping", {}) for _ in range(5)])
    assert [reader.latestOffset()["seq"] - first[-1] for _ in range(4)] == [2, 4, 5, 5]
    assert seen() == [x.global_seq for x in e.fetch_after(0, 100)]


def test_live_cache(spark):
    from ledgerleaf.store import Breadcrumbs, LiveCache, Metrics

    spark.range(3).createOrReplaceTempView("live")
    cache = LiveCache(spark, 60)
    assert cache.scalar("n", "select count(*) from live") == 3
    spark.range(5).createOrReplaceTempView("live")
    assert cache.scalar("n", "select count(*) from live") == 3
    cache.invalidate("n")
    assert cache.scalar("n", "select count(*) from live") == 5
    m = Metrics("x")
    m.add("events", 2, "t")
    m.set("lag", 4)
    assert 'x_events{tenant="t"} 2' in m.render() and "# TYPE x_lag gauge" in m.render()
    b = Breadcrumbs()
    b.note("a", "b", "go")
    assert "a->>b: go" in b.mermaid()


def test_values_last_over_batches(store):
    e = store.events()
    e.append("s", [Event("Boom" if i % 3 == 2 else "Ok", {"i": i}) for i in range(8)])

    def handle(event, values):
        values[f"n:{event.typ}"] = values.get(f"n:{event.typ}", 0) + 1
        values.setdefault("seen", []).append(event.body["i"])
        values["last"] = event.body["i"]
        if event.body["i"] == 6:
            del values["last"]
        if event.typ == "Boom":
            raise ValueError("boom")

    d = Daemon(e, batch=3, backoff_base_s=0.01).register("p", FunctionProjection(handle))
    want = {"n:Ok": 6, "seen": [0, 1, 3, 4, 6, 7], "last": 7}
    for run in (d.run_until_idle, d.replay):
        assert run("p") == 8
        values = store.log().state().values
        assert {k: values.get(k) for k in (*want, "n:Boom")} == want | {"n:Boom": None}
    d.rebuild("p")
    assert not want.keys() & store.log().state().values.keys()
    assert d.tick_once("p") == ("processed", 3) and store.log().state().values["seen"] == [0, 1]


def test_values_that_another_writer_set_are_not_overwritten(store):
    e = store.events()
    e.append("s", [Event("Ok", {}), Event("Ok", {})])

    def handle(event, values):
        if event.global_seq == 2:
            store.commit(lambda s: Change(set={"n": 10}))
        values["n"] = values.get("n", 0) + 1

    d = Daemon(e, batch=1).register("p", FunctionProjection(handle))
    assert d.tick_once("p") == ("processed", 1)
    with pytest.raises(errors.LeaseMismatch):
        d.tick_once("p")
    assert store.log().state().values["n"] == 10 and d.checkpoint("p") == 1


def test_all_that_a_batch_gives_is_kept(store):
    e = store.events()
    e.append("s", [Event("Keep", {"i": i}) for i in range(4)] + [Event("Anew", {"i": 4}), Event("Keep", {"i": 5}), Event("Boom", {})])

    class Rows(Projection):
        def apply(self, event, change):
            i = event.body["i"]
            row = store.frame([(f"v{i}", None, "k", i, float(i), event.global_seq)], "views")
            if event.typ == "Anew":
                change.replace["views"] = row
            else:
                change.add["views"] = row
            change.add["dlq"] = store.frame([(100 + i, "own", None, event.global_seq, event.typ, None, None, None)], "dlq")

    d = Daemon(e, batch=4, backoff_base_s=0.01).register("p", Rows())

    def kept():
        return sorted(r.view for r in store.scan("views").collect())

    assert d.tick_once("p") == ("processed", 4) and kept() == ["v0", "v1", "v2", "v3"]
    assert d.tick_once("p") == ("processed", 3) and kept() == ["v4", "v5"]
    assert d.dlq("p").count() == 1 and d.dlq("own").count() == 6
    swap = Change(add={"views": 1, "dlq": 1}, swap={"docs": (["a"], [1])})
    swap.take(Change(add={"views": [2, 3]}, replace={"dlq": 2}, swap={"docs": (["b"], [2])}))
    assert (swap.add, swap.replace, swap.swap) == ({"views": [1, 2, 3]}, {"dlq": 2}, {"docs": (["a", "b"], [1, 2])})

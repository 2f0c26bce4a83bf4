from __future__ import annotations

import time

import pytest

from ledgerleaf import cli, errors
from ledgerleaf.operators.events import Event
from ledgerleaf.operators.schema import Config, Promoted, SchemaPlanner, promote, suggest_promoted
from ledgerleaf.streaming.cluster import ClusterNode


def test_planner_is_idempotent(spark):
    name = f"plan_{int(time.time() * 1000)}"
    planner = SchemaPlanner(spark)
    config = Config(schema=name)
    assert {a.kind for a in planner.sync(config).actions} == {"create_schema", "create_table"}
    assert planner.plan(config).actions == []
    more = Config(schema=name, promoted=(Promoted("email", "email", "text", "lower({value})"),))
    assert planner.drift(more) == {name: ["add_column docs email"]}
    planner.sync(more)
    assert planner.plan(more).actions == []
    planner.down(more)
    spark.sql(f"DROP DATABASE {name}")


def test_promoted_columns(store):
    d = store.documents()
    d.bulk_upsert([(str(i), {"email": f"User{i}@X.com", "age": 20 + i, "p": {"deep": {"n": i}}}) for i in range(10)])
    fields = [Promoted("email", "email", "text", "lower({value})"), Promoted("p.deep.n", "n", "integer")]
    rows = promote(d.current(), fields).where("email = 'user3@x.com'").select("n").collect()
    assert [r.n for r in rows] == [3]
    assert {p.path: p.kind for p in suggest_promoted(d.current())} == {"email": "text", "age": "bigint"}
    q = d.query({"email": ("string", "lower({value})"), "age": ("int", "{value}")})
    from ledgerleaf.plans.predicate import Predicate as P

    assert len(q.filter(P.gt("age", 25)).fetch_all()) == 4 and len(q.filter(P.eq("email", "user1@x.com")).fetch_all()) == 1


def test_cluster_failover(store):
    a, b = ClusterNode(store, "c", 60, 1), ClusterNode(store, "c", 60, 1)
    assert a.heartbeat() == "hot" and b.heartbeat() == "cold"
    assert a.health() == {"cluster": "c", "hot": 1, "cold": 1, "healthy": True}
    token = a.token()
    a.relinquish()
    began = time.time()
    assert b.heartbeat() == "hot" and time.time() - began < 2
    assert b.token() == token + 1 and a.heartbeat() == "cold"
    with pytest.raises(errors.LeaseMismatch):
        a.check(token)
    a.promote()
    assert a.token() == token + 2


def test_cli(spark, store, tmp_path):
    store.documents().upsert("a", {"x": 1})
    store.events().append("s", [Event("A", {"n": 1})])

    def run(*args):
        return cli.run(cli.parser().parse_args(["--root", store.root, *args]), spark)

    assert run("docs", "get", "a") == ({"x": 1}, 1)
    assert run("docs", "verify") == {"versions": 1, "documents_with_gaps": 0}
    assert run("streams", "read", "s") == [{"stream_seq": 1, "type": "A", "body": {"n": 1}}]
    assert run("archive", "move", "--before", "2999-01-01T00:00:00", "--dry-run") == 1
    assert run("projections", "list") == [] and run("health") == {"healthy": True}
    run("tenants", "archive", "--to", str(tmp_path / "out"))
    assert '"event_type":"A"' in spark.read.text(str(tmp_path / "out" / "events")).first().value
    assert [cli.format_duration(s) for s in (0, 40, 185, 93600)] == ["0s", "40s", "3m5s", "1d2h"]


def test_more_of_the_command_line(spark, store, tmp_path):
    from ledgerleaf.operators.events import Event
    from ledgerleaf.streaming.cluster import ClusterNode
    from ledgerleaf.streaming.projections import Daemon, FunctionProjection
    from ledgerleaf.streaming.subscriptions import Subscriptions

    def run(*args):
        return cli.run(cli.parser().parse_args(["--root", store.root, *args]), spark)

    events = store.events()
    events.append("s1", [Event("A", {"n": i}) for i in range(3)])
    store.documents().upsert("d", {"name": "Ann"})
    subs = Subscriptions(events)
    subs.checkpoint("sub", 2)
    subs.checkpoint("sub", 1, "g")
    assert run("subscriptions", "list") == ["sub"] and run("subscriptions", "groups", "sub") == ["g"]
    assert run("subscriptions", "status", "sub")["lag"] == 1 and run("subscriptions", "status", "sub", "--group", "g")["lag"] == 2
    run("subscriptions", "pause", "sub")
    run("subscriptions", "max-in-flight", "sub", "g", "5")
    run("subscriptions", "reset", "sub", "--group", "g", "--to", "3")
    found = run("subscriptions", "status", "sub", "--group", "g")
    assert (found["lag"], found["max_in_flight"], found["paused"]) == (0, 5, True)
    run("subscriptions", "resume", "sub")
    assert run("snapshots", "metrics", "--threshold", "2") == {"candidates": 1, "max_gap": 3}
    assert [r["stream_id"] for r in run("snapshots", "candidates", "--threshold", "2")] == ["s1"]
    assert run("snapshots", "run", "test_scale:Sum", "--threshold", "2") == 1 and run("snapshots", "candidates", "--threshold", "2") == []
    assert run("archive", "redirect", "on") is True and run("archive", "redirect", "show") is True and run("archive", "redirect", "off") is False
    assert run("--promote", "name:name_n", "schema", "backfill") == 1 and run("schema", "merge") == 0
    assert "name_n" in run("--promote", "name:name_n", "schema", "show")["docs"]["columns"] and run("schema", "suggest")[0]["path"] == "name"
    node = ClusterNode(store, "c", ttl_s=60)
    node.heartbeat()
    assert run("cluster", "health", "c")["hot"] == 1
    run("cluster", "promote", "c", "other")
    assert not node._log().state().values["cluster:c:leader"]["node"] == node.node
    Daemon(events).register("p", FunctionProjection(lambda e, v: None)).run_until_idle("p")
    run("projections", "rebuild", "p")
    assert run("projections", "status", "p")["last_seq"] == 0
    assert any(line.startswith("ledgerleaf_projection_lag_p 3") for line in run("metrics"))
    assert run("docs", "explain-sql", "SELECT id FROM range(10) WHERE id > 4", "--analyze")["rows"] == 5
    run("tenants", "archive", "t", "--to", str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "projections")).first().name == "p"
    assert run("archive", "move", "--before", "2999-01-01T00:00:00+00:00", "--batches", "10") == 3 and events.is_archived("s1")


def test_http_and_streaming_metrics(spark, store):
    import urllib.error
    import urllib.request

    from ledgerleaf.operators.events import Event
    from ledgerleaf.serving import serve, watch
    from ledgerleaf.streaming.source import read_stream

    store.events().append("s", [Event("A", {})] * 2)
    listener = watch(store)
    query = read_stream(spark, store.log().root).writeStream.format("memory").queryName("m").trigger(availableNow=True).start()
    query.awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark.streams.removeListener(listener)
    server = serve(store)
    at = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        assert urllib.request.urlopen(f"{at}/health").read() == b'{"healthy": true}'
        text = urllib.request.urlopen(f"{at}/metrics").read().decode()
        assert "ledgerleaf_executors 1" in text and "ledgerleaf_appends 1" in text
        assert "ledgerleaf_events_head 2" in text and "ledgerleaf_events_appended 2" in text and "# TYPE ledgerleaf_events_head gauge" in text
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(f"{at}/other")
    finally:
        server.shutdown()


def test_legacy_upcasters(store):
    from ledgerleaf.operators.events import Event, envelopes
    from ledgerleaf.operators.upcasting import LegacyUpcasters

    events = store.events()
    events.append("a", [Event("A", {"n": 1}), Event("A", {"x": 1}), Event("B", {"n": 1})])
    old = LegacyUpcasters().register("A", 1, lambda b: b | {"one": 1}).register("A", 2, lambda b: b | {"two": b["n"]})
    found = envelopes(old.apply(events.frame()).orderBy("global_seq"))
    assert [(e.event_version, e.body) for e in found] == [(3, {"n": 1, "one": 1, "two": 1}), (2, {"one": 1, "x": 1}), (1, {"n": 1})]


def test_builders_cache_headers_and_schemas(spark, store, tmp_path):
    from ledgerleaf.context import Context, lock_key
    from ledgerleaf.functions.json_schema import violations
    from ledgerleaf.operators.events import Event
    from ledgerleaf.operators.schema import advise
    from ledgerleaf.plans import event_ops as ev
    from ledgerleaf.plans.predicate import Predicate as P
    from ledgerleaf.promoted import Promoted
    from ledgerleaf.store import LiveCache, StoreBuilder

    made = StoreBuilder(spark, str(tmp_path / "b")).tenancy("conjoined", lambda: None).defaults(Context(user_id="u")).promote(Promoted("a", "a_n", "integer")).search("simple").archive_redirect().build()
    with pytest.raises(errors.TenantRequired):
        made.session_builder().user("v").build()
    session = made.session_builder().tenant("t").user("v").headers(a=1).headers(b=2).correlation("c").build()
    assert (session.context.tenant, session.context.user_id, session.context.headers, session.context.correlation_id) == ("t", "v", {"a": 1, "b": 2}, "c")
    session.store_doc("1", {"a": 5})
    session.save_changes()
    assert made.documents().for_tenant("t").query().filter(P.eq("a", 5)).fetch_first() is not None
    cache = LiveCache.shared(spark, 60)
    n = cache.scalar("k", "SELECT rand()")
    assert LiveCache.shared(spark, 60).scalar("k", "SELECT rand()") == n
    cache.invalidate("k")
    assert cache.scalar("k", "SELECT rand()") != n
    store.events().append("s", [Event("A", {})], context=Context(headers={"req": "x"}))
    store.events().append("s", [Event("A", {})])
    rows = store.events().frame().select("global_seq", ev.header("req").alias("h"), ev.has_header("req").alias("has")).orderBy("global_seq").collect()
    assert [(r.h, r.has) for r in rows] == [("x", True), (None, False)]
    assert lock_key("") == 0xCBF29CE484222325 - (1 << 64) and lock_key("a") == 0xAF63DC4C8601EC8C - (1 << 64)
    schema = {"$defs": {"id": {"type": "string", "minLength": 2}}, "properties": {"id": {"$ref": "#/$defs/id"}, "n": {"anyOf": [{"type": "integer"}, {"const": None}]}, "l": {"uniqueItems": True, "maxItems": 3}}, "patternProperties": {"^x_": {"exclusiveMinimum": 0}}, "additionalProperties": {"type": "boolean"}, "not": {"required": ["bad"]}}
    assert violations({"id": "ab", "n": None, "l": [1, 2], "x_a": 1, "other": True}, schema) == []
    for wrong in ({"id": "a"}, {"n": "x"}, {"l": [1, 1]}, {"l": [1, 2, 3, 4]}, {"x_a": 0}, {"other": 1}, {"bad": True}):
        assert violations(wrong, schema), wrong
    q = store.documents().query()
    found = advise([q.filter(P.eq("email", "x")).order_by("age"), q.filter(P.eq("email", "y") | P.gt("age", 1)), q.full_text_search("a"), q.full_text_search("b")], [Promoted("email", "e")])
    assert {(a.path, a.action) for a in found} == {("email", "bloom"), ("age", "sort"), ("age", "promote"), ("", "lexemes")}


def test_a_group_checkpoint_is_fenced(store):
    from ledgerleaf.operators.events import Event
    from ledgerleaf.sources.commitlog import Change
    from ledgerleaf.streaming.subscriptions import MANUAL, Options, Subscriptions

    store.events().append("s", [Event("A", {}) for _ in range(3)])
    subs = Subscriptions(store.events())
    sub = subs.subscribe("x", options=Options(group="g", ack=MANUAL, poll_s=0.05))
    first, second = sub.receive(30), sub.receive(30)
    sub.ack(first)
    sub.stop()
    key = subs._key("lease", "x", "g")
    store.log().commit(lambda s: Change(set={key: {"owner": "another", "until": 4e9}}))
    with pytest.raises(errors.LeaseMismatch):
        sub.ack(second)
    assert subs.last("x", "g") == 1

"""What is read and written as a log grows, and the operators that came with it."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from ledgerleaf.context import Context
from ledgerleaf.errors import LeaseMismatch, ProjectionPaused, QueryError, StreamArchived, UpcastingFailed, ValidationFailed
from ledgerleaf.operators.aggregates import Aggregate
from ledgerleaf.operators.events import Event
from ledgerleaf.operators.upcasting import UpcasterRegistry
from ledgerleaf.plans.event_ops import SubscriptionFilter
from ledgerleaf.plans.predicate import Predicate as P
from ledgerleaf.plans.query import Collection, DocumentQuery
from ledgerleaf.promoted import Promoted
from ledgerleaf.sources import commitlog
from ledgerleaf.sources.commitlog import Change, CommitLog
from ledgerleaf.store import Store
from ledgerleaf.streaming.cluster import ClusterNode
from ledgerleaf.streaming.projections import Daemon, FunctionProjection, Projection
from ledgerleaf.streaming.source import _Reader
from ledgerleaf.streaming.subscriptions import Subscriptions


@pytest.fixture()
def opened(monkeypatch):
    """Folders that reads name, in order."""
    seen = []
    read = CommitLog.read_folders
    monkeypatch.setattr(CommitLog, "read_folders", lambda self, table, folders: seen.extend(folders) or read(self, table, folders))
    return seen


def ping(n, start=0):
    return [Event("Ping", {"i": start + i}) for i in range(n)]


def test_appends_and_heads_need_no_reads(store, opened):
    events = store.events()
    for i in range(6):
        assert events.append(f"s{i % 3}", ping(2), expected=2 * (i // 3), idempotency_key=f"k{i}") == 2 * (i // 3) + 2
    assert events.head_sequence() == 12 and opened == []
    assert [s for s, _ in events.read_stream("s1")] == [1, 2, 3, 4] and len(opened) == 2
    opened.clear()
    assert [e.global_seq for e in events.fetch_after(5, 3)] == [6, 7, 8] and len(opened) <= 3
    opened.clear()
    assert events.after(12, 5).count() == 0 and opened == []


def test_small_folders_are_merged(store, monkeypatch, opened):
    monkeypatch.setattr(commitlog, "FAN", 4)
    monkeypatch.setattr("ledgerleaf.store.FAN", 4)
    events, docs = store.events(), store.documents()
    for i in range(18):
        events.append(f"s{i % 5}", ping(1, i))
        docs.upsert(f"d{i % 3}", {"i": i})
    state = store.log().state()
    assert len(state.tables["events"]) <= 6 and len(state.tables["docs"]) <= 6 and len(state.tables["streams"]) <= 4
    assert sum(state.facts[f]["n"] for f in state.tables["events"]) == 18
    assert [e.body["i"] for e in events.fetch_after(0, 100)] == list(range(18))
    assert [e.body["i"] for e in events.read_stream_envelopes("s2")] == [2, 7, 12, 17] and events.append("s2", ping(1)) == 5
    assert docs.get("d1") == ({"i": 16}, 6) and docs.history().count() == 15
    names = lambda: sum(len(store.log().files.names(t)) for t in ("events", "docs", "streams"))
    before, kept = names(), sum(len(store.log().state().tables[t]) for t in ("events", "docs", "streams"))
    assert store.log().vacuum(3600) == 0 and store.log().vacuum(-1) == before - kept and names() == kept
    assert store.log().files.names("_import") == []
    again = Store(store.spark, store.root)  # from the log's files alone
    assert again.log().state().facts == store.log().state().facts and again.events().head_sequence() == 19


def test_state_files_keep_facts(store):
    for i in range(commitlog.SNAPSHOT_EVERY + 2):
        store.log().commit(lambda s, i=i: Change(set={"x": i}))
    store.events().append("a", ping(3))
    assert Store(store.spark, store.root).events().stream_head(store.log().state(), "a") == 3


def test_archive_writes_only_folders_with_old_events(store, opened):
    events = store.events()
    events.append("a", ping(5))
    events.append("b", ping(3))
    cut = datetime.now(timezone.utc)
    events.append("a", ping(2))
    first, second, third = store.log().state().tables["events"]
    opened.clear()
    assert events.archive_before(cut, "a", dry_run=True) == 5 and opened == [first]
    assert events.archive_before(cut, "a") == 5
    state = store.log().state()
    assert second in state.tables["events"] and third in state.tables["events"] and first not in state.tables["events"]
    opened.clear()
    assert events.frame().count() == 5 and set(opened) == {second, third}  # no cold folder is opened
    assert events.with_archived().frame().count() == 10 and events.head_sequence() == 10
    assert [s for s, _ in events.with_archived().read_stream("a")] == list(range(1, 8)) and events.append("a", ping(1)) == 8
    assert events.archive_before(cut) == 3 and events.archive_before(cut) == 0
    assert {r.retention_class: r.n for r in events.archive_status().collect()} == {"cold": 8, "hot": 3}


def test_archive_in_batches_and_redirect(store):
    events = store.events()
    for i in range(5):
        events.append(f"s{i}", ping(2))
    later = datetime.now(timezone.utc) + timedelta(minutes=1)
    assert events.archive_in_batches(later, streams=2, max_batches=1) == 4
    assert events.archive_in_batches(later, streams=2) == 6 and all(events.is_archived(f"s{i}") for i in range(5))
    with pytest.raises(StreamArchived):
        events.append("s0", ping(1))
    store.set_archive_redirect(True)
    other = Store(store.spark, store.root).events()  # the switch is in the log, not in an object
    assert other.append("s0", ping(1)) == 3 and other.frame().count() == 0
    store.set_archive_redirect(False)
    events.reactivate_stream("s1")
    assert events.append("s1", ping(1)) == 3 and events.frame().count() == 1


class Refusing(Projection):
    def __init__(self):
        self.seen = []

    def apply(self, event, change):
        if event.body["i"] == 4:
            raise ValueError("no")
        self.seen.append(event.body["i"])


def test_replay_reaches_the_head_over_dead_letters(store, opened):
    events = store.events()
    for a in range(0, 10, 2):
        events.append("a", ping(2, a))
    projection = Refusing()
    daemon = Daemon(events, batch=3, backoff_base_s=0.05).register("p", projection)
    opened.clear()
    assert daemon.run_until_idle("p") == 10 and daemon.checkpoint("p") == 10
    assert projection.seen == [0, 1, 2, 3, 5, 6, 7, 8, 9] and [r.global_seq for r in daemon.dlq("p").collect()] == [5]
    reads = [f for f in opened if f.startswith("events/")]
    assert len(reads) <= 10  # each of five folders once or twice, however many ticks there are
    daemon.pause("p")
    events.append("a", ping(1, 10))
    with pytest.raises(ProjectionPaused):
        daemon.run_until_idle("p")
    daemon.resume("p")
    projection.seen.clear()
    assert daemon.replay("p") == 11 and len(projection.seen) == 10


def test_a_projection_needs_the_lead_of_its_cluster(store):
    events = store.events()
    events.append("a", ping(1))
    one, two = ClusterNode(store, "c", ttl_s=60), ClusterNode(store, "c", ttl_s=60)
    assert one.heartbeat() == "hot" and two.heartbeat() == "cold"
    count = FunctionProjection(lambda e, values: values.update(n=e.global_seq))
    leader, standby = (Daemon(events, node=n).register("p", count) for n in (one, two))
    assert standby.tick_once("p") == ("leased_by_other", 0) and leader.tick_once("p") == ("processed", 1)
    leader.release("p")
    events.append("a", ping(1))

    class Deposed(Projection):
        def apply(self, event, change):
            two.promote()  # while the batch is worked on

    leader.register("p", Deposed())
    with pytest.raises(LeaseMismatch):
        leader.tick_once("p")
    assert leader.checkpoint("p") == 1
    leader.release("p")
    assert standby.tick_once("p") == ("processed", 1)


def test_subscription_polls_read_windows(store, opened):
    events = store.events()
    for i in range(6):
        events.append("a" if i % 2 else "b", [Event("X" if i == 5 else "Y", {"i": i})])
    subs = Subscriptions(events)
    opened.clear()
    assert [e.body["i"] for e in subs.poll("s", SubscriptionFilter(event_types=["Y"]), 2, 1, 10)] == [2] and len(opened) == 1
    assert [e.body["i"] for e in subs.poll("s", SubscriptionFilter(event_types=["X"]), 0, 2, 10)] == [5]  # windows without it are passed
    assert subs.poll("s", SubscriptionFilter(event_types=["Z"]), 0, 2, 10) == []
    assert [e.body["i"] for e in subs.poll("s", SubscriptionFilter(stream_ids=["a"]), 0, 3, 10)] == [1, 3, 5]  # a batch is filled
    assert [e.body["i"] for e in subs.poll("s", SubscriptionFilter(stream_ids=["a"]), 0, 3, 2)] == [1, 3]
    subs.checkpoint("s", 5)
    change = Change()
    subs.checkpoint("s", 3, change=change)
    assert list(change.set.values()) == [5]  # never back


def test_source_opens_only_folders_of_a_batch(store):
    events = store.events()
    for i in range(4):
        events.append("a", ping(3))
    reader = _Reader({"path": store.log().root})
    assert reader.latestOffset() == {"seq": 12}
    files = reader.partitions({"seq": 4}, {"seq": 6})
    assert len({f.path.rsplit("/", 1)[0] for f in files}) == 1 and sum(len(list(reader.read(f))) for f in files) == 2
    assert len(reader.partitions({"seq": 0}, {"seq": 12})) >= 4 and reader.partitions({"seq": 12}, {"seq": 12}) == []


def test_append_frame(store):
    events = store.events()
    events.append("a", ping(2))
    rows = store.spark.range(100).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("stream_id"), F.lit("Bulk").alias("event_type"), F.parse_json(F.format_string('{"i":%d}', "id")).alias("body"), (-F.col("id")).alias("order"))
    assert events.append_frame(rows) == 100 and events.append_frame(rows.limit(0)) == 0
    state = store.log().state()
    assert [events.window(a, n, state) for a, n in ((0, 1), (0, 2), (1, 5), (40, 7), (95, 7), (95, 8))] == [1, 2, 6, 47, 102, None]
    found = events.fetch_after(2, 200)
    assert [e.global_seq for e in found] == list(range(3, 103)) and [e.body["i"] for e in found] == list(range(99, -1, -1))
    assert [s for s, _ in events.read_stream("a")] == list(range(1, 53)) and events.append("b", ping(1)) == 51
    assert events.stream_state("b") is not None and events._streams().count() == 2


def test_numbers_and_types_of_native_columns(spark):
    rows = spark.createDataFrame([(1, "9", 9), (2, "10", 10), (3, "100", 100), (4, "x", None)], "id long, t string, n int")
    q = DocumentQuery(Collection.from_table(rows, "id"))
    ids = lambda q: [r.id for r in q.select_field("id", "id").to_df().collect()]
    assert ids(q.order_by_number("t")) == [1, 2, 3, 4] and ids(q.order_by_number("t", True).limit(2)) in ([4, 3], [3, 2])
    assert ids(q.filter(P.eq("t", 9))) == [] and ids(q.filter(P.eq("t", "9"))) == [1]
    assert ids(q.filter(P.eq("n", "9"))) == [] and ids(q.filter(P.eq("n", 9))) == [1] and ids(q.filter(P.eq("n", True))) == []
    assert sorted(ids(q.filter(~P.eq("t", 9)))) == [1, 2, 3, 4] and sorted(ids(q.filter(~P.eq("n", "9")))) == [1, 2, 3]
    assert ids(q.filter(P.gt("t", 9.5)).order_by("id")) == [2, 3]


def test_streamed_view_of_a_folder(spark, tmp_path):
    from ledgerleaf.queries import QUERIES

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    events.limit(5).write.parquet(str(tmp_path / "events_x.parquet"))
    assert QUERIES["view_streaming"](spark, str(tmp_path)).agg(F.sum("count")).first()[0] == events.count()


def test_kept_columns_and_backfill(store):
    plain = store.documents()
    plain.upsert("1", {"name": "Ann Running", "age": 30})
    fields = (Promoted("name", "name_lower", "text", "lower({value})"), Promoted("age", "age_n", "integer"))
    kept = Store(store.spark, store.root, promoted=fields, search="english")
    docs = kept.documents()
    docs.upsert("2", {"name": "Bob Runs", "age": "old"})
    docs.bulk_upsert([("3", {"name": "Cy Walks", "age": 31})])
    assert {r.id for r in docs.query().filter(P.eq("name", "bob runs")).fetch_all()} == {"2"}
    assert docs.current().where("name_lower is null").count() == 1  # written before the column was kept
    assert kept.backfill() == 1 and kept.backfill() == 0
    assert {r.id for r in docs.query().filter(P.ge("age", 30)).fetch_all()} == {"1", "3"}
    assert {r.id for r in docs.query().full_text_search("run").fetch_all()} == {"1", "2"}
    plan = docs.query().full_text_search("run").to_df()._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and docs.get("1") == ({"age": 30, "name": "Ann Running"}, 1)
    with pytest.raises(QueryError, match="klingon"):
        Store(store.spark, store.root, search="klingon")


def test_frames_of_documents(store):
    docs, spark = store.documents(), store.spark
    docs.upsert_frame(spark.range(50).select("id", F.format_string('{"v":%d}', "id").alias("json")))
    docs.update_frame(spark.createDataFrame([("1", '{"v":-1}', 1), ("2", '{"v":-2}', 7), ("no", "{}", 1)], "id string, json string, expected int"))
    docs.patch_frame(spark.createDataFrame([(3, 9), (99, 9)], "id long, w long"), {"w": F.col("w"), "tag": "t"})
    docs.delete_frame(spark.createDataFrame([("4",), ("none",)], "id string"))
    assert [docs.get(str(i)) for i in (1, 2, 3, 4)] == [({"v": -1}, 2), ({"v": 2}, 1), ({"tag": "t", "v": 3, "w": 9}, 2), None]
    assert docs.current().count() == 49 and docs.get_field("3", "w") == 9 and docs.get_field("3", "none") is None and docs.get_field("no", "v") is None


def test_published_views(store):
    store.documents().upsert("1", {"a": 1})
    store.documents().upsert("1", {"a": 2})
    store.events().append("s", ping(3))
    names = store.publish("led_")
    assert {"led_docs", "led_events", "led_docs_current"} <= set(names)
    row = store.spark.sql("SELECT (SELECT count(*) FROM led_docs) v, (SELECT max(variant_get(doc, '$.a', 'int')) FROM led_docs_current) a, (SELECT count(*) FROM led_events) e").first()
    assert (row.v, row.a, row.e) == (2, 2, 3)


class Sum(Aggregate):
    def new(self):
        return {"n": 0}

    def apply(self, state, typ, body):
        return {"n": state["n"] + body["n"]}


def test_session_bound_aggregates(store):
    session = store.session(Context(user_id="u"))
    aggregates = session.aggregates(lambda s: "too much" if s["n"] > 9 else None)
    agg = aggregates.load("a", Sum)
    aggregates.commit("a", agg, [Event("Add", {"n": 4})])
    session.store_doc("d", {"x": 1})
    assert agg.version == 0 and store.events().head_sequence() == 0 and store.documents().get("d") is None
    session.save_changes()
    assert (agg.version, agg.state) == (1, {"n": 4}) and store.documents().get("d") == ({"x": 1}, 1)
    aggregates.commit("a", agg, [Event("Add", {"n": 7})], snapshot=True)
    session.save_changes()
    assert aggregates.load("a", Sum).state == {"n": 11} and store.scan("snapshots").first().version == 2
    with pytest.raises(ValidationFailed):
        aggregates.commit("a", agg, [Event("Add", {"n": 1})])


def test_lookup_and_python_upcasters(store, opened):
    events, spark = store.events(), store.spark
    events.append("a", [Event("Order", {"customer": "c1"}), Event("Order", {"customer": "zz"}), Event("Other", {"customer": "c1"})])
    names = spark.createDataFrame([("c1", "Ann", 1)], "id string, name string, rank int")
    registry = UpcasterRegistry().register(("Order", 1), ("Order", 2), lambda b: b | {"a": 1}).register(("Order", 2), ("Order", 3), lambda b: b | {"b": b["a"] + 1})
    registry.register_lookup(("Order", 3), ("Placed", 4), names, "id", "$.customer", {"name": "name", "rank": "rank"})
    registry.register(("Placed", 4), ("Placed", 5), lambda b: b | {"shown": (b.get("name") or "?").upper()})
    found = events.with_upcasters(registry).fetch_after(0, 10)
    assert [(e.typ, e.event_version, e.body.get("name"), e.body.get("rank"), e.body.get("shown"), e.body.get("b")) for e in found] == [("Placed", 5, "Ann", 1, "ANN", 2), ("Placed", 5, None, None, "?", 2), ("Other", 1, None, None, None, None)]
    plan = events.with_upcasters(registry).after(0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # neighbouring Python steps are one
    failing = UpcasterRegistry().register(("Order", 1), ("Order", 2), lambda b: b["none"])
    with pytest.raises(Exception, match="Order"):
        events.with_upcasters(failing).fetch_after(0, 10)
    with pytest.raises(UpcastingFailed):
        failing.apply_one("Order", 1, {})


def test_log_files_are_made_once(spark, tmp_path):
    with pytest.raises(ValueError, match="s3a"):
        commitlog.Files(spark, "s3a://bucket/x")
    files = commitlog.Files(spark, f"file://{tmp_path}")
    files.local, path = None, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{tmp_path}")
    files.jvm, files.fs = spark.sparkContext._jvm, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert files.create("_log/1.json", "one") and not files.create("_log/1.json", "two")
    assert files.read("_log/1.json") == "one" and [n for n in files.names("_log") if not n.startswith(".")] == ["1.json"]


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_history_is_dealt_by_key(store):
    docs = store.documents()
    docs.bulk_upsert([("a", {"i": 1}), ("b", {"i": 1})])
    docs.upsert("a", {"i": 2})
    found = docs.history().select("id", "version")
    assert "BroadcastExchange" not in plan_of(found)
    assert [tuple(r) for r in found.collect()] == [("a", 1)]


def test_bulk_writes_deal_the_present_rows_by_key(store, spark):
    docs = store.documents()
    docs.bulk_upsert([("a", {"i": 1}), ("b", {"i": 1})])
    items = spark.createDataFrame([("a", '{"i": 2}'), ("c", '{"i": 2}')], "id string, json string")
    plan = plan_of(docs._joined(store.log().state(), items))
    assert "BroadcastExchange" not in plan and "doc#" not in plan
    docs.upsert_frame(items)
    assert {(r.id, r.version) for r in docs.current().collect()} == {("a", 2), ("b", 1), ("c", 1)}


def test_kept_lexemes_are_the_words_of_the_text(spark, tmp_path):
    docs = Store(spark, str(tmp_path / "search"), search="simple").documents()
    texts = ["that\nthing", "thing\tThat", '"thing"\\that', "that\x01thing", "nthat thing", "thatK thing", "that İthing", "Ɓthat thing", None]
    docs.bulk_upsert([(str(i), {"text": t}) for i, t in enumerate(texts)])
    assert sorted(int(r.id) for r in docs.query().full_text_search("that thing", "simple").to_df().collect()) == [0, 1, 2, 3, 7]
    assert [r.id for r in docs.query().full_text_search("ithing", "simple").to_df().collect()] == ["6"]


def test_a_batch_is_taken_in_slices(store, monkeypatch):
    from ledgerleaf.operators import events as log
    from ledgerleaf.streaming import projections

    held, taken = [], []
    kind = type(store.spark.range(0))
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: held.append(collect(self)) or held[-1])
    for module in (log, projections):
        monkeypatch.setattr(module, "SLICE", 4, raising=False)
    events = store.events()
    for i in range(3):
        events.append(f"s{i}", ping(7, 7 * i))

    def odd(event, values):
        taken.append(event.global_seq)
        if event.body["i"] % 3:
            raise ValueError("odd")
        values["sum"] = values.get("sum", 0) + event.body["i"]

    before = store.log().state().version
    daemon = Daemon(events, batch=20, backoff_base_s=0.01).register("p", FunctionProjection(odd))
    assert daemon.tick_once("p") == ("processed", 20)
    assert max(map(len, held), default=0) <= 4 and taken == list(range(1, 21))
    state = store.log().state()
    assert state.version == before + 2 and daemon.checkpoint("p") == 20  # the lease and the batch
    assert state.values["sum"] == 63 and state.values["dlq_id"] == 13
    assert [(r.id, r.global_seq) for r in daemon.dlq("p").orderBy("id").collect()] == list(enumerate((i + 1 for i in range(20) if i % 3), 1))
    assert not store.log().files.names("_dead")
    assert daemon.run_until_idle("p") == 1 and daemon.dlq("p").count() == 14


def test_update_counts_are_dealt_by_key(spark):
    from ledgerleaf.queries import QUERIES
    from ledgerleaf import store_queries  # noqa: F401  registers its queries

    found = QUERIES["bulk_update_occ"](spark, "/root/testdata/sf0.001")
    assert "BroadcastExchange" not in plan_of(found)
    assert found.first().updated > 0

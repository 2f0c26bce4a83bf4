"""Catalogue queries that write to a store and read from it.

Each fills a store of its own under the checkpoint folder from whole tables, through
the store's interface, and returns what a reader sees afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.documents import Documents
from .operators.events import Events
from .operators.upcasting import UpcasterRegistry
from .plans import event_ops as ev
from .plans.event_ops import SubscriptionFilter
from .plans.predicate import Predicate as P
from .promoted import Promoted
from .queries import _SEQ_SQL, _SPLIT, _VERSIONS_SQL, _query, _table
from .sources.commitlog import Change
from .store import Store
from .streaming.projections import Daemon, FunctionProjection, Projection, ViewProjection, read_view
from .streaming.subscriptions import Subscriptions
from .streaming.views import _folder

#: The log of the events table, appended in the order of time and id.
_LOG = "(SELECT CAST(row_number() OVER (ORDER BY ts, event_id) AS BIGINT) AS global_seq, user_id, event_type, value, ts, props, event_id FROM events)"


def _store(spark: SparkSession, **how) -> Store:
    return Store(spark, _folder(spark), **how)


def _filled(spark: SparkSession, sf_dir: str, table: str, key: str, columns: list[str] | None = None, **how) -> Documents:
    """The rows of a table as documents."""
    docs = _store(spark, **how).documents()
    docs.upsert_frame(_items(_table(spark, sf_dir, table), key, columns))
    return docs


def _items(rows: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    return rows.select(F.col(key).cast("string").alias("id"), F.to_json(F.struct(*(columns or rows.columns))).alias("json"))


def _logged(spark: SparkSession, sf_dir: str, **how) -> Events:
    """The events table appended to a store, one stream a user."""
    events = _store(spark, **how).events()
    events.append_frame(_log_rows(_table(spark, sf_dir, "events")))
    return events


def _log_rows(rows: DataFrame) -> DataFrame:
    body = F.to_variant_object(F.struct(F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"), "value", F.col("user_id").alias("user"), "event_id"))
    return rows.select(F.col("user_id").cast("string").alias("stream_id"), "event_type", body.alias("body"), F.col("ts").alias("created_at"), F.struct("ts", "event_id").alias("order"))


def _body(path: str, kind: str):
    return F.variant_get("body", f"$.{path}", kind)


# --- documents -----------------------------------------------------------------
@_query("SELECT c_custkey, c_name, c_mktsegment AS segment, CAST(1 AS INTEGER) AS version FROM customer WHERE c_custkey IN (1, 7)")
def doc_get(spark, sf_dir):
    """Documents by id, whole and by field; a missing id gives nothing."""
    docs, found = _filled(spark, sf_dir, "customer", "c_custkey"), []
    for id_ in ("1", "7", "no such id"):
        if got := docs.get(id_):
            found.append((got[0]["c_custkey"], got[0]["c_name"], docs.get_field(id_, "c_mktsegment"), got[1]))
    return spark.createDataFrame(found, "c_custkey long, c_name string, segment string, version int")


@_query("SELECT id, version, price FROM (SELECT o_orderkey AS id, CAST(2 AS INTEGER) AS version, o_totalprice + 1 AS price FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT o_orderkey, CAST(1 AS INTEGER), o_totalprice FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT -o_orderkey - 1, CAST(1 AS INTEGER), o_totalprice + 1 FROM orders WHERE o_orderkey % 1000 = 0) t")
def bulk_upsert(spark, sf_dir):
    """Versions after an upsert of known and new documents."""
    docs = _upserted(spark, sf_dir)
    return docs.current().select(F.col("id").cast("long").alias("id"), "version", F.variant_get("doc", "$.price", "double").alias("price"))


def _upserted(spark: SparkSession, sf_dir: str) -> Documents:
    base = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    docs = _store(spark).documents()
    docs.upsert_frame(_items(base, "id", ["price"]))
    more = base.where("id % 10 = 0").unionByName(base.where("id % 1000 = 0").withColumn("id", -F.col("id") - 1))
    docs.upsert_frame(_items(more.withColumn("price", F.col("price") + 1), "id", ["price"]))
    return docs


@_query("SELECT o_orderkey AS id, CAST(1 AS INTEGER) AS version, o_totalprice AS price FROM orders WHERE o_orderkey % 10 = 0")
def store_history(spark, sf_dir):
    """What the upsert has replaced."""
    return _upserted(spark, sf_dir).history().select(F.col("id").cast("long").alias("id"), "version", F.variant_get("doc", "$.price", "double").alias("price"))


@_query(f"WITH cur AS (SELECT id, max(version) AS version FROM {_VERSIONS_SQL} v GROUP BY id), want AS (SELECT o_orderkey AS id, CAST(1 + o_orderkey % 2 AS INTEGER) AS expected FROM orders WHERE o_orderkey % 5 = 0) SELECT CAST(count(*) FILTER (WHERE cur.version = expected) AS BIGINT) AS updated, CAST(count(*) FILTER (WHERE cur.version IS NULL OR cur.version <> expected) AS BIGINT) AS conflicts FROM want LEFT JOIN cur ON cur.id = want.id")
def bulk_update_occ(spark, sf_dir):
    """Updates with expected versions: those that fit, and conflicts."""
    orders, docs = _table(spark, sf_dir, "orders"), _store(spark).documents()
    for least in range(3):
        docs.upsert_frame(_items(orders.where(f"o_orderkey % 3 >= {least}"), "o_orderkey"))
    want = _items(orders.where("o_orderkey % 5 = 0").withColumn("mark", F.lit("updated")), "o_orderkey").withColumn("expected", (F.col("id").cast("long") % 2 + 1).cast("int"))
    docs.update_frame(want)
    done = F.coalesce(F.variant_get("doc", "$.mark", "string") == "updated", F.lit(False))
    return want.join(ev.dealt(docs.current()), "id", "left").agg(F.count_if(done).alias("updated"), F.count_if(~done).alias("conflicts"))


@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 7 AS bucket, 'patched' AS status, CAST(2 AS INTEGER) AS version FROM events WHERE event_type = 'purchase'")
def doc_patch(spark, sf_dir):
    """Fields set on matching documents, siblings kept."""
    events, docs = _table(spark, sf_dir, "events"), _store(spark).documents()
    docs.upsert_frame(events.select(F.col("event_id").cast("string").alias("id"), F.col("props").alias("json")))
    docs.patch_frame(events.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), (F.col("event_id") % 7).alias("bucket")), {"bucket": F.col("bucket"), "status": "patched"})
    found = docs.current().select(F.col("id").cast("long").alias("event_id"), *[F.variant_get("doc", f"$.{n}", t).alias(n) for n, t in (("k", "bigint"), ("bucket", "bigint"), ("status", "string"))], "version")
    return found.where("status is not null")


@_query("SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING'")
def bulk_delete(spark, sf_dir):
    docs = _filled(spark, sf_dir, "customer", "c_custkey", ["c_custkey", "c_acctbal"])
    docs.delete_frame(_table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id")))
    return docs.query().select_field("c_custkey", "c_custkey").select_field("c_acctbal", "c_acctbal").to_df().select(F.col("c_custkey").cast("long").alias("c_custkey"), F.col("c_acctbal").cast("double").alias("c_acctbal"))


@_query("SELECT c_custkey FROM customer WHERE c_custkey IN (3, 5)")
def soft_deleted(spark, sf_dir):
    """Soft-deleted documents are found only where they are asked for; one is restored."""
    docs = _filled(spark, sf_dir, "customer", "c_custkey", ["c_custkey"])
    for id_ in ("3", "4", "5"):
        docs.soft_delete(id_)
    docs.restore("4")
    assert docs.get("3") is None and docs.get("4") is not None
    return docs.query().only_deleted().select_field("c_custkey", "c_custkey").to_df().select(F.col("c_custkey").cast("long").alias("c_custkey"))


@_query("SELECT p_partkey, lower(p_brand) AS brand FROM part WHERE lower(p_brand) = 'brand#12'")
def promoted_lower(spark, sf_dir):
    """A column kept at write with a transform; the filter reaches the scan."""
    docs = _filled(spark, sf_dir, "part", "p_partkey", ["p_partkey", "p_brand"], promoted=(Promoted("p_brand", "brand", "text", "lower({value})"), Promoted("p_partkey", "part_key", "bigint")))
    return docs.query().filter(P.eq("p_brand", "brand#12")).select_fields([("p_partkey", "p_partkey"), ("brand", "p_brand")]).to_df()


@_query("SELECT p_partkey, p_size FROM part WHERE p_size >= 40")
def promoted_backfill(spark, sf_dir):
    """Documents written before a column was promoted get it by a backfill."""
    docs = _filled(spark, sf_dir, "part", "p_partkey", ["p_partkey", "p_size"])
    later = Store(spark, docs.store.root, promoted=(Promoted("p_size", "size", "integer"), Promoted("p_partkey", "part_key", "bigint")))
    later.backfill()
    return later.documents().query().filter(P.ge("p_size", 40)).select_fields([("p_partkey", "p_partkey"), ("p_size", "p_size")]).to_df()


@_query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9À-ɏ])that([^a-z0-9À-ɏ]|$)') AND regexp_matches(lower(text), '(^|[^a-z0-9À-ɏ])thing([^a-z0-9À-ɏ]|$)')")
def fts_kept(spark, sf_dir):
    """Full text search in lexemes that were written with the documents."""
    docs = _filled(spark, sf_dir, "documents", "doc_id", ["text"], search="simple")
    return docs.query().full_text_search("that thing", "simple").to_df().select(F.col("id").cast("long").alias("doc_id"))


@_query("SELECT c_mktsegment AS tenant, CAST(count(*) AS BIGINT) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY c_mktsegment")
def tenant_query(spark, sf_dir):
    """Tenants in one log, each with its own documents under the same ids."""
    store, customers, found = _store(spark, mode="conjoined"), _table(spark, sf_dir, "customer"), None
    for tenant in ("BUILDING", "MACHINERY"):
        rows = customers.where(F.col("c_mktsegment") == tenant).select(F.row_number().over(ev.Window.orderBy("c_custkey")).alias("id"), "c_acctbal")
        store.documents().for_tenant(tenant).upsert_frame(_items(rows, "id", ["c_acctbal"]))
    for tenant in ("BUILDING", "MACHINERY"):
        own = store.documents().for_tenant(tenant).current().agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.variant_get("doc", "$.c_acctbal", "double")), 2).alias("total")).withColumn("tenant", F.lit(tenant))
        found = own if found is None else found.unionByName(own)
    return found


# --- event log ------------------------------------------------------------------
@_query(f"SELECT stream_seq, event_type, value FROM {_SEQ_SQL} s WHERE stream_id = 7")
def store_stream(spark, sf_dir):
    """One stream of the log; folders and row groups without it are not read."""
    return _logged(spark, sf_dir).stream("7").select("stream_seq", "event_type", _body("value", "double").alias("value"))


@_query(f"SELECT global_seq, event_id FROM {_LOG} l WHERE global_seq > 100 AND global_seq <= 150")
def store_after(spark, sf_dir):
    return _logged(spark, sf_dir).after(100, 50).select("global_seq", _body("event_id", "bigint").alias("event_id"))


@_query(f"SELECT retention_class, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN ts < TIMESTAMP '{_SPLIT}' THEN 'cold' ELSE 'hot' END AS retention_class FROM events) t GROUP BY retention_class")
def store_archive(spark, sf_dir):
    """Old events moved to the cold class."""
    from datetime import datetime, timezone

    events = _logged(spark, sf_dir)
    events.archive_before(datetime.fromisoformat(_SPLIT).replace(tzinfo=timezone.utc))
    return events.archive_status().select("retention_class", "n")


@_query(f"SELECT CAST(count(*) AS BIGINT) AS hot, (SELECT CAST(count(*) AS BIGINT) FROM events) AS every FROM events WHERE ts >= TIMESTAMP '{_SPLIT}'")
def store_hot_only(spark, sf_dir):
    """Hot reads and reads with the archive after a move."""
    from datetime import datetime, timezone

    events = _logged(spark, sf_dir)
    events.archive_before(datetime.fromisoformat(_SPLIT).replace(tzinfo=timezone.utc))
    hot = events.frame().agg(F.count(F.lit(1)).alias("hot"))
    return hot.crossJoin(F.broadcast(events.with_archived().frame().agg(F.count(F.lit(1)).alias("every"))))  # a row by a row


@_query("SELECT user_id AS stream_id, 'registered' AS state FROM events WHERE user_id % 2 = 0 GROUP BY user_id UNION ALL SELECT user_id, 'new' FROM events WHERE user_id % 2 <> 0 GROUP BY user_id")
def insert_ignore(spark, sf_dir):
    """Streams registered only where they are not there yet."""
    events, rows = _store(spark).events(), _table(spark, sf_dir, "events")
    events.append_frame(_log_rows(rows.where("user_id % 2 = 0")))
    events.append_frame(_log_rows(rows))
    streams = events.store.scan("streams")
    return streams.select(F.col("stream_id").cast("long").alias("stream_id"), F.when(F.col("rev") == 1, "registered").otherwise("new").alias("state"))


@_query("SELECT json_extract_string(props, '$.k') AS key, CAST(count(*) AS BIGINT) AS count, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS DOUBLE) AS sum FROM events GROUP BY 1")
def daemon_view(spark, sf_dir):
    """A view projection run by the daemon to the head of the log."""
    events = _logged(spark, sf_dir)
    daemon = Daemon(events, batch=100_000).register("by_k", ViewProjection("by_k", "k", "k"))
    daemon.replay("by_k")
    return read_view(events, "by_k")


class _Refusing(Projection):
    """Counts what it takes and raises at errors."""

    def apply(self, event, change):
        if event.typ == "error":
            raise ValueError("refused")
        change.set["taken"] = change.set.get("taken", 0) + 1


@_query(f"SELECT global_seq, event_type FROM {_LOG} l WHERE event_type = 'error'")
def dlq_list(spark, sf_dir):
    """Events that a projection refused; it ran to the head all the same."""
    events = _logged(spark, sf_dir)
    daemon = Daemon(events, batch=1_000_000, backoff_base_s=0.01).register("strict", _Refusing())
    daemon.replay("strict")
    return daemon.dlq("strict").select("global_seq", "event_type")


@_query("SELECT DISTINCT name FROM (SELECT 'proj_' || event_type AS name FROM events UNION ALL SELECT 'proj_' || lower(o_orderstatus) FROM orders) t ORDER BY name")
def name_discovery(spark, sf_dir):
    """Names that only dead letters or only checkpoints know."""
    events = _store(spark).events()
    daemon = Daemon(events)
    dead = _table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("id"), F.concat(F.lit("proj_"), "event_type").alias("name"), *[F.lit(None).cast("string").alias(c) for c in ("tenant_id", "event_type", "body", "error")], (F.col("event_id") + 1).alias("global_seq"), F.col("ts").alias("failed_at"))
    events.store.commit(lambda s: Change(add={"dlq": dead}))
    for r in _table(spark, sf_dir, "orders").select(F.lower("o_orderstatus").alias("s")).distinct().collect():  # a few
        daemon.reset(f"proj_{r.s}", 0)
    return spark.createDataFrame([(n,) for n in daemon.names()], "name string")


@_query(f"SELECT global_seq, event_type FROM {_LOG} l WHERE event_type = 'purchase' AND global_seq > 100 ORDER BY global_seq LIMIT 40")
def subscription_poll(spark, sf_dir):
    """One batch of a filtered subscription."""
    found = Subscriptions(_logged(spark, sf_dir)).poll("s", SubscriptionFilter(event_types=["purchase"]), 100, 40, 1024)
    return spark.createDataFrame([(e.global_seq, e.typ) for e in found], "global_seq long, event_type string")


@_query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END AS event_version, CASE WHEN event_type = 'purchase' THEN c_mktsegment END AS segment FROM events LEFT JOIN customer ON c_custkey = user_id")
def upcast_lookup(spark, sf_dir):
    """purchase v1 gains a field looked up in a table."""
    registry = UpcasterRegistry().register_lookup(("purchase", 1), ("purchase", 2), _table(spark, sf_dir, "customer"), "c_custkey", "$.user", {"segment": "c_mktsegment"})
    found = _logged(spark, sf_dir).with_upcasters(registry).after(0)
    return found.select(_body("event_id", "bigint").alias("event_id"), "event_version", _body("segment", "string").alias("segment"))


@_query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def function_projection(spark, sf_dir):
    """A projection of a Python function, its state kept in the log's values."""
    events = _logged(spark, sf_dir)

    def count(event, values):
        values[f"n:{event.typ}"] = values.get(f"n:{event.typ}", 0) + 1

    Daemon(events, batch=1_000_000).register("count", FunctionProjection(count)).replay("count")
    values = events.store.log().state().values
    return spark.createDataFrame([(k[2:], v) for k, v in values.items() if k.startswith("n:")], "event_type string, n long")

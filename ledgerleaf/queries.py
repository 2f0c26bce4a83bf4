"""The query catalogue on the driver's tables, with equivalent SQL.

orders, events and others serve as document collections (each row an object of
its columns); events serves as the event log: the stream is the user, global_seq
is event_id + 1, stream_seq numbers a user's events by time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import jsonpath
from .operators import folds
from .operators.upcasting import UpcasterRegistry, with_fields
from .plans import event_ops as ev
from .plans.predicate import Predicate as P
from .plans.query import Collection, CompiledQuery, DocumentQuery, union_all
from .session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def wrap(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(configure(spark), sf_dir)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return wrap


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str, name: str, key: str) -> DocumentQuery:
    return DocumentQuery(Collection.from_table(_table(spark, sf_dir, name), key))


def _props(spark: SparkSession, sf_dir: str) -> DocumentQuery:
    """events as documents of their JSON column, event_id kept native."""
    return DocumentQuery(Collection.from_json(_table(spark, sf_dir, "events"), "event_id", "props", {"event_id": "event_id"}))


#: global_seq, stream_id, created_at, event_type, value, body of the events table.
_LOG_SQL = "(SELECT event_id + 1 AS global_seq, user_id AS stream_id, ts AS created_at, event_type, value, props, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'cold' ELSE 'hot' END AS retention_class FROM events)"
_SEQ_SQL = f"(SELECT *, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY created_at, global_seq) AS INTEGER) AS stream_seq FROM {_LOG_SQL} e)"
_SPLIT = "2024-01-16"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    cold = F.col("ts") < F.lit(_SPLIT).cast("timestamp")
    return _table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("global_seq"), F.col("user_id").alias("stream_id"), F.col("ts").alias("created_at"), "event_type", "value", "props", F.when(cold, F.lit(ev.COLD)).otherwise(F.lit(ev.HOT)).alias("retention_class"))


def _sequenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.numbered(_log(spark, sf_dir), "stream_id", ["created_at", "global_seq"])


# --- documents: predicates ---------------------------------------------------
@_query("SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value > 100 ORDER BY value DESC NULLS FIRST, event_id LIMIT 20")
def doc_flagship(spark, sf_dir):
    """Filter, sort and page over documents."""
    q = _docs(spark, sf_dir, "events", "event_id").filter(P.eq("event_type", "purchase")).filter(P.gt("value", 100))
    q = q.select_fields([("event_id", "event_id"), ("user_id", "user_id"), ("value", "value")])
    return q.order_by_number("value", True).order_by_number("event_id").limit(20).to_df()


@_query("SELECT event_id, user_id FROM events WHERE event_type = 'purchase'")
def doc_eq(spark, sf_dir):
    return _docs(spark, sf_dir, "events", "event_id").filter(P.eq("event_type", "purchase")).select_fields([("event_id", "event_id"), ("user_id", "user_id")]).to_df()


@_query("SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) = 7")
def doc_eq_json(spark, sf_dir):
    return _props(spark, sf_dir).filter(P.eq("k", 7)).select_field("event_id", "event_id").to_df()


@_query("SELECT event_id FROM events WHERE NOT (event_type = 'view') AND CAST(json_extract_string(props, '$.k') AS DOUBLE) <> 7")
def doc_ne(spark, sf_dir):
    c = Collection.from_json(_table(spark, sf_dir, "events"), "event_id", "props", {"event_id": "event_id", "event_type": "event_type"})
    return DocumentQuery(c).filter(P.ne("event_type", "view")).filter(P.ne("k", 7)).select_field("event_id", "event_id").to_df()


@_query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def doc_in(spark, sf_dir):
    q = _docs(spark, sf_dir, "orders", "o_orderkey").filter(P.is_in("o_orderstatus", ["F", "P"])).filter(P.is_in("o_orderpriority", ["1-URGENT", "2-HIGH"]))
    return q.select_fields([("o_orderkey", "o_orderkey"), ("o_orderstatus", "o_orderstatus")]).to_df()


@_query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'O' OR o_totalprice < 100000) AND (o_orderpriority = '1-URGENT' OR o_totalprice >= 150000)")
def doc_not_or(spark, sf_dir):
    q = _docs(spark, sf_dir, "orders", "o_orderkey").filter(~(P.eq("o_orderstatus", "O") | P.lt("o_totalprice", 100000)))
    return q.filter(P.either(P.eq("o_orderpriority", "1-URGENT"), P.ge("o_totalprice", 150000))).select_field("o_orderkey", "o_orderkey").to_df()


@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50 AND CAST(json_extract_string(props, '$.k') AS DOUBLE) <= 90")
def doc_numeric_cmp(spark, sf_dir):
    found = _props(spark, sf_dir).filter(P.gt("k", 50)).filter(P.le("k", 90)).select_fields([("event_id", "event_id"), ("k", "k")]).to_df()
    return found.select("event_id", F.variant_get("k", "$", "double").alias("k"))


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount >= 0.05")
def doc_between(spark, sf_dir):
    q = _docs(spark, sf_dir, "lineitem", "l_orderkey").filter(P.between("l_quantity", 10, 12)).filter(P.ge("l_discount", 0.05))
    return q.select_fields([("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber")]).to_df()


@_query("SELECT event_id FROM events WHERE json_extract(props, '$.k') IS NOT NULL AND json_extract(props, '$.missing') IS NULL")
def doc_exists(spark, sf_dir):
    return _props(spark, sf_dir).filter(P.exists("k")).filter(~P.exists("missing")).select_field("event_id", "event_id").to_df()


@_query("SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) = 42")
def doc_contains(spark, sf_dir):
    return _props(spark, sf_dir).filter(P.contains("", {"k": 42})).select_field("event_id", "event_id").to_df()


@_query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^s.*(ring|bolt)$')")
def doc_regex(spark, sf_dir):
    return _docs(spark, sf_dir, "part", "p_partkey").filter(P.regex("p_name", "^s.*(ring|bolt)$")).select_fields([("p_partkey", "p_partkey"), ("p_name", "p_name")]).to_df()


@_query("SELECT p_partkey, p_type FROM part WHERE regexp_matches(lower(p_type), '^(economy|promo)')")
def doc_iregex(spark, sf_dir):
    return _docs(spark, sf_dir, "part", "p_partkey").filter(P.iregex("p_type", "^(economy|promo)")).select_fields([("p_partkey", "p_partkey"), ("p_type", "p_type")]).to_df()


@_query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def doc_select_fields(spark, sf_dir):
    return _docs(spark, sf_dir, "customer", "c_custkey").select_fields([("id", "c_custkey"), ("name", "c_name")]).select_field("segment", "c_mktsegment").to_df()


@_query("SELECT c_custkey, c_name FROM customer ORDER BY c_mktsegment ASC NULLS LAST, c_name ASC NULLS LAST LIMIT 10 OFFSET 20")
def doc_sort_page(spark, sf_dir):
    q = _docs(spark, sf_dir, "customer", "c_custkey").order_by("c_mktsegment").order_by("c_name").page(3, 10)
    return q.select_fields([("c_custkey", "c_custkey"), ("c_name", "c_name")]).to_df()


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey ASC NULLS LAST LIMIT 25 OFFSET 5")
def doc_sort_numeric(spark, sf_dir):
    q = _docs(spark, sf_dir, "orders", "o_orderkey").order_by_number("o_totalprice", True).order_by_number("o_orderkey").offset(5).limit(25)
    return q.select_fields([("o_orderkey", "o_orderkey"), ("o_totalprice", "o_totalprice")]).to_df()


class _Urgent(CompiledQuery):
    def configure(self, query: DocumentQuery) -> DocumentQuery:
        return query.filter(P.eq("o_orderpriority", "1-URGENT")).filter_if(False, lambda: P.eq("o_orderstatus", "F")).select_fields([("o_orderkey", "o_orderkey")])


@_query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def doc_compiled(spark, sf_dir):
    return _Urgent().on(Collection.from_table(_table(spark, sf_dir, "orders"), "o_orderkey")).to_df()


@_query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9À-ɏ])that([^a-z0-9À-ɏ]|$)') AND regexp_matches(lower(text), '(^|[^a-z0-9À-ɏ])thing([^a-z0-9À-ɏ]|$)')")
def fts_and(spark, sf_dir):
    c = Collection(_table(spark, sf_dir, "documents"), "doc_id", "text", None, search_col="text", promoted={"doc_id": "doc_id"})
    return DocumentQuery(c).full_text_search("that thing", "simple").select_field("doc_id", "doc_id").to_df()


# --- documents: includes and aggregates ---------------------------------------
@_query("SELECT o_orderkey, c_name AS customer, o_totalprice FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 150000")
def include_left(spark, sf_dir):
    q = _docs(spark, sf_dir, "orders", "o_orderkey").filter(P.gt("o_totalprice", 150000)).include(_table(spark, sf_dir, "customer"), "o_custkey", "c_custkey", "c")
    return q.select_fields([("o_orderkey", "o_orderkey"), ("o_totalprice", "o_totalprice")]).select_from("c", "customer", "c_name").to_df()


@_query("SELECT l_orderkey, l_linenumber, p_name AS part, s_name AS supplier FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity >= 45 ORDER BY s_name ASC NULLS LAST, p_name ASC NULLS LAST, l_orderkey DESC NULLS FIRST, l_linenumber ASC NULLS LAST LIMIT 50")
def include_multi(spark, sf_dir):
    q = _docs(spark, sf_dir, "lineitem", "l_orderkey").filter(P.ge("l_quantity", 45))
    q = q.include(_table(spark, sf_dir, "part"), "l_partkey", "p_partkey", "p").include(_table(spark, sf_dir, "supplier"), "l_suppkey", "s_suppkey", "s")
    q = q.select_fields([("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber")]).select_from("p", "part", "p_name").select_from("s", "supplier", "s_name")
    q = q.order_by_from("s", "s_name").order_by_from("p", "p_name").order_by_number("l_orderkey", True).order_by_number("l_linenumber")
    return q.limit(50).to_df()


@_query("SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment")
def include_group_sum(spark, sf_dir):
    q = _docs(spark, sf_dir, "orders", "o_orderkey").include(_table(spark, sf_dir, "customer"), "o_custkey", "c_custkey", "c")
    return q.group_by_from("c", "c_mktsegment").count("n").sum("o_totalprice", "total").to_df(keys=True).withColumn("total", F.round("total", 2))


@_query("SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY o_orderstatus")
def agg_all(spark, sf_dir):
    q = _docs(spark, sf_dir, "orders", "o_orderkey").group_by("o_orderstatus").count("n").sum("o_totalprice", "total").avg("o_totalprice", "mean").min("o_totalprice", "least").max("o_totalprice", "most")
    return q.to_df(keys=True).withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4)})


@_query("SELECT CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderpriority, o_orderstatus")
def agg_without_keys(spark, sf_dir):
    """Aggregates come without their group keys unless asked for."""
    return _docs(spark, sf_dir, "orders", "o_orderkey").group_by("o_orderpriority").group_by("o_orderstatus").count("n").to_df()


# --- documents: versions --------------------------------------------------------
_VERSIONS_SQL = "(SELECT o_orderkey AS id, v AS version, o_totalprice * v AS price FROM orders, (VALUES (1), (2), (3)) t(v) WHERE v <= 1 + o_orderkey % 3)"


def _versions(spark, sf_dir):
    v = F.explode(F.sequence(F.lit(1), F.least(F.lit(3), F.col("o_orderkey") % 3 + 1).cast("int")))
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice", v.alias("version")).select("id", "version", (F.col("o_totalprice") * F.col("version")).alias("price"))


@_query(f"SELECT id, version, price FROM {_VERSIONS_SQL} v QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1")
def latest_version(spark, sf_dir):
    return ev.latest(_versions(spark, sf_dir), ["id"])


@_query(f"SELECT id, version, price FROM {_VERSIONS_SQL} v QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) > 1")
def history(spark, sf_dir):
    return ev.superseded(_versions(spark, sf_dir), ["id"])


# --- event log ------------------------------------------------------------------
@_query(f"SELECT global_seq, stream_seq, event_type, value FROM {_SEQ_SQL} s WHERE stream_id = 7 ORDER BY stream_seq DESC LIMIT 20")
def stream_read(spark, sf_dir):
    """One stream, newest first; the filter reaches the scan below the numbering."""
    return ev.stream(_sequenced(spark, sf_dir), 7, limit=20, ascending=False).select("global_seq", "stream_seq", "event_type", "value")


@_query(f"SELECT global_seq, stream_id, event_type FROM {_LOG_SQL} e WHERE global_seq > 500 ORDER BY global_seq LIMIT 512")
def global_after(spark, sf_dir):
    return ev.after(_log(spark, sf_dir), 500, 512).select("global_seq", "stream_id", "event_type")


@_query(f"SELECT coalesce(max(global_seq), 0) AS head FROM {_LOG_SQL} e")
def head_seq(spark, sf_dir):
    return ev.head_sequence(_log(spark, sf_dir))


@_query(f"SELECT global_seq, stream_id, retention_class FROM {_LOG_SQL} e WHERE event_type = 'signup'")
def hot_cold_union(spark, sf_dir):
    log = _log(spark, sf_dir).where("event_type = 'signup'")
    return union_all([log.where(F.col("retention_class") == c) for c in (ev.HOT, ev.COLD)]).select("global_seq", "stream_id", "retention_class")


@_query(f"SELECT CAST(count(*) AS BIGINT) AS n, max(global_seq) AS head FROM {_LOG_SQL} e WHERE retention_class = 'hot'")
def hot_only(spark, sf_dir):
    return ev.visible(_log(spark, sf_dir), False).agg(F.count(F.lit(1)).alias("n"), F.max("global_seq").alias("head"))


@_query(f"SELECT global_seq, stream_id, event_type FROM {_LOG_SQL} e WHERE event_type IN ('purchase', 'signup') AND CAST(stream_id AS VARCHAR) LIKE '1%' AND global_seq > 100 ORDER BY global_seq LIMIT 500")
def sub_filter_batch(spark, sf_dir):
    wanted = ev.SubscriptionFilter(event_types=["purchase", "signup"], stream_prefix="1")
    return ev.subscription_batch(_log(spark, sf_dir), wanted, 100, 500, 1024).select("global_seq", "stream_id", "event_type")


@_query(f"SELECT CAST(stream_id AS VARCHAR) AS key, CAST(count(*) AS BIGINT) AS count, round(sum(coalesce(value, 0)), 4) AS sum FROM {_LOG_SQL} e GROUP BY stream_id")
def view_count_sum(spark, sf_dir):
    return ev.view(_log(spark, sf_dir), F.col("stream_id"), F.col("value")).withColumn("sum", F.round("sum", 4))


@_query(f"SELECT json_extract_string(props, '$.k') AS key, CAST(count(*) AS BIGINT) AS count, CAST(sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS DOUBLE) AS sum FROM {_LOG_SQL} e GROUP BY 1")
def view_json(spark, sf_dir):
    """The same view read by path from event bodies."""
    log = _log(spark, sf_dir).withColumn("found", jsonpath.value(F.parse_json("props"), "k"))  # parsed once
    return ev.view(log, ev.view_key(F.col("found"), ""), ev.view_number(F.col("found"), ""))


_FOLD_SQL = f"SELECT stream_id, CAST(max(stream_seq) AS INTEGER) AS version, CAST(sum(points * (CASE WHEN stream_seq % 2 = 0 THEN -1 ELSE 1 END)) AS BIGINT) AS balance, arg_max(event_type, stream_seq) AS last_type FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN 10 ELSE 1 END AS points FROM {_SEQ_SQL} s) p GROUP BY stream_id"


def _balance(events: DataFrame) -> DataFrame:
    start = F.struct(F.lit(0).cast("long").alias("balance"), F.lit("").alias("last_type"))

    def step(state, e):
        points = F.when(e["event_type"] == "purchase", F.lit(10)).otherwise(F.lit(1)) * F.when(e["stream_seq"] % 2 == 0, F.lit(-1)).otherwise(F.lit(1))
        return F.struct((state["balance"] + points).cast("long").alias("balance"), e["event_type"].alias("last_type"))

    def merge(a, b):
        return F.struct((a["balance"] + b["balance"]).alias("balance"), b["last_type"].alias("last_type"))

    return folds.fold_native(events, start, step, ["event_type"], merge=merge).select("stream_id", "version", "state.balance", "state.last_type")


@_query(_FOLD_SQL)
def aggregate_fold(spark, sf_dir):
    """An order-sensitive fold: signs alternate, the last type wins."""
    return _balance(_sequenced(spark, sf_dir))


@_query(_FOLD_SQL)
def aggregate_fold_python(spark, sf_dir):
    """The same fold by Python while reading sorted partitions."""

    def apply(state, typ, body):
        sign = 1 if state["n"] % 2 == 0 else -1
        return {"n": state["n"] + 1, "balance": state["balance"] + sign * (10 if typ == "purchase" else 1), "last_type": typ}

    found = folds.fold_frame(_sequenced(spark, sf_dir), lambda: {"n": 0, "balance": 0, "last_type": ""}, apply, body="props")
    state = F.from_json("state", "balance long, last_type string")
    return found.select("stream_id", "version", state["balance"].alias("balance"), state["last_type"].alias("last_type"))


@_query(f"SELECT stream_id, CAST(count(*) AS BIGINT) AS tail, CAST(min(stream_seq) AS INTEGER) AS first FROM {_SEQ_SQL} s WHERE stream_seq > CASE WHEN stream_id % 2 = 0 THEN 3 ELSE 0 END GROUP BY stream_id")
def snapshot_tail(spark, sf_dir):
    """Only the events past the snapshot are folded."""
    log = _sequenced(spark, sf_dir)
    snaps = log.where("stream_id % 2 = 0").select("stream_id").distinct().select("stream_id", F.lit(3).alias("version"), F.lit("{}").alias("body"))
    return folds.tail(log, snaps).groupBy("stream_id").agg(F.count(F.lit(1)).alias("tail"), F.min("stream_seq").alias("first"))


_SNAPS_SQL = "(SELECT DISTINCT user_id AS stream_id, CAST(2 AS INTEGER) AS version FROM events WHERE user_id % 3 = 0)"


def _heads_and_snaps(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    heads = events.groupBy(F.col("user_id").alias("stream_id")).agg(F.count(F.lit(1)).cast("int").alias("head"))
    snaps = events.where("user_id % 3 = 0").select(F.col("user_id").alias("stream_id")).distinct().withColumn("version", F.lit(2))
    return heads, snaps


@_query(f"WITH h AS (SELECT user_id AS stream_id, CAST(count(*) AS INTEGER) AS head FROM events GROUP BY user_id) SELECT h.stream_id, head, coalesce(s.version, 0) AS version, head - coalesce(s.version, 0) AS gap FROM h LEFT JOIN {_SNAPS_SQL} s ON s.stream_id = h.stream_id WHERE head - coalesce(s.version, 0) >= 5 ORDER BY head DESC, h.stream_id LIMIT 100")
def snapshot_candidates(spark, sf_dir):
    return ev.snapshot_candidates(*_heads_and_snaps(spark, sf_dir), threshold=5, batch=100)


@_query(f"WITH h AS (SELECT user_id AS stream_id, CAST(count(*) AS INTEGER) AS head FROM events GROUP BY user_id) SELECT CAST(count(*) FILTER (WHERE head - coalesce(s.version, 0) >= 5) AS BIGINT) AS candidates, CAST(coalesce(max(head - coalesce(s.version, 0)), 0) AS BIGINT) AS max_gap FROM h LEFT JOIN {_SNAPS_SQL} s ON s.stream_id = h.stream_id")
def snapshot_gap(spark, sf_dir):
    return ev.snapshot_gap(*_heads_and_snaps(spark, sf_dir), threshold=5)


@_query("SELECT name, last_seq, head, CAST(greatest(head - last_seq, 0) AS BIGINT) AS lag FROM (VALUES ('a', CAST(10 AS BIGINT)), ('b', CAST(100000000 AS BIGINT))) t(name, last_seq), (SELECT max(event_id + 1) AS head FROM events) h")
def projection_lag(spark, sf_dir):
    return ev.lag(_log(spark, sf_dir), spark.createDataFrame([("a", 10), ("b", 100000000)], "name string, last_seq long"))


@_query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN 3 ELSE 1 END AS event_version, CASE WHEN event_type = 'purchase' THEN 'order_placed' ELSE event_type END AS event_type, CASE WHEN event_type = 'purchase' THEN 'USD' END AS currency, CASE WHEN event_type = 'purchase' THEN 'K' || json_extract_string(props, '$.k') END AS label, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def upcast_chain(spark, sf_dir):
    """purchase v1 gains a currency, then a label, then another name."""
    reg = UpcasterRegistry()
    reg.register(("purchase", 1), ("purchase", 2), lambda b: with_fields(b, {"currency": "USD"}), native=True)
    reg.register(("purchase", 2), ("order_placed", 3), lambda b: with_fields(b, {"label": F.concat(F.lit("K"), F.variant_get(b, "$.k", "string"))}), native=True)
    events = _table(spark, sf_dir, "events").select("event_id", "event_type", F.lit(1).alias("event_version"), F.parse_json("props").alias("body"))
    found = reg.apply(events, pairs=[("purchase", 1)])
    return found.select("event_id", "event_version", "event_type", F.variant_get("body", "$.currency", "string").alias("currency"), F.variant_get("body", "$.label", "string").alias("label"), F.variant_get("body", "$.k", "bigint").alias("k"))


@_query(f"SELECT DISTINCT stream_id FROM {_LOG_SQL} e WHERE created_at < TIMESTAMP '2024-01-16' ORDER BY stream_id LIMIT 50")
def archive_candidates(spark, sf_dir):
    return ev.archive_candidates(_log(spark, sf_dir), F.lit(_SPLIT).cast("timestamp"), 50)


@_query(f"SELECT retention_class, CAST(count(*) AS BIGINT) AS n FROM {_LOG_SQL} e GROUP BY retention_class")
def retention_counts(spark, sf_dir):
    return ev.retention_counts(_log(spark, sf_dir))


@_query("SELECT cluster, CAST(count(*) FILTER (WHERE role = 'hot') AS BIGINT) AS hot, CAST(count(*) FILTER (WHERE role = 'cold') AS BIGINT) AS cold, count(*) FILTER (WHERE role = 'hot') = 1 AND count(*) FILTER (WHERE role = 'cold') >= max(min_cold) AS healthy FROM (VALUES ('a', 'hot', 1), ('a', 'cold', 1), ('b', 'hot', 2), ('b', 'cold', 1), ('c', 'cold', 0)) t(cluster, role, min_cold) GROUP BY cluster")
def cluster_health(spark, sf_dir):
    rows = [("a", "hot", 1), ("a", "cold", 1), ("b", "hot", 2), ("b", "cold", 1), ("c", "cold", 0)]
    return ev.cluster_health(spark.createDataFrame(rows, "cluster string, role string, min_cold_standbys int"))


# --- more of the document and event operators -------------------------------------
@_query("SELECT c_name, o_orderkey, o_totalprice FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_totalprice BETWEEN 50000 AND 120000 ORDER BY c_name ASC NULLS LAST, o_totalprice DESC NULLS FIRST, o_orderkey ASC NULLS LAST LIMIT 15 OFFSET 15")
def include_filter_page(spark, sf_dir):
    """Include, filter, order by the joined source, second page."""
    q = _docs(spark, sf_dir, "orders", "o_orderkey").filter(P.between("o_totalprice", 50000, 120000)).include(_table(spark, sf_dir, "customer"), "o_custkey", "c_custkey", "c")
    q = q.order_by_from("c", "c_name").order_by_number("o_totalprice", True).order_by_number("o_orderkey").page(2, 15)
    return q.select_fields([("o_orderkey", "o_orderkey"), ("o_totalprice", "o_totalprice")]).select_from("c", "c_name", "c_name").to_df()


@_query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') IN ('3', '5', '8')")
def doc_in_json(spark, sf_dir):
    return _props(spark, sf_dir).filter(P.is_in("k", [3, 5, 8])).select_field("event_id", "event_id").to_df()


@_query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join_ids(spark, sf_dir):
    wanted = _docs(spark, sf_dir, "customer", "c_custkey").filter(P.eq("c_mktsegment", "BUILDING")).select_field("o_custkey", "c_custkey").to_df()
    return _table(spark, sf_dir, "orders").join(wanted, "o_custkey", "left_semi").select("o_orderkey")


@_query("SELECT event_type AS key, CAST(count(*) AS BIGINT) AS count, round(sum(coalesce(value, 0)), 4) AS sum FROM events GROUP BY event_type")
def view_streaming(spark, sf_dir):
    """The count and sum view kept by Structured Streaming until its input is used up."""
    from .streaming.views import streamed_view

    schema, path = _table(spark, sf_dir, "events").schema, f"{sf_dir}/events.parquet"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        stream = spark.readStream.schema(schema).parquet(path)
    else:  # a stream reads folders: this one, and of it this file
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return streamed_view(stream, "event_type", "value").withColumn("sum", F.round("sum", 4))


from . import store_queries  # noqa: E402,F401  registers its queries here

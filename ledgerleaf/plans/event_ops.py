"""Reads of an event log as DataFrame plans.

An event log is a DataFrame with the columns of EVENT_COLUMNS (others may
follow).  Nothing here runs a job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonpath
from ..functions.jsonpath import Path

EVENT_COLUMNS = ("global_seq", "stream_id", "stream_seq", "event_type", "body", "headers", "causation_id", "correlation_id", "event_version", "tenant_id", "user_id", "is_tombstone", "created_at")
HOT, COLD = "hot", "cold"


@dataclass(frozen=True)
class SubscriptionFilter:
    """None lets everything through; the prefix is a LIKE pattern before its %."""

    event_types: Sequence[str] | None = None
    stream_ids: Sequence[str] | None = None
    stream_prefix: str | None = None

    def column(self) -> Column:
        found = F.lit(True)
        if self.event_types is not None:
            found = found & F.col("event_type").isin(list(self.event_types))
        if self.stream_ids is not None:
            found = found & F.col("stream_id").isin(list(self.stream_ids))
        if self.stream_prefix is not None:
            found = found & F.col("stream_id").cast("string").like(self.stream_prefix + "%")
        return found


def visible(events: DataFrame, include_archived: bool, tenant: str | None = None) -> DataFrame:
    """Hot events, and cold ones if asked for: a predicate on the class column, which the
    store's folders name, so that it opens no folder of cold events."""
    if not include_archived and "retention_class" in events.columns:
        events = events.where(F.col("retention_class") == HOT)
    return events if tenant is None else events.where(F.col("tenant_id") == tenant)


def header(name: str) -> Column:
    """The text of a header, null where there is none."""
    return jsonpath.text(F.col("headers"), (name,))


def has_header(name: str) -> Column:
    return jsonpath.value(F.col("headers"), (name,)).isNotNull()


def after(events: DataFrame, last: int, limit: int | None = None) -> DataFrame:
    """Global order: events past a sequence number, lowest first."""
    found = events.where(F.col("global_seq") > last).orderBy("global_seq")
    return found if limit is None else found.limit(limit)


def stream(events: DataFrame, stream_id: object, after_global: int | None = None, limit: int | None = None, ascending: bool = True) -> DataFrame:
    """One stream by stream_seq; after_global is a global sequence number."""
    found = events.where(F.col("stream_id") == stream_id)
    if after_global is not None:
        found = found.where(F.col("global_seq") > after_global)
    found = found.orderBy(F.col("stream_seq").asc() if ascending else F.col("stream_seq").desc())
    return found if limit is None else found.limit(limit)


def head_sequence(events: DataFrame) -> DataFrame:
    return events.agg(F.coalesce(F.max("global_seq"), F.lit(0).cast("long")).alias("head"))


def stream_heads(events: DataFrame) -> DataFrame:
    return events.groupBy("stream_id").agg(F.max("stream_seq").alias("head"))


def subscription_batch(events: DataFrame, wanted: SubscriptionFilter, cursor: int, batch: int, max_in_flight: int) -> DataFrame:
    return after(events.where(wanted.column()), cursor, min(batch, max_in_flight))


def numbered(events: DataFrame, stream_col: str, order: Sequence[str]) -> DataFrame:
    """Adds stream_seq from 1 within each stream."""
    return events.withColumn("stream_seq", F.row_number().over(Window.partitionBy(stream_col).orderBy(*order)).cast("int"))


def view(events: DataFrame, key: Column, number: Column | None = None) -> DataFrame:
    """count and sum by key: a missing key is '', a missing number 0."""
    total = F.lit(0.0) if number is None else F.coalesce(number.cast("double"), F.lit(0.0))
    return events.groupBy(F.coalesce(key.cast("string"), F.lit("")).alias("key")).agg(F.count(F.lit(1)).alias("count"), F.sum(total).alias("sum"))


def view_key(body: Column, path: Path) -> Column:
    """The key text of a view: '' where the path is missing, 'null' for JSON null."""
    found = jsonpath.value(body, path)
    return F.when(found.isNull(), F.lit("")).when(F.is_variant_null(found), F.lit("null")).otherwise(jsonpath.text(body, path))


def view_number(body: Column, path: Path) -> Column:
    """The number of a view: 0 for anything that is not a JSON number."""
    found = jsonpath.value(body, path)
    is_number = F.schema_of_variant(found).rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)")
    return F.when(is_number, F.try_variant_get(found, "$", "double")).otherwise(F.lit(0.0))


def snapshot_candidates(heads: DataFrame, snapshots: DataFrame, threshold: int, batch: int | None = None) -> DataFrame:
    """stream_id, head, version, gap of streams at least `threshold` events past
    their snapshot, the longest first."""
    found = heads.join(snapshots.select("stream_id", "version"), "stream_id", "left")
    found = found.select("stream_id", "head", F.coalesce("version", F.lit(0)).alias("version")).withColumn("gap", F.col("head") - F.col("version"))
    found = found.where(F.col("gap") >= threshold).orderBy(F.col("head").desc(), F.col("stream_id"))
    return found if batch is None else found.limit(batch)


def snapshot_gap(heads: DataFrame, snapshots: DataFrame, threshold: int) -> DataFrame:
    """candidates, max_gap over all streams."""
    gaps = heads.join(snapshots.select("stream_id", "version"), "stream_id", "left").select((F.col("head") - F.coalesce("version", F.lit(0))).alias("gap"))
    return gaps.agg(F.count_if(F.col("gap") >= threshold).alias("candidates"), F.coalesce(F.max("gap"), F.lit(0)).cast("long").alias("max_gap"))


def lag(events: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """name, last_seq, head, lag of every checkpoint (name, last_seq)."""
    found = checkpoints.select("name", "last_seq", head_sequence(events).scalar().alias("head"))
    return found.withColumn("lag", F.greatest(F.col("head") - F.col("last_seq"), F.lit(0)).cast("long"))


def retention_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("retention_class").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_tombstone").alias("tombstones")) if "is_tombstone" in events.columns else events.groupBy("retention_class").agg(F.count(F.lit(1)).alias("n"))


def archive_candidates(events: DataFrame, before: Column, limit: int) -> DataFrame:
    """Streams with events before a time, lowest ids first."""
    return events.where(F.col("created_at") < before).select("stream_id").distinct().orderBy("stream_id").limit(limit)


def cluster_health(nodes: DataFrame, min_cold: Column | None = None) -> DataFrame:
    """cluster, hot, cold, healthy of daemon nodes (cluster, role, min_cold_standbys)."""
    found = nodes.groupBy("cluster").agg(F.count_if(F.col("role") == HOT).alias("hot"), F.count_if(F.col("role") == COLD).alias("cold"), F.max("min_cold_standbys").alias("min_cold"))
    return found.select("cluster", "hot", "cold", ((F.col("hot") == 1) & (F.col("cold") >= F.col("min_cold"))).alias("healthy"))


def dealt(table: DataFrame) -> DataFrame:
    """A side of a join that grows with the log, to be dealt out by key.  Spark's estimate
    takes a variant for 2048 bytes, so that without it any table seems small enough to
    be broadcast through the driver."""
    return table.hint("merge")


def latest(versions: DataFrame, key: Sequence[str], version: str = "version") -> DataFrame:
    """The row of the greatest version of each key, without a sort of the groups."""
    rest = [c for c in versions.columns if c not in key]
    found = versions.groupBy(*key).agg(F.max_by(F.struct(*rest), version).alias("__row"))
    return found.select(*key, *[F.col(f"__row.`{c}`").alias(c) for c in rest]).select(*versions.columns)


def superseded(versions: DataFrame, key: Sequence[str], version: str = "version") -> DataFrame:
    """All rows but the latest of each key: the history."""
    heads = versions.groupBy(*key).agg(F.max(version).alias("__head")).withColumnsRenamed({k: f"__{k}" for k in key})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key])  # a missing tenant is a key too
    return versions.join(dealt(heads), same).where(F.col(version) < F.col("__head")).select(*versions.columns)

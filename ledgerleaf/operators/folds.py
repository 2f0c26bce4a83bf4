"""Ordered folds of event streams into aggregate states.

fold_native() folds with Column expressions: the events of a stream are gathered
sorted and reduced by a higher-order function, in the JVM.  Where states of
neighbouring stretches of a stream can be merged, stretches of SEGMENT events are
folded apart and then merged, so no more than that is ever gathered, and a very long
stream is folded by many tasks.  fold_frame() is for all other folds of long streams:
it hash-partitions by stream, sorts within partitions and folds while reading.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Events of a stream that are gathered at once, where states can be merged.
SEGMENT = 4096


def fold_native(events: DataFrame, start: Column, step: Callable[[Column, Column], Column], fields: list[str], finish: Callable[[Column], Column] | None = None, merge: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """stream_id, version, state.  step(state, event) sees a struct of stream_seq and
    `fields`; merge(earlier, later) gives the state of two neighbouring stretches, each
    folded from `start`."""
    row, finish = F.struct("stream_seq", *fields), finish or (lambda s: s)
    if merge is not None:
        stretch = F.floor(F.col("stream_seq") / SEGMENT).alias("__stretch")
        parts = events.groupBy("stream_id", stretch).agg(F.array_sort(F.collect_list(row)).alias("__events"), F.max("stream_seq").alias("version"))
        parts = parts.select("stream_id", "version", F.struct("__stretch", F.aggregate("__events", start, step).alias("state")).alias("__part"))
        whole = parts.groupBy("stream_id").agg(F.array_sort(F.collect_list("__part")).alias("__parts"), F.max("version").alias("version"))
        return whole.select("stream_id", "version", F.aggregate("__parts", start, lambda s, p: merge(s, p["state"]), finish).alias("state"))
    gathered = events.groupBy("stream_id").agg(F.array_sort(F.collect_list(row)).alias("__events"), F.max("stream_seq").alias("version"))
    return gathered.select("stream_id", "version", F.aggregate("__events", start, step, finish).alias("state"))


def fold_frame(events: DataFrame, new: Callable[[], Any], apply: Callable[[Any, str, Any], Any], body: str = "body", state: str | None = None) -> DataFrame:
    """stream_id, version, state (JSON) by a Python fold.

    apply(state, event_type, body) returns the new state.  With `state`, a column
    of JSON text, the fold of a stream starts from the value of its first event's row."""
    kind = events.schema["stream_id"].dataType.simpleString()
    text = F.to_json(body) if events.schema[body].dataType.simpleString() == "variant" else F.col(body).cast("string")
    rows = events.select("stream_id", "stream_seq", "event_type", text.alias("body"), (F.col(state) if state else F.lit(None)).cast("string").alias("start"))
    rows = rows.repartition("stream_id").sortWithinPartitions("stream_id", "stream_seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, value, version, done = None, None, 0, []
        first = True
        for batch in batches:
            for stream, seq, typ, raw, start in zip(*(c.to_pylist() for c in batch.columns)):
                if first or stream != at:
                    if not first:
                        done.append((at, version, json.dumps(value)))
                    at, value, first = stream, json.loads(start) if start else new(), False
                value, version = apply(value, typ, json.loads(raw) if raw else None), seq
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)
                done = []
        if not first:
            done.append((at, version, json.dumps(value)))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)

    from pyspark.sql.pandas.types import to_arrow_type

    names = ["stream_id", "version", "state"]
    types = [to_arrow_type(events.schema["stream_id"].dataType), pa.int32(), pa.string()]
    return rows.mapInArrow(run, f"stream_id {kind}, version int, state string")


def tail(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Events past the snapshot of their stream, with its body as `snapshot`."""
    known = snapshots.select("stream_id", F.col("version").alias("__version"), F.col("body").alias("snapshot"))
    found = events.join(known, "stream_id", "left")
    return found.where(F.col("stream_seq") > F.coalesce("__version", F.lit(0))).drop("__version")

"""The event log as a Structured Streaming source; the offset is global_seq."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import urlparse

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.commitlog import State, advanced

#: Columns as the stream gives them: JSON text for body and headers.
SCHEMA = "global_seq long, stream_id string, stream_seq int, event_type string, body string, headers string, event_version int, tenant_id string, created_at timestamp"
NAME = "ledgerleaf_events"


class _Range(InputPartition):
    def __init__(self, path: str, after: int, upto: int):
        self.path, self.after, self.upto = path, after, upto


class _Reader(DataSourceStreamReader):
    """Reads the files that the commit log names, one partition for each file of a
    folder that holds sequence numbers of the batch.

    Spark tells a reader neither the trigger nor the offset of the checkpoint before
    it asks for an end, and asks once in an availableNow run: the first end is the
    head of the log.  Those after it are at most maxEventsPerTrigger further on."""

    def __init__(self, options: dict):
        parsed = urlparse(options["path"])
        if parsed.scheme not in ("", "file"):
            raise ValueError("this source reads logs on shared local paths")
        self.root, self.most = parsed.path.rstrip("/"), int(options.get("maxeventspertrigger", 0))
        self.start = int(options.get("startafter", 0))
        self._at = None  # the end given last
        self._known = State()

    def _read(self, name: str) -> str:
        with open(os.path.join(self.root, name), encoding="utf-8") as f:
            return f.read()

    def _state(self) -> State:
        """The state of the log; entries read before are not read again."""
        folder = os.path.join(self.root, "_log")
        names = set(os.listdir(folder)) if os.path.isdir(folder) else set()
        self._known = advanced(self._known, names, self._read)
        return self._known

    def initialOffset(self) -> dict:
        return {"seq": self.start}

    def latestOffset(self) -> dict:
        head = max(self._state().values.get("global_seq", 0), self.start)
        if self.most and self._at is not None:
            head = min(head, self._at + self.most)
        self._at = head
        return {"seq": head}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        files, state = [], self._state()
        for folder in state.tables.get("events", []):
            facts = state.facts.get(folder, {})
            if facts.get("hi", end["seq"]) <= start["seq"] or facts.get("lo", end["seq"]) > end["seq"]:
                continue  # nothing of this batch is there
            path = os.path.join(self.root, folder)
            files += [os.path.join(path, n) for n in sorted(os.listdir(path)) if n.endswith(".parquet")]
        return [_Range(f, start["seq"], end["seq"]) for f in files]

    def read(self, partition: _Range) -> Iterator[tuple]:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        names = ["global_seq", "stream_id", "stream_seq", "event_type", "body", "headers", "event_version", "tenant_id", "created_at"]
        file = pq.ParquetFile(partition.path)
        at = file.schema_arrow.get_field_index("global_seq")
        groups = []  # row groups with numbers of the batch
        for g in range(file.num_row_groups):
            about = file.metadata.row_group(g).column(at).statistics
            if about is None or not about.has_min_max or about.max > partition.after and about.min <= partition.upto:
                groups.append(g)
        for batch in file.iter_batches(columns=names, batch_size=4096, row_groups=groups):
            seq = batch.column("global_seq")
            found = batch.filter(pc.and_(pc.greater(seq, partition.after), pc.less_equal(seq, partition.upto)))
            at = found.schema.get_field_index("created_at")
            found = found.set_column(at, "created_at", found.column(at).cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC")))
            for r in found.to_pylist():
                yield (r["global_seq"], r["stream_id"], r["stream_seq"], r["event_type"], _variant(r["body"]), _variant(r["headers"]), r["event_version"], r["tenant_id"], r["created_at"])

    def commit(self, end: dict) -> None:
        pass


def _variant(v: dict | None) -> str | None:
    """The JSON text of a variant column as Parquet stores it."""
    if v is None:
        return None
    from pyspark.sql.types import VariantVal

    return VariantVal(v["value"], v["metadata"]).toJson()


class EventSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_stream(spark: SparkSession, root: str, start_after: int = 0, max_events: int = 0):
    """A streaming DataFrame of a store's log (its folder, such as <root>/main).

    max_events bounds the micro-batches after the first of a run, which takes all
    events there are; a run that ends by itself (availableNow) has no bound."""
    spark.dataSource.register(EventSource)
    return spark.readStream.format(NAME).option("path", root).option("startAfter", str(start_after)).option("maxEventsPerTrigger", str(max_events)).load()

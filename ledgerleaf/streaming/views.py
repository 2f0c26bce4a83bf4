"""Views kept by Structured Streaming over any streaming DataFrame."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import event_ops


def _folder(spark: SparkSession) -> str:
    """A folder that all executors see: the cluster's checkpoint folder where set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines see")
        base = "file://" + tempfile.mkdtemp(prefix="ledgerleaf-")
    return f"{base.rstrip('/')}/view-{uuid.uuid4().hex}"


def streamed_view(stream: DataFrame, key: str, number: str, out: str | None = None) -> DataFrame:
    """key, count, sum: each micro-batch is aggregated and written under its id, so
    a batch that is run again replaces itself; the view adds the batches up."""
    spark = stream.sparkSession
    out = out or _folder(spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        event_ops.view(batch, F.col(key), F.col(number)).write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema("key string, count long, sum double, batch long").parquet(f"{out}/data")
    return found.groupBy("key").agg(F.sum("count").alias("count"), F.sum("sum").alias("sum"))

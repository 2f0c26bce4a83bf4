"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # duplicate object keys keep the last value
    "spark.sql.variant.allowDuplicateKeys": "true",
    # the streaming source reads variant columns as they are
    "spark.sql.variant.writeShredding.enabled": "false",
    "spark.sql.variant.inferShreddingSchema": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Applies SETTINGS to a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark

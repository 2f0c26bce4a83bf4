"""Promoted columns: document paths kept as native columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import jsonpath

#: Types that a promoted column can have, and Spark's names for them.
PROMOTED_TYPES = {"text": "string", "integer": "int", "bigint": "bigint", "numeric": "decimal(38,18)", "boolean": "boolean", "timestamptz": "timestamp", "uuid": "string", "jsonb": "variant"}


@dataclass(frozen=True)
class Promoted:
    """A document path kept as a native column; transform is a template of {value}."""

    path: str
    column: str
    kind: str = "text"
    transform: str = "{value}"

    def data_type(self) -> T.DataType:
        return T.VariantType() if self.kind == "jsonb" else T._parse_datatype_string(PROMOTED_TYPES[self.kind])


def promote(frame: DataFrame, fields: list[Promoted], doc: str = "doc") -> DataFrame:
    """frame with promoted columns; any SQL template is allowed here."""
    for p in fields:
        raw = jsonpath.value(F.col(doc), p.path) if p.kind == "jsonb" else jsonpath.text(F.col(doc), p.path).try_cast(PROMOTED_TYPES[p.kind])
        made = F.expr(p.transform.replace("{value}", "__value"))
        frame = frame.withColumn("__value", raw).withColumn(p.column, made if p.kind == "jsonb" else made.cast(PROMOTED_TYPES[p.kind])).drop("__value")
    return frame

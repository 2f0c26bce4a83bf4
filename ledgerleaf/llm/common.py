"""Helpers that the operators of this subpackage share.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``; a temporary folder is made only where that setting is
absent (tests on one machine).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows of an Arrow batch: whole texts travel to Python, so batches are kept short.
BATCH_ROWS = 512
#: Bytes of an Arrow batch: very long texts make it shorter still.
BATCH_BYTES = 8 << 20
#: Spark's own defaults, which are the only values that prepare() replaces.
_DEFAULT_BATCH, _DEFAULT_BYTES = "10000", "67108864b"
#: Keys that are treated as hot at most, and rows of a key that never make it hot.
HOT_KEYS, HOT_ROWS = 20_000, 1_000


def prepare(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small unless the user has chosen a size."""
    for key, default, own in (("Records", _DEFAULT_BATCH, BATCH_ROWS), ("Bytes", _DEFAULT_BYTES, BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.max{key}PerBatch"
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, str(own))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver see."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines see")
        found = "file://" + tempfile.mkdtemp(prefix="ledgerleaf-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_OPEN: list[list[str]] = []


def fresh_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are removed at the end, but for the last one, which must
    be all that is read afterwards."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.pop()
        for path in made[:-1]:
            drop_path(spark, path)
        if _OPEN and made:
            _OPEN[-1].append(made[-1])


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, and a
    lost executor makes nothing before this point run again."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_bound(total: int) -> int:
    """Of `total` rows fewer than HOT_KEYS keys have more than so many."""
    return max(HOT_ROWS, total // HOT_KEYS)


def hot_join(rows: DataFrame, table: DataFrame, on: list[str], total: int, n: str = "n") -> DataFrame:
    """Inner join of `total` rows with a table of one row a key, in which n is the
    number of rows of the key or more.  Rows of hot keys meet a broadcast of those
    keys (HOT_KEYS at most) where they are; the others are dealt out by key."""
    most = hot_bound(total)
    hot = table.where(F.col(n) > most)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(table.where(F.col(n) <= most), on)
    return rows.join(F.broadcast(hot), on).unionByName(cold)


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """key, parts of the hot keys of rows (HOT_KEYS at most)."""
    most = hot_bound(rows.count())
    return rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts")).where("parts > 1")


def salted_join(rows: DataFrame, table: DataFrame, key: str, by: str, hot: DataFrame) -> DataFrame:
    """Inner join with a table of one row a key whose rows are too wide to broadcast:
    rows of a hot key are dealt out to its parts by `by`, and the table's row is
    repeated for each part."""
    hot, part = F.broadcast(hot), F.coalesce("parts", F.lit(1))
    rows = rows.join(hot, key, "left").withColumn("part", F.pmod(F.xxhash64(by), part).cast("int")).drop("parts")
    table = table.join(hot, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), part - 1))).drop("parts")
    return rows.join(table, [key, "part"]).drop("part")


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that count, under fixed names; null texts are empty."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_text(make: Callable[[], Callable[[list[str]], list]], schema: T.StructType) -> Callable[[Column], Column]:
    """A column function over whole texts: make() runs once a task and returns a
    function from a list of texts to a list of rows (dicts) of the schema."""
    arrow = pa.struct([pa.field(f.name, _arrow(f.dataType)) for f in schema.fields])

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = make()
        for texts in it:
            yield pa.array(work([t or "" for t in texts.to_pylist()]), type=arrow)

    run.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, schema)


def _arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def crc_mod(column: str, by: int) -> Column:
    """crc32 of the id written as text, modulo `by`."""
    return F.crc32(F.col(f"`{column}`").cast("string").cast("binary")) % F.lit(by)


def stratified(rows: DataFrame, key: str, quotas: Callable[[dict], dict], *by: str) -> DataFrame:
    """Of each value of key, the quotas(counts) rows with the least hashes of the
    columns `by`.  Adds __h, the order.

    Rows are counted by the bits of their hash, which says how far down enough rows
    of each key lie, so that only about twice the sample is dealt by key."""
    spark = rows.sparkSession
    h = F.xxhash64(*by).bitwiseAND(F.lit((1 << 61) - 1))
    rows = rows.withColumn("__h", h).withColumn("__bits", F.length(F.bin("__h")))
    levels: dict = {}
    for r in rows.groupBy(key, "__bits").count().collect():
        levels.setdefault(r[key], {})[r["__bits"]] = r["count"]
    quota, cuts = quotas({k: sum(v.values()) for k, v in levels.items()}), []
    for k, found in levels.items():
        have = 0
        for bits in sorted(found):
            have += found[bits]
            if have >= quota[k]:
                break
        cuts.append((k, bits, quota[k]))
    cut = spark.createDataFrame(cuts, T.StructType([rows.schema[key], T.StructField("__cut", T.IntegerType()), T.StructField("__quota", T.IntegerType())]))
    rows = rows.join(F.broadcast(cut), key).where("__bits <= __cut")
    most = max([n for *_, n in cuts], default=0)  # a constant bound, which Spark applies before it deals the rows
    place = F.row_number().over(Window.partitionBy(key).orderBy("__h", *by))
    return rows.withColumn("__place", place).where(F.col("__place") <= most).where("__place <= __quota").drop("__bits", "__cut", "__quota", "__place")

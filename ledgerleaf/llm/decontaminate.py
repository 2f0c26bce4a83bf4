"""Benchmark decontamination by Wu-Manber search over words.

Words are runs of ASCII digits, lower-cased ASCII letters and non-ASCII
characters.  The patterns are all windows of 10 consecutive words of each
benchmark item (an item of 1 to 9 words is one shorter window).  For each window
length a table gives how far a block of two words allows the search to shift; at
shift 0 the suffix block chooses a bucket, the prefix block narrows it, and a
direct comparison of the words confirms an occurrence.

The benchmark is written in blocks of about BLOCK_BYTES to the shared folder, and
workers read it from there: up to KEPT_BLOCKS are kept by a worker, more are read one
after another for each CHUNK_BYTES of texts.  Each block is searched for in every whole
text and the findings are united, so neither side is cut and none comes to the driver.
A benchmark of n blocks takes n passes over the words of a text.

Null, empty and very long texts are taken whole; such without words are clean.  Items
without a text or words have no windows; items without an id are searched for like
the others, count as one item in all and have no part in the list of ids; rows that
repeat an item add nothing.  Either table may be empty.  Rows may repeat ids; other
columns are ignored, or kept by without_contaminated(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW = 10
#: Bytes of benchmark text in a block (more where an item is longer), blocks that a worker
#: keeps, and bytes of texts that are searched for one block after another beyond that.
BLOCK_BYTES, KEPT_BLOCKS, CHUNK_BYTES = 1 << 20, 4, 32 << 20

_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class WuManber:
    """Searches word lists for windows of one length, all at once."""

    def __init__(self, length: int, windows: Iterator[tuple[str | None, list[bytes], int]]):
        """windows: (item, words of the item, start of the window); an item may be None."""
        self.m, self.b = length, min(2, length)
        self.default = self.m - self.b + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[bytes, list[tuple[str | None, list[bytes], int]]]] = {}
        for item, words, start in windows:
            for end in range(self.b, self.m + 1):
                block = b" ".join(words[start + end - self.b : start + end])
                self.shift[block] = min(self.shift.get(block, self.default), self.m - end)
            prefix = b" ".join(words[start : start + self.b])
            self.buckets.setdefault(block, {}).setdefault(prefix, []).append((item, words, start))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, str | None]]:
        """(start, item) of every occurrence."""
        m, n, default, shift, buckets = self.m, len(words), self.default, self.shift.get, self.buckets
        at, two = m, self.b == 2
        while at <= n:
            block = words[at - 2] + b" " + words[at - 1] if two else words[at - 1]
            if s := shift(block, default):
                at += s
                continue
            start = at - m
            prefix = words[start] + b" " + words[start + 1] if two else block
            if found := buckets[block].get(prefix):
                here = words[start:at]
                for item, own, k in found:
                    if own[k : k + m] == here:
                        yield start, item
            at += 1


def searchers(items: list[tuple[str | None, str]], window: int = WINDOW) -> list[WuManber]:
    by_length: dict[int, list] = {}
    for item, text in items:
        words = words_of(text)
        if m := min(window, len(words)):
            by_length.setdefault(m, []).extend((item, words, k) for k in range(len(words) - m + 1))
    return [WuManber(m, iter(found)) for m, found in sorted(by_length.items())]


def _stored_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[str, int]:
    """The folder of the blocks (block=0, block=1, ...) and their number."""
    rows = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, path = -(-size // BLOCK_BYTES), common.fresh_path(benchmark.sparkSession, "benchmark-blocks")
    if n:
        block = F.pmod(F.xxhash64("item", "text"), F.lit(n)).alias("block")
        rows.select("item", "text", block).repartition(min(n, 4096), "block").write.partitionBy("block").parquet(path)
    return path, n


_KEPT: dict[tuple[str, int], list[WuManber]] = {}


def _machines(path: str, block: int, keep: bool) -> list[WuManber]:
    """The searchers of a block; a worker keeps those of one small benchmark."""
    if (path, block) in _KEPT:
        return _KEPT[path, block]
    where, top = fs.FileSystem.from_uri(path)
    names = [f.path for f in where.get_file_info(fs.FileSelector(f"{top}/block={block}", allow_not_found=True)) if f.path.endswith(".parquet")]
    items = [(r["item"], r["text"]) for name in names for r in pq.ParquetFile(where.open_input_file(name)).read(columns=["item", "text"]).to_pylist()]
    found = searchers(items)
    if keep:
        if any(p != path for p, _ in _KEPT):
            _KEPT.clear()
        _KEPT[path, block] = found
    return found


def search(texts: list[str], blocks: Iterator[list[WuManber]]) -> list[dict]:
    words = [words_of(t) for t in texts]
    starts, items = [set() for _ in texts], [set() for _ in texts]
    for machines in blocks:
        for i, own in enumerate(words):
            for machine in machines:
                for start, item in machine.find(own):
                    starts[i].add((start, start + machine.m))
                    items[i].add(item)
    out = []
    for own, hit, found in zip(words, starts, items):
        spans: list[list[int]] = []
        for a, b in sorted(hit):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(b, spans[-1][1])
            else:
                spans.append([a, b])
        out.append({"n_words": len(own), "spans": [{"a": a, "b": b} for a, b in spans], "items": sorted(found - {None}) + [None] * (None in found)})
    return out


def findings(df: DataFrame, benchmark: DataFrame, text: Column, item_col: str = "item_id", item_text_col: str = "text") -> Column:
    """A struct column: n_words, spans (of hit words), items (ids, distinct)."""
    common.prepare(df.sparkSession)
    path, n = _stored_blocks(benchmark, item_col, item_text_col)
    few, chunk, arrow = n <= KEPT_BLOCKS, CHUNK_BYTES, common._arrow(_FOUND)

    def searched(held: list[pa.Array]) -> Iterator[pa.Array]:
        rows = search([t or "" for texts in held for t in texts.to_pylist()], (_machines(path, b, few) for b in range(n)))
        at = 0
        for texts in held:
            yield pa.array(rows[at : at + len(texts)], arrow)
            at += len(texts)

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held, size = [], 0
        for texts in it:
            held.append(texts)
            size += texts.nbytes
            if few or size >= chunk:
                yield from searched(held)
                held, size = [], 0
        if held:
            yield from searched(held)

    run.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, _FOUND)(text)


def _covered(spans: Column) -> Column:
    """Words in the union of sorted spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0).cast("long"), s["b"] - F.greatest(s["a"], acc["end"]))).alias("n"),
        F.greatest(acc["end"], s["b"]).alias("end"),
    )
    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = common.id_and_text(df, id_col, text_col)
    rows = rows.select("doc_id", findings(rows, benchmark, F.col("text")).alias("r"))
    ids = F.array_join(F.array_sort("r.items"), ",")
    return rows.select(
        "doc_id",
        F.col("r.n_words").alias("n_words"),
        _covered(F.col("r.spans")).alias("n_hit"),
        F.size("r.items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        (F.size("r.spans") > 0).alias("contaminated"),
    )


def without_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, whose text has no benchmark window."""
    spans = findings(df, benchmark, common.text_of(text_col))["spans"]
    return df.where(F.size(spans) == 0)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


OP5_SQL = r"""
WITH letters AS (SELECT '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS pattern),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), pattern) AS w FROM documents, letters),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), pattern) AS w FROM benchmark, letters WHERE text IS NOT NULL),
bi AS (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, CAST(len(w) - least(10, len(w)) + 2 AS BIGINT))) AS i FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s FROM bi),
ks AS (SELECT DISTINCT k FROM p),
di AS (SELECT doc_id, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM d, ks WHERE len(w) >= k),
ds AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s FROM di),
o AS (SELECT ds.doc_id, ds.k, ds.i, p.item FROM ds JOIN p ON ds.k = p.k AND ds.s = p.s),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM (SELECT DISTINCT doc_id, i, k FROM o)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""

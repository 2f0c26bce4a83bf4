"""Token counts without ids.

Tokens never cross a pre-token, so a text has as many as its pre-tokens have in
sum.  In one pass the texts are cut into pre-tokens, and their frequencies in each
document are kept by block: a block is a row with the distinct pre-tokens of some
BLOCK_CHARS characters of text, and for each document how often it has which.
All places of a pre-token are brought together, in order, where it is counted once;
this merge join gives each place its count.  The counts go back to the blocks, where
they are multiplied by the frequencies and summed.  A pre-token travels once for each
block that has it and not once for each document; no ids are made of texts, and of a
distinct pre-token only their number is taken.

Special strings of the vocabulary are one token each, and text around them is cut
by itself, as the library does.  Null and empty texts have 0 bytes and 0 tokens; a
very long text is a block alone; an empty table gives an empty result.  Repeated
rows each give a row, ids are of any type and may be null; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import PreTokens, vocabulary

#: Characters of text in a block; a longer text is a block alone.
BLOCK_CHARS = 32 << 20


class Block:
    """Frequencies of pre-tokens by document, pre-tokens numbered as they come."""

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}
        self.docs: list = []
        self.bytes: list[int] = []
        self.sizes: list[int] = []
        self.pairs: list[np.ndarray] = []
        self.chars = 0

    def add(self, doc: object, text: str, parts: list[str]) -> None:
        times, codes = Counter(parts), self.codes
        pairs = np.empty((len(times), 2), np.uint32)
        pairs[:, 0] = [codes.setdefault(p, len(codes)) for p in times]
        pairs[:, 1] = list(times.values())
        pairs = pairs[np.argsort(pairs[:, 0])]
        pairs[1:, 0] -= pairs[:-1, 0].copy()  # small numbers, which compress
        self.docs.append(doc)
        self.bytes.append(len(text.encode("utf-8", "surrogatepass")))
        self.sizes.append(len(pairs))
        self.pairs.append(pairs)
        self.chars += len(text)

    def row(self, name: int, schema: pa.Schema) -> pa.RecordBatch:
        pairs = np.concatenate(self.pairs) if self.pairs else np.empty((0, 2), np.uint32)
        planes = pairs.view(np.uint8).reshape(-1, 8).T  # high bytes are nearly all 0
        packed = zstandard.ZstdCompressor(level=1).compress(planes.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((name, self.docs, self.bytes, self.sizes, packed, list(self.codes)), schema)], schema=schema)


def sums(sizes: np.ndarray, packed: bytes, counts: np.ndarray) -> np.ndarray:
    """Tokens of each document of a block: frequencies times counts of pre-tokens."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1)
    steps, times = np.ascontiguousarray(planes.T).view(np.uint32).T.astype(np.int64)
    ends = np.cumsum(sizes)
    codes = np.cumsum(steps)
    begins = (ends - sizes)[sizes > 0]
    base = np.zeros(len(sizes), np.int64)
    base[sizes > 0] = codes[begins] - steps[begins]  # where the codes of each document start from
    total = np.concatenate(([0], np.cumsum(counts[codes - np.repeat(base, sizes)] * times)))
    return total[ends] - total[ends - sizes]


def frequencies(rows: DataFrame, vocabulary_path: str) -> DataFrame:
    """Blocks (block, docs, bytes, sizes, pairs, words) of rows (doc_id, text)."""
    kind = rows.schema["doc_id"].dataType
    schema = pa.schema([("block", pa.int64()), ("docs", pa.list_(common._arrow(kind))), ("bytes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("pairs", pa.binary()), ("words", pa.list_(pa.string()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = PreTokens(vocabulary_path)
        name = TaskContext.get().partitionId() << 32
        block = Block()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block.add(doc, text, pre.of(text))
                if block.chars >= BLOCK_CHARS:
                    yield block.row(name, schema)
                    name, block = name + 1, Block()
        if block.docs:
            yield block.row(name, schema)

    return rows.mapInArrow(cut, f"block long, docs array<{kind.simpleString()}>, bytes array<long>, sizes array<long>, pairs binary, words array<string>")


def counted(batches: Iterator[pa.RecordBatch], pre: PreTokens) -> Iterator[pa.RecordBatch]:
    """block, at, n of rows (block, at, word) in the order of words: a word is counted
    where it begins."""
    last, n = None, 0
    for batch in batches:
        found = batch.column("word").dictionary_encode()
        words = found.dictionary.to_pylist()
        if not words:
            continue
        fresh = [w for w in words if w != last]
        counts = dict(zip(fresh, pre.counts(fresh))) | ({last: n} if last is not None else {})
        own = np.array([counts[w] for w in words], np.int32)[found.indices.to_numpy()]
        last = batch.column("word")[-1].as_py()
        n = counts[last]
        yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("at"), pa.array(own)], ["block", "at", "n"])


def count_tokens(df: DataFrame, vocabulary_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    common.prepare(df.sparkSession)
    rows = common.id_and_text(df, id_col, text_col)
    kind = rows.schema["doc_id"].dataType
    out = pa.schema([("doc_id", common._arrow(kind)), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return counted(batches, PreTokens(vocabulary_path))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                sizes = np.array(r["sizes"], np.int64)
                n = sums(sizes, r["pairs"], np.array(r["counts"] or [0], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(r["docs"], out[0].type), pa.array(r["bytes"], pa.int64()), pa.array(n), pa.array(n > limit)], schema=out)

    blocks = common.stored(frequencies(rows, vocabulary_path), "pre-token-blocks")
    placed = blocks.select("block", F.posexplode("words").alias("at", "word")).repartition("word").sortWithinPartitions("word")
    known = placed.mapInArrow(count, "block long, at int, n int").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("found"))
    known = known.select("block", F.col("found.n").alias("counts"))
    whole = blocks.drop("words").join(known, "block", "left").select("docs", "bytes", "sizes", "pairs", "counts")
    return whole.mapInArrow(add, f"doc_id {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))

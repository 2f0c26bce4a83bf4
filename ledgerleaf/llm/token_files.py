"""Token ids in flat binary files with 64-bit document offsets.

Layout of a data set, one pair of files for each range of ids:

* ``<part>-<attempt>.bin``: the ids of its documents, one after another, as
  little-endian unsigned integers of the narrowest width for the vocabulary;
* ``<part>-<attempt>.idx``: n (uint64), then n document ids (int64; 0 for a missing
  one), then n + 1 offsets (uint64, in ids, from 0), then n bytes, 1 where the id is
  missing.

Documents are dealt out by ranges of (doc_id, text hash, row), so files hold them in
ascending order; a manifest names the files of the attempts that succeeded, and
the place of a file in the whole sequence is the prefix sum of the lengths
before it.  A task that runs again writes under another name, so a lost executor
leaves a stray file at most.  Local files are memory-mapped, others are read
through their file system.

Null and empty texts give the end id alone; very long texts are written in parts; an
empty table gives no files and an empty result.  A task encodes batches of
_COLUMN_BYTES together, each distinct pre-token of them once.  Document ids are integers (others
raise TypeError); missing ones come first and stay missing.  Equal doc_ids keep all
their rows, ordered by a hash of the text and then as they were read; a range may end
between them.
The driver collects a row for each file.  Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .tokens import encoder, vocabulary

#: Ids held in memory before they go to the file.
_BUFFER_BYTES = 4 << 20
#: Bytes of texts that are encoded together; a larger batch is encoded alone.
_COLUMN_BYTES = 24 << 20


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of several batches at a time."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > _COLUMN_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def write_token_files(df: DataFrame, out: str, vocabulary_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files under `out` and returns the manifest: part, file, width,
    n_docs, n_tokens, base (ids in all the files before)."""
    spark = df.sparkSession
    common.prepare(spark)
    if not isinstance(df.schema[id_col].dataType, (T.IntegralType, T.NullType)):
        raise TypeError(f"{id_col} is no integer column")
    filesystem, root = fs.FileSystem.from_uri(out)
    filesystem.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary_path)
        end = np.array([end_id], enc.dtype).tobytes()
        part = TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex}"
        where, top = fs.FileSystem.from_uri(out)
        ids, missing, lengths, sink, held, size = [], [], [], None, [], 0
        for batch in _columns(batches):
            ids.append(batch.column(0).fill_null(0).to_numpy().astype("<i8"))
            missing.append(batch.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
            for raw in enc.encode_column(batch.column(1)):
                lengths.append(len(raw) // enc.dtype.itemsize + 1)
                held += (raw, end)
                size += len(raw)
                if size > _BUFFER_BYTES:
                    sink = sink or where.open_output_stream(f"{top}/{name}.bin")
                    sink.write(b"".join(held))
                    held, size = [], 0
        if not lengths:
            return
        sink = sink or where.open_output_stream(f"{top}/{name}.bin")
        sink.write(b"".join(held))
        sink.close()
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype("<u8")
        with where.open_output_stream(f"{top}/{name}.idx") as f:
            f.write(np.array([len(lengths)], "<u8").tobytes())
            f.write(np.concatenate(ids).tobytes())
            f.write(offsets.tobytes())
            f.write(np.concatenate(missing).tobytes())
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "width": pa.array([enc.dtype.itemsize], pa.int32()), "n_docs": [len(lengths)], "n_tokens": [int(offsets[-1])]})

    rows = common.id_and_text(df, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    dealt = rows.repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").select("doc_id", "text")
    parts = common.stored(dealt.mapInArrow(write, "part long, file string, width int, n_docs long, n_tokens long"), "token-manifest")
    found, base = [], 0
    for r in sorted(parts.collect(), key=lambda r: r.part):  # a row for each file
        found.append((*r, base))
        base += r.n_tokens
    return spark.createDataFrame(found, "part long, file string, width int, n_docs long, n_tokens long, base long")


def _mapped(where: fs.FileSystem, path: str, dtype: str) -> np.ndarray:
    if isinstance(where, fs.LocalFileSystem):
        return np.memmap(path, dtype, mode="r")
    with where.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read_token_files(manifest: DataFrame, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = fs.FileSystem.from_uri(out)
        for batch in batches:
            for r in batch.to_pylist():
                raw = _mapped(where, f"{top}/{r['file']}.idx", "<u1")
                n = int(raw[:8].view("<u8")[0])
                index, missing = raw[: 8 * (2 * n + 2)].view("<u8"), np.asarray(raw[8 * (2 * n + 2) :]).astype(bool)
                ids, offsets = np.asarray(index[1 : n + 1]).view("<i8"), np.asarray(index[n + 1 : 2 * n + 2]).astype(np.int64)
                data = _mapped(where, f"{top}/{r['file']}.bin", f"<u{r['width']}")
                for a in range(0, n, 4096):
                    at = offsets[a : a + 4097]
                    crc = [zlib.crc32(data[i:j].astype("<u4").tobytes()) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[a : a + 4096], mask=missing[a : a + 4096]), "start": at[:-1] + r["base"], "n_tokens": np.diff(at), "ids_crc32": pa.array(crc, pa.int64())})

    spread = manifest.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 2))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = common.fresh_path(spark, "token-files")
    manifest = write_token_files(common.table(spark, sf_dir, "documents"), out, vocabulary("byte_bpe_50k.json"), end_id=2)
    return read_token_files(manifest, out)

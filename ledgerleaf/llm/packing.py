"""Best-fit packing of documents into sequences under several capacities.

A document becomes its token ids and an end id; one longer than a sequence is
cut into full pieces and a rest.  Every piece is a vector (tokens, documents,
attention cost = tokens squared) and a sequence has a capacity for each of
these.  A full piece alone has the attention cost 2048 squared, and costs of parts never
add up to more than that of their sum, so with an attention capacity that lets a full
piece in, tokens bind first; op10 packs with DOCUMENTS, which does bind.  Pieces are taken from the largest down; among the open sequences with
room in every dimension, a piece goes to the one that scores best by the
weighted norm of what would be left (least) or the weighted dot product of piece
and residual (greatest), ties to the oldest.

Pieces are written once and dealt round-robin to groups of a bounded number, and
each group is packed alone: a group wastes less than a sequence, and no group
grows with the data or with any key.

Null and empty texts give one piece, the end id alone; very long texts are cut into
as many pieces as it takes; an empty table gives an empty result.  Repeated rows are
packed each for itself; ids are of any type and may be null.  Pieces of equal size
are taken in their order.  Other columns of the input are ignored, whatever their
names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import common
from .tokens import encoder, vocabulary

_PIECE = "piece int, start long, length long, ids_crc32 long"
#: Documents in a sequence at most, as registered.
DOCUMENTS = 64


def pack(lengths: np.ndarray, tokens: int = 2048, documents: int | None = None, attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), by: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """The sequence (from 0) and the offset of each piece.

    documents and attention default to what `tokens` allows anyway.  A piece
    that breaks a capacity on its own gets a sequence of its own only if it
    fits; otherwise ValueError."""
    documents, attention = documents or tokens, attention or tokens * tokens
    caps = np.array([tokens, documents, attention], np.float64)
    lengths = np.asarray(lengths, np.int64)
    items = np.stack([lengths, np.ones_like(lengths), lengths * lengths], 1)
    if len(items) and (items > caps).any():
        raise ValueError("a piece exceeds a capacity of an empty sequence")
    w = np.array(weights, np.float64) / (caps**2)
    n = len(lengths)
    sequence, offset = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    least = int(lengths.min()) if n else 0
    room = np.empty((max(n, 1), 3), np.int64)
    names = np.empty(max(n, 1), np.int64)
    held = made = 0
    for i in np.argsort(-lengths, kind="stable"):
        item = items[i]
        at = -1
        if held:
            open_ = room[:held]
            fits = np.flatnonzero(open_[:, 0] >= item[0])
            if len(fits):
                fits = fits[(open_[fits, 1] >= 1) & (open_[fits, 2] >= item[2])]
            if len(fits):
                left = open_[fits]
                score = ((left - item) ** 2.0) @ w if by == "norm" else -((left * item.astype(np.float64)) @ w)
                at = int(fits[np.argmin(score)])
        if at < 0:
            room[held], names[held], at = caps, made, held
            held, made = held + 1, made + 1
        sequence[i], offset[i] = names[at], tokens - room[at, 0]
        room[at] -= item
        if room[at, 0] < least or room[at, 1] < 1 or room[at, 2] < least * least:  # full: closed, the order of the others stays
            room[at : held - 1] = room[at + 1 : held]
            names[at : held - 1] = names[at + 1 : held]
            held -= 1
    return sequence, offset


def pieces_of(df: DataFrame, vocabulary_path: str, end_id: int = 0, tokens: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    common.prepare(df.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary_path)
        for batch in batches:
            rows = []
            for doc, raw in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist())):
                ids = np.append(np.frombuffer(raw, enc.dtype), enc.dtype.type(end_id)).astype("<u4")
                rows += [(doc, k, a, len(x := ids[a : a + tokens]), zlib.crc32(x.tobytes())) for k, a in enumerate(range(0, len(ids), tokens))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    rows = common.id_and_text(df, id_col, text_col)
    kind = rows.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", common._arrow(kind)), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    return rows.mapInArrow(cut, f"doc_id {kind.simpleString()}, {_PIECE}")


def pack_documents(df: DataFrame, vocabulary_path: str, end_id: int = 0, tokens: int = 2048, group: int = 16384, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The pieces with sequence_id and offset; `group` pieces are packed together,
    `limits` go to pack()."""
    pieces = common.stored(pieces_of(df, vocabulary_path, end_id, tokens, id_col, text_col), "pieces")
    groups = max(1, round(pieces.count() / group))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held)
        sequence, offset = pack(t["length"].to_numpy(), tokens, **limits)
        t = t.append_column("sequence_id", pa.array(sequence + (TaskContext.get().partitionId() << 32)))
        yield from t.append_column("offset", pa.array(offset)).combine_chunks().to_batches()

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return pieces.repartition(groups).mapInArrow(place, f"doc_id {kind}, {_PIECE}, sequence_id long, offset long")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), documents=DOCUMENTS)

"""Language identification by a string kernel.

Two texts are as alike as the n-grams (1 to 4 characters) that both contain: the
blended-spectrum presence kernel |A and B| / sqrt(|A| |B|) over sets of hashed
n-grams.  Texts are taken by lower case, with every run of other characters than
letters as one blank.  A sample of LANDMARKS training texts spans the Nyström
approximation; on its features a kernel ridge regression is solved for each
language against the rest.  Presence vectors are multiplied in batches: presence
by landmarks, kernel rows by the dual weights.

The sample is bounded: of each language the SAMPLE texts with the least hashes of
id and text, fewer where the languages are many: MAX_SAMPLE in all, but one of each
language at least.  Texts without letters do not count.  Whole texts are made to
presence bits where they lie, so the driver gets HASHES bits a text.  No language is
left out.  There are LANDMARKS landmarks, or one for each language up to
MAX_LANDMARKS.

Null texts and such without a letter are "und" with score 0.  Very long texts are
taken whole.  The score is the softmax of the regressions, sharpened by SHARP, of the
predicted language; ties go to the first name.  Without any training text every text
is "und".  Repeated rows are each a row, in the sample too, and equal texts have equal
results; an empty table gives an empty result.  Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

HASHES = 1 << 15
NGRAMS = (1, 2, 3, 4)
LANDMARKS, SAMPLE = 96, 150
RIDGE, SHARP = 1e-3, 8.0
#: Training texts in all (more only if there are more languages), and landmarks at most.
MAX_SAMPLE, MAX_LANDMARKS = 4000, 1024
#: Code points hashed at once, and texts multiplied at once.
BLOCK, BATCH = 1 << 18, 128
_OTHER = re.compile(r"[\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def presence(text: str) -> np.ndarray:
    """Which hashed n-grams a text contains, as 0 and 1; all 0 without letters."""
    out = np.zeros(HASHES, np.float32)
    plain = _OTHER.sub(" ", text.lower()).strip()
    if not any(map(str.isalpha, plain)):  # figures such as ½ are no letters
        return out
    codes = np.frombuffer(f" {plain} ".encode("utf-32-le", "surrogatepass"), "<u4")
    shift = np.uint64(64 - HASHES.bit_length() + 1)
    for a in range(0, len(codes), BLOCK):
        part = codes[a : a + BLOCK + max(NGRAMS) - 1].astype(np.uint64)
        key = np.zeros(len(part), np.uint64)
        for n in range(1, max(NGRAMS) + 1):
            key = key[: len(part) - n + 1] * np.uint64(0x100000001B3) + part[n - 1 :]
            if n in NGRAMS and len(key):
                out[((key + np.uint64(n)) * _MIX) >> shift] = 1
    return out


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows of x against rows of y; 0 for a row without n-grams."""
    size = lambda v: np.sqrt(np.maximum(v.sum(1), 1))
    return (x @ y.T) / size(x)[:, None] / size(y)[None, :]


@dataclass
class Model:
    names: list[str]
    landmarks: np.ndarray
    weights: np.ndarray


def packed(texts: list[str]) -> list[bytes]:
    """Presence as bits."""
    return [np.packbits(presence(t) > 0).tobytes() for t in texts]


def _unpacked(bits: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1).astype(np.float32)


def train(bits: list[bytes], names: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """One-versus-rest kernel ridge regression in the Nyström space, of packed() texts."""
    known = [i for i, b in enumerate(bits) if any(b)]
    bits, own = [bits[i] for i in known], np.array([names[i] for i in known])
    classes = sorted(set(own.tolist()))
    if not classes:
        return Model([], np.zeros((0, HASHES), np.float32), np.zeros((0, 0)))
    # landmarks in turn from each language, so that rare ones are spanned too
    seen: dict[str, int] = {}
    turn = []
    for name in own.tolist():
        turn.append(seen.get(name, 0))
        seen[name] = turn[-1] + 1
    order = sorted(range(len(own)), key=lambda i: (turn[i], own[i]))
    marks = _unpacked([bits[i] for i in order[: max(landmarks, min(len(classes), MAX_LANDMARKS))]])
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    z = np.concatenate([kernel(_unpacked(bits[a : a + BATCH]), marks) for a in range(0, len(bits), BATCH)]) @ root
    z1 = np.hstack([z, np.ones((len(z), 1))])
    weigh = np.array([len(own) / (len(classes) * (own == c).sum()) for c in own])[:, None]
    # 1 for the language and -1 for the rest: twice the sums of each language less all
    sums = np.zeros((len(classes), z1.shape[1]))
    np.add.at(sums, np.searchsorted(classes, own), weigh * z1)
    solved = np.linalg.solve(z1.T @ (weigh * z1) + ridge * len(z) * np.eye(z1.shape[1]), (2 * sums - (weigh * z1).sum(0)).T)
    return Model(classes, marks, np.vstack([root @ solved[:-1], solved[-1:]]).astype(np.float32))


def predict(texts: list[str], model: Model) -> list[dict]:
    out = []
    for a in range(0, len(texts), BATCH):
        x = np.stack([presence(t) for t in texts[a : a + BATCH]])
        if not model.names:
            out += [{"lang_pred": "und", "score": 0.0}] * len(x)
            continue
        f = (kernel(x, model.landmarks) @ model.weights[:-1] + model.weights[-1]).astype(np.float64)
        p = np.exp(SHARP * (f - f.max(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        for known, row in zip(x.any(1), np.round(p, 6)):
            best = int(row.argmax())
            out.append({"lang_pred": model.names[best], "score": float(row[best])} if known else {"lang_pred": "und", "score": 0.0})
    return out


_BITS = T.StructType([T.StructField("bits", T.BinaryType())])


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Trains on rows with a language, ids whose crc32 modulo 4 is 2 left out."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), common.text_of(text_col).alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (common.crc_mod("doc_id", 4) != 2))
    # letters, also those newer than the JVM's tables
    rows = rows.where(F.col("text").rlike(r"[\p{L}\p{Cn}]"))

    def quotas(counts: dict) -> dict:
        return dict.fromkeys(counts, max(1, min(sample, MAX_SAMPLE // max(1, len(counts)))))

    common.prepare(docs.sparkSession)
    chosen = common.stratified(rows, "lang", quotas, "doc_id", "text")
    bits = common.per_text(lambda: lambda texts: [{"bits": b} for b in packed(texts)], _BITS)("text")["bits"]
    found = chosen.select("__h", "doc_id", "lang", F.xxhash64("text").alias("t"), bits.alias("bits")).collect()
    found.sort(key=lambda r: (r["__h"], str(r.doc_id), r.t, r.lang))
    return train([r.bits for r in found], [r.lang for r in found])


_ROW = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predicted(spark: SparkSession, model: Model, text: Column) -> Column:
    """A struct column: lang_pred, score."""
    common.prepare(spark)
    sent = spark.sparkContext.broadcast(model)  # LANDMARKS x HASHES floats

    def make():
        own = sent.value
        return lambda texts: predict(texts, own)

    return common.per_text(make, _ROW)(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    model = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **how)
    rows = common.id_and_text(docs, id_col, text_col)
    rows = rows.select("doc_id", (F.coalesce(common.crc_mod("doc_id", 4), F.lit(-1)) == 2).alias("held_out"), predicted(docs.sparkSession, model, F.col("text")).alias("r"))
    return rows.select("doc_id", "held_out", "r.lang_pred", "r.score")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(common.table(spark, sf_dir, "documents"))

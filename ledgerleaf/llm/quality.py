"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its words and the character
n-grams of its words (3 to 5, between < and >), all hashed into BUCKETS rows, and
of one more feature for each word that repeats the word before it; a softmax
layer turns the average into class probabilities.  The
vectors and the layer are trained by stochastic gradient descent in numpy, on
whole texts of a bounded sample of labelled documents: SAMPLE of them, half of
each class (more of one if the other has fewer), with the least hashes of their
ids.  The texts are made to features where they lie, so the driver gets BUCKETS
numbers a document at most.  Words are runs of non-space.

Scoring needs no vectors: both steps before the softmax are linear, so each
feature adds a number to the logit, and a word's numbers are added up once a
worker for each distinct word (a table of KEPT_WORDS words of KEPT_CHARS characters
at most; longer ones are added up where they occur).  A score depends on the text
alone, equal texts have equal scores, and very long texts are taken whole.

Null and empty texts get the score of an average without terms: the layer's
bias.  Without two classes in the sample every score is that of the class there
is, or 0.5 without labels.  Of a repeated id with labels or texts that differ the
least label and the least text are learned; every row is scored.  An empty table gives
an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BUCKETS, WIDTH = 1 << 17, 16
EPOCHS, RATE = 4, 0.6
SAMPLE = 1000
#: Distinct words that a worker keeps the numbers of.
KEPT_WORDS, KEPT_CHARS = 200_000, 64
#: The bucket of a word that repeats the one before it.
REPEAT = 0
_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of their character n-grams, all words at once, and
    which word each belongs to; in no particular order."""
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(codes)) - starts[owner]
    # a word: the sum over its characters, mixed with their places
    mixed = (codes + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _MIX
    keys, owners = [np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), starts)], [np.arange(len(words))]
    left, key = lengths[owner] - place, codes
    for n in range(2, 6):
        key = key[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n >= 3:
            inside = left[: len(key)] >= n
            keys.append(key[inside] + np.uint64(n))
            owners.append(owner[: len(key)][inside])
    h = np.concatenate(keys) * _MIX
    return ((h ^ (h >> np.uint64(32))) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1, np.concatenate(owners)


@dataclass
class Model:
    """What scoring needs: a number for each bucket, and the bias."""

    logit: np.ndarray
    bias: float


def shares_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their shares of a document's average."""
    words = text.split()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    times = Counter(words)
    ids, owners = grams_of(list(times))
    ids = np.append(ids, REPEAT)
    n = np.append(np.array(list(times.values()))[owners], sum(map(operator.eq, words, words[1:])))
    ids, at = np.unique(ids, return_inverse=True)
    n = np.bincount(at, n)
    return ids, (n / n.sum()).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """Two classes; each class weighs the same in sum.  rows: shares_of() of each text."""
    y = np.array(labels, np.int64)
    share = np.bincount(y, minlength=2)
    if not len(y) or not share.all():
        odds = 0.0 if not len(y) else (4.0 if share[1] else -4.0)
        return Model(np.zeros(BUCKETS, np.float32), odds)
    weight = len(y) / (2.0 * share)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((2, WIDTH), np.float32), np.zeros(2, np.float32)
    steps = epochs * len(rows)
    done = 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, part = rows[i]
            step = rate * (1 - done / steps)
            done += 1
            mean = part @ vectors[ids]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= weight[y[i]]
            back = p @ out
            out -= step * np.outer(p, mean)
            bias -= 0.1 * step * p
            # an average over many terms moves each of them little: the share is scaled to a mean of one
            vectors[ids] -= (step * min(len(ids), 200)) * np.outer(part, back)
    return Model(vectors @ (out[1] - out[0]), float(bias[1] - bias[0]))


class Scorer:
    """Scores of whole texts; the sum and the number of terms of each distinct word are kept."""

    def __init__(self, model: Model):
        self.model, self.sums, self.sizes = model, {}, {}

    def _learn(self, words: list[str]) -> None:
        for a in range(0, len(words), 4096):
            part = words[a : a + 4096]
            ids, owners = grams_of(part)
            sums = np.round(np.bincount(owners, self.model.logit[ids], len(part)), 6)
            self.sums.update(zip(part, sums.tolist()))
            self.sizes.update(zip(part, np.bincount(owners, minlength=len(part)).tolist()))

    def scores(self, texts: list[str]) -> list[float]:
        cuts = [t.split() for t in texts]
        fresh = set().union(*cuts).difference(self.sums)
        if fresh and len(self.sums) + len(fresh) > KEPT_WORDS:
            self.sums, self.sizes, fresh = {}, {}, set().union(*cuts)
        self._learn(list(fresh))
        found = [self._score(c) for c in cuts]
        for w in fresh:
            if len(w) > KEPT_CHARS:
                del self.sums[w], self.sizes[w]
        return found

    def _score(self, words: list[str]) -> float:
        if not words:
            return float(1 / (1 + np.exp(-self.model.bias)))
        again = sum(map(operator.eq, words, words[1:]))
        total = math.fsum(map(self.sums.__getitem__, words)) + again * float(self.model.logit[REPEAT])
        n = sum(map(self.sizes.__getitem__, words)) + again
        return round(float(1 / (1 + np.exp(-(total / n + self.model.bias)))), 9)


_SHARES = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("part", T.BinaryType())])


def _shares(texts: list[str]) -> list[dict]:
    return [{"ids": ids.astype("<i4").tobytes(), "part": part.astype("<f4").tobytes()} for ids, part in map(shares_of, texts)]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Trains on rows of docs with a label, ids whose crc32 modulo 3 is 1 left out.

    The sample is drawn for each class from the labels that have a document, one row
    for each id (the least text of a repeated one)."""
    common.prepare(docs.sparkSession)
    rows = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    rows = rows.where(F.col("label").isin(0, 1) & (common.crc_mod("doc_id", 3) != 1)).groupBy("doc_id").agg(F.min("label").alias("label"))
    texts = common.id_and_text(docs, id_col, text_col)
    rows = texts.select("doc_id").distinct().join(rows, "doc_id")

    def quotas(counts: dict) -> dict:
        return {k: max(1, sample // 2, sample - sum(counts.values()) + n) for k, n in counts.items()}

    chosen = common.stratified(rows, "label", quotas, "doc_id").select("doc_id", "label", "__h")
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("__h", "doc_id", "label").agg(F.min("text").alias("text"))
    found = found.select("__h", "doc_id", "label", common.per_text(lambda: _shares, _SHARES)("text").alias("r")).collect()
    found = sorted(found, key=lambda r: (r["__h"], r.doc_id))
    return train([(np.frombuffer(r.r.ids, "<i4").astype(np.int64), np.frombuffer(r.r.part, "<f4")) for r in found], [r.label for r in found])


_SCORE = T.StructType([T.StructField("score", T.DoubleType())])


def scores(spark: SparkSession, model: Model, text: Column) -> Column:
    common.prepare(spark)
    sent = spark.sparkContext.broadcast(model)  # BUCKETS floats

    def make():
        scorer = Scorer(sent.value)
        return lambda texts: [{"score": x} for x in scorer.scores(texts)]

    return common.per_text(make, _SCORE)(text)["score"]


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **how)
    rows = common.id_and_text(docs, id_col, text_col)
    rows = rows.select("doc_id", (F.coalesce(common.crc_mod("doc_id", 3), F.lit(-1)) == 1).alias("held_out"), scores(docs.sparkSession, model, F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))

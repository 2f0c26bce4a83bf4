from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import common, near_dup
from ledgerleaf.llm.components import components


def brute_force(texts):
    """The least index of each text's class."""
    found = [near_dup.shingles(near_dup.word_hashes(t or "")) for t in texts]
    root = list(range(len(texts)))

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        same = (texts[i] or "") == (texts[j] or "")
        if same or near_dup.similarity(found[i], found[j]) >= near_dup.THRESHOLD:
            a, b = sorted((of(i), of(j)))
            root[b] = a
    return [of(i) for i in range(len(texts))]


def family(rng, base, edits, n):
    """Variants of a text, each with its own edits."""
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_classes_equal_brute_force(spark):
    rng = random.Random(7)
    new = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    base = new(150)
    texts = family(rng, base, 5, 60) + family(rng, new(80), 2, 20) + [" ".join(new(60)) for _ in range(20)]
    shared = new(60)  # a passage that many texts share
    texts += [" ".join(shared + new(60)) for _ in range(30)]
    texts += [None, "", "", "!!!", "!!!", "one two", "One TWO", "one two three", texts[0], texts[0], " ".join(["spam"] * 400), " ".join(["spam"] * 420)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, same string, class_size int")
    want = brute_force(texts)
    rows = near_dup.near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in rows} == dict(enumerate(want))
    assert sorted(r.doc_id for r in rows if r.kept) == sorted(set(want))
    sizes = {c: want.count(c) for c in want}
    assert all(r.class_size == sizes[r.class_id] for r in rows)
    kept = near_dup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_repeated_ids_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words of some length here")], "doc_id long, text string")
    assert near_dup.near_duplicates(docs).where("kept").count() == 2
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("top", [1, 4])
def test_signatures_estimate_the_weighted_similarity(top):
    rng = np.random.default_rng(top)
    ids, weights = np.sort(rng.integers(0, 1 << 63, 500).astype(np.uint64)), rng.integers(1, top + 1, 500)
    kept = rng.random(500) < 0.85
    a, b = (ids, weights), (ids[kept], np.maximum(1, weights[kept] - rng.integers(0, top, kept.sum())))
    agree = (near_dup.signature(*a, k=2000) == near_dup.signature(*b, k=2000)).mean()
    assert agree == pytest.approx(near_dup.similarity(a, b), abs=0.05)


def test_shingles():
    words = near_dup.word_hashes("a B c d e f a b C d e")
    ids, counts = near_dup.shingles(words)
    assert counts.sum() == 7 and counts.max() == 2
    assert len(near_dup.word_hashes("")) == 0 and len(near_dup.shingles(near_dup.word_hashes("x y"))[0]) == 1
    assert near_dup.word_hashes("q" * 1000)[0] != near_dup.word_hashes("q" * 1001)[0]
    assert len(near_dup.occurrences((ids, counts))) == 7 == len(set(near_dup.occurrences((ids, counts)).tolist()))


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    root = {}

    def of(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((of(a), of(b)))
        root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: of(i) for i in root if of(i) != i}


def test_rows_that_meet_grow_with_the_input(spark, monkeypatch):
    """One group of near copies of a text of 120 words, most of them not linked to its
    middle: what the joins on edits match by key, before any further condition, and what
    they give stay below a bound in proportion to the edits."""
    kept = {}
    stored = common.stored
    monkeypatch.setattr(common, "drop_path", lambda spark, path: None)
    monkeypatch.setattr(common, "stored", lambda df, what: kept.setdefault(what, []).append(stored(df, what)) or kept[what][-1])
    rng = random.Random(2)
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    for n in (200, 400, 800):
        texts = family(rng, base, 7, n)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        kept.clear()
        got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()}
        assert got == dict(enumerate(brute_force(texts))), n
        edits = sum(len(r.edits) for r in kept["edits"][0].collect())
        placed = kept["placed-edits"][0]
        other = placed.groupBy("centre", "edit", F.col("own").alias("other"), F.col("other").alias("own")).agg(F.count(F.lit(1)).alias("m"))
        matches = placed.where("open").join(other, ["centre", "edit", "own", "other"]).agg(F.sum("m")).first()[0] or 0
        assert kept["pairs"][0].count() <= 10 * n and placed.count() <= 3 * edits, n
        assert matches <= edits and kept["pairs"][1].count() <= n, (n, matches, edits)


def test_odd_tables(spark):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(30_000))
    rows = [(1, long, "a"), (1, long + " more", "b"), (2, None, "c"), (2, None, "d"), (None, "one two three four five six", "e"), (None, "one two three four five six", "f")]
    names = ["doc_id", "text", "node"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    for extra in ("__node", "__same", "__mark", "__keys", "same", "keys", "row", "mark", "keeper", "class_id", "n", "part", "a.b"):
        docs, names = docs.withColumn(extra, F.lit(extra)), [*names, extra]
    kept = near_dup.deduplicate(docs)
    assert kept.columns == names and [f.dataType for f in kept.schema] == [f.dataType for f in docs.schema]
    found = kept.collect()
    assert sorted(str(r.doc_id) for r in found) == ["1", "2", "None"] and all(r["a.b"] == "a.b" for r in found)
    rows = near_dup.near_duplicates(docs).collect()
    assert sorted(r.class_size for r in rows) == [2] * 6 and sum(r.kept for r in rows) == 3
    assert near_dup.deduplicate(docs.limit(0)).count() == near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_long_loose_texts_give_rows_by_their_length(spark, monkeypatch):
    """Texts that share a part and no link: rows follow the length, not its square."""
    kept = {}
    stored = common.stored
    monkeypatch.setattr(common, "drop_path", lambda spark, path: None)
    monkeypatch.setattr(common, "stored", lambda df, what: kept.setdefault(what, []).append(stored(df, what)) or kept[what][-1])
    rng, sizes = random.Random(6), []
    for words in (400, 1600):
        shared = [f"s{rng.randrange(10**6)}" for _ in range(int(words * 0.7))]
        texts = [" ".join(shared + [f"w{rng.randrange(10**6)}" for _ in range(int(words * 0.3))]) for _ in range(12)]
        kept.clear()
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert near_dup.near_duplicates(docs).where("class_id <> doc_id").count() == 0
        sizes.append(kept["placed-edits"][0].count() if "placed-edits" in kept else 0)
    assert sizes[1] <= 8 * max(1, sizes[0])


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = spark.createDataFrame([("h", i) for i in range(50)] + [(f"k{i % 7}", i) for i in range(14)] + [("none", 1)], "k string, v long")
    table = rows.where("k <> 'none'").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.upper("k"))
    got = sorted((r.k, r.v, r.w) for r in common.hot_join(rows, table, ["k"], 65).collect())
    assert got == sorted((r.k, r.v, r.k.upper()) for r in rows.where("k <> 'none'").collect())
    hot = common.hot_keys(rows, "k")
    assert {(r.k, r.parts) for r in hot.collect()} == {("h", 17)}
    got = sorted((r.k, r.v, r.w) for r in common.salted_join(rows, table.drop("n"), "k", "v", hot).collect())
    assert got == sorted((r.k, r.v, r.k.upper()) for r in rows.where("k <> 'none'").collect())


def test_long_pairs_are_compared_in_parts(spark, monkeypatch):
    import pyarrow as pa

    common.prepare(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) == common.BATCH_BYTES
    texts = [" ".join(f"w{(i * j) % 997}" for j in range(3000)) for i in range(1, 21)] + [""]
    batch = pa.RecordBatch.from_pydict({"a": [0] * 21, "b": list(range(21)), "text_a": [texts[0]] * 21, "text_b": texts})
    for edits in (True, False):
        monkeypatch.setattr(near_dup, "EDIT_BYTES", 1 << 40)
        (whole,) = near_dup.compared(batch, near_dup._Shingles(), edits)
        monkeypatch.setattr(near_dup, "EDIT_BYTES", 100_000)
        parts = list(near_dup.compared(batch, near_dup._Shingles(), edits))
        assert pa.Table.from_batches(parts) == pa.Table.from_batches([whole])
        assert max(p.nbytes for p in parts) < 200_000 and (len(parts) > 5) == edits
    assert whole.column("similarity").to_pylist()[0] == 1.0 and list(near_dup.compared(batch.slice(0, 0), near_dup._Shingles(), True)) == []

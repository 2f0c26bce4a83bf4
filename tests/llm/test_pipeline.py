from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerleaf.llm import common, decontaminate, secrets
from ledgerleaf.llm.tokens import TextEncoder, vocabulary

from test_near_dup import brute_force

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = common.table(spark, SF, "documents")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(common.stored(stage(spark, seen[-1], SF), f"test-{name}"))
        assert seen[-1].columns == docs.columns
    start, good, single, clean, masked = [{r.doc_id: r.text for r in d.collect()} for d in seen]
    labels = {r.doc_id: r.quality for r in common.table(spark, SF, "labels").collect()}
    assert sum((i in good) == bool(q) for i, q in labels.items() if i in start) >= 0.97 * len(labels)
    ids = sorted(good)
    assert sorted(single) == sorted({ids[k] for k in brute_force([good[i] for i in ids])})
    bench = [(str(r.item_id), r.text) for r in common.table(spark, SF, "benchmark").collect()]
    windows = {tuple(w[k : k + 10]) for w in (decontaminate.words_of(t) for _, t in bench) for k in range(max(1, len(w) - 9))}

    def hit(text):
        w = decontaminate.words_of(text)
        return any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))

    assert sorted(clean) == sorted(i for i, t in single.items() if not hit(t))
    assert all(not secrets.base_spans(t) for t in masked.values()) and sorted(masked) == sorted(clean)
    enc = TextEncoder(vocabulary("word_bpe_49k.json"))
    rows = corpus_pipeline.STAGES[-1][1](spark, seen[-1], SF).collect()
    want = sum(len(np.frombuffer(raw, enc.dtype)) + 1 for raw in enc.encode(list(masked.values())))
    assert sum(r.length for r in rows) == want and {r.doc_id for r in rows} == set(masked)
    assert corpus_pipeline.run(spark, SF).count() == len(rows)


ODD = [None, "", "", "!!!", "汉字 かな", "one two three", "one two three", "x" * 3000 + " " + "long text of words " * 8000, "password = 'abc123DEF456ghi' and some more plain words in a row here"]


def test_every_stage_on_odd_repeated_and_empty_tables(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns, no rows."""
    rows = [(i // 2, t, "junk", i) for i, t in enumerate([*ODD, *ODD])] + [(None, "a row without an id", "junk", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars int")
    for name in ("node", "same", "keys", "__h", "label", "quality", "score", "spans", "redacted", "items", "item_id", "sequence_id", "offset", "length", "piece"):
        docs = docs.withColumn(name, F.lit("clash"))
    spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(9)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("1", "some item text that no document has"), (None, None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, table, str(tmp_path))
            kept = found.collect()
            if name != "packing":
                assert found.columns == docs.columns, name
                assert len(kept) == table.count() if name in ("secrets", "decontamination") else len(kept) <= table.count(), name
            if name == "near_duplicates" and kept:
                assert len(kept) == len({t or "" for t in ODD}) + 1
            if name == "secrets" and kept:
                assert sum(r.text is None for r in kept) == 2 and any("[SECRET]" in (r.text or "") for r in kept)
            if name == "packing":
                assert len({(r.doc_id, r.sequence_id, r.offset) for r in kept}) == len(kept) and (len(kept) == 0) == (table is not docs)
    for missing in ("labels", "benchmark"):  # nothing labelled, nothing to look for
        spark.read.parquet(f"{tmp_path}/{missing}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{missing}.parquet")
    none = f"{tmp_path}/none"
    assert corpus_pipeline.keep_quality(spark, docs, none).count() == docs.count() == corpus_pipeline.drop_contaminated(spark, docs, none).count()

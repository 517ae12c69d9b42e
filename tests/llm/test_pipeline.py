import re
from collections import Counter

import corpus_pipeline
import numpy as np
from test_near_dup import brute
from test_perplexity import brute_base
from test_secrets import brute as brute_spans

from locusframe.llm import common, packing


def test_stages_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = common.cut(stage(spark, docs, sf_dir), name)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before) and len(after) == docs.count()
        kept[name] = before, after
    before, after = kept["quality_classifier"]
    assert 0.6 * len(before) < len(after) < len(before)
    before, after = kept["quality_rules"]
    for d, t in before.items():
        n, _, _, _, repeated = brute_base(t)
        if n < 50 or 100 * repeated > 50 * n:
            assert d not in after
    assert len(after) > 0.75 * len(before)
    before, after = kept["minhash_near_dedup"]
    groups = brute(before, 5)
    assert set(after) == {c for _, c in groups.values()} and all(after[d] == before[d] for d in after)
    before, after = kept["secret_scans"]
    assert set(before) == set(after) and any(before[d] != after[d] for d in after)
    for d in before:
        assert (before[d] == after[d]) or brute_spans(before[d]) or "<" in after[d]
        assert not brute_spans(after[d])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    enc = packing.Encoder(packing.default_tokenizer())
    size = Counter()
    for p in pieces:
        size[p.sequence_id] += p.length
    assert max(size.values()) <= 2048
    for d, t in after.items():
        own = sorted((p for p in pieces if p.doc_id == d), key=lambda p: p.start)
        assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in own]).tolist() == [*enc.whole(t).tolist(), 1]


def test_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names if re.match(r"op\d+_", n)) == list(range(1, 14))


def test_batches_are_bounded_by_bytes(spark):
    setting, texts = "spark.sql.execution.arrow.maxBytesPerBatch", ["x" * 500_000] * 40 + [None, "", "y" * (common.BATCH_BYTES * 2)]
    before = spark.conf.get(setting)
    try:
        for given, stays in ((str(common.BATCH_BYTES * 4), False), ("64m", False), ("1k", True), ("1000", True)):
            spark.conf.set(setting, given)
            common.small_batches(spark)
            assert spark.conf.get(setting) == (given if stays else str(common.BATCH_BYTES))
        spark.conf.set(setting, before)
        common.small_batches(spark)
        docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
        sizes = docs.mapInArrow(lambda rows: (b.slice(0, 0).from_pydict({"n": [b.num_rows]}) for b in rows), "n long").collect()
        assert sum(r.n for r in sizes) == len(texts) and max(r.n for r in sizes) <= 10
    finally:
        spark.conf.set(setting, before)

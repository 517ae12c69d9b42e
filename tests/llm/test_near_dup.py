import re

import numpy as np
from helpers import AWKWARD, awkward, empty
from pyspark.sql import functions as F

from locusframe.llm import near_dup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(texts, k, percent=80):
    """Components of all documents by an inverted index of shingles, every pair that shares one counted."""
    sets = {d: shingles(t, k) for d, t in texts.items()}
    up = {d: d for d in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    by = {}
    for d in sorted(sets):
        count = {}
        for s in sets[d]:
            for e in by.setdefault(s, []):
                count[e] = count.get(e, 0) + 1
            by[s].append(d)
        for e, n in count.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[e]) - n):
                x, y = sorted((root(d), root(e)))
                up[y] = x
    return {d: (len(sets[d]), root(d)) for d in texts}


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = brute(texts, 4)
    rows = near_dup.near_duplicates(docs, k=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want and len(rows) == len(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows) and sum(not r.kept for r in rows) > 20


def test_chains_hubs_and_unlinked_groups(spark):
    """A chain whose ends are far apart, a large group around one text, and one just under the threshold."""
    rng = np.random.default_rng(4)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    texts, base = {}, word(200)
    for i in range(12):
        texts[i] = " ".join(base)
        base = base[10:] + word(10)
    centre = word(300)
    for i in range(100, 160):
        own = list(centre)
        for at in rng.integers(0, 300, 5):
            own[at] = word(1)[0]
        texts[i] = " ".join(own)
    half = word(100)
    for i in range(200, 220):
        texts[i] = " ".join(half + word(60))
    docs = spark.createDataFrame([(k, v) for k, v in texts.items()], "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, k=5).collect()}
    assert got == brute(texts, 5)
    left = {r.doc_id for r in near_dup.deduplicate(docs).collect()}
    assert left == {c for _, c in got.values()}


def test_awkward_rows(spark):
    rows = near_dup.near_duplicates(awkward(spark), k=4).collect()
    assert len(rows) == 9
    by = {r.doc_id: r for r in rows}
    assert by[6].component_id == 1 and not by[6].kept and by[2].n_shingles == 0 and by[2].kept and by[4].n_shingles == 0 and by[5].n_shingles == 1
    out = near_dup.deduplicate(awkward(spark))
    assert out.columns == awkward(spark).columns and sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 2, 3, 4, 5, 8]
    assert near_dup.near_duplicates(empty(spark)).count() == 0 and near_dup.deduplicate(empty(spark)).count() == 0
    same = spark.range(2000).select("id", F.lit(AWKWARD[0][1]).alias("text")).withColumnRenamed("id", "doc_id")
    assert near_dup.near_duplicates(same).agg(F.max("component_id"), F.sum(F.col("kept").cast("int"))).first()[:] == (0, 1)


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(6)
    for n, share in ((40, 0.9), (1000, 0.8), (3000, 0.3)):
        est = []
        for _ in range(20):
            x = rng.integers(0, 2**63, 2 * n, dtype=np.int64).astype(np.uint64)
            both = int(2 * n * share / (1 + share))
            a, b = np.unique(x[:n]), np.unique(x[n - both : 2 * n - both])
            s = near_dup.sketches([a, b, np.union1d(a, b)])
            assert (near_dup.merged(s[0], s[1]) == s[2]).all()
            est.append(near_dup.joint_similarity(s[:1], s[1:2], np.array([len(a)]), np.array([len(b)]))[0])
        assert abs(np.mean(est) - both / (2 * n - both)) < 0.04


def test_large_bucket_of_scattered_copies(spark, monkeypatch):
    """A centre with copies at all distances, copies of far copies, shorter ones, and texts that share a passage only."""
    rng = np.random.default_rng(9)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    centre, texts = word(150), {}

    def edited(words, n):
        own = list(words)
        for at in rng.choice(len(own), n, replace=False):
            own[at] = word(1)[0]
        return own

    texts[500] = " ".join(centre)
    for i in range(250):
        own = edited(centre, int(rng.integers(1, 14)))
        texts[i] = " ".join(own[: int(rng.integers(120, 151))] if i % 5 == 0 else own)
    for c in range(3):
        far = edited(centre, 12)
        for i in range(40):
            texts[600 + 100 * c + i] = " ".join(edited(far, int(rng.integers(1, 9))))
    for i in range(60):
        texts[1000 + i] = " ".join(word(20) + centre[:60] + word(20))
    want = brute(texts, 4)
    docs = spark.createDataFrame([(k, v) for k, v in texts.items()], "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, k=4).collect()} == want
    monkeypatch.setattr(near_dup, "CHUNK", 16)  # so that the buckets have many blocks and size classes
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, k=4).collect()} == want
    assert 2 < len({c for _, c in want.values()}) < len(want)

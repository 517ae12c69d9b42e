"""Searches at scale: stored and salted indexes, bitmaps, models sent once, counters of one search, families searched anew only where they changed."""

import random
import re

import pytest
from pyspark.sql import functions as F

from locusframe.functions.sequence import AMINO, REDUCED
from locusframe.operators import codes, search, similarity


def sequences(draw, n, common=""):
    return [(i, "".join(draw.choices(AMINO, k=draw.randint(0, 120))) + common + "".join(draw.choices(AMINO + "X", k=draw.randint(0, 60)))) for i in range(n)]


def frame(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, s string")


def brute_diagonals(q, t, k):
    at = {}
    for i, s in q:
        for p in range(len(s) - k + 1):
            at.setdefault(s[p : p + k], []).append((i, p))
    out = {}
    for j, s in t:
        for p in range(len(s) - k + 1):
            if "X" not in s[p : p + k]:
                for i, own in at.get(s[p : p + k], []):
                    out[i, j, p - own] = out.get((i, j, p - own), 0) + 1
    return sorted((*key, n) for key, n in out.items())


@pytest.fixture(scope="module")
def both(spark):
    draw = random.Random(1)
    q, t = sequences(draw, 20, "WWWWWW"), [*sequences(draw, 300, "ACDWWWWWW"), (900, None), (901, "acd")]
    return q, [(i, s or "") for i, s in t], frame(spark, q, "q"), frame(spark, t, "t")


def test_codes_are_the_kmers(spark, monkeypatch):
    rows = [(1, "ACDXEFG"), (2, "AC"), (3, ""), (4, None), (5, "ACDÉFGH"), (6, "Y" * 50)]
    for piece in (3, 1 << 18):
        monkeypatch.setattr(codes, "PIECE", piece)
        got = sorted((r.id, r.pos, r.kmer) for r in codes.index(spark.createDataFrame(rows, "id long, s string"), "id", F.col("s"), 3).collect())
        number = lambda x: sum(AMINO.index(c) * 20 ** (2 - i) for i, c in enumerate(x))
        assert got == sorted((i, p, number(s[p : p + 3])) for i, s in rows if s for p in range(len(s) - 2) if set(s[p : p + 3]) <= set(AMINO))
    with pytest.raises(ValueError):
        codes.rolled(codes.letter_codes(AMINO)[[65] * 20], 20, 15)


@pytest.mark.parametrize("sent", [0, 10**6])
def test_seeds_by_broadcast_and_by_salted_join(both, monkeypatch, sent):
    q, t, qd, td = both
    monkeypatch.setattr(similarity, "MOST_SENT", sent)
    found = similarity.diagonals(similarity.index(qd, "q", F.col("s"), 4), similarity.index(td, "t", F.col("s"), 4), "q", "t")
    assert sorted(map(tuple, found.select("q", "t", "diagonal", "n").collect())) == brute_diagonals(q, t, 4)


def test_a_stored_index_is_read_in_its_buckets_with_heavy_kmers_dealt(spark, both):
    q, t, qd, td = both
    own = similarity.StoredIndex.store(td, "t", F.col("s"), 4, "locusframe_test_index", buckets=8)
    try:
        assert own.heavy.count() >= 3  # WWWW is in every text
        per = [r["count"] for r in own.rows.groupBy(F.input_file_name().alias("f")).count().collect()]
        assert len(per) == 8 and max(per) <= 2 * sorted(per)[len(per) // 2]
        queries = similarity.index(qd, "q", F.col("s"), 4)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            joined = own.join(queries.withColumnRenamed("pos", "q_pos"))
            found = similarity.diagonals(queries, own, "q", "t")
            assert sorted(map(tuple, found.select("q", "t", "diagonal", "n").collect())) == brute_diagonals(q, t, 4)
            plan = joined._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        side = plan[plan.index("FileScan parquet spark_catalog.default.locusframe_test_index[") - 600 :] if "spark_catalog.default.locusframe_test_index[" in plan else plan
        assert len(re.findall(r"Exchange hashpartitioning\(kmer", plan)) == 1, side  # the queries' k-mers alone
    finally:
        own.drop()


@pytest.mark.parametrize("least", [0.0, 0.2, 0.6])
def test_bitmaps_give_the_jaccard_of_sets(spark, monkeypatch, least):
    draw = random.Random(2)
    q, t = sequences(draw, 40), sequences(draw, 150)
    t += [(500 + i, s) for i, s in q[:10]] + [(600, ""), (601, "XXXXXX"), (602, None)]
    monkeypatch.setattr(similarity, "SETS", 7)
    monkeypatch.setattr(similarity, "TARGETS", 30)
    classes = dict(zip(*REDUCED, strict=True))
    of = lambda s: {x for i in range(len(s) - 3) if "X" not in (x := "".join(classes.get(c, "X") for c in s[i : i + 4]))}
    want = []
    for i, a in q:
        for j, b in t:
            x, y = of(a), of(b or "")
            if x & y and len(x & y) / len(x | y) >= least:
                want.append((i, j, len(x & y), round(len(x & y) / len(x | y), 9)))
    found = similarity.shared_bitmaps(codes.bitmaps(frame(spark, q, "q"), "q", F.col("s")), codes.bitmaps(frame(spark, t, "t"), "t", F.col("s")), "q", "t", least)
    assert sorted((r.q, r.t, r.shared, round(r.jaccard, 9)) for r in found.collect()) == sorted(want)
    none = codes.bitmaps(frame(spark, q, "q").limit(0), "q", F.col("s"))
    assert similarity.shared_bitmaps(none, codes.bitmaps(frame(spark, t, "t"), "t", F.col("s")), "q", "t").count() == 0


def family(draw, n, rate, ancestor=None):
    ancestor = ancestor or "".join(draw.choices(AMINO, k=150))
    return [ancestor] + ["".join(draw.choice(AMINO) if draw.random() < rate else c for c in ancestor) for _ in range(n)]


def searched(spark, blocks=None):
    draw = random.Random(5)
    own = family(draw, 12, 0.25)
    targets = spark.createDataFrame([(f"m{i}", s) for i, s in enumerate(own)] + [(f"d{i}", "".join(draw.choices(AMINO, k=200))) for i in range(40)], "target string, t_seq string")
    queries = spark.createDataFrame([("fam", own[0]), ("other", "".join(draw.choices(AMINO, k=100))), ("none", "W")], "query string, q_seq string")
    return queries, targets, search.sequence_search(queries, targets)


def test_counters_come_with_the_search(spark):
    queries, targets, found = searched(spark)
    table, counters = search.counted(found)
    n = search.hits(table).count()
    rows = search.funnel(found, queries, targets).collect()
    sums = {c: sum(r[c] for r in rows) for c in ("prefilter", "ungapped", "aligned", "reported")}
    assert counters.get == sums and sums["reported"] == n > 5 and {r.database for r in rows} == {53}


def test_blocks_and_caps_change_no_row(spark, monkeypatch):
    of = lambda df: sorted(map(str, search.hits(df).collect()))
    queries, targets, found = searched(spark)
    want = of(found)
    monkeypatch.setattr(search, "BLOCK", 3)
    monkeypatch.setattr(search, "AT_ONCE", 2)
    assert of(search.sequence_search(queries, targets, keep=None, limit=None)) == want
    assert len(of(search.sequence_search(queries, targets, limit=2))) == 2


def test_families_that_did_not_change_are_not_searched_again(spark):
    draw = random.Random(9)
    one, two = family(draw, 8, 0.05), family(draw, 24, 0.45)  # of the second the first search finds some, its profile more
    targets = spark.createDataFrame([(f"a{i}", s) for i, s in enumerate(one)] + [(f"b{i}", s) for i, s in enumerate(two)], "target string, t_seq string")
    seeds = spark.createDataFrame([("one", "ref", one[0]), ("two", "ref", two[0])], "family string, member string, sequence string")
    counts = []
    model, members = search.bootstrapped(seeds, targets, rounds=3, first_evalue=1e-30, searches=counts)
    assert counts[:2] == [2, 1]
    assert {r.family for r in model.collect()} == {"one", "two"}
    got = {f: {r.member for r in members.where(F.col("family") == f).collect()} for f in ("one", "two")}
    assert got["one"] == {"ref", *(f"a{i}" for i in range(9))} and len(got["two"]) > 8

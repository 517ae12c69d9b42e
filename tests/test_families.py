"""Alignments, profiles, searches and clusters against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.functions.sequence import AMINO
from locusframe.operators import alignment, clusters, profiles, search


def gotoh(query, target, local=True):
    """The best score cell by cell."""
    m, n = len(query), len(target)
    h = [[0] * (n + 1) for _ in range(m + 1)]
    e = [[-(10**9)] * (n + 1) for _ in range(m + 1)]
    f = [[-(10**9)] * (n + 1) for _ in range(m + 1)]
    q, t = alignment.encode(query), alignment.encode(target)
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            e[i][j] = max(h[i][j - 1] - 12, e[i][j - 1] - 1)
            f[i][j] = max(h[i - 1][j] - 12, f[i - 1][j] - 1)
            h[i][j] = max(h[i - 1][j - 1] + int(alignment.BLOSUM62[q[i - 1], t[j - 1]]), e[i][j], f[i][j], 0 if local else -(10**9))
    return max(map(max, h)) if local else max(max(h[m][1:]), max(r[n] for r in h[1:]))


def mutated(draw, s, rate):
    return "".join(draw.choice(AMINO) if draw.random() < rate else c for c in s)


def pairs(n=60, seed=4):
    draw, out = random.Random(seed), []
    for _ in range(n):
        a = "".join(draw.choices(AMINO + "X", k=draw.randint(0, 60)))
        cut = draw.randint(0, len(a))
        b = mutated(draw, a[:cut] + "".join(draw.choices(AMINO, k=draw.randint(0, 12))) + a[cut + draw.randint(0, 9) :], 0.2)
        out.append((a, b if draw.random() < 0.7 else "".join(draw.choices(AMINO, k=30))))
    return [*out, ("", "ACD"), ("ACD", ""), ("W", "W")]


def test_batch_scores_equal_those_cell_by_cell():
    own = pairs()
    assert alignment.pair_scores(*map(list, zip(*own))).tolist() == [gotoh(a, b) for a, b in own]


@pytest.mark.parametrize("local", [True, False])
def test_alignments_score_what_they_show(local):
    for a, b in pairs(40, 9):
        x = alignment.align(a, b, local)
        if not a or not b:
            assert x == alignment.NO_ALIGNMENT
            continue
        assert x["score"] == gotoh(a, b, local)
        assert x["q_aln"].replace("-", "") == a[x["q_start"] : x["q_end"]] and x["t_aln"].replace("-", "") == b[x["t_start"] : x["t_end"]]
        total, gap = 0, ""
        for p, q in zip(x["q_aln"], x["t_aln"]):
            here = "q" if p == "-" else "t" if q == "-" else ""
            total += int(alignment.BLOSUM62[alignment.encode(p)[0], alignment.encode(q)[0]]) if not here else -1 if here == gap else -12
            gap = here
        assert total == x["score"]


def test_profile_batch_equals_its_alignments():
    draw = random.Random(2)
    pssm = np.array([[draw.uniform(-4, 4) for _ in range(21)] for _ in range(25)], dtype=np.float32)
    targets = ["".join(draw.choices(AMINO, k=draw.randint(1, 90))) for _ in range(20)]
    single = [alignment.align("A" * 25, t, True, pssm)["score"] for t in targets]
    assert np.allclose(alignment.profile_scores(pssm, targets), single, atol=1e-3)


def test_segments():
    draw = random.Random(6)
    a, b = ("".join(draw.choices(AMINO, k=40)) for _ in range(2))
    matrix, code = alignment.BLOSUM62[alignment.encode(a)], alignment.encode(b)
    for d in (-50, -7, 0, 11, 50):
        cells = [int(matrix[i, code[i + d]]) for i in range(40) if 0 <= i + d < 40]
        best = max([0] + [sum(cells[i:j]) for i in range(len(cells)) for j in range(i + 1, len(cells) + 1)])
        assert alignment.best_segment(matrix, code, [d]) == best


def family(draw, n, length=120, rate=0.3):
    ancestor = "".join(draw.choices(AMINO, k=length))
    return ancestor, [mutated(draw, ancestor, rate) for _ in range(n)]


def test_searches_find_homologs_and_no_decoys(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    draw = random.Random(11)
    ancestor, members = family(draw, 6)
    decoys = ["".join(draw.choices(AMINO, k=draw.randint(80, 200))) for _ in range(60)]
    targets = spark.createDataFrame([(f"m{i}", s) for i, s in enumerate(members)] + [(f"d{i}", s) for i, s in enumerate(decoys)] + [("half", members[0][30:80])], "target string, t_seq string")
    queries = spark.createDataFrame([("fam", ancestor), ("none", "W" * 40)], "query string, q_seq string")
    searched = search.sequence_search(queries, targets)
    rows = search.hits(searched).collect()
    assert {r.target for r in rows if r.target != "half"} == {f"m{i}" for i in range(6)} and all(r.evalue <= 1e-3 for r in rows)
    assert [r.place for r in sorted(rows, key=lambda r: -r.alignment.score)] == list(range(1, len(rows) + 1))
    f = {r["query"]: r for r in search.funnel(searched, queries, 67).collect()}
    assert f["fam"].database == 67 >= f["fam"].prefilter >= f["fam"].ungapped >= f["fam"].aligned >= f["fam"].reported == len(rows) and f["none"].reported == 0
    seeds = spark.createDataFrame([("fam", "seed", ancestor)], "family string, member string, sequence string")
    model, found = search.bootstrapped(seeds, targets, rounds=2)
    names = {r.member for r in found.collect()}
    assert {"seed", *(f"m{i}" for i in range(6))} <= names and not any(n.startswith("d") for n in names)
    scan = {r.target: r.z for r in search.hits(search.profile_search(model, targets, least_z=5.0, align=False)).collect()}
    assert min(scan[f"m{i}"] for i in range(6)) > max([z for t, z in scan.items() if t.startswith("d")], default=5)
    whole = {r.target: r.core_coverage for r in search.hits(search.profile_search(model, targets, least_core=0.0)).collect()}
    assert whole["m1"] > 0.9 and whole.get("half", 0) < 0.6


def test_projection_and_calibration(spark):
    draw = random.Random(3)
    ancestor, members = family(draw, 4, 60, 0.1)
    rows = [("f", i, m) for i, m in enumerate([ancestor, *members[:2], members[2][:40], members[3][:20] + "WWW" + members[3][20:]])]
    aligned = profiles.projected(spark.createDataFrame(rows, "family string, member int, sequence string")).cache()
    got = {r.member: r.aligned for r in aligned.collect()}
    assert got[4] == rows[4][2] and all(len(x) == 63 for x in got.values()) and got[3].rstrip("-").replace("-", "") == rows[3][2]
    model = profiles.calibrated(profiles.profiles(aligned), aligned, 30).first()
    assert len(model.pssm) == len(model.consensus) == 60 or len(model.pssm) == 63
    assert model.decoy_sd > 0 and model.members == 5
    own = alignment.profile_scores(np.array(model.pssm, dtype=np.float32), [ancestor])[0]
    assert (own - model.decoy_mean) / model.decoy_sd > 8


def brute_greedy(records, identity, coverage, jaccard, sets):
    reps, out = [], {}
    for i, s in sorted(records.items(), key=lambda x: (-len(x[1]), x[0])):
        for r in reps:
            both = len(sets[i] & sets[r])
            if not both or both / len(sets[i] | sets[r]) < jaccard:
                continue
            x = alignment.align(s, records[r])
            if x["identity"] >= identity and x["aligned_len"] >= coverage * max(1, min(len(s), len(records[r]))):
                out[i] = r
                break
        else:
            reps.append(i)
            out[i] = i
    return out


def test_greedy_clusters_equal_one_at_a_time(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    draw, records = random.Random(8), {}
    for f in range(4):
        ancestor = "".join(draw.choices(AMINO, k=60))
        for i in range(7):  # a drifting chain, so that neighbours of neighbours differ
            records[10 * f + i] = ancestor[: 60 - draw.randint(0, 3)]
            ancestor = mutated(draw, ancestor, 0.04)
    df = spark.createDataFrame(list(records.items()), "id int, sequence string")
    from locusframe.functions.sequence import kmer_set

    sets = {r.id: set(r.k) for r in df.select("id", kmer_set(F.col("sequence")).alias("k")).collect()}
    got = {r.id: r.representative for r in clusters.greedy_clusters(df).collect()}
    assert got == brute_greedy(records, 0.9, 0.8, 0.35, sets) and 4 <= len(set(got.values())) < 28
    assert clusters.non_redundant(clusters.greedy_clusters(df)).count() == len(set(got.values()))

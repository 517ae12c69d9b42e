"""Repeat arrays, motif sets and text sources on small planted inputs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from locusframe.functions import motifs
from locusframe.functions.sequence import AMINO
from locusframe.operators import motif_sets, repeats
from locusframe.sources import text


def dna(draw, n):
    return "".join(draw.choices("ACGT", k=n))


def array(draw, copies, repeat=30, spacer=35, alike=False, changed=0):
    unit, one = dna(draw, repeat), dna(draw, spacer)
    out = []
    for i in range(copies):
        own = list(unit)
        for at in draw.sample(range(repeat), changed):
            own[at] = draw.choice("ACGT")
        out.append("".join(own) + (one if alike else dna(draw, spacer)))
    return "".join(out)[: -spacer or None]


@pytest.mark.parametrize("strand", [1, -1])
def test_planted_arrays(spark, strand):
    draw = random.Random(5)
    body = array(draw, 9)
    s = dna(draw, 400) + body + dna(draw, 500)
    if strand < 0:
        s = s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    found = repeats.repeat_arrays(spark.createDataFrame([("c", s)], "contig_id string, dna string")).collect()
    assert len(found) == 1
    x = found[0]
    assert len(x["repeat_positions"]) == 9 and 30 <= len(x["repeat_consensus"]) <= 35 and x["spacer_identity"] < 0.6 and x["repeat_identity"] > 0.88
    low = 400 if strand > 0 else 500
    assert abs(x["start"] - low) <= 6 and abs(x["end"] - low - len(body)) <= 6


def many(draw, n):
    """Contigs with none to four arrays of all kinds on both strands."""
    out = []
    for i in range(n):
        s = dna(draw, draw.randint(50, 600))
        for _ in range(draw.randint(0, 4)):
            s += array(draw, draw.randint(2, 9), draw.randint(16, 58), draw.randint(12, 85), draw.random() < 0.3, draw.randint(0, 3)) + dna(draw, draw.randint(60, 500))
        out.append((i, s.translate(str.maketrans("ACGT", "TGCA"))[::-1] if draw.random() < 0.5 else s))
    return out


def rows_of(df):
    return sorted(tuple(r) for r in df.select("contig_id", "start", "end", "strand", "repeat_consensus", "repeat_positions", "spacers", F.round("spacer_identity", 9)).collect())


def test_chunks_give_the_arrays_of_whole_contigs(spark):
    contigs = many(random.Random(11), 60)
    apart = [("".join(s + dna(random.Random(i), 300) for i, (_, s) in enumerate(contigs)))]  # one contig of all
    df = spark.createDataFrame([(i, s) for i, s in enumerate(apart)], "contig_id long, dna string")
    want = rows_of(repeats.repeat_arrays(df))
    assert len(want) > 60 and {w[3] for w in want} == {1, -1}
    for chunk, halo in ((20_000, 2500), (5000, 2500)):
        assert rows_of(repeats.repeat_arrays(df, chunk, halo)) == want
    assert repeats.chunked(df, 5000, 2500).count() > 20
    # seeds are counted over the contig
    seeds = lambda **k: sorted(map(tuple, repeats.seed_positions(df, **k).collect()))
    assert seeds(chunk=700) == seeds() and seeds()


@pytest.mark.parametrize("strand", [1, -1])
def test_an_array_longer_than_what_a_task_sees_is_put_together(spark, strand):
    draw = random.Random(4)
    body = array(draw, 200)
    s = dna(draw, 1500) + body + dna(draw, 900)
    if strand < 0:
        s = s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    df = spark.createDataFrame([(1, s)], "contig_id long, dna string")
    want = rows_of(repeats.repeat_arrays(df))
    assert len(want) == 1 and len(want[0][5]) == 200
    assert rows_of(repeats.repeat_arrays(df, 3000, 1000)) == want


def brute_seeds(contigs, k=14, copies=3):
    out = []
    for i, s in contigs:
        for strand, own in ((1, s), (-1, s.translate(str.maketrans("ACGT", "TGCA"))[::-1])):
            at = {}
            for p in range(len(own) - k + 1):
                at.setdefault(own[p : p + k], []).append(p)
            out += [(i, strand, kmer, len(p), p[0]) for kmer, p in at.items() if len(p) >= copies]
    return sorted(out)


def test_arrays_do_not_overlap_and_show_what_they_tell(spark):
    contigs = many(random.Random(13), 40)
    df = spark.createDataFrame(contigs, "contig_id long, dna string")
    assert sorted(map(tuple, repeats.seed_positions(df).collect())) == brute_seeds(contigs)
    text_of, by = dict(contigs), {}
    for r in repeats.repeat_arrays(df).collect():
        s = text_of[r.contig_id]
        own = s if r.strand == 1 else s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
        n = r.repeat_length
        assert 18 <= n <= 60 and r.copy_number >= 3 and all(15 <= x <= 80 for x in r.spacer_lengths)
        assert [own[a + n : b] for a, b in zip(r.repeat_positions, r.repeat_positions[1:])] == list(r.spacers)
        for p in r.repeat_positions:
            assert sum(a != b for a, b in zip(own[p : p + n], r.repeat_consensus, strict=True)) <= 0.5 * n
        low = r.repeat_positions[0] if r.strand == 1 else len(s) - r.repeat_positions[-1] - n
        assert (r.start, r.end) == (low, low + r.repeat_positions[-1] - r.repeat_positions[0] + n)
        by.setdefault(r.contig_id, []).append((r.start, r.end))
    assert len(by) > 20
    for spans in by.values():
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_changed_copies_chance_and_tandem(spark):
    draw = random.Random(7)
    cases = {"changed": dna(draw, 300) + array(draw, 10, changed=1) + dna(draw, 300), "chance": dna(draw, 6000), "tandem": dna(draw, 300) + array(draw, 6, alike=True) + dna(draw, 300), "short": "ACG", "empty": ""}
    contigs = spark.createDataFrame([*cases.items(), ("null", None)], "contig_id string, dna string")
    got = {r.contig_id: r for r in repeats.repeat_arrays(contigs).collect()}
    assert set(got) == {"changed", "tandem"}
    assert got["changed"].copy_number >= 8 and got["changed"]["class"] == "spacer-array" and got["changed"].regularity > 0.9
    assert got["tandem"]["class"] == "tandem-repeat"
    unit = repeats.repeat_arrays(contigs).where("contig_id = 'changed'").select(F.size(repeats.transcript_units(F.col("repeat_positions"), F.col("repeat_length"))).alias("n"), "copy_number").first()
    assert unit.n == unit.copy_number - 1


def brute_placement(of, found):
    best = None
    for pick in itertools.product(*[[*own, None] for own in found]):
        placed = [(m.name, *p) for m, p in zip(of.motifs, pick) if p is not None]
        if of.ordered and any(a[1] > b[1] for a, b in zip(placed, placed[1:])):
            continue
        if any(not motif_sets._spaced(of, a, b) for a, b in itertools.combinations(placed, 2)):
            continue
        ess = {m.name: m for m in of.motifs}
        at = [p[1] for p in placed]
        key = (sum(ess[p[0]].essential for p in placed), len(placed), sum(motifs.information(ess[p[0]].pattern) for p in placed), -(max(at) - min(at)) if at else 0)
        if best is None or key > best[0]:
            best = key, placed
    return best


def test_placements_equal_all_choices():
    draw, of = random.Random(3), motif_sets.RT_PALM
    name = {m.name: m for m in of.motifs}
    for _ in range(150):
        found = [sorted((draw.randint(0, 260), "MADG") for _ in range(draw.randint(0, 5))) for _ in of.motifs]
        got, want = motif_sets.best_placement(of, found), brute_placement(of, found)
        at = [p[1] for p in got]
        key = (sum(name[p[0]].essential for p in got), len(got), sum(motifs.information(name[p[0]].pattern) for p in got), -(max(at) - min(at)) if at else 0)
        assert key[:2] == want[0][:2] and abs(key[2] - want[0][2]) < 1e-9 and key[3] == want[0][3]


def test_triad_and_scan(spark):
    draw = random.Random(1)
    plain = lambda n: "".join(draw.choices("GSTPQ", k=n))
    cases = {
        "intact": plain(30) + "LADL" + plain(70) + "YADD" + plain(30), "dead": plain(30) + "LADL" + plain(70) + "YAND" + plain(30), "no_a_d": plain(30) + "LANL" + plain(70) + "YADD" + plain(30),
        "near": plain(30) + "LADL" + plain(5) + "YADD" + plain(30), "none": plain(80), "only_c": plain(40) + "YADD", "two": plain(10) + "YAND" + plain(30) + "LADL" + plain(60) + "YADD", "empty": "",
    }
    df = spark.createDataFrame(list(cases.items()), "id string, s string")
    got = {r.id: r for r in motif_sets.triad(df, "id", F.col("s")).collect()}
    assert {k for k, r in got.items() if r.intact} == {"intact", "two"}
    assert "pair" in got["dead"].reason and "its aspartate" in got["no_a_d"].reason and "apart" in got["near"].reason and "no match" in got["none"].reason and "without" in got["only_c"].reason
    placed = {r.id: r for r in motif_sets.scan(df, "s").collect()}
    assert placed["intact"].intact and not placed["none"].intact and placed["near"].missing_essential


def test_variable_motifs_have_one_match_a_place(spark):
    df = spark.createDataFrame([("a", "KAAALALKKXXFLAAKR")], "id string, s string")
    got = {(r.start, r.match) for r in motifs.matches(df, "id", F.col("s"), "[KR]-x(2,4)-[LIVMFYA]-x-[LIVMFYAG]-[KRQ]").collect()}
    import re

    want = {(m.start(), m[1]) for m in re.finditer("(?=([KR].{2,4}[LIVMFYA].[LIVMFYAG][KRQ]))", "KAAALALKKXXFLAAKR")}
    assert got == want and got


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "a.fa").write_text("junk\nmore\n>one first thing\nACGT\nAC\r\n>two\n\n>one again\nGG GG\n")
    (tmp_path / "b.fa").write_text(">three\n" + "A" * 150)
    rows = {(r.seq_id, r.description, r.sequence) for r in text.read_fasta(spark, str(tmp_path)).collect()}
    assert rows == {("one", "again", "GGGG"), ("two", "", ""), ("three", "", "A" * 150)}
    source = spark.createDataFrame([("x", "".join(random.Random(1).choices(AMINO, k=n))) for n in (61,)] + [("y", "ACD"), ("z", "")], "seq_id string, sequence string")
    text.write_fasta(source, str(tmp_path / "out"))
    assert {(r.seq_id, r.sequence) for r in text.read_fasta(spark, str(tmp_path / "out")).collect()} == {tuple(r) for r in source.collect()}
    assert max(len(line) for f in (tmp_path / "out").glob("part*") for line in f.read_text().splitlines()) == 60


def test_feature_tables(spark, tmp_path):
    (tmp_path / "t.tbl").write_text("note\n>Feature ref|A1| x\n1\t90\tgene\n\t\t\tgene\tabc\n<1\t90\tCDS\n\t\t\tproduct\talpha\n\t\t\tprotein_id\tp1\n300\t>101\tCDS\n\t\t\tproduct\tbeta\n>Feature B2\n5\t10\tCDS\n")
    rows = {tuple(r) for r in text.read_feature_table(spark, str(tmp_path)).collect()}
    assert rows == {("ref|A1|", 0, 90, 1, "alpha", "p1"), ("ref|A1|", 100, 300, -1, "beta", ""), ("B2", 4, 10, 1, "", "")}


def test_labels(spark):
    rows = text.labels(spark.createDataFrame([("a", " Promoted"), ("b", "eliminate"), ("c", "maybe"), ("d", None)], "candidate_id string, label string")).collect()
    assert {tuple(r) for r in rows} == {("a", "promote"), ("b", "set_aside")}

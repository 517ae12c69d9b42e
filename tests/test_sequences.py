"""Functions whose rows SQL cannot give, against brute force."""

import random
import re

from locusframe.functions import motifs, windows


def brute_frames(dna, least):
    """From each start codon, codon by codon to a stop."""
    pair = {"A": "T", "C": "G", "G": "C", "T": "A"}
    found, n = [], len(dna)
    for strand, s in ((1, dna), (-1, "".join(pair[x] for x in reversed(dna)))):
        for begin in range(n - 2):
            if s[begin : begin + 3] != "ATG":
                continue
            at = begin
            while at + 3 <= n and s[at : at + 3] not in ("TAA", "TAG", "TGA"):
                at += 3
            residues = (at - begin) // 3
            if at + 3 <= n and residues >= least:
                found.append((begin, at + 3, strand, residues) if strand == 1 else (n - at - 3, n - begin, strand, residues))
    return sorted(found)


def test_open_reading_frames():
    draw = random.Random(5)
    for n in (0, 5, 6, 50, 3000):
        dna = "".join(draw.choices("ACGT", k=n))
        for least in (1, 10):
            assert [tuple(f.values()) for f in windows.frames(dna, least)] == brute_frames(dna, least)


def test_open_reading_frames_query(spark, sf_dir):
    from locusframe.queries import QUERIES

    rows = QUERIES["open_reading_frames"](spark, sf_dir)
    letters = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    want = []
    for doc_id, text in letters.items():
        dna = "".join("ACGT"[(ord(c) - 97) % 4] for c in re.sub("[^A-Za-z]", "", text).lower())
        want += [(doc_id, *f) for f in brute_frames(dna, 30)]
    assert sorted(map(tuple, rows.collect())) == sorted(want)


def test_motifs():
    assert motifs.to_regex("[FY]-x-D-D") == "[FY].DD"
    assert motifs.to_regex("<M-x(2,4)-{P}>") == "^M.{2,4}[ACDEFGHIKLMNQRSTVWY]$"
    assert abs(motifs.information("A-[CD]-x") - (4.321928 + 3.321928)) < 1e-5


def test_low_complexity():
    assert (windows.window_entropies("A" * 25) == 0).all() and len(windows.window_entropies("A" * 25)) == 6
    assert (windows.window_entropies("ACDEFGHIKLMNPQRSTVWY") > 4.3).all()
    assert len(windows.window_entropies("AC")) == 1 and len(windows.window_entropies("")) <= 1

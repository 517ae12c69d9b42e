"""Corpora by their place, what was read of them, and catalogues from files."""

import json

import pytest

from locusframe.operators import locus
from locusframe.sources.corpus import Corpus
from locusframe.sources.opened import open_corpus, provenance, read_catalogue


def _corpus(spark):
    return Corpus({"contigs": spark.createDataFrame([("c1", "ACGT"), ("c2", None)], "contig_id string, dna string").repartition(2), "genes": spark.createDataFrame([], "gene_id string")})


def test_a_corpus_by_its_place_and_what_was_read(spark, tmp_path):
    _corpus(spark).write(str(tmp_path / "a"))
    names = ("contigs", "genes")
    for place in (f"local:{tmp_path}/a", f"{tmp_path}/a", f"file:{tmp_path}/a"):
        found = open_corpus(spark, place, names)
        assert {r.contig_id for r in found["contigs"].collect()} == {"c1", "c2"}
    was = {r.name: r for r in provenance(found).collect()}
    files = [p for p in (tmp_path / "a/contigs").iterdir() if p.name.endswith(".parquet")]
    full = [p for p in files if spark.read.parquet(str(p)).count()]
    assert (was["contigs"].n_rows, was["contigs"].n_files, was["contigs"].n_bytes) == (2, len(full), sum(p.stat().st_size for p in full))
    assert was["contigs"].modified is not None and (was["genes"].n_rows, was["genes"].n_files, was["genes"].identity) == (0, 0, None)
    assert {r.name: r for r in provenance(open_corpus(spark, f"local:{tmp_path}/a", names)).collect()} == was
    _corpus(spark).write(str(tmp_path / "b"))
    other = {r.name: r for r in provenance(open_corpus(spark, f"local:{tmp_path}/b", names)).collect()}
    assert other["contigs"].n_rows == 2 and other["contigs"].identity != was["contigs"].identity


def test_tables_of_the_session_and_rows_without_files(spark):
    made = _corpus(spark)
    held = {r.name: tuple(r)[1:] for r in provenance(made).collect()}
    assert held == {"contigs": (2, None, None, None, None), "genes": (0, None, None, None, None)}
    made["contigs"].createOrReplaceGlobalTempView("contigs")
    assert open_corpus(spark, "tables:global_temp", ("contigs",))["contigs"].count() == 2


GOOD = {
    "systems": [
        {"system_id": "s1", "name": "first", "required": ["RT", "A"], "forbidden": ["B"], "array_repeat_range": [20, 40]},
        {"system_id": "s2", "name": "second", "required_labels": ["RT"], "optional_labels": ["C"], "requires_array": True, "typical_anchor_aa": [200, 500], "reference": "a paper"},
    ],
    "reproduction_targets": [{"system_id": "s1", "min_recall": 0.7, "min_precision": 0.8}],
}


def _written(tmp_path, document):
    path = tmp_path / "catalogue.json"
    path.write_text(json.dumps(document, indent=1))
    return str(path)


def test_a_catalogue_from_a_file(spark, tmp_path):
    found = read_catalogue(spark, _written(tmp_path, GOOD))
    assert found.systems == [locus.System("s1", "first", ("RT", "A"), forbidden=("B",), array_repeat_range=(20, 40)), locus.System("s2", "second", ("RT",), ("C",), requires_array=True, anchor_aa=(200, 500))]
    assert found.systems[1].notes == {"reference": "a paper"}
    assert [tuple(r) for r in found.targets.collect()] == [("s1", 0.7, 0.8)]


@pytest.mark.parametrize(
    ("change", "said"),
    [
        (lambda d: d["systems"].append(dict(d["systems"][0])), "s1 occurs more than once"),
        (lambda d: d["systems"][0].pop("required"), "s1 requires nothing"),
        (lambda d: d["systems"][0].pop("forbidden"), "nothing rules s1 out"),
        (lambda d: d["systems"][0].update(array_repeat_range=[40, 20]), "array_repeat_range is no range"),
        (lambda d: d["systems"][0].pop("system_id"), "a system has no system_id"),
        (lambda d: d["reproduction_targets"].append({"system_id": "x", "min_recall": 0.0, "min_precision": 1.0}), "target x is no system; target x: min_recall"),
        (lambda d: d.pop("reproduction_targets"), "no reproduction targets"),
        (lambda d: d.update(systems=[]), "no systems"),
    ],
)
def test_what_is_wrong_with_a_catalogue_is_said(spark, tmp_path, change, said):
    document = json.loads(json.dumps(GOOD))
    change(document)
    with pytest.raises(ValueError, match=said):
        read_catalogue(spark, _written(tmp_path, document))

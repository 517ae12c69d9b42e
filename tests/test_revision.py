"""The next version of a rubric: what is proposed, what is applied, and that the new rubric judges by it."""

from pyspark.sql import functions as F

from locusframe.catalogue import rules
from locusframe.plans import outcomes, revision, rubric

OWN = rubric.Rubric(
    (rubric.Gate("never", "?", "size > 0", "x"), rubric.Gate("always", "?", "size > 100", "y"), rubric.Gate("off", "?", "size > 1000", "z", False)),
    (rubric.Score("size", "?", "clamp(size / 20.0)", 1.0),),
)


def _rows(spark, n):
    rows = [(i, float(i + 1), i * 3.0, 1.0 - i / 20.0, i >= n // 2, ["always"], [f"a{i % 2}: asserted as strong", "b: asserted as direct"] if i < 6 else None) for i in range(n)]
    return spark.createDataFrame(rows, "candidate_id long, size double, mass double, decay double, promoted boolean, failed_gates array<string>, overclaims array<string>")


def _proposed(rows, external=False):
    return revision.proposed(rows, outcomes.separation(rows, ["size", "mass", "decay"], revision.known_metrics(OWN)), OWN, external)


def test_proposals_and_the_rubric_that_follows(spark):
    rows = _rows(spark, 20)
    found = _proposed(rows)
    got = {(p.kind, p.target): (p.basis, p.applied, p.auroc, p.n) for p in found.collect()}
    assert got == {
        ("reweight", "size"): ("circular", False, 1.0, 20), ("add_score", "mass"): ("structural", True, 1.0, 20), ("add_score", "decay"): ("structural", True, 0.0, 20),
        ("retire_gate", "never"): ("structural", False, None, 0), ("loosen_gate", "always"): ("structural", False, None, 20),
        ("guidance", "b"): ("structural", True, None, 6), ("guidance", "a0"): ("structural", True, None, 3), ("guidance", "a1"): ("structural", True, None, 3),
    }
    new = revision.next_version(OWN, found)
    assert new.version == 2 and new.gates == OWN.gates and new.scores[0] == OWN.scores[0] and "add_score mass (structural)" in new.history[-1]
    assert {s.score_id: (s.expr, s.weight) for s in new.scores[1:]} == {"learned_mass": ("clamp(mass / 43.5)", 0.5), "learned_decay": ("1.0 - (clamp(decay))", 0.5)}
    assert len(new.guidance) == 3 and any("of b no more" in g and "6 reports" in g for g in new.guidance)
    judged = new.apply(rows.select("candidate_id", "size", "mass", "decay"))
    for r in judged.collect():
        i = r.candidate_id
        want = (min((i + 1) / 20, 1) + 0.5 * min(i * 3 / 43.5, 1) + 0.5 * (1 - (1 - i / 20))) / 2
        assert abs(r.priority - want) < 1e-9
    assert rubric.Rubric.from_dict(new.to_dict()) == new
    again = revision.next_version(new, found.where("kind = 'add_score'"))
    assert again.version == 3 and again.scores == new.scores


def test_few_candidates_change_no_scores(spark):
    found = _proposed(_rows(spark, 6), external=True)
    adds = [p for p in found.collect() if p.kind == "add_score"]
    assert adds and all(p.basis == "external" and not p.applied for p in adds)
    assert revision.next_version(OWN, found.where("kind <> 'guidance'")) is OWN
    assert {p.kind for p in _proposed(_rows(spark, 6).limit(0)).collect()} == {"retire_gate"}


def test_a_learned_score_is_the_metric_in_its_own_units():
    assert revision.learned("flag", "boolean", 0.9, 0.8).expr == "flag"
    assert revision.learned("flag", "boolean", 0.1, 0.8).expr == "1.0 - (flag)"
    assert revision.learned("x", "numeric", 0.9, 0.8).expr == "clamp(x)"
    assert revision.learned("x", "numeric", 0.9, -250.0).expr == "clamp(x / 250)"


def test_the_revised_rubric_of_the_query_can_be_applied(spark, sf_dir):
    own = rubric.default_rubric()
    m = rules.metrics(spark, sf_dir).withColumn("anchor_aa", F.expr("(k % 29) * 20.0"))
    row = spark.createDataFrame([("add_score", "anchor_aa", "external", True, 0.9, 200, "numeric", 440.0)], "kind string, target string, basis string, applied boolean, auroc double, n long, metric_kind string, mean_promoted double")
    new = revision.next_version(own, row, "external")
    assert new.apply(m).where("scores['learned_anchor_aa'] between 0 and 1").count() == m.count()

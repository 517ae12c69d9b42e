"""What a package hands to the bench: constructs, assays, controls and what would refute it, as rows chosen by rules over a candidate's metrics.

A component is a row of a table of rules (kind, name, purpose, rule); a rule is of the rubrics' language, and a component without one belongs to every
package. Another table of rules may be given.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import outcomes, rubric

_PARTNER, _ARRAY = "partner_conservation >= 0.4", "array_quality >= 0.4"


@dataclass(frozen=True)
class Component:
    kind: str
    name: str
    purpose: str
    rule: str = ""


COMPONENTS = (
    Component("construct", "enzyme, wild type", "purified alone for activity in vitro"),
    Component("construct", "enzyme, catalytic pair changed", "whatever it still does is not the enzyme's work"),
    Component("construct", "partner", "expressed beside the enzyme and pulled down with it", _PARTNER),
    Component("construct", "whole locus", "the array is transcribed and cut in its own place", _ARRAY),
    Component("construct", "locus without its array", "what the array adds shows only where it is missing", _ARRAY),
    Component("assay", "polymerisation on an RNA template", "incorporation that needs the catalytic pair"),
    Component("assay", "mass in solution", "how many chains stand together, alone and with the partner"),
    Component("assay", "short RNA by sequencing and blot", "transcripts as long as a repeat and a spacer", _ARRAY),
    Component("assay", "nucleic acid that comes with the enzyme", "enriched array transcripts against a mock pull-down", _ARRAY),
    Component("assay", "structure", "the palm with its residues in place; the partner's face, if there is one"),
    Component("control", "empty vector", "same host, same induction"),
    Component("control", "dead enzyme", "beside every reading of activity"),
    Component("control", "a described enzyme", "shows that the assay works"),
    Component("control", "mock pull-down", "a host without the tagged protein"),
    Component("refutation", "no incorporation on any template", "it is no polymerase"),
    Component("refutation", "activity that the dead enzyme keeps", "the activity is not its own"),
    Component("refutation", "no transcript as long as repeat and spacer", "the array is not read as one", _ARRAY),
    Component("refutation", "the same phenotype without the array", "the array has no part in it", _ARRAY),
    Component("refutation", "the partner neither follows nor changes activity", "neighbours by chance", _PARTNER),
)


def components(cands: DataFrame, table: tuple[Component, ...] = COMPONENTS, key: str = "candidate_id") -> DataFrame:
    """A row a candidate and component that its metrics ask for: kind, place (within the kind, from 1), name and purpose. A metric that a rule names and a candidate lacks does not ask for it."""
    holds = lambda c: F.coalesce(rubric.condition(c.rule, cands), F.lit(False)) if c.rule else F.lit(True)
    rows = F.array(*[F.when(holds(c), F.struct(F.lit(c.kind).alias("kind"), F.lit(i).alias("order"), F.lit(c.name).alias("name"), F.lit(c.purpose).alias("purpose"))) for i, c in enumerate(table)])
    kept = cands.select(key, F.array_compact(rows).alias("all"))
    place = lambda x: F.size(F.filter("all", lambda y: (y["kind"] == x["kind"]) & (y["order"] <= x["order"])))
    each: Column = F.transform("all", lambda x: F.struct(x["kind"].alias("kind"), place(x).alias("place"), x["name"].alias("name"), x["purpose"].alias("purpose")))
    return kept.select(key, F.inline(each))


def packages(cands: DataFrame, verdicts: DataFrame, table: tuple[Component, ...] = COMPONENTS) -> DataFrame:
    """The components of each package's lead (see bench_packages), with its architecture and number of loci."""
    leads = outcomes.bench_packages(cands, verdicts).where("role = 'lead'").select("signature", "candidate_id", "n")
    return components(cands.join(leads.select("candidate_id"), "candidate_id", "left_semi"), table).join(leads, "candidate_id")

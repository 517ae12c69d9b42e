"""A small rule language compiled to Columns: gates that reject rows and weighted scores that rank them.

Rule text is parsed once, checked against a whitelist and the schema while the plan is built, and becomes ordinary
expressions, so all rules of a rubric run in one projection. Nothing of a rule is ever executed as Python.
"""

from __future__ import annotations

import ast
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType


class RuleError(ValueError):
    """A rule that the language does not have, or a name that the table does not have."""


@dataclass(frozen=True)
class _Value:
    column: Column
    boolean: bool = False
    items: tuple | None = None


_COMPARE = {
    ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b,
}
_FUNCTIONS = ("min", "max", "abs", "len", "round", "float", "int", "bool", "any", "all", "clamp")


def _number(v: _Value) -> Column:
    return v.column.cast("double") if v.boolean else v.column


def _truth(v: _Value) -> Column:
    if v.items is not None:
        return F.lit(bool(v.items))
    return v.column if v.boolean else v.column.cast("double") != 0


def _divided(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.raise_error(F.lit("a rule divides by zero")).cast("double")).otherwise(a.cast("double") / b)


class _Compiler:
    def __init__(self, schema):
        self.kinds = {f.name: f.dataType for f in schema.fields}

    def walk(self, node: ast.AST) -> _Value:
        return getattr(self, f"_{type(node).__name__}", self._refuse)(node)

    def _refuse(self, node: ast.AST) -> _Value:
        raise RuleError(f"a rule cannot have {type(node).__name__}")

    def _Expression(self, node):
        return self.walk(node.body)

    def _Constant(self, node):
        if not isinstance(node.value, (bool, int, float, str)):
            raise RuleError(f"a rule cannot have the constant {node.value!r}")
        return _Value(F.lit(node.value), isinstance(node.value, bool))

    def _Name(self, node):
        if node.id not in self.kinds:
            raise RuleError(f"unknown name {node.id}")
        return _Value(F.col(f"`{node.id}`"), isinstance(self.kinds[node.id], BooleanType))

    def _UnaryOp(self, node):
        v = self.walk(node.operand)
        if isinstance(node.op, ast.Not):
            return _Value(~_truth(v), True)
        if isinstance(node.op, (ast.USub, ast.UAdd)):
            return _Value(-_number(v) if isinstance(node.op, ast.USub) else _number(v))
        return self._refuse(node.op)

    def _BinOp(self, node):
        a, b = _number(self.walk(node.left)), _number(self.walk(node.right))
        kind = type(node.op)
        if kind is ast.Add:
            return _Value(a + b)
        if kind is ast.Sub:
            return _Value(a - b)
        if kind is ast.Mult:
            return _Value(a * b)
        if kind is ast.Div:
            return _Value(_divided(a, b))
        if kind is ast.Mod:
            return _Value(F.when(b == 0, F.raise_error(F.lit("a rule divides by zero")).cast("double")).otherwise(a - b * F.floor(a / b)))
        if kind is ast.Pow:
            return _Value(F.pow(a, b))
        return self._refuse(node.op)

    def _Compare(self, node):
        left, out = self.walk(node.left), None
        for op, right_node in zip(node.ops, node.comparators, strict=True):
            right = self.walk(right_node)
            if isinstance(op, (ast.In, ast.NotIn)):
                if right.items is None:
                    raise RuleError("in needs a list")
                one = F.lit(False)
                for item in right.items:
                    one = one | (left.column == item.column)
                one = ~one if isinstance(op, ast.NotIn) else one
            elif type(op) in _COMPARE:
                one = _COMPARE[type(op)](_number(left) if left.boolean != right.boolean else left.column, _number(right) if left.boolean != right.boolean else right.column)
            else:
                return self._refuse(op)
            out, left = one if out is None else out & one, right
        return _Value(out, True)

    def _BoolOp(self, node):
        parts = [_truth(self.walk(v)) for v in node.values]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(node.op, ast.And) else out | p
        return _Value(out, True)

    def _IfExp(self, node):
        yes, no = self.walk(node.body), self.walk(node.orelse)
        both = yes.boolean and no.boolean
        return _Value(F.when(_truth(self.walk(node.test)), yes.column if both else _number(yes)).otherwise(no.column if both else _number(no)), both)

    def _List(self, node):
        items = tuple(self.walk(x) for x in node.elts)
        return _Value(F.array(*[x.column for x in items]), items=items)

    _Tuple = _List

    def _Call(self, node):
        if not isinstance(node.func, ast.Name) or node.func.id not in _FUNCTIONS or node.keywords:
            raise RuleError("a rule cannot call this")
        name, args = node.func.id, [self.walk(a) for a in node.args]
        listed = list(args[0].items) if len(args) == 1 and args[0].items is not None else args
        if not args or name in ("min", "max", "any", "all") and not listed:
            raise RuleError(f"{name} needs something")
        if name in ("min", "max"):
            numbers = [_number(a) for a in listed]
            return _Value(numbers[0] if len(numbers) == 1 else (F.least if name == "min" else F.greatest)(*numbers))
        if name in ("any", "all"):
            out = _truth(listed[0])
            for a in listed[1:]:
                out = out | _truth(a) if name == "any" else out & _truth(a)
            return _Value(out, True)
        x = args[0]
        if name == "clamp":
            lo, hi = ([_number(a) for a in args[1:]] + [F.lit(0.0), F.lit(1.0)][len(args) - 1 :])[:2]
            return _Value(F.least(F.greatest(_number(x).cast("double"), lo), hi))
        if name == "len":
            return _Value(F.lit(len(x.items)) if x.items is not None else F.length(x.column))
        if name == "bool":
            return _Value(_truth(x), True)
        if name == "round":
            if len(args) > 1:
                places = node.args[1]
                if not isinstance(places, ast.Constant) or not isinstance(places.value, int):
                    raise RuleError("round needs a whole number of places")
                return _Value(F.bround(_number(x), places.value))
            return _Value(F.bround(_number(x), 0).cast("long"))
        return _Value({"abs": lambda c: F.abs(c), "float": lambda c: c.cast("double"), "int": lambda c: c.cast("long")}[name](_number(x)))


def _compiled(text: str, df: DataFrame) -> _Value:
    try:
        tree = ast.parse(text, mode="eval")
    except SyntaxError as e:
        raise RuleError(f"{text!r} is no rule") from e
    return _Compiler(df.schema).walk(tree)


def rule(text: str, df: DataFrame) -> Column:
    """The value of a rule over df's columns."""
    return _compiled(text, df).column


def condition(text: str, df: DataFrame) -> Column:
    """Whether a rule holds."""
    return _truth(_compiled(text, df))


def names(text: str) -> set[str]:
    """The names in a rule."""
    return {n.id for n in ast.walk(ast.parse(text, mode="eval")) if isinstance(n, ast.Name)}


@dataclass(frozen=True)
class Gate:
    gate_id: str
    question: str
    expr: str
    kill_reason: str
    enabled: bool = True


@dataclass(frozen=True)
class Score:
    score_id: str
    question: str
    expr: str
    weight: float = 1.0


@dataclass(frozen=True)
class Rubric:
    gates: tuple[Gate, ...]
    scores: tuple[Score, ...]
    version: int = 1
    promote_at: float = 0.55
    hold_at: float = 0.35
    guidance: tuple[str, ...] = ()
    history: tuple[str, ...] = field(default=())

    def apply(self, df: DataFrame) -> DataFrame:
        """df with failed_gates, kill_reason (of the first), scores, priority and disposition.

        A row with a null among what the rules read is held, and error says so.
        """
        read = sorted({n for g in self.gates for n in names(g.expr)} | {n for s in self.scores for n in names(s.expr)})
        missing = [F.when(F.col(f"`{n}`").isNull(), F.lit(n)) for n in read if n in df.columns]
        failed = F.array_compact(F.array(*[F.when(~condition(g.expr, df), F.lit(g.gate_id)) for g in self.gates if g.enabled])) if self.gates else F.array().cast("array<string>")
        reasons = F.coalesce(*[F.when(~condition(g.expr, df), F.lit(g.kill_reason)) for g in self.gates if g.enabled], F.lit(None).cast("string"))
        values = {s.score_id: F.least(F.greatest(_number(_compiled(s.expr, df)).cast("double"), F.lit(0.0)), F.lit(1.0)) for s in self.scores}
        weight = sum(s.weight for s in self.scores)
        total = F.lit(0.0)
        for s in self.scores:
            total = total + s.weight * values[s.score_id]
        out = df.withColumns(
            {
                "failed_gates": failed,
                "kill_reason": reasons,
                "scores": F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]) if values else F.lit(None).cast("map<string,double>"),
                "priority": total / weight if weight else F.lit(0.0),
                "error": F.when(F.size(F.array_compact(F.array(*missing))) > 0, F.concat(F.lit("no value of "), F.array_join(F.array_compact(F.array(*missing)), ", "))) if missing else F.lit(None).cast(StringType()),
            }
        )
        verdict = (
            F.when(F.col("error").isNotNull(), "hold").when(F.size("failed_gates") > 0, "eliminate").when(F.col("priority") >= self.promote_at, "promote").when(F.col("priority") >= self.hold_at, "hold").otherwise("eliminate")
        )
        return out.withColumn("disposition", verdict)

    def gate_activity(self, applied: DataFrame) -> DataFrame:
        """gate_id, fired, total, inert and saturated of each gate."""
        spark = applied.sparkSession
        fired = applied.select(F.explode("failed_gates").alias("gate_id")).groupBy("gate_id").agg(F.count("*").alias("fired"))
        total = applied.agg(F.count("*").alias("total"))
        gates = spark.createDataFrame([(g.gate_id,) for g in self.gates], "gate_id string")
        out = gates.join(fired, "gate_id", "left").crossJoin(F.broadcast(total)).withColumn("fired", F.coalesce("fired", F.lit(0)))
        return out.withColumn("inert", F.col("fired") == 0).withColumn("saturated", (F.col("fired") == F.col("total")) & (F.col("total") > 0))

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> Rubric:
        rest = {k: tuple(v) if isinstance(v, list) else v for k, v in d.items() if k not in ("gates", "scores")}
        return cls(gates=tuple(Gate(**g) for g in d.get("gates", ())), scores=tuple(Score(**s) for s in d.get("scores", ())), **rest)

    def as_prompt(self) -> str:
        lines = [f"Rubric version {self.version}", "Gates (all must hold):"]
        lines += [f"- {g.gate_id}: {g.question} [{g.expr}]" + ("" if g.enabled else " (off)") for g in self.gates]
        lines += ["Scores:"] + [f"- {s.score_id} (weight {s.weight:g}): {s.question} [{s.expr}]" for s in self.scores]
        return "\n".join([*lines, *[f"* {g}" for g in self.guidance]])

    def with_score(self, score: Score, why: str) -> Rubric:
        """The next version with a score more."""
        return replace(self, scores=(*self.scores, score), version=self.version + 1, history=(*self.history, why))


def default_rubric() -> Rubric:
    """Nine gates and six scores for candidates of a neighbourhood survey (expressions and weights are fixed values)."""
    gates = [
        ("catalytic_core", "Does the enzyme keep its catalytic residues?", "triad_intact", "a catalytic residue is missing"),
        ("domain_coverage", "Is the conserved core of the domain covered?", "core_coverage >= 0.7 and aligned_fraction >= 0.35", "the hit is a fragment"),
        ("not_low_complexity", "Is the hit more than composition?", "low_complexity <= 0.3", "the hit is low-complexity sequence"),
        ("significance", "Is membership in the family significant?", "evalue <= 1e-5 and profile_z >= 8", "membership is not significant"),
        ("novelty", "Is the locus outside the catalogue?", "novelty >= 0.35", "a described system explains the locus"),
        ("partner_is_not_known", "Is the partner really undescribed?", "partner_known_neglog_e < 3.0", "the partner belongs to a described family"),
        ("reproducible_association", "Do independent loci repeat the association?", "n_independent_loci >= 3 and partner_conservation >= 0.5", "too few loci repeat it"),
        ("has_testable_component", "Is there a partner or an array to test?", "partner_conservation >= 0.5 or (array_quality >= 0.4 and array_operon_gap_bp <= 3000)", "there is nothing to test"),
        ("not_redundant", "Are the sequences independent?", "n_clusters >= 3", "the sequences are one observation"),
    ]
    scores = [
        ("architectural_novelty", "How far is the nearest described system?", "novelty", 2.0),
        ("partner_conservation", "How steadily does the partner occur?", "partner_conservation", 2.0),
        ("association_significance", "How enriched is the partner?", "clamp(association_neglog_p / 6.0)", 1.5),
        ("taxonomic_spread", "How widely is it spread?", "clamp(n_phyla / 3.0) * (0.4 if clade_restricted else 1.0)", 1.0),
        ("noncoding_component", "How well formed is the array?", "array_quality", 1.5),
        ("testability", "How many predictions can fail?", "clamp(n_predictions / 3.0)", 1.0),
    ]
    return Rubric(tuple(Gate(*g) for g in gates), tuple(Score(*s) for s in scores))


# ---- evidence strength

RANKS = {"absent": 0, "weak": 1, "suggestive": 2, "strong": 3, "direct": 4}


def strength_for(key: Column) -> Column:
    """The strongest claim that a candidate's measurements support for an evidence key; null where there is no rule."""
    m = F.col
    membership = F.when((m("profile_z") >= 20) & (m("core_coverage") >= 0.8), "direct").when(m("profile_z") >= 10, "strong").otherwise("suggestive")
    association = (
        F.when((m("association_neglog_p") >= 6) & (m("n_independent_loci") >= 8) & (m("partner_conservation") >= 0.8), "strong").when((m("association_neglog_p") >= 3) & (m("n_independent_loci") >= 3), "suggestive").otherwise("weak")
    )
    q = m("array_quality")
    noncoding = F.when(q <= 0, "absent").when(m("array_operon_gap_bp") > 3000, "weak").when(q >= 0.7, "strong").when(q >= 0.4, "suggestive").otherwise("weak")
    spread = F.when(m("clade_restricted"), "weak").when(m("n_phyla") >= 3, "strong").otherwise("suggestive")
    return (
        F.when(key == "catalytic_core", F.when(m("triad_intact"), "direct").otherwise("absent"))
        .when(key == "family_membership", membership)
        .when(key == "partner_association", association)
        .when(key == "noncoding_component", noncoding)
        .when(key == "taxonomic_spread", spread)
        .when(key == "architecture", F.when(m("novelty") >= 0.6, "strong").otherwise("suggestive"))
        .when(key.isin("array_placement", "partner_is_known"), "strong")
    )


def overclaims(claims: DataFrame) -> DataFrame:
    """Of claims (evidence_key, strength and the candidate's metrics) those that go beyond strength_for; supported says what holds."""
    rank = F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])
    return claims.withColumn("supported", strength_for(F.col("evidence_key"))).where(rank[F.col("strength")] > rank[F.col("supported")])


#: What each kind of evidence rests on, and the least of it that is evidence for a candidate rather than against it.
EVIDENCE = {
    "catalytic_core": ("triad_intact", 1.0), "family_membership": ("profile_z", 8.0), "architecture": ("novelty", 0.35), "partner_association": ("partner_conservation", 0.5),
    "taxonomic_spread": ("n_phyla", 2.0), "noncoding_component": ("array_quality", 0.4), "array_placement": ("array_operon_gap_bp", None), "partner_is_known": ("partner_known_neglog_e", None),
}


def evidence(cands: DataFrame, key: str = "candidate_id") -> DataFrame:
    """A row a candidate and kind of evidence: evidence_key, metric, measured, strength (what strength_for supports, else suggestive) and supports.

    An array's placement is evidence only where there is an array, and supports within 3000 letters; a described partner speaks against novelty, and has a row only from three orders of magnitude.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("evidence_key"), F.lit(metric).alias("metric"), F.col(metric).cast("double").alias("measured"), F.lit(least).cast("double").alias("least")) for k, (metric, least) in EVIDENCE.items()])
    rows = cands.withColumn("kinds_", F.explode(kinds)).select("*", "kinds_.*").drop("kinds_")
    there = (F.col("evidence_key") != "array_placement") | (F.col("array_quality") > 0)
    there &= (F.col("evidence_key") != "partner_is_known") | (F.col("partner_known_neglog_e") >= 3.0)
    supports = F.when(F.col("evidence_key") == "array_placement", F.col("measured") <= 3000).when(F.col("evidence_key") == "partner_is_known", False).otherwise(F.col("measured") >= F.col("least"))
    return rows.where(there).select(key, "evidence_key", "metric", "measured", F.coalesce(strength_for(F.col("evidence_key")), F.lit("suggestive")).alias("strength"), F.coalesce(supports, F.lit(False)).alias("supports"))


def asserted_beyond(found: DataFrame, claims: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Of claims (key, evidence_key, asserted) those stronger than the evidence rows hold, or about what has none (absent).

    Both sides have several rows a candidate, which Spark's estimate from the files does not count: neither is broadcast.
    """
    rank = F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])
    both = claims.join(found.select(key, "evidence_key", F.col("strength").alias("held")).hint("merge"), [key, "evidence_key"], "left").withColumn("held", F.coalesce("held", F.lit("absent")))
    return both.where(rank[F.col("asserted")] > rank[F.col("held")]).select(key, "evidence_key", "asserted", "held")

"""Sets of motifs with an order and spacings, and the catalytic triad of a two-metal active site.

Matches come from one lookahead expression a motif, inside the JVM. The triad is a range join by window frames. The best placement of a
set, a choice among few matches a motif, is made by a function of the match lists, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from locusframe.functions import motifs

#: Matches of a motif that a placement chooses among: the first ones.
MOST_MATCHES = 40


@dataclass(frozen=True)
class Motif:
    name: str
    pattern: str
    essential: bool = False
    earliest: int | None = None
    latest: int | None = None


@dataclass(frozen=True)
class MotifSet:
    motifs: tuple[Motif, ...]
    #: (earlier, later) motif: least and most residues between the end of one and the start of the other
    spacing: dict[tuple[str, str], tuple[int, int]] = field(default_factory=dict)
    ordered: bool = True


# The motifs of the reverse-transcriptase palm and their spacings.
RT_PALM = MotifSet(
    (
        Motif("A", "[LIVMF]-x-[DN]-[LIVMFYAG]", True),
        Motif("B", "[KR]-x(2,4)-[LIVMFYA]-x-[LIVMFYAG]-[KRQ]"),
        Motif("C", "[YF]-x-[DN]-[DN]", True),
        Motif("E", "[LIVMFY]-[GAST]-x-[LIVMFY]-x-[KRQNH]"),
    ),
    {("A", "C"): (40, 180), ("C", "E"): (0, 90)},
)
_PLACED = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int32()), ("text", pa.string())]))


def options(sequence: Column, motif: Motif) -> Column:
    """The places and texts of a motif's first MOST_MATCHES matches, those in its range of places."""
    places = F.transform(motifs.found_at(sequence, motif.pattern), lambda t, i: F.struct(i.alias("start"), t.alias("text")))
    first = F.slice(F.filter(places, lambda x: x["text"] != ""), 1, MOST_MATCHES)
    low, high = motif.earliest if motif.earliest is not None else 0, motif.latest if motif.latest is not None else (1 << 31) - 1
    return F.filter(first, lambda x: x["start"].between(low, high))


def best_placement(of: MotifSet, found: list[list[tuple[int, str]]]) -> list[tuple[str, int, str]]:
    """The placement with the most essential motifs, then motifs, then information, then the least span; of equal ones the first by matches, a match before none.

    Placements are extended motif by motif. Of those that agree in the last placed start and in all placements that a spacing
    still asks for, one is carried on for each way they can still differ: counts, information and first start.
    """
    bits = [motifs.information(m.pattern) for m in of.motifs]
    states: list[tuple] = [((), 0, 0, 0.0)]  # placed (name, start, text), essential, motifs, information
    for at, (motif, own) in enumerate(zip(of.motifs, found, strict=True)):
        grown = []
        for placed, essential, n, info in states:
            for start, text in own:
                if of.ordered and placed and start < placed[-1][1]:
                    continue
                if all(_spaced(of, p, (motif.name, start, text)) for p in placed):
                    grown.append(((*placed, (motif.name, start, text)), essential + motif.essential, n + 1, info + bits[at]))
            grown.append((placed, essential, n, info))
        needed = {a for a, b in of.spacing if any(m.name == b for m in of.motifs[at + 1 :])} | {b for a, b in of.spacing if any(m.name == a for m in of.motifs[at + 1 :])}
        seen, states = {}, []
        for s in grown:
            placed = s[0]
            starts = [p[1] for p in placed]
            key = (s[1], s[2], s[3], placed[-1][1] if placed else -1, min(starts, default=-1), max(starts, default=-1), tuple(p for p in placed if p[0] in needed))
            if key not in seen:
                seen[key] = True
                states.append(s)
    span = lambda s: max((p[1] for p in s[0]), default=0) - min((p[1] for p in s[0]), default=0)
    return list(max(states, key=lambda s: (s[1], s[2], s[3], -span(s)))[0])


def _spaced(of: MotifSet, a: tuple[str, int, str], b: tuple[str, int, str]) -> bool:
    for (first, second), (low, high) in of.spacing.items():
        for x, y in ((a, b), (b, a)):
            if x[0] == first and y[0] == second and not low <= y[1] - x[1] - len(x[2]) <= high:
                return False
    return True


def scan(df: DataFrame, sequence: str, of: MotifSet = RT_PALM) -> DataFrame:
    """df with placed (the best placement), missing, missing_essential, intact and completeness."""

    @F.arrow_udf(from_arrow_type(_PLACED))
    def place(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            rows = ([[(m["start"], m["text"]) for m in own or []] for own in row] for row in column.to_pylist())
            yield pa.array([[dict(zip(("name", "start", "text"), p, strict=True)) for p in best_placement(of, row)] for row in rows], _PLACED)

    names = F.array(*[F.lit(m.name) for m in of.motifs])
    essential = F.array(*[F.lit(m.name) for m in of.motifs if m.essential]) if any(m.essential for m in of.motifs) else F.array().cast("array<string>")
    out = df.withColumn("placed", place(F.array(*[options(F.col(sequence), m) for m in of.motifs])))
    there = F.col("placed.name")
    out = out.withColumn("missing", F.array_except(names, there)).withColumn("missing_essential", F.array_except(essential, there))
    return out.withColumn("intact", F.size("missing_essential") == 0).withColumn("completeness", F.size("placed") / len(of.motifs))


def summary() -> Column:
    """A placement in words."""
    hits = F.array_join(F.transform("placed", lambda p: F.concat(p["name"], F.lit("@"), p["start"], F.lit(":"), p["text"])), ", ")
    found = F.concat(F.lit("found["), F.when(hits != "", hits).otherwise("none"), F.lit("]"))
    return F.concat(found, F.when(F.size("missing") > 0, F.concat(F.lit(" missing["), F.array_join("missing", ","), F.lit("]"))).otherwise(""))


def triad(df: DataFrame, key: str, sequence: Column, of: MotifSet = RT_PALM, first: str = "A", second: str = "C") -> DataFrame:
    """key, intact and reason: whether a spaced pair of the two motifs has an aspartate in the first and two in the second.

    A window frame gives each first motif the second ones at its distance; no pair is made.
    """
    low, high = of.spacing[first, second]
    pattern = {m.name: m.pattern for m in of.motifs}
    a, c = (motifs.matches(df, key, sequence, pattern[x]) for x in (first, second))
    both = a.select(key, "start", "match", (F.col("start") + F.length("match")).alias("at"), F.lit(False).alias("second")).union(c.select(key, "start", "match", F.col("start").alias("at"), F.lit(True).alias("second")))
    ahead = Window.partitionBy(key).orderBy("at").rangeBetween(low, high)
    aspartates = F.length("match") - F.length(F.replace("match", F.lit("D"), F.lit("")))
    other = F.struct("start", "match")
    rows = both.withColumn("partner", F.min(F.when(F.col("second"), other)).over(ahead)).withColumn("good_partner", F.min(F.when(F.col("second") & (aspartates >= 2), other)).over(ahead))
    own = F.struct("start", "match")
    is_first = ~F.col("second")
    pair = lambda partner: F.min(F.when(is_first & F.col(partner).isNotNull(), F.struct(own.alias("a"), F.col(partner).alias("c"))))
    good = F.min(F.when(is_first & F.col("good_partner").isNotNull() & (aspartates >= 1), F.struct(own.alias("a"), F.col("good_partner").alias("c"))))
    found = rows.groupBy(key).agg(F.min(F.when(is_first, own)).alias("a"), F.min(F.when(F.col("second"), own)).alias("c"), pair("partner").alias("spaced"), good.alias("good"))
    out = df.select(key).distinct().join(found, key, "left")
    at = lambda c: F.concat(F.col(f"{c}.match"), F.lit("@"), F.col(f"{c}.start") + 1)
    reason = (
        F.when(F.col("c").isNull(), F.lit(f"no match of motif {second}"))
        .when(F.col("good").isNotNull(), F.concat(F.lit(f"intact: motif {first} "), at("good.a"), F.lit(f", motif {second} "), at("good.c")))
        .when(F.col("spaced").isNull() & F.col("a").isNull(), F.concat(F.lit(f"motif {second} "), at("c"), F.lit(f" without a motif {first}")))
        .when(F.col("spaced").isNull(), F.concat(F.lit(f"no motifs {low} to {high} apart; first are "), at("a"), F.lit(" and "), at("c")))
        .when(F.length("spaced.c.match") - F.length(F.replace("spaced.c.match", F.lit("D"), F.lit(""))) < 2, F.concat(F.lit(f"motif {second} "), at("spaced.c"), F.lit(" lacks an aspartate of its pair")))
        .otherwise(F.concat(F.lit(f"motif {first} "), at("spaced.a"), F.lit(" lacks its aspartate")))
    )
    return out.select(key, F.col("good").isNotNull().alias("intact"), reason.alias("reason"))

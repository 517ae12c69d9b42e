"""Motifs in PROSITE-like notation: compiled on the driver, searched as Columns."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .sequence import AMINO

_ELEMENT = re.compile(r"(<?)(?:\[([A-Z]+)\]|\{([A-Z]+)\}|([A-Zx]))(?:\((\d+)(?:,(\d+))?\))?(>?)")


def elements(pattern: str) -> list[tuple[str, str, int, int, str]]:
    """(anchor, letters, least, most, anchor) of each element; x is all letters."""
    out = []
    for part in pattern.strip().rstrip(".").split("-"):
        m = _ELEMENT.fullmatch(part)
        if not m:
            raise ValueError(f"{part!r} is no motif element")
        begin, some, none, one, least, most, end = m.groups()
        letters = some or ("".join(a for a in AMINO if a not in none) if none else AMINO if one == "x" else one)
        low = int(least or 1)
        out.append((begin, letters, low, int(most or low), end))
    return out


def to_regex(pattern: str) -> str:
    """A regular expression; x also takes what is no residue."""
    out = ""
    for begin, letters, low, high, end in elements(pattern):
        one = "." if letters == AMINO else letters if len(letters) == 1 else f"[{letters}]"
        times = "" if low == high == 1 else f"{{{low}}}" if low == high else f"{{{low},{high}}}"
        out += "^" * bool(begin) + one + times + "$" * bool(end)
    return out


def information(pattern: str) -> float:
    """Bits: log2(20 / allowed residues) over all positions."""
    return sum(low * math.log2(len(AMINO) / len(letters)) for _, letters, low, _, _ in elements(pattern))


@F.arrow_udf(DoubleType())
def information_of(patterns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """information of a column of patterns; null of null."""
    for column in patterns:
        yield pa.array([None if p is None else information(p) for p in column.to_pylist()], pa.float64())


def found_at(sequence: Column, pattern: str) -> Column:
    """An array with an entry for each place: what matches there, or an empty string. Patterns may be of any length; a place has one match."""
    return F.regexp_extract_all(sequence, F.lit(f"(?s)(?=({to_regex(pattern)})?)."), F.lit(1))


def matches(df: DataFrame, key: str, sequence: Column, pattern: str) -> DataFrame:
    """key, start (from 0) and match of all matches of a pattern, overlapping ones included."""
    return df.select(key, F.posexplode(found_at(sequence, pattern)).alias("start", "match")).where("match <> ''")


def linked_pairs(first: DataFrame, second: DataFrame, key: str, gap: tuple[int, int]) -> DataFrame:
    """Of first (key, start, match) the rows with n, how many rows of second begin between gap[0] and gap[1] after its end.

    A range join by one window a key: the frame counts, no pair is made.
    """
    both = first.select(key, (F.col("start") + F.length("match")).alias("at"), "start", "match").withColumn("other", F.lit(0)).unionByName(
        second.select(key, F.col("start").alias("at"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("string").alias("match"), F.lit(1).alias("other"))
    )
    ahead = Window.partitionBy(key).orderBy("at").rangeBetween(*gap)
    return both.withColumn("n", F.coalesce(F.sum("other").over(ahead), F.lit(0))).where("other = 0").select(key, "start", "match", "n")

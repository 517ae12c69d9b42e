"""Statistics over DataFrames: exact tests, false-discovery control, ranks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: Stirling's series eight steps up, and the product back down. Good to 1e-12."""
    y = x + 8.0
    product = F.lit(1.0)
    for i in range(8):
        product = product * (x + float(i))
    inverse = 1.0 / y
    square = inverse * inverse
    series = inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square / 1680)))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def log_choose(n: Column, k: Column) -> Column:
    return log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)


def log_hypergeometric(k: Column, drawn: Column, marked: Column, total: Column) -> Column:
    """ln of the chance of k marked among drawn of total."""
    k, drawn, marked, total = (x.cast("double") for x in (k, drawn, marked, total))
    return log_choose(drawn, k) + log_choose(total - drawn, marked - k) - log_choose(total, marked)


#: Terms of a tail that are summed at once, and the share of the sum below which further terms change nothing.
_TERMS, _NOTHING = 4096, 1e-18


def _terms(k: int, step: int, drawn: int, marked: int, total: int, last: int) -> float:
    """The sum of hypergeometric terms from k to last relative to that of k, which is the largest of them."""
    out, term = 1.0, 1.0
    while k != last:
        at = np.arange(k, k + step * min(_TERMS, abs(last - k)), step, dtype=np.float64)
        up, down = (drawn - at) * (marked - at), (at + 1) * (total - drawn - marked + at + 1)
        if step < 0:
            up, down = at * (total - drawn - marked + at), (drawn - at + 1) * (marked - at + 1)
        terms = term * np.cumprod(up / down)
        out, term, k = out + float(terms.sum()), float(terms[-1]), k + step * len(at)
        if term < _NOTHING * out:
            break
    return out


def _tail(a: int, b: int, c: int, d: int) -> float:
    drawn, marked, total = a + b, a + c, a + b + c + d
    if total == 0:
        return 1.0
    low, high = max(0, drawn + marked - total), min(drawn, marked)
    mode = min(max(low, (drawn + 1) * (marked + 1) // (total + 2)), high)
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    start = max(a, mode)
    at = math.exp(choose(drawn, start) + choose(total - drawn, marked - start) - choose(total, marked))
    out = _terms(start, 1, drawn, marked, total, high)
    if a < start:
        out += _terms(start, -1, drawn, marked, total, a) - 1
    return min(1.0, at * out)


@F.arrow_udf(DoubleType())
def fisher_p(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """One-sided p of a table [[a, b], [c, d]] with at least a in its corner, margins kept.

    The tail is summed from its largest term outwards by the ratio of neighbours, until a term no longer changes the sum: no array
    is as long as a margin.
    """
    for batch in columns:
        rows = zip(*(c.to_pylist() for c in batch), strict=True)
        yield pa.array([None if None in r else _tail(*map(int, r)) for r in rows], pa.float64())


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """With half a count added to each cell; 1 for an empty table."""
    a, b, c, d = (x + 0.5 for x in (a, b, c, d))
    return F.when(a + b + c + d == 2.0, 1.0).otherwise((a * d) / (b * c))


def running(counted: DataFrame, by: list[str], chunk: Column, order: str, of: dict[str, str]) -> DataFrame:
    """counted (distinct values of ``order``) with running sums: of[name] is the column summed up to and with each row.

    Sums run within chunks, ranges of the order, then over the chunks' sums: no task sorts a whole group.
    """
    own = counted.withColumn("chunk_", chunk)
    sums = own.groupBy(*by, "chunk_").agg(*[F.sum(c).alias(f"{n}_before") for n, c in of.items()])
    over = Window.partitionBy(*by).orderBy("chunk_").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    sums = sums.select(*by, "chunk_", *[F.coalesce(F.sum(f"{n}_before").over(over), F.lit(0)).alias(f"{n}_before") for n in of])
    inner = Window.partitionBy(*by, "chunk_").orderBy(order)
    own = own.withColumns({f"{n}_within": F.sum(c).over(inner) for n, c in of.items()}).join(sums, [*by, "chunk_"])
    out = own.withColumns({n: F.col(f"{n}_before") + F.col(f"{n}_within") for n in of})
    return out.drop("chunk_", *[f"{n}_before" for n in of], *[f"{n}_within" for n in of])


def benjamini_hochberg(df: DataFrame, p: str, by: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """df with rejected: ranks by p up to the last one whose p is within alpha * rank / n, within each group of by.

    Equal p are rejected together, so it takes only the largest such p of a group, from the counts of distinct ones.
    """
    keys = by or ["all_"]
    rows = df if by else df.withColumn("all_", F.lit(0))
    counted = rows.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count("*").alias("times_"))
    ratio = F.when(F.col(p) > 0, F.floor(64 * F.log(p))).otherwise(-(1 << 30))  # ranges of p whose ends differ by one part in 64
    ranked = running(counted, keys, ratio, p, {"rank_": "times_"})
    n = counted.groupBy(*keys).agg(F.sum("times_").alias("n_"))
    good = ranked.join(F.broadcast(n) if not by else n, keys).where(F.col(p) <= alpha * F.col("rank_") / F.col("n_"))
    last = good.groupBy(*keys).agg(F.max(p).alias("last_"))  # a row a group
    out = rows.join(F.broadcast(last) if not by else last, keys, "left")
    return out.withColumn("rejected", F.coalesce(F.col(p) <= F.col("last_"), F.lit(False))).drop("last_", "all_")


def auroc(df: DataFrame, feature: str, value: str, positive: str) -> DataFrame:
    """feature, auroc, n_positive, n_negative: Mann-Whitney with ties as a half; 0.5 if a class is empty.

    Equal values are counted first; the counts of distinct values are then summed in ranges between approximate percentiles.
    """
    counted = df.where(F.col(value).isNotNull() & F.col(positive).isNotNull()).groupBy(feature, value).agg(F.sum(F.col(positive).cast("long")).alias("pos"), F.sum((~F.col(positive)).cast("long")).alias("neg"))
    ends = counted.groupBy(feature).agg(F.percentile_approx(value, [i / 128 for i in range(1, 128)], 1000).alias("ends_"))  # a row a feature
    chunk = F.size(F.filter("ends_", lambda e: e < F.col(value)))
    ranked = running(counted.join(ends, feature), [feature], chunk, value, {"upto_": "neg"})
    wins = ranked.withColumn("won", F.col("pos") * (F.col("upto_") - F.col("neg") / 2.0))
    out = wins.groupBy(feature).agg(F.sum("won").alias("won"), F.sum("pos").alias("n_positive"), F.sum("neg").alias("n_negative"))
    area = F.when((F.col("n_positive") == 0) | (F.col("n_negative") == 0), 0.5).otherwise(F.col("won") / (F.col("n_positive") * F.col("n_negative")))
    return out.select(feature, area.alias("auroc"), "n_positive", "n_negative")


def permutation_p(df: DataFrame, by: list[str], observed: str, null: str) -> DataFrame:
    """A row a group: the share of null values at least the observed one, one added to both, and the null's mean and spread."""
    extreme = F.sum((F.col(null) >= F.col(observed)).cast("long"))
    n = F.count(null)
    return df.groupBy(*by).agg(
        F.max(observed).alias("observed"), F.avg(null).alias("null_mean"), F.stddev_pop(null).alias("null_sd"), F.when(n == 0, 1.0).otherwise((extreme + 1) / (n + 1)).alias("p_value"), n.alias("n")
    )


def neglog(p: Column) -> Column:
    """-log10 with 0 for infinity or null and 300 for what is not above 1e-300."""
    return F.when(p.isNull() | (p == float("inf")), 0.0).when(p <= 1e-300, 300.0).otherwise(-F.log10(p))

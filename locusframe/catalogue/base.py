"""What the groups of queries share: reading tables and registering a query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions.sequence import AMINO

#: A text's letters as residues and as bases, in SQL; see text_as_protein and text_as_dna.
PROTEIN_SQL = "translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'BJOUXZ', 'XXXXXX')"
DNA_SQL = f"translate(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', '{('ACGT' * 7)[:26]}')"
RESIDUES_SQL = "(" + ", ".join(f"('{a}')" for a in AMINO) + ")"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """key and text of a table, null texts as empty."""
    return table(spark, sf_dir, name).select(key, F.coalesce("text", F.lit("")).alias("text"))


def rounded(c: Column, places: int = 6) -> Column:
    return F.round(c, places)


def registry() -> tuple[dict, dict, Callable]:
    """QUERIES, ORACLES and a decorator that enters a query with its SQL (None: held against brute force in tests)."""
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None):
        def enter(f):
            found[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return enter

    return found, oracles, query

"""Where a survey's data come from: corpora by a word for their place, what was read, and the catalogue of described systems with its targets from a file."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.operators import locus

from .corpus import TABLES, Corpus, systems

#: Described systems are compiled into one expression each; a file with more is refused.
MOST_SYSTEMS = 1000
_FILE = """
    systems array<struct<
        system_id: string, name: string, required: array<string>, optional: array<string>, forbidden: array<string>,
        required_labels: array<string>, optional_labels: array<string>, forbidden_labels: array<string>,
        requires_array: boolean, forbids_array: boolean, array_repeat_range: array<int>, anchor_aa: array<int>, typical_anchor_aa: array<int>,
        reference: string, notes: string>>,
    reproduction_targets array<struct<system_id: string, min_recall: double, min_precision: double>>
"""
#: Other names that a file may give a key.
_NAMES = {"required_labels": "required", "optional_labels": "optional", "forbidden_labels": "forbidden", "typical_anchor_aa": "anchor_aa"}


def open_corpus(spark: SparkSession, place: str, names: tuple[str, ...] = TABLES) -> Corpus:
    """The corpus at a place: ``local:<folder>`` or a folder (a table a subfolder, any store that Spark reads), or ``tables:<schema>`` for tables of the session's catalogue."""
    kind, _, rest = place.partition(":")
    if kind == "tables":
        return Corpus({n: spark.table(f"{rest}.{n}") for n in names})
    return Corpus.read(spark, rest if kind == "local" else place, names)


def provenance(corpus: Corpus) -> DataFrame:
    """A row a table of the corpus: name, n_rows, n_files, n_bytes, modified (of the newest file) and identity, which changes with any file's name, size or time.

    Counts and files come from what the reader knows of its files; no column is read. A table that is not of files has nulls but for its rows; an empty one has no files.
    """
    return reduce(DataFrame.union, [_of_table(n, t) for n, t in corpus.tables.items()])


def _of_table(name: str, table: DataFrame) -> DataFrame:
    try:
        files = table.groupBy(*[F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_size", "file_modification_time")]).agg(F.count("*").alias("n"))
        identity = F.bit_xor(F.xxhash64("file_path", "file_size", "file_modification_time"))
        about = [F.count("*"), F.sum("file_size"), F.max("file_modification_time"), identity]
    except AnalysisException:
        files, about = table.agg(F.count("*").alias("n")), [F.max(F.lit(None).cast(t)) for t in ("long", "long", "timestamp", "long")]
    aliased = [c.alias(a) for c, a in zip(about, ("n_files", "n_bytes", "modified", "identity"), strict=True)]
    return files.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), *aliased).select(F.lit(name).alias("name"), "n_rows", "n_files", "n_bytes", "modified", "identity")


@dataclass(frozen=True)
class Catalogue:
    systems: list[locus.System]
    #: system_id, min_recall and min_precision of the systems that a survey must find again
    targets: DataFrame


def read_catalogue(spark: SparkSession, path: str) -> Catalogue:
    """Described systems and reproduction targets of a JSON document (``systems``, ``reproduction_targets``).

    Raises ValueError with all that is wrong: no or repeated ids, a system that requires nothing or that nothing could rule out, ranges that are not two ascending
    numbers, targets of unknown systems or outside of (0, 1], no target, more than MOST_SYSTEMS systems.
    """
    document = spark.read.schema(_FILE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = document.select(F.inline("systems")).limit(MOST_SYSTEMS + 1).collect()
    described = [_keys({k: v for k, v in r.asDict().items() if v is not None}) for r in rows]
    wanted = document.select(F.inline("reproduction_targets"))
    wrong = _faults(described) + _target_faults([r.asDict() for r in wanted.limit(MOST_SYSTEMS + 1).collect()], {d.get("system_id") for d in described})
    if wrong:
        raise ValueError(f"{path}: " + "; ".join(wrong))
    return Catalogue(systems(described), wanted)


def _keys(d: dict) -> dict:
    out = {_NAMES.get(k, k): v for k, v in d.items() if k not in ("reference", "notes")}
    notes = {k: d[k] for k in ("reference", "notes") if k in d}
    return {"required": [], **out, **({"notes": notes} if notes else {})}


def _faults(described: list[dict]) -> list[str]:
    out = [f"more than {MOST_SYSTEMS} systems"] if len(described) > MOST_SYSTEMS else [] if described else ["no systems"]
    ids = [d.get("system_id") for d in described]
    out += [f"{i} occurs more than once" for i in sorted({i for i in ids if i and ids.count(i) > 1})]
    for d in described:
        who = d.get("system_id") or "a system"
        out += [f"{who} has no {k}" for k in ("system_id", "name") if not d.get(k)]
        out += [f"{who} requires nothing"] if not d["required"] else []
        out += [f"nothing rules {who} out"] if not (d.get("forbidden") or d.get("requires_array") or d.get("forbids_array")) else []
        out += [f"{who}: {k} is no range" for k in ("array_repeat_range", "anchor_aa") if k in d and (len(d[k]) != 2 or None in d[k] or d[k][0] > d[k][1])]
    return out


def _target_faults(targets: list[dict], known: set[str]) -> list[str]:
    out = [] if targets else ["no reproduction targets"]
    for t in targets:
        out += [f"target {t['system_id']} is no system"] if t["system_id"] not in known else []
        out += [f"target {t['system_id']}: {k} is not above 0 and up to 1" for k in ("min_recall", "min_precision") if t[k] is None or not 0 < t[k] <= 1]
    return out

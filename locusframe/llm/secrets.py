"""Secret scans with multipart credential linking.

Three kinds of pattern give base spans (assignments, access identifiers, hexadecimal runs). The method adds
weak candidates: account names, endpoints and dense opaque strings, which alone mean little. Within a
document the candidates' intervals are joined with those of the complementary kinds, and a weak candidate
is reported only where a complementary part lies in the same scope, a window of code points.

Defined cases: a null or empty text has no spans; texts are scanned whole; repeated rows give equal rows; an
empty table gives no rows; columns other than doc_id and text are not read by the query.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

KINDS = ("assign", "access", "hex", "account", "endpoint", "opaque")
#: Code points between two parts' nearest ends, at most, for them to be in one scope.
SCOPE = 300

_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_ACCOUNT = re.compile(r"""(?ai)\b(?:user(?:name)?|login|client_?id|account(?:_?id)?|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""")
_ENDPOINT = re.compile(r"""(?ai)\b(?:(?:https?|postgres|postgresql|mysql|redis|amqp|mongodb|ftp|s3)://[A-Za-z0-9._:@/-]{4,}|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{4,})""")
_OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_HAS = {"assign": ("passw", "secret", "token", "api"), "account": ("user", "login", "client", "account", "access")}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, index of the kind), by start, then kind."""
    low = text.lower() if text.isascii() else text.translate(_LOWER)
    out = []
    if any(x in low for x in _HAS["assign"]):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


_LOWER = {c: c + 32 for c in range(65, 91)}


def dense(s: str) -> bool:
    """Whether a run of letters and digits mixes three classes, as generated keys do and words do not."""
    return sum((any(c.islower() for c in s), any(c.isupper() for c in s), any(c.isdigit() for c in s))) == 3


def weak_spans(text: str) -> list[tuple[int, int, int]]:
    low = text.lower() if text.isascii() else text.translate(_LOWER)
    out = []
    if any(x in low for x in _HAS["account"]):
        out += [(m.start(1), m.end(1), 3) for m in _ACCOUNT.finditer(text)]
    if "://" in text or any(x in low for x in ("host", "endpoint", "server")):
        out += [(m.start(), m.end(), 4) for m in _ENDPOINT.finditer(text)]
    out += [(m.start(), m.end(), 5) for m in _OPAQUE.finditer(text) if dense(m[0])]
    return out


#: Which kinds make a weak candidate of a kind believable: secrets for names and places, names and places for opaque strings.
COMPLEMENT = {3: (0, 1, 2, 5), 4: (0, 1, 2, 5), 5: (1, 3, 4)}


def linked(base: list[tuple[int, int, int]], weak: list[tuple[int, int, int]], scope: int = SCOPE) -> list[tuple[int, int, int]]:
    """The weak spans with a complementary span within scope of them. An interval join by sorted starts and running ends: no pairs are made."""
    if not weak:
        return []
    taken = {s[:2] for s in base}
    weak = [w for w, inside in zip(weak, _contained(weak, taken), strict=True) if w[:2] not in taken and not (w[2] == 5 and inside)]
    everything = sorted(set(base) | set(weak))
    keep = []
    by_kind = {}
    for kind in range(len(KINDS)):
        own = [s for s in everything if s[2] == kind]
        if own:
            by_kind[kind] = np.array([s[0] for s in own]), np.maximum.accumulate(np.array([s[1] for s in own]))
    for kind, needs in COMPLEMENT.items():
        own = [w for w in weak if w[2] == kind]
        if not own:
            continue
        starts, ends = np.array([w[0] for w in own]), np.array([w[1] for w in own])
        found = np.zeros(len(own), dtype=bool)
        for other in needs:
            if other in by_kind:
                s, furthest = by_kind[other]
                upto = np.searchsorted(s, ends + scope, side="right")  # parts that start no later than the scope ends
                found |= (upto > 0) & (furthest[np.maximum(upto - 1, 0)] >= starts - scope)
        keep += [w for w, f in zip(own, found, strict=True) if f]
    return sorted(set(keep), key=lambda s: (s[0], s[2]))


def _contained(spans: list[tuple[int, int, int]], taken: set[tuple[int, int]]) -> list[bool]:
    """Whether each span lies in one of the taken: of those that start no later, one ends no earlier."""
    if not taken:
        return [False] * len(spans)
    own = sorted(taken)
    starts, furthest = np.array([t[0] for t in own]), np.maximum.accumulate(np.array([t[1] for t in own]))
    upto = np.searchsorted(starts, np.array([s[0] for s in spans]), side="right")
    return ((upto > 0) & (furthest[np.maximum(upto - 1, 0)] >= np.array([s[1] for s in spans]))).tolist()


def find(text: str, scope: int = SCOPE) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    return base, linked(base, weak_spans(text), scope)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


SPANS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        out = []
        for text in batch.column("text").to_pylist():
            base, added = find(text or "")
            count = [sum(s[2] == k for s in base) for k in range(3)]
            out.append((*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(set(base) | set(added), key=lambda s: (s[0], s[2])))))
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.int64(),) * 3 + (pa.string(),) * 2
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in SPANS.split(", ")])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, a digest of the base spans, and all spans as kind:start:end."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, SPANS)


@F.pandas_udf(StringType())
def _mask(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for column in texts:
        out = []
        for text in column:
            if not text:
                out.append(text)
                continue
            base, added = find(text)
            parts, at = [], 0
            for a, b, k in sorted(set(base) | set(added)):
                if b > at:
                    parts += [text[at : max(a, at)], f"<{KINDS[k]}>"] if a >= at else []
                    at = b
            out.append("".join([*parts, text[at:]]) if parts else text)
        yield pd.Series(out, dtype=object)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every found span replaced by its kind; other columns and all rows stay (n_chars follows the text where there is such a column)."""
    out = docs.withColumn("text", _mask("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

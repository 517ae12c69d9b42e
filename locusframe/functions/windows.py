"""Per-sequence measures that need rolling counts: Arrow batches and numpy, a text at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .sequence import AMINO, LOW_ENTROPY, LOW_WINDOW

_CODE = np.full(256, len(AMINO), dtype=np.int64)
_CODE[np.frombuffer(AMINO.encode(), np.uint8)] = np.arange(len(AMINO))


def window_entropies(sequence: str, window: int = LOW_WINDOW) -> np.ndarray:
    """Shannon entropy (bits, over standard residues) of each window; of the whole where it is shorter."""
    code = _CODE[np.frombuffer(sequence.encode("ascii", "replace"), np.uint8)]
    span = min(window, len(code))
    out, total = np.zeros(max(len(code) - span + 1, 0)), np.zeros(max(len(code) - span + 1, 0))
    counts = []
    for a in range(len(AMINO)):
        upto = np.concatenate([[0], np.cumsum(code == a)])
        counts.append(upto[span:] - upto[: len(upto) - span])
        total += counts[-1]
    for n in counts:
        p = n / np.maximum(total, 1)
        out -= np.where(n > 0, p * np.log2(np.where(n > 0, p, 1)), 0.0)
    return out


@F.pandas_udf(DoubleType())
def low_complexity_fraction(sequences: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The share of windows of LOW_WINDOW residues with an entropy under LOW_ENTROPY; 1 or 0 for a shorter sequence, 0 for an empty one."""
    for s in sequences:
        yield pd.Series([float(np.mean(window_entropies(x) < LOW_ENTROPY - 1e-9)) if x else 0.0 for x in s], dtype=float)


_FRAME = ("start", "end", "strand", "length")


@F.pandas_udf(ArrayType(StructType([StructField(x, IntegerType()) for x in _FRAME])))
def open_reading_frames(sequences: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Open reading frames of both strands: from each ATG to the first stop in frame; forward coordinates, length in residues."""
    for s in sequences:
        yield pd.Series([frames(x or "") for x in s])


_COMPLEMENT = bytes.maketrans(b"ACGT", b"TGCA")


def _forward(dna: bytes) -> np.ndarray:
    """(start, end) of each ATG with a stop in its frame, the stop included."""
    x = np.frombuffer(dna, np.uint8)
    if len(x) < 6:
        return np.empty((0, 2), dtype=np.int64)
    a, b, c = x[:-2], x[1:-1], x[2:]
    t, g, ad = ord("T"), ord("G"), ord("A")
    begin = np.flatnonzero((a == ad) & (b == t) & (c == g))
    stop = np.flatnonzero((a == t) & (((b == ad) & ((c == ad) | (c == g))) | ((b == g) & (c == ad))))
    out = []
    for frame in range(3):
        starts, stops = begin[begin % 3 == frame], stop[stop % 3 == frame]
        at = np.searchsorted(stops, starts)
        there = at < len(stops)
        out.append(np.stack([starts[there], stops[at[there]] + 3], axis=1))
    return np.concatenate(out)


def frames(dna: str, least: int = 30) -> list[dict]:
    """All open reading frames of at least so many residues, by start and end."""
    raw = dna.upper().encode("ascii", "replace")
    n, found = len(raw), []
    for strand, seq in ((1, raw), (-1, raw.translate(_COMPLEMENT)[::-1])):
        for a, b in _forward(seq).tolist():
            length = (b - a) // 3 - 1
            if length >= least:
                found.append((a, b, strand, length) if strand > 0 else (n - b, n - a, strand, length))
    return [dict(zip(_FRAME, f, strict=True)) for f in sorted(found)]

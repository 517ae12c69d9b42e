"""k-mers as whole numbers, rolled over sequences in Arrow batches.

A k-mer of an alphabet of n letters is a number in base n, exact and of one long: no string of it is ever made. Sequences are taken in
pieces of PIECE letters with the next k - 1 of them, so a long one takes no more memory than a short one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions.sequence import AMINO, REDUCED

PIECE = 1 << 18


def letter_codes(alphabet: str) -> np.ndarray:
    """The code of each byte: its letter's place in the alphabet; len(alphabet) for any other."""
    out = np.full(256, len(alphabet), dtype=np.int64)
    out[np.frombuffer(alphabet.encode(), np.uint8)] = np.arange(len(alphabet))
    return out


def rolled(codes: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and numbers of the k-mers without a code of n or more."""
    if n**k >= 1 << 63:
        raise ValueError(f"{k}-mers of {n} letters do not fit a long")
    places = len(codes) - k + 1
    if places <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    out = np.zeros(places, dtype=np.int64)
    for j in range(k):
        out *= n
        out += codes[j : j + places]
    odd = np.concatenate([[0], np.cumsum(codes >= n)])
    good = np.flatnonzero(odd[k:] == odd[:-k])
    return good, out[good]


def _pieces(sequences: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, place, bytes) of the pieces of sequences; other than ASCII letters count as one odd letter each."""
    for row, s in enumerate(sequences.to_pylist()):
        raw = np.frombuffer((s or "").encode("ascii", "replace"), np.uint8)
        for at in range(0, max(len(raw) - k + 1, 0), PIECE):
            yield row, at, raw[at : at + PIECE + k - 1]


def index(df: DataFrame, key: str, sequence: Column, k: int, alphabet: str = AMINO) -> DataFrame:
    """key, pos (from 0) and kmer, a long, of all k-mers of letters of the alphabet."""
    table, n = letter_codes(alphabet), len(alphabet)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            own, pos, kmer, held = [], [], [], 0

            def made():
                at = pa.array(np.concatenate(own) if own else np.empty(0, dtype=np.int64))
                return pa.RecordBatch.from_arrays([batch.column("key").take(at), pa.array(np.concatenate(pos) if pos else [], pa.int32()), pa.array(np.concatenate(kmer) if kmer else [], pa.int64())], names=["key", "pos", "kmer"])

            for row, at, raw in _pieces(batch.column("s"), k):
                places, numbers = rolled(table[raw], n, k)
                own.append(np.full(len(places), row, dtype=np.int64))
                pos.append((places + at).astype(np.int32))
                kmer.append(numbers)
                held += len(places)
                if held > PIECE:
                    yield made()
                    own, pos, kmer, held = [], [], [], 0
            yield made()

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), sequence.alias("s")).mapInArrow(run, f"key {kind}, pos int, kmer long").withColumnRenamed("key", key)


def class_codes(classes: tuple[str, str]) -> np.ndarray:
    """The code of each byte: of the letter that stands for it, among the distinct ones; their number for any other."""
    names = "".join(dict.fromkeys(classes[1]))
    out = np.full(256, len(names), dtype=np.int64)
    for a, b in zip(*classes, strict=True):
        out[ord(a)] = names.index(b)
    return out


def bitmaps(df: DataFrame, key: str, sequence: Column, k: int = 4, classes: tuple[str, str] = REDUCED) -> DataFrame:
    """key, size and bits of each sequence: the set of its k-mers of letter classes as a bit a possible k-mer (those with other letters left out)."""
    table, n = class_codes(classes), len(set(classes[1]))
    width = -(-(n**k) // 64) * 8

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            held = np.zeros((batch.num_rows, width * 8), dtype=bool)
            for row, _, raw in _pieces(batch.column("s"), k):
                held[row, rolled(table[raw], n, k)[1]] = True
            bits = np.packbits(held, axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(held.sum(axis=1), pa.int64()), pa.array([b.tobytes() for b in bits], pa.binary())], names=["key", "size", "bits"])

    kind = df.schema[key].dataType.simpleString()
    thin = df.select(F.col(key).alias("key"), sequence.alias("s")).mapInArrow(_small_batches(run), f"key {kind}, size long, bits binary")
    return thin.withColumnRenamed("key", key)


def _small_batches(run, most: int = 512):
    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(batch.slice(i, most) for batch in rows for i in range(0, batch.num_rows, most))

    return each

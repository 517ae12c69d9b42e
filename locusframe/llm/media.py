"""Telephony audio columns: G.711 mu-law and A-law, IMA ADPCM, resampled 16-bit PCM.

``store`` turns texts' payloads into WAV files, one a row, in a binary column: by a checksum of the payload its bytes are mu-law samples,
A-law samples or ADPCM blocks. ``decode`` reads such files back, expands their samples by lookup tables or decodes ADPCM blocks,
those of many files at once, and resamples them; ``store_pcm`` writes the result as a table.

Defined cases: a null or empty text is a payload of one block of spaces; very long texts are whole files;
equal texts give equal files and features; an empty table gives no rows; columns other than doc_id and text
are not read. A column of null files stays null.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

BLOCK = 192
RATE_IN, RATE_OUT = 8000, 16000
MULAW, ALAW, ADPCM = 7, 6, 17


def mulaw_table() -> np.ndarray:
    """16-bit PCM of each mu-law byte (G.711)."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit PCM of each A-law byte (G.711)."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    segment, size = (code >> 4) & 7, ((code & 0x0F) << 4) + 8
    size = np.where(segment > 0, (size + 0x100) << np.maximum(segment - 1, 0), size)
    return np.where(code & 0x80, size, -size).astype(np.int16)


# The step sizes of IMA ADPCM and how a code moves the step index.
STEPS = np.array(
    """7 8 9 10 11 12 13 14 16 17 19 21 23 25 28 31 34 37 41 45 50 55 60 66 73 80 88 97 107 118 130 143 157 173 190 209 230 253 279 307
    337 371 408 449 494 544 598 658 724 796 876 963 1060 1166 1282 1411 1552 1707 1878 2066 2272 2499 2749 3024 3327 3660 4026 4428
    4871 5358 5894 6484 7132 7845 8630 9493 10442 11487 12635 13899 15289 16818 18500 20350 22385 24623 27086 29794 32767""".split(),
    dtype=np.int32,
)
INDEX_MOVE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)
MULAW_PCM, ALAW_PCM = mulaw_table(), alaw_table()


def adpcm_decode(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM (mono WAV blocks, a row of bytes each) to int16 rows. Loops over the samples of a block and decodes all blocks at each."""
    head = blocks[:, :4].astype(np.int32)
    value = ((head[:, 0] | head[:, 1] << 8) ^ 0x8000) - 0x8000
    index = np.clip(head[:, 2], 0, 88)
    body = blocks[:, 4:]
    nibbles = np.empty((len(blocks), body.shape[1] * 2), dtype=np.int32)
    nibbles[:, 0::2], nibbles[:, 1::2] = body & 15, body >> 4
    out = np.empty((len(blocks), nibbles.shape[1] + 1), dtype=np.int16)
    out[:, 0] = value
    for i in range(nibbles.shape[1]):
        code, step = nibbles[:, i], STEPS[index]
        delta = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -delta, delta), -32768, 32767)
        index = np.clip(index + INDEX_MOVE[code], 0, 88)
        out[:, i + 1] = value
    return out


def resample(pcm: np.ndarray, rate_in: int, rate_out: int) -> np.ndarray:
    """Linear interpolation in integers, so that every machine gives the same samples."""
    if rate_in == rate_out or not len(pcm):
        return pcm.astype(np.int16)
    wide = pcm.astype(np.int32)
    if rate_out == 2 * rate_in:
        out = np.empty(2 * len(wide), dtype=np.int16)
        out[0::2] = wide
        out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
        out[-1] = wide[-1]
        return out
    at = np.arange(len(wide) * rate_out // rate_in, dtype=np.int64) * rate_in
    i, part = at // rate_out, at % rate_out
    after = wide[np.minimum(i + 1, len(wide) - 1)]
    return (wide[i] + (after - wide[i]) * part // rate_out).astype(np.int16)


def payload(text: bytes) -> bytes:
    size = max(1, -(-len(text) // BLOCK)) * BLOCK
    return text + b" " * (size - len(text))


def wav(samples: bytes, kind: int = MULAW, rate: int = RATE_IN, block: int = 1) -> bytes:
    """A mono WAV file of compressed samples."""
    extra = struct.pack("<HH", 2, (block - 4) * 2 + 1) if kind == ADPCM else struct.pack("<H", 0)
    per_second = rate if kind != ADPCM else rate * block // ((block - 4) * 2 + 1)
    fmt = struct.pack("<HHIIHH", kind, 1, rate, per_second, block, 4 if kind == ADPCM else 8) + extra
    count = len(samples) if kind != ADPCM else len(samples) // block * ((block - 4) * 2 + 1)
    chunks = b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) % 2) for k, v in ((b"fmt ", fmt), (b"fact", struct.pack("<I", count)), (b"data", samples)))
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read_wav(data: bytes) -> tuple[int, int, int, bytes]:
    """Format, rate, block size and the bytes of the samples."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind, rate, block = 12, 0, 0, 1
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            kind, _, rate, _, block = struct.unpack_from("<HHIIH", data, at + 8)
        elif name == b"data":
            return kind, rate, block, data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV file without samples")


def expand_all(files: list[bytes], rate_out: int = RATE_OUT) -> list[np.ndarray]:
    """Resampled 16-bit PCM of WAV files. ADPCM blocks of one size are decoded together, whichever file they are of."""
    parts = [read_wav(f) for f in files]
    out: list[np.ndarray | None] = [None] * len(files)
    blocks: dict[int, list[int]] = {}
    for i, (kind, rate, block, samples) in enumerate(parts):
        raw = np.frombuffer(samples, dtype=np.uint8)
        if kind in (MULAW, ALAW):
            out[i] = resample((MULAW_PCM if kind == MULAW else ALAW_PCM)[raw], rate, rate_out)
        elif kind == ADPCM:
            blocks.setdefault(block, []).append(i)
        else:
            raise ValueError(f"WAV format {kind}")
    for block, places in blocks.items():
        own = [np.frombuffer(parts[i][3], dtype=np.uint8) for i in places]
        own = [x[: len(x) // block * block].reshape(-1, block) for x in own]
        pcm = adpcm_decode(np.concatenate(own))
        ends = np.cumsum([len(x) for x in own])
        for i, a, b in zip(places, [0, *ends[:-1]], ends, strict=True):
            out[i] = resample(pcm[a:b].ravel(), parts[i][1], rate_out)
    return out


def expand(data: bytes, rate_out: int = RATE_OUT) -> np.ndarray:
    """Resampled 16-bit PCM of a WAV file."""
    return expand_all([data], rate_out)[0]


def kind_of(samples: bytes) -> int:
    """The format that a payload is stored in: its checksum deals payloads to the three."""
    return (MULAW, ALAW, ADPCM)[zlib.crc32(samples) % 3]


def file_of(text: bytes) -> bytes:
    """The WAV file of a text's payload."""
    samples = payload(text)
    kind = kind_of(samples)
    return wav(samples, kind, block=BLOCK if kind == ADPCM else 1)


def feature(pcm: np.ndarray) -> str:
    """Peak, mean square, zero crossings and a checksum of the samples, all in integers."""
    if not len(pcm):
        return "samples=0"
    wide = pcm.astype(np.int64)
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"samples={len(pcm)};peak={int(np.abs(wide).max())};power={int(wide @ wide) // len(pcm)};crossings={crossings};pcm_crc32={zlib.crc32(pcm.astype('<i2').tobytes())}"


STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def _store(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        texts = common.as_bytes(batch.column("text"))
        for i, j in common.batches(texts, 8 << 20):
            own = texts[i:j]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j].cast(pa.int64()), pa.array(map(len, own), pa.int64()), pa.array([file_of(t) for t in own], pa.binary())], schema=STORED)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, a WAV file of the text's payload."""
    return docs.select("doc_id", "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def _pcm(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        media = batch.column("media").to_pylist()
        for i, j in common.batches([m or b"" for m in media]):
            known = [m for m in media[i:j] if m is not None]
            pcm = iter(expand_all(known))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j].cast(pa.int64()), pa.array([None if m is None else next(pcm).astype("<i2").tobytes() for m in media[i:j]], pa.binary())], names=["doc_id", "pcm"])


def decode(media: DataFrame) -> DataFrame:
    """doc_id and pcm, little-endian 16-bit samples at RATE_OUT, of a column of WAV files (null stays null)."""
    return media.select("doc_id", "media").mapInArrow(_pcm, "doc_id long, pcm binary")


def store_pcm(media: DataFrame, path: str) -> DataFrame:
    """The table of resampled PCM at path: doc_id and pcm. 16-bit samples at twice the rate take four to eight times the bytes of a payload."""
    decode(media).write.option("compression", "zstd").parquet(path)
    return media.sparkSession.read.schema("doc_id long, pcm binary").parquet(path)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        whole = batch.column("media").to_pylist()
        for i, j in common.batches(whole):
            media = whole[i:j]
            samples = [read_wav(m)[3] for m in media]
            columns = [
                batch.column("doc_id")[i:j],
                batch.column("n_bytes")[i:j],
                pa.array(map(len, samples), pa.int64()),
                pa.array([hashlib.sha256(s).hexdigest() for s in samples], pa.string()),
                pa.array([zlib.crc32(s[-16:]) for s in samples], pa.int64()),
                pa.array(map(len, media), pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()),
                pa.array([feature(p) for p in expand_all(media)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in DIGEST.split(", ")])


def digest(media: DataFrame) -> DataFrame:
    """Digests and features of stored files."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_digest, DIGEST)


def op8_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(common.cut(store(docs), "media"))

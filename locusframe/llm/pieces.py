"""Offset-preserving SentencePiece encoding and exact decoding.

The normaliser walks the text by the longest prefix that the model's compiled character map rewrites and records,
for every normalised byte, the source byte it came from. Words of the normalised text are encoded by the
model once each and kept; their pieces are laid over the normalised bytes and projected to spans of the original.
The ids are those of the sentencepiece library.

Defined cases: a null text counts as empty and has no ids; texts are encoded whole; repeated rows give equal rows; an
empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "▁"
_MOST_CACHED = 300_000


class CharacterMap:
    """A compiled character map: a double-array trie whose values point at the replacements.

    The blob is the trie's size in bytes, its 32-bit units, then the replacements, each ended by a zero byte.
    """

    def __init__(self, blob: bytes):
        if not blob:
            self.units, self.out = None, b""
            return
        size = struct.unpack_from("<I", blob)[0]
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.out = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes taken and their replacement, of the longest key that text has at ``at``."""
        if self.units is None:
            return None
        units, found = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[k]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                value = units[node] & 0x7FFFFFFF
                found = k + 1 - at, self.out[value : self.out.index(b"\0", value)]
        return found


class Normaliser:
    """The model's normalisation with the alignment of each normalised byte to the source."""

    def __init__(self, blob: bytes = b"", dummy_prefix: bool = True, remove_extra: bool = False, escape: bool = True):
        self.map, self.dummy_prefix, self.remove_extra = CharacterMap(blob), dummy_prefix, remove_extra
        self.space = MARK.encode() if escape else b" "

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, one longer, where each begins in text."""
        if self.map.units is None and not self.remove_extra:
            return self._plain(text)
        out, at = bytearray(), []
        pieces, i = [], 0
        while i < len(text):
            found = self.map.longest(text, i)
            if found:
                taken, new = found
            else:
                lead = text[i]
                taken = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = text[i : i + taken]
            pieces.append((i, taken, new))
            i += taken
        end = len(text)
        if self.remove_extra:
            while pieces and pieces[0][2] in (b" ", b""):
                pieces.pop(0)
            while pieces and pieces[-1][2] == b" ":
                end = pieces.pop()[0]
        first = pieces[0][0] if pieces else 0
        if self.dummy_prefix and pieces:
            out += self.space
            at += [first] * len(self.space)
        spaced = self.remove_extra
        for start, _, new in pieces:
            if self.remove_extra and spaced:
                new = new.lstrip(b" ")
            for byte in new:
                put = self.space if byte == 0x20 else bytes([byte])
                out += put
                at += [start] * len(put)
            if new:
                spaced = self.remove_extra and new.endswith(b" ")
        return bytes(out), np.array([*at, end], dtype=np.int64)

    def _plain(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Without a map or trimming: spaces become marks, one mark goes before; vectorised."""
        if not text:
            return b"", np.zeros(1, dtype=np.int64)
        raw = np.frombuffer(text, np.uint8)
        width = np.where(raw == 0x20, len(self.space), 1)
        at = np.repeat(np.arange(len(raw)), width)
        prefix = len(self.space) if self.dummy_prefix else 0
        return (self.space if prefix else b"") + text.replace(b" ", self.space), np.concatenate([np.zeros(prefix, np.int64), at, [len(text)]])


class Codec:
    """Ids, spans and decoding of texts by a model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        self.normaliser = Normaliser(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        #: Whether no piece joins a word to what follows its space, so that words can be encoded one by one.
        self.by_word = model.trainer_spec.model_type == 2 and spec.add_dummy_prefix and spec.escape_whitespaces and not any(MARK in p.piece.lstrip(MARK) for p in model.pieces) and not any(p.type == 4 for p in model.pieces)
        self.plain = self.normaliser.map.units is None and not spec.remove_extra_whitespaces
        self.known: dict[str, tuple[int, ...]] = {}
        #: Ids of the space that ends a text.
        self.last_space = tuple(self.processor.encode("x ")[len(self.processor.encode("x")) :])
        # byte lengths of the pieces over the normalised text; a byte piece is one byte, the unknown piece has none of its own
        self.widths = np.array([1 if p.type == 6 else 0 if p.type == 2 else len(p.piece.encode()) for p in model.pieces], dtype=np.int64)
        self.unknown = {i for i, p in enumerate(model.pieces) if p.type == 2}

    def encode(self, text: str) -> list[int]:
        if not text or not (self.by_word and self.plain):
            return self.processor.encode(text) if text else []
        if len(self.known) > _MOST_CACHED:
            self.known.clear()
        known, out = self.known, []
        parts = text.split(" ")
        # A run of spaces or marks is one word with what follows it: the model has pieces of several marks.
        if "" in parts or MARK in text:
            parts = _joined(parts) if MARK not in text else None
            if parts is None:
                return self.processor.encode(text)
        known[""] = self.last_space
        for w in parts:
            ids = known.get(w)
            if ids is None:
                ids = known[w] = tuple(self.processor.encode(w))
            out += ids
        return out

    def spans(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids and where the bytes of the original that each stands for start and end."""
        normal, at = self.normaliser.normalise(text.encode())
        ids = self.encode(text)
        if self.unknown.isdisjoint(ids):
            widths = self.widths[ids] if ids else np.empty(0, np.int64)
        else:  # an unknown piece is as wide as its surface
            widths = np.array([len(p.encode()) if i in self.unknown else self.widths[i] for i, p in zip(ids, self.processor.encode(text, out_type=str), strict=True)], dtype=np.int64)
        ends = np.cumsum(widths)
        if len(ends) and ends[-1] != len(normal):
            raise ValueError("the pieces do not cover the normalised text")
        return ids, at[ends - widths], at[ends]

    def decode(self, ids: list[int]) -> str:
        return self.processor.decode(ids)


def _joined(parts: list[str]) -> list[str]:
    """parts of a split at single spaces, with every empty one joined to the next word."""
    out, spaces = [], 0
    for k, p in enumerate(parts):
        if p == "" and k < len(parts) - 1:
            spaces += 1
            continue
        out.append(" " * spaces + p)
        spaces = 0
    return out


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _encoder(path: str):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in rows:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [own.spans(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        pa.array([f[0] for f in found], pa.list_(pa.int32())),
                        pa.array([f[1] for f in found], pa.list_(pa.int32())),
                        pa.array([f[2] for f in found], pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "ids", "starts", "ends"],
                )

    return run


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, starts and ends: the byte span of the UTF-8 text that each id stands for."""
    return docs.select("doc_id", "text").mapInArrow(_encoder(model_path), "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of a column of ids."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in rows:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([own.decode(i or []) for i in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _digester(path: str):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        names = [str(i) for i in range(len(own.widths))]
        for batch in rows:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out = []
                for text in part.column("text").to_pylist():
                    ids, starts, ends = own.spans(text or "")
                    joined = ",".join([names[x] for x in ids])
                    edges = np.concatenate([starts, ends]).astype("<i8").tobytes()
                    out.append((len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest(), hashlib.sha256(edges).hexdigest()))
                cols = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.string()), strict=True))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return run


def digest(docs: DataFrame, model_path: str) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_digester(model_path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_offset_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())

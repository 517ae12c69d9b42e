"""Cost-balanced packing of token sequences.

A sequence of ``capacity`` tokens costs a linear part for its tokens and a quadratic part for the attention
within each of its pieces. Documents are cut into full sequences and a remainder; the remainders of a window
of the corpus are taken in descending order, each into the sequence of lowest cost with room for it. The number of
sequences is the least that holds the window, so a remainder that fits nowhere whole is cut over the cheapest
ones. A window is a bounded run of an input partition: nothing is shuffled and a lost task repeats its own
partition only.

Defined cases: a null or empty text is the end id alone; a very long text is encoded whole and cut into full sequences; of equal
lengths the earlier row is placed first; a document's ids never leave their order; equal rows
are packed separately; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
#: Tokens of remainders that a task gathers before it packs them; bounds its memory and, at one partly filled sequence a window, the padding.
WINDOW_TOKENS = 1_000_000
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n (projections and attention of a layer, up to a factor).
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
END_ID = 1
#: Runs of text of which an encoder keeps the ids in a generation, about (some 60 bytes each), and bytes of text that it splits at once.
MOST_KEPT, SPLIT_BYTES = 300_000, 1 << 18


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def assign(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, sequence, offset) that place every item in the least number of sequences."""
    total = sum(lengths)
    if not total:
        return []
    n = -(-total // capacity)
    room, filled = [capacity] * n, [0] * n
    heap = [(0.0, s) for s in range(n)]
    out = []

    def put(item: int, start: int, length: int, seq: int, at: float) -> None:
        out.append((item, start, length, seq, filled[seq]))
        room[seq] -= length
        filled[seq] += length
        if room[seq]:
            heapq.heappush(heap, (at + cost(length), seq))

    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        length = lengths[item]
        if not length:
            continue
        passed = []
        while heap and room[heap[0][1]] < length:
            passed.append(heapq.heappop(heap))
        if heap:
            at, seq = heapq.heappop(heap)
            for x in passed:
                heapq.heappush(heap, x)
            put(item, 0, length, seq, at)
            continue
        start = 0  # fits nowhere whole: the cheapest sequences take what they can
        for k, (at, seq) in enumerate(passed):
            take = min(room[seq], length - start)
            put(item, start, take, seq, at)
            start += take
            if start == length:
                for x in passed[k + 1 :]:
                    heapq.heappush(heap, x)
                break
    return out


#: Fixed value: a pre-tokenizer's pattern whose matches hold no white space.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def parts_at_white_space(rules: dict) -> bool:
    """Whether a tokenizers file's normaliser and pre-tokenizer are ones known never to join text across white space, nor to make tokens of it."""

    def steps(x: dict | None, inner: str) -> list[dict]:
        return [] if x is None else [z for y in x[inner] for z in steps(y, inner)] if x["type"] == "Sequence" else [x]

    for x in steps(rules.get("normalizer"), "normalizers"):
        if x["type"] not in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase") and (x["type"], x.get("pattern"), x.get("content")) != ("Replace", {"Regex": r"\s+"}, " "):
            return False
    first = next(iter(steps(rules.get("pre_tokenizer"), "pretokenizers")), {"type": None})
    split = (first["type"], first.get("pattern"), first.get("behavior"), first.get("invert")) == ("Split", {"Regex": SPLIT_PATTERN}, "Removed", True)
    plain = not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in rules.get("added_tokens", []))
    return plain and (split or first["type"] in ("Whitespace", "WhitespaceSplit"))


class Known:
    """Words by two 64-bit keys in an open-addressing table, and their ids in one array. All steps take whole arrays of words."""

    def __init__(self, slots: int):
        self.mask = np.uint64(slots - 1)
        self.keys, self.checks, self.codes = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        self.first, self.sizes, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.uint32)
        self.words = self.used = 0

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The words' numbers, -1 for unknown ones."""
        out = np.full(len(keys), -1, dtype=np.int64)
        slot, todo = (keys & self.mask).astype(np.int64), np.arange(len(keys))
        while len(todo):
            there = self.keys[slot]
            same = (there == keys[todo]) & (self.checks[slot] == checks[todo])
            out[todo[same]] = self.codes[slot[same]]
            on = ~same & (there != 0)
            todo, slot = todo[on], (slot[on] + 1) & np.int64(self.mask)
        return out

    def add(self, keys: np.ndarray, checks: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Words that are not known yet, each once; ids: one word's after the other's."""
        n, codes = len(keys), np.arange(self.words, self.words + len(keys), dtype=np.int32)
        for name, most, fill in (("first", self.words + n, 0), ("sizes", self.words + n, 0), ("ids", self.used + len(ids), 0)):
            own = getattr(self, name)
            if most > len(own):
                setattr(self, name, np.concatenate([own, np.full(max(most, 2 * len(own)) - len(own), fill, own.dtype)]))
        self.first[self.words : self.words + n] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.words : self.words + n] = sizes
        self.ids[self.used : self.used + len(ids)] = ids
        self.words, self.used = self.words + n, self.used + len(ids)
        if 2 * self.words > len(self.keys):  # half full at most
            old = self.keys != 0
            keys, checks, codes = np.concatenate([self.keys[old], keys]), np.concatenate([self.checks[old], checks]), np.concatenate([self.codes[old], codes])
            slots = 1 << int(4 * self.words - 1).bit_length()
            self.mask = np.uint64(slots - 1)
            self.keys, self.checks, self.codes = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        slot, todo = (keys & self.mask).astype(np.int64), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]], self.codes[slot[free]] = keys[todo[free]], codes[todo[free]]
            placed = free & (self.codes[slot] == codes[todo]) & (self.keys[slot] == keys[todo])  # of several for one slot, the last has it
            self.checks[slot[placed]] = checks[todo[placed]]
            todo, slot = todo[~placed], (slot[~placed] + 1) & np.int64(self.mask)

    def spread(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and how many each has."""
        sizes = self.sizes[codes].astype(np.int64)
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[codes] - (ends - sizes), sizes)
        return self.ids[at], sizes


def second_keys(words: common.Words) -> np.ndarray:
    """A key of a word's length, first and last eight bytes, so that two words are taken for one only where these and the 64-bit hash agree."""
    padded = bytes(8) + words.buffer + bytes(8)
    at = np.ndarray(len(padded) - 7, dtype="<u8", buffer=padded, strides=(1,))  # eight bytes from each place
    size = words.ends - words.starts
    low = np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * (8 - np.minimum(size, 8))).astype(np.uint64)
    head, tail = at[words.starts + 8] & low, np.where(size > 8, at[words.ends], np.uint64(0))
    return common.mix64(head + np.uint64(0x9E3779B97F4A7C15) * size.astype(np.uint64)) + tail * np.uint64(0xD1342543DE82EF95)


class Encoder:
    """Token ids of texts by a tokenizers file, as arrays.

    Where the file's rules part at white space, each run between ASCII white space is encoded once and kept; encode() is then a
    lookup of all runs of some texts at once. Two generations of runs are kept, MOST_KEPT runs and 8 * MOST_KEPT ids each at most before the
    older goes; a run that is met again moves to the younger. ``whole`` encodes without the split, as encode() does by any other file.
    """

    def __init__(self, path: str, most: int = MOST_KEPT):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has dealt out the cores
        self.tokenizer = Tokenizer.from_file(path)
        self.parts, self.most = parts_at_white_space(json.loads(self.tokenizer.to_str())), most
        self.young, self.old = Known(1 << 16), Known(1 << 4)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if not self.parts:
            return [self.whole(t.decode()) for t in texts]
        if self.young.words > self.most or self.young.used > 8 * self.most:
            self.young, self.old = Known(1 << 16), self.young
        words = common.Words(texts)
        keys, checks = np.maximum(words.hashes, np.uint64(1)), second_keys(words)
        codes = self.young.find(keys, checks)
        while (missing := np.flatnonzero(codes < 0)).size:  # again only where two new words have one hash
            _, once = np.unique(keys[missing], return_index=True)
            self._learn(words, missing[once], keys, checks)
            codes[missing] = self.young.find(keys[missing], checks[missing])
        ids, sizes = self.young.spread(codes)
        cuts = np.concatenate([[0], np.cumsum(sizes)])[words.offsets]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _learn(self, words: common.Words, at: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> None:
        before = self.old.find(keys[at], checks[at])
        kept, new = at[before >= 0], at[before < 0]
        ids, sizes = self.old.spread(before[before >= 0])
        runs = [words.buffer[a:b].decode() for a, b in zip(words.starts[new].tolist(), words.ends[new].tolist(), strict=True)]
        own = [e.ids for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)]
        count = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
        flat = np.fromiter((i for e in own for i in e), dtype=np.uint32, count=int(count.sum()))
        both = np.concatenate([kept, new])
        self.young.add(keys[both], checks[both], np.concatenate([sizes, count]), np.concatenate([ids, flat]))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
DIGESTS = pa.schema([*(PIECES.field(i) for i in range(6)), ("ids_crc32", pa.int64())])


def _packer(path: str, capacity: int, end_id: int, digests: bool):
    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        first = TaskContext.get().partitionId() << 36  # a task numbers its own sequences from here
        done = 0
        waiting: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, start, doc_tokens, ids
        held = 0
        out: list[tuple] = []

        def piece(doc, start, total, seq, offset, ids):
            data = ids.astype("<u4").tobytes()
            out.append((doc, start, len(ids), total, first + seq, offset, zlib.crc32(data) if digests else data))

        def batch():
            cols = list(zip(*out, strict=True))
            schema = DIGESTS if digests else PIECES
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        def flush():
            nonlocal done, held
            placed = assign([len(w[3]) for w in waiting], capacity)
            for item, start, length, seq, offset in placed:
                doc, at, total, ids = waiting[item]
                piece(doc, at + start, total, done + seq, offset, ids[start : start + length])
            done += max((p[3] for p in placed), default=-1) + 1
            waiting.clear()
            held = 0

        for b in (whole.slice(i, 1024) for whole in rows for i in range(0, whole.num_rows, 1024)):
            docs, texts = b.column("doc_id").to_pylist(), common.as_bytes(b.column("text"))
            for i, j in common.batches(texts, SPLIT_BYTES):
                for doc, ids in zip(docs[i:j], enc.encode(texts[i:j]), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype(np.uint32)
                    full = len(ids) // capacity * capacity
                    for at in range(0, full, capacity):
                        piece(doc, at, len(ids), done, 0, ids[at : at + capacity])
                        done += 1
                    if full < len(ids):
                        waiting.append((doc, full, len(ids), ids[full:].copy()))
                        held += len(ids) - full
                    if held >= WINDOW_TOKENS:
                        flush()
                if len(out) > 2000 or not digests and out:
                    yield batch()
        flush()
        if out:
            yield batch()

    return pack


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, digests: bool = False) -> DataFrame:
    """A row a piece: doc_id, start, length, doc_tokens, sequence_id, offset and its ids (little-endian unsigned 32-bit), or ids_crc32 where only digests are wanted."""
    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, " + ("ids_crc32 long" if digests else "ids binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_packer(tokenizer_path, capacity, end_id, digests), schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer(), digests=True)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

"""The registered queries of shards, audio and archives, every column against plain Python."""

import base64
import hashlib
import struct
import zlib
from collections import Counter, defaultdict

from test_media import scalar_adpcm

from locusframe.llm import media, registry

QUERIES = registry.queries()


def texts(spark, sf_dir):
    return {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_shards(spark, sf_dir):
    raw = texts(spark, sf_dir)
    rows = QUERIES["op4_slot_shards"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(raw) and {r.law for r in rows} == {"bytes"} and all(r.grown_shard is None for r in rows)
    load, places, moved = Counter(), defaultdict(list), 0
    for r in rows:
        assert (r["size"], r.text_crc32) == (len(raw[r.doc_id]) + 8, zlib.crc32(raw[r.doc_id])) and 0 <= r.shard < 24
        load[r.shard] += r["size"]
        places[r.shard].append(r.slot)
        assert r.next_shard in (r.shard, 24)
        moved += r.next_shard == 24
    assert len(load) == 24 and all(sorted(p) == list(range(len(p))) for p in places.values()) and moved
    largest = max(r["size"] for r in rows)
    assert max(load.values()) - min(load.values()) <= largest


def wav_of(samples):
    """A WAV file byte by byte."""
    kind, block = ((7, 1), (6, 1), (17, 192))[zlib.crc32(samples) % 3]
    n = len(samples) if block == 1 else len(samples) // 192 * 377
    fmt = struct.pack("<HHIIHH", kind, 1, 8000, 8000 if block == 1 else 8000 * 192 // 377, block, 8 if block == 1 else 4)
    fmt += struct.pack("<H", 0) if block == 1 else struct.pack("<HH", 2, 377)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, n) + b"data" + struct.pack("<I", len(samples)) + samples
    return kind, b"RIFF" + struct.pack("<I", len(body)) + body


def g711(kind, byte):
    """A sample by the bits of its code."""
    if kind == 7:
        byte ^= 0xFF
        size = (((byte & 15) * 8 + 132) << (byte >> 4 & 7)) - 132
        return -size if byte & 128 else size
    byte ^= 0x55
    segment, part = byte >> 4 & 7, byte & 15
    size = part * 16 + 8 if segment == 0 else (part * 16 + 264) << (segment - 1)
    return size if byte & 128 else -size


def test_audio(spark, sf_dir):
    raw = texts(spark, sf_dir)
    rows = QUERIES["op8_telephony_audio"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(raw)
    kinds = Counter()
    for r in rows:
        text = raw[r.doc_id]
        samples = text + b" " * (max(192, -(-len(text) // 192) * 192) - len(text))
        kind, file = wav_of(samples)
        kinds[kind] += 1
        assert (r.n_bytes, r.payload_bytes, r.media_bytes, r.tail_crc32) == (len(text), len(samples), len(file), zlib.crc32(samples[-16:]))
        assert (r.payload_sha256, r.media_sha256) == (hashlib.sha256(samples).hexdigest(), hashlib.sha256(file).hexdigest())
        if len(samples) > 2000:
            continue
        pcm = [g711(kind, b) for b in samples] if kind != 17 else [x for i in range(0, len(samples), 192) for x in scalar_adpcm(samples[i : i + 192])]
        twice = [y for a, b in zip(pcm, [*pcm[1:], pcm[-1]]) for y in (a, (a + b) >> 1)]
        data = struct.pack(f"<{len(twice)}h", *twice)
        crossings = sum((a < 0) != (b < 0) for a, b in zip(twice, twice[1:]))
        assert r.feature == f"samples={len(twice)};peak={max(map(abs, twice))};power={sum(x * x for x in twice) // len(twice)};crossings={crossings};pcm_crc32={zlib.crc32(data)}"
    assert len(kinds) == 3


def test_pcm_is_stored(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = media.store(docs)
    want = {r.doc_id: media.expand(r.media).tobytes() for r in files.collect()}
    assert {r.doc_id: r.pcm for r in media.store_pcm(files, str(tmp_path / "pcm")).collect()} == want


def test_archives(spark, sf_dir):
    html = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = QUERIES["op10_capture_index"](spark, sf_dir).collect()
    first = {}
    for p in sorted(html):
        first.setdefault(html[p], p)
    assert sorted(r.page_id for r in rows) == sorted(html)
    for r in rows:
        payload = html[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        own = first[payload] == r.page_id
        assert (r.record_type, r.refers_to) == (("response", None) if own else ("revisit", first[payload]))


def test_archives_by_join(spark, sf_dir, monkeypatch):
    """More shared digests than may be broadcast give the same rows."""
    from locusframe.llm import warc

    of = lambda: sorted(tuple(r) for r in QUERIES["op10_capture_index"](spark, sf_dir).select("page_id", "payload_digest", "record_type", "refers_to").collect())
    want = of()
    monkeypatch.setattr(warc, "MOST_SHARED", 0)
    assert of() == want

import zlib

import numpy as np
from helpers import awkward, empty

from locusframe.llm import media


def test_tables():
    assert media.MULAW_PCM[0] == -32124 and media.MULAW_PCM[0x80] == 32124 and media.MULAW_PCM[0xFF] == 0
    assert media.ALAW_PCM[0x55] == -8 and media.ALAW_PCM[0xD5] == 8 and media.ALAW_PCM[0x2A] == -32256
    assert len(media.STEPS) == 89


def scalar_adpcm(block):
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(88, block[2]), []
    out.append(value)
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            delta = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - delta if code & 8 else value + delta))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            out.append(value)
    return out


def test_adpcm_blocks_equal_one_sample_at_a_time():
    rng = np.random.default_rng(5)
    blocks = rng.integers(0, 256, (7, 36), dtype=np.uint8)
    assert media.adpcm_decode(blocks).tolist() == [scalar_adpcm(bytes(b)) for b in blocks]
    data = media.wav(blocks.tobytes(), media.ADPCM, 8000, 36)
    assert np.array_equal(media.expand(data, 8000), media.adpcm_decode(blocks).ravel())


def test_resample_interpolates():
    pcm = np.array([0, 10, -4], dtype=np.int16)
    assert media.resample(pcm, 8000, 16000).tolist() == [0, 5, 10, 3, -4, -4]
    assert media.resample(pcm, 8000, 8000).tolist() == pcm.tolist()
    assert len(media.resample(np.arange(441, dtype=np.int16), 44100, 16000)) == 160


def test_round_trip_is_exact(spark):
    rows = media.digest(media.store(awkward(spark))).collect()
    assert len(rows) == 9
    by = {r.doc_id: r for r in rows}
    for doc, text in ((2, ""), (3, ""), (1, "a plain text of some words that are read"), (5, "long " * 40_000)):
        raw = text.encode()
        full = media.payload(raw)
        assert len(full) % 192 == 0 and full.rstrip(b" ") == raw.rstrip(b" ")
        assert by[doc].n_bytes == len(raw) and by[doc].payload_bytes == len(full)
        assert by[doc].tail_crc32 == zlib.crc32(full[-16:])
    assert by[1].media_sha256 == by[6].media_sha256 and by[1].feature == by[6].feature
    assert media.digest(media.store(empty(spark))).count() == 0
    pcm = media.decode(media.store(awkward(spark))).where("doc_id = 1").first().pcm
    assert len(pcm) == 192 * 2 * 2

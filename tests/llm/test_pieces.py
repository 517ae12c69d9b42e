import hashlib
import struct

import numpy as np
import sentencepiece
from helpers import AWKWARD, awkward, empty

from locusframe.llm import pieces

MODEL = pieces.default_model()
LIB = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_whole_table_equals_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pieces.digest(docs, MODEL).collect():
        ids = LIB.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIB.decode(ids).encode()).hexdigest()


def test_awkward_texts_and_spans(spark):
    own = pieces.Codec(MODEL)
    texts = [a[1] or "" for a in AWKWARD] + [" ", "  ", "a ", " a", "a  b", "  a   b  ", "▁", "a▁b", "x\ny\tz", " \n ", "é́", " x", "a\0b", "1234 12", "ａ"]
    for t in texts:
        ids, starts, ends = own.spans(t)
        assert ids == LIB.encode(t), t
        raw = t.encode()
        assert len(ids) == len(starts) == len(ends)
        if ids:
            assert starts[0] == 0 and ends[-1] == len(raw) and (starts[1:] == ends[:-1]).all()
        for i, a, b in zip(ids, starts, ends):
            piece = LIB.id_to_piece(i)
            if not LIB.is_byte(i):
                assert raw[a:b].decode().replace(" ", "▁") in (piece, piece[1:]), (t, piece)
            else:
                assert raw[a:b] == bytes([int(piece[3:5], 16)])
    rows = pieces.encode(awkward(spark), MODEL)
    assert rows.count() == 9 and pieces.encode(empty(spark), MODEL).count() == 0
    back = {r.doc_id: r.text for r in pieces.decode(rows, MODEL).collect()}
    assert back[1] == AWKWARD[0][1] and back[2] == "" and back[8] == LIB.decode(LIB.encode(AWKWARD[8][1]))


def trie(entries: dict[bytes, bytes]) -> bytes:
    """A character map compiled from a rule table, as a plain double array for tests."""
    out, at = b"", {}
    for key, new in entries.items():
        at[key] = len(out)
        out += new + b"\0"
    units: dict[int, int] = {}
    used: set[int] = set()

    def children(prefix):
        return sorted({k[len(prefix)] for k in entries if k.startswith(prefix) and len(k) > len(prefix)})

    def build(node, prefix):
        labels = children(prefix)
        leaf = prefix in entries
        base = next(b for b in range(1, 1 << 20) if all((b ^ c) not in used and (b ^ c) != 0 for c in labels + [0] * leaf) and (b ^ node) < (1 << 21) and not (b & 0xFF and False))
        units[node] = units.get(node, 0) | ((node ^ base) << 10) | (0x100 if leaf else 0)
        if leaf:
            used.add(base)
            units[base] = 0x80000000 | at[prefix]
        for c in labels:
            used.add(base ^ c)
            units[base ^ c] = c
        for c in labels:
            build(base ^ c, prefix + bytes([c]))

    used.add(0)
    build(0, b"")
    data = b"".join(struct.pack("<I", units.get(i, 0)) for i in range(max(units) + 257))
    return struct.pack("<I", len(data)) + data + out


RULES = {"ﬁ".encode(): b"fi", "Ａ".encode(): b"A", " ".encode(): b" ", b"e\xcc\x81": "é".encode(), b"e": b"e", "​".encode(): b""}


def test_longest_prefix_and_alignment():
    blob = trie(RULES)
    cm = pieces.CharacterMap(blob)
    for key, new in RULES.items():
        assert cm.longest(key + b"zz", 0) == (len(key), new)
    assert cm.longest(b"zz", 0) is None
    norm = pieces.Normaliser(blob, dummy_prefix=True, remove_extra=True)
    text = "  oﬁ   éx  ".encode()
    out, at = norm.normalise(text)
    assert out.decode() == "▁ofi▁éx"
    source = {"o": b"o", "f": "ﬁ".encode(), "x": b"x"}
    for ch, want in source.items():
        i = out.index(ch.encode())
        assert text[at[i] :].startswith(want)
    assert text[at[out.index("é".encode())] :].startswith(b"e\xcc\x81")
    assert (np.diff(at) >= 0).all() and len(at) == len(out) + 1


def test_map_equals_the_librarys_normaliser():
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    spec.ParseFromString(normalizer.serialized_model_proto())
    rules = spec.normalizer_spec
    norm = pieces.Normaliser(rules.precompiled_charsmap, rules.add_dummy_prefix, rules.remove_extra_whitespaces, rules.escape_whitespaces)
    for text in ("ＡＢＣ ﬁne ①② ㍿ é ½", "plain", "ｶﾞ한가", "a b　c", "", "İıſK 👩‍💻"):
        assert norm.normalise(text.encode())[0].decode() == normalizer.normalize(text), text

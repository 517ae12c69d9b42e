import zlib
from collections import defaultdict

import numpy as np
from helpers import AWKWARD, awkward, empty

from locusframe.llm import packing


def check(rows, ids_of, capacity):
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for doc, ids in ids_of.items():
        got = sorted(docs[doc], key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in got]).tolist() == ids
        assert [r.start for r in got] == np.cumsum([0] + [r.length for r in got])[:-1].tolist() and {r.doc_tokens for r in got} == {len(ids)}
    for pieces in seqs.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == np.cumsum([0] + [p.length for p in pieces])[:-1].tolist()
        assert sum(p.length for p in pieces) <= capacity
    return len(seqs) * capacity / sum(r.length for r in rows)


def test_pack_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    enc = packing.Encoder(packing.default_tokenizer())
    ids = {r.doc_id: [*enc.whole(r.text).tolist(), 1] for r in docs.collect()}
    rows = packing.pack(docs, packing.default_tokenizer()).collect()
    assert check(rows, ids, 2048) < 1.01
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in packing.pack(docs, packing.default_tokenizer(), digests=True).collect()}
    assert crc == {(r.doc_id, r.start): zlib.crc32(r.ids) for r in rows}


def test_awkward_rows(spark):
    enc = packing.Encoder(packing.default_tokenizer())
    rows = packing.pack(awkward(spark), packing.default_tokenizer(), capacity=64).collect()
    ids = {a[0]: [*enc.whole(a[1] or "").tolist(), 1] for a in AWKWARD if a[0] != 6}
    check([r for r in rows if r.doc_id != 6], {}, 64)
    check([r for r in rows if r.doc_id != 6], {}, 64)
    for doc, want in ids.items():
        assert sum(r.length for r in rows if r.doc_id == doc) == len(want)
    assert sum(r.length for r in rows if r.doc_id == 6) == 2 * len([*enc.whole(AWKWARD[5][1]), 1])
    assert packing.pack(empty(spark), packing.default_tokenizer()).count() == 0


def test_costs_are_balanced():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 2048, 900).tolist()
    placed = packing.assign(lengths)
    load, cost, items = defaultdict(int), defaultdict(float), defaultdict(int)
    for item, _, n, seq, _ in placed:
        load[seq] += n
        cost[seq] += packing.cost(n)
        items[item] += n
    assert [items[i] for i in range(900)] == lengths and max(load.values()) <= 2048
    assert len(load) == -(-sum(lengths) // 2048)
    first_fit, room = [], []
    for n in sorted(lengths, reverse=True):
        at = next((i for i, r in enumerate(room) if r >= n), len(room))
        if at == len(room):
            room.append(2048)
            first_fit.append(0.0)
        room[at] -= n
        first_fit[at] += packing.cost(n)
    assert np.std(list(cost.values())) <= np.std(first_fit)

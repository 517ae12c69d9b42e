"""Scores of many pairs in strips: equal to alignments one by one, in few passes, with the ends that alignments start from."""

import random
import time

import numpy as np

from locusframe.operators import alignment
from locusframe.operators.alignment import AMINO


def related(draw, n):
    """A query, and targets of all lengths that hold changed pieces of it."""
    q = "".join(draw.choices(AMINO + "X", k=draw.randint(1, 90)))
    out = ["", "W", q]
    for _ in range(n):
        s = list(q[draw.randint(0, len(q) // 2) :])
        for _ in range(draw.randint(0, 5)):
            at = draw.randrange(len(s) + 1)
            s[at : at + draw.randint(0, 3)] = draw.choices(AMINO, k=draw.randint(0, 40))
        out.append("".join(draw.choices(AMINO, k=draw.randint(0, 200))) + "".join(s) + "".join(draw.choices(AMINO, k=draw.randint(0, 70))))
    return q, out


def one_by_one(table, target):
    """Score and end by rows of one pair."""
    score, i, j = alignment._Pair(lambda k: table[k, alignment.encode(target)], len(table), len(target), True).end()
    return (score, i, j) if score > 0 else (0, 0, 0)


def test_strips_give_scores_and_ends_of_single_pairs(monkeypatch):
    draw = random.Random(2)
    for cells in (1, 500, 1 << 16):
        monkeypatch.setattr(alignment, "SWEEP_CELLS", cells)
        for n in range(4):
            q, targets = related(draw, 25)
            table = alignment.BLOSUM62[alignment.encode(q)].astype(float)
            want = [one_by_one(table, t) if t else (0, 0, 0) for t in targets]
            assert [tuple(x) for x in alignment.pair_ends([q] * len(targets), targets).tolist()] == want
            pssm = np.random.default_rng(n).normal(-0.5, 3, (len(q), 21)).astype(np.float32)
            for got, t in zip(alignment.profile_ends(pssm, targets).tolist(), targets, strict=True):
                score, i, j = one_by_one(pssm.astype(float), t) if t else (0, 0, 0)
                assert abs(got[0] - score) < 1e-9 and got[1:] == [i, j]
            for t in targets[3:9]:  # with and without the end told
                ends = alignment.pair_ends([q], [t])[0].tolist()
                assert alignment.align(q, t, end=tuple(ends)) == alignment.align(q, t)
    long_ = "".join(draw.choices(AMINO, k=1600))  # too many rows for the narrow integers
    assert alignment.pair_scores([long_, long_], [long_, long_[:700] + long_[760:]])[0] == int(sum(alignment.BLOSUM62[c, c] for c in alignment.encode(long_)))


def test_a_profile_score_far_into_a_long_target_is_that_of_a_short_one():
    draw = random.Random(4)
    q = "".join(draw.choices(AMINO, k=120))
    pssm = (alignment.BLOSUM62[alignment.encode(q)][:, :21] * 1.0137).astype(np.float32)
    own = q[:60] + "GG" + q[60:]  # a gap along the target
    far = "P" * 200_000 + own
    near, away = alignment.profile_scores(pssm, [own])[0], alignment.profile_scores(pssm, [far])[0]
    assert abs(near - away) < 1e-6


def test_a_pass_over_many_pairs_is_quick():
    draw = random.Random(5)
    q = "".join(draw.choices("ETAOINSHRDLC", k=180))
    targets = ["".join(draw.choices("ETAINSHRDLC", k=6000)) + q for _ in range(40)]
    start = time.process_time()
    alignment.pair_scores([q] * 40, targets)
    strips = time.process_time() - start
    start = time.process_time()
    for t in targets[:4]:
        one_by_one(alignment.BLOSUM62[alignment.encode(q)].astype(float), t)
    assert strips < 5 * (time.process_time() - start)  # half the time of single pairs at most

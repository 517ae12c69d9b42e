"""Alignments in little memory: equal to those of the whole matrix, whatever rows are kept."""

import random
import tracemalloc

import numpy as np
import pytest

from locusframe.operators import alignment


def whole(q, t, table, local):
    """Score, ends, start and moves by three whole matrices, from the definition."""
    low, n, m = -(10**6), len(q), len(t)
    h, e, f = ([[0.0 if x is h_ else low] * (m + 1) for _ in range(n + 1)] for h_ in ("h",) for x in ("h", "e", "f"))
    code = alignment.encode(t)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            e[i][j] = max(h[i][j - 1] - 12, e[i][j - 1] - 1)
            f[i][j] = max(h[i - 1][j] - 12, f[i - 1][j] - 1)
            h[i][j] = max(h[i - 1][j - 1] + table[i - 1][code[j - 1]], e[i][j], f[i][j], *([0] if local else []))
    cells = [(i, j) for i in range(1, n + 1) for j in range(1, m + 1)]
    if local:
        i, j = min(cells, key=lambda c: (-h[c[0]][c[1]], c))
    else:
        i, j = min([(n, j) for j in range(1, m + 1)] + [(i, m) for i in range(1, n)], key=lambda c: (-h[c[0]][c[1]], c[0] < n, c))
    end, moves, state = (h[i][j], i, j), [], "h"
    near = lambda a, b: abs(a - b) < 1e-6
    while i and j and not (local and state == "h" and h[i][j] <= 0):
        if state == "h":
            state = "m" if near(h[i][j], h[i - 1][j - 1] + table[i - 1][code[j - 1]]) else "e" if near(h[i][j], e[i][j]) else "f"
            continue
        moves.append(state)
        if state == "m":
            i, j, state = i - 1, j - 1, "h"
        elif state == "e":
            state, j = ("h" if near(e[i][j], h[i][j - 1] - 12) else "e"), j - 1
        else:
            state, i = ("h" if near(f[i][j], h[i - 1][j] - 12) else "f"), i - 1
    return (*end, i, j, "".join(reversed(moves)))


def changed(draw, s, letters):
    out = list(s)
    for _ in range(draw.randint(0, 6)):
        at = draw.randrange(len(out) + 1)
        if draw.random() < 0.5:
            out[at:at] = draw.choices(letters, k=draw.randint(1, 9))
        else:
            del out[at : at + draw.randint(1, 6)]
    return "".join(draw.choices(letters, k=draw.randint(0, 15))) + "".join(out) + "".join(draw.choices(letters, k=draw.randint(0, 15)))


@pytest.mark.parametrize("kept", [1, 3, 64])
@pytest.mark.parametrize("local", [True, False])
def test_equal_to_the_whole_matrix(monkeypatch, kept, local):
    monkeypatch.setattr(alignment, "KEPT_ROWS", kept)
    draw = random.Random(kept)
    for n in range(60):
        letters = draw.choice([alignment.AMINO + "X", "AC", "ACDW"])
        a = "".join(draw.choices(letters, k=draw.randint(1, 25)))
        b = changed(draw, a, letters) or "A"
        pssm = np.random.default_rng(n).normal(0, 3, (len(a), 21)) if n % 3 == 0 else None
        x = alignment.align(a, b, local, pssm)
        table = alignment.BLOSUM62[alignment.encode(a)] if pssm is None else pssm
        moves = "".join("m" if p != "-" and q != "-" else "e" if p == "-" else "f" for p, q in zip(x["q_aln"], x["t_aln"], strict=True))
        score, i, j, i0, j0, want = whole(a, b, table, local)
        assert abs(x["score"] - score) < 1e-6 and (x["q_end"], x["t_end"], moves) == (i, j, want)
        assert (x["q_start"], x["t_start"]) == (i0, j0)
        assert x["q_aln"].replace("-", "") == a[i0:i] and x["t_aln"].replace("-", "") == b[j0:j]


@pytest.mark.parametrize("local", [True, False])
def test_a_long_target_takes_little_memory(local):
    draw = random.Random(1)
    q = "".join(draw.choices(alignment.AMINO, k=186))
    t = "".join(draw.choices(alignment.AMINO, k=100_000)) + q[:90] + "WWWWW" * 7 + q[95:] + "".join(draw.choices(alignment.AMINO, k=100_000))
    tracemalloc.start()
    x = alignment.align(q, t, local)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and x["t_start"] == 100_000 and x["gaps"] >= 30


def test_two_long_sequences_take_little_memory():
    draw = random.Random(2)
    q = "".join(draw.choices(alignment.AMINO, k=3000))
    t = q[:1400] + q[1500:]
    tracemalloc.start()
    x = alignment.align(q, t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6 and (x["q_start"], x["q_end"], x["gaps"], x["aligned_len"]) == (0, 3000, 100, 3000)

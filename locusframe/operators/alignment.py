"""Alignments of proteins with affine gaps, for pairs that a search has already narrowed down.

Scores are Columns over pairs of sequences. An Arrow batch of pairs is swept row by row of the query, all pairs and all positions of
the targets at once: targets lie in strips side by side, so that a gap along the target is a running maximum of all strips at once, carried from strip to strip. Only pairs that are
reported are aligned one by one, in memory that grows with the longer sequence alone: a sweep finds the end, the score bounds how far back the
alignment can begin, and within that window moves are kept, a byte each, for a few rows at a time, between rows that are stored by halving.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import DoubleType, LongType

from locusframe.functions.sequence import AMINO

GAP_OPEN, GAP_EXTEND = 11, 1
# BLOSUM62, rows and columns in the order ARNDCQEGHILKMFPSTWYV.
BLOSUM62_ORDER = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62_TABLE = """
 4 -1 -2 -2  0 -1 -1  0 -2 -1 -1 -1 -1 -2 -1  1  0 -3 -2  0
-1  5  0 -2 -3  1  0 -2  0 -3 -2  2 -1 -3 -2 -1 -1 -3 -2 -3
-2  0  6  1 -3  0  0  0  1 -3 -3  0 -2 -3 -2  1  0 -4 -2 -3
-2 -2  1  6 -3  0  2 -1 -1 -3 -4 -1 -3 -3 -1  0 -1 -4 -3 -3
 0 -3 -3 -3  9 -3 -4 -3 -3 -1 -1 -3 -1 -2 -3 -1 -1 -2 -2 -1
-1  1  0  0 -3  5  2 -2  0 -3 -2  1  0 -3 -1  0 -1 -2 -1 -2
-1  0  0  2 -4  2  5 -2  0 -3 -3  1 -2 -3 -1  0 -1 -3 -2 -2
 0 -2  0 -1 -3 -2 -2  6 -2 -4 -4 -2 -3 -3 -2  0 -2 -2 -3 -3
-2  0  1 -1 -3  0  0 -2  8 -3 -3 -1 -2 -1 -2 -1 -2 -2  2 -3
-1 -3 -3 -3 -1 -3 -3 -4 -3  4  2 -3  1  0 -3 -2 -1 -3 -1  3
-1 -2 -3 -4 -1 -2 -3 -4 -3  2  4 -2  2  0 -3 -2 -1 -2 -1  1
-1  2  0 -1 -3  1  1 -2 -1 -3 -2  5 -1 -3 -1  0 -1 -3 -2 -2
-1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5  0 -2 -1 -1 -1 -1  1
-2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6 -4 -2 -2  1  3 -1
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7 -1 -1 -4 -3 -2
 1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4  1 -3 -2 -2
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5 -2 -2  0
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11  2 -3
-2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7 -1
 0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
"""
#: Codes of residues are their places in AMINO; UNKNOWN is any other letter, PAD no letter.
UNKNOWN, PAD = len(AMINO), len(AMINO) + 1
UNKNOWN_SCORE = -1
_NEVER, _FAR = -(1 << 20), 1 << 14
#: Cells (pairs times positions of the longest target) that one sweep takes; a longer pair is a sweep of its own.
SWEEP_CELLS = 1 << 16
#: Letters of a strip, a power of two.
STRIP = 32

_CODE = np.full(256, UNKNOWN, dtype=np.int8)
_CODE[np.frombuffer(AMINO.encode(), np.uint8)] = np.arange(len(AMINO))


def substitution() -> np.ndarray:
    """BLOSUM62 by codes; PAD fits nothing."""
    out = np.full((PAD + 1, PAD + 1), UNKNOWN_SCORE, dtype=np.int32)
    at = [AMINO.index(a) for a in BLOSUM62_ORDER]
    out[np.ix_(at, at)] = np.array(BLOSUM62_TABLE.split(), dtype=np.int32).reshape(len(at), len(at))
    out[PAD], out[:, PAD] = _NEVER, _NEVER
    return out


BLOSUM62 = substitution()


def encode(sequence: str) -> np.ndarray:
    return _CODE[np.frombuffer(sequence.upper().encode("ascii", "replace"), np.uint8)].astype(np.int64)


def encode_batch(sequences: list[str]) -> np.ndarray:
    """Codes of sequences, a row each, filled up with PAD."""
    codes = [encode(s) for s in sequences]
    out = np.full((len(codes), max(map(len, codes), default=0)), PAD, dtype=np.int64)
    for row, own in zip(out, codes, strict=True):
        row[: len(own)] = own
    return out


class _Strips:
    """Targets (codes, a row each) as strips of STRIP letters side by side: strip l of a pair holds its places from l * STRIP on, a place a row."""

    def __init__(self, codes: np.ndarray):
        self.pairs, places = codes.shape
        self.length, self.per_pair = STRIP, -(-places // STRIP)
        filled = np.full((self.pairs, self.per_pair * self.length), PAD, dtype=np.int64)
        filled[:, :places] = codes
        self.codes = np.ascontiguousarray(filled.reshape(self.pairs * self.per_pair, self.length).T)

    def narrow(self, rows: int) -> type:
        """The integers that hold the BLOSUM62 scores of a query of so many rows and what is added to them."""
        return np.int16 if rows * int(BLOSUM62.max()) + self.length < _FAR else np.int32

    def scores(self, table: np.ndarray, dtype: type) -> Callable[[int], np.ndarray]:
        """What position i of a query scores at each place. table: scores by position and code; where many positions are equal, each kind is looked up once."""
        wide = np.full((len(table), PAD + 1), -_FAR if dtype is np.int16 else _NEVER, dtype=dtype)  # PAD fits nothing
        wide[:, :PAD] = table[:, :PAD]
        kinds, kind = np.unique(wide, axis=0, return_inverse=True)
        if len(kinds) > PAD + 1:
            return lambda i: wide[i].take(self.codes)
        kind, made = kind.ravel().tolist(), {}

        def of(i: int) -> np.ndarray:
            if kind[i] not in made:
                made[kind[i]] = wide[i].take(self.codes)
            return made[kind[i]]

        return of

    def sweep(self, scores_of: Callable[[int], np.ndarray], rows: int, dtype: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best local score of each pair and where it stands, counted from 1 (0 for none): of equal ones the first by row, then place."""
        shape = self.codes.shape
        above, here, down, run, top, nothing = (np.zeros(shape, dtype=dtype) for _ in range(6))
        down -= dtype(_FAR)
        ramp = np.ascontiguousarray(np.broadcast_to((GAP_EXTEND * np.arange(self.length))[:, None], shape).astype(dtype))
        opened = ramp + dtype(GAP_OPEN)
        begins = GAP_EXTEND * self.length * np.arange(self.per_pair)
        before, carry = np.zeros((self.pairs, self.per_pair), dtype=dtype), np.full((self.pairs, self.per_pair), -_FAR, dtype=dtype)
        steps = [1 << k for k in range(self.length.bit_length() - 1)]
        best = np.zeros(self.pairs, dtype=dtype)
        row, place = np.zeros(self.pairs, dtype=np.int64), np.zeros(self.pairs, dtype=np.int64)
        for i in range(rows):
            scores = scores_of(i)
            np.subtract(above, dtype(GAP_OPEN + GAP_EXTEND), out=run)
            np.subtract(down, dtype(GAP_EXTEND), out=down)
            np.maximum(run, down, out=down)
            before[:, 1:] = above[-1].reshape(before.shape)[:, :-1]
            np.add(above[:-1], scores[1:], out=here[1:])
            np.add(before.ravel(), scores[0], out=here[0])
            np.maximum(here, down, out=here)
            np.maximum(here, nothing, out=here)
            np.add(here, ramp, out=top)
            for step in steps:  # the maxima of so many rows, then of twice as many
                np.maximum(top[step:], top[:-step], out=run[step:])
                run[:step] = top[:step]
                top, run = run, top
            if self.per_pair > 1:  # what comes from the strips before, counted from a strip's begin
                ends = np.maximum.accumulate(top[-1].reshape(carry.shape) + begins, axis=1)
                carry[:, 1:] = np.maximum(ends[:, :-1] - begins[1:], -_FAR)
                np.maximum(top, carry.ravel(), out=top)
            np.subtract(top[:-1], opened[1:], out=run[1:])
            np.subtract(carry.ravel(), opened[0], out=run[0])
            np.maximum(here, run, out=here)
            of_strips = here.max(axis=0).reshape(carry.shape)
            highest = of_strips.max(axis=1)
            for k in np.flatnonzero(highest > best):
                strip = int(of_strips[k].argmax())
                best[k], row[k] = highest[k], i + 1
                place[k] = strip * self.length + int(here[:, k * self.per_pair + strip].argmax()) + 1
            above, here = here, above
        return best, row, place


def _groups(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Places of pairs by length of target, such that each group is a sweep."""
    order, start = np.argsort(lengths, kind="stable"), 0
    for end in range(1, len(order) + 1):
        if end == len(order) or (end + 1 - start) * max(1, lengths[order[end]]) > SWEEP_CELLS:
            yield order[start:end]
            start = end


def pair_ends(queries: list[str], targets: list[str]) -> np.ndarray:
    """Local alignment scores of pairs and where they stand, as sweep tells it, a row a pair."""
    out = np.zeros((len(queries), 3), dtype=np.int64)
    for group in _groups(np.array([len(t) for t in targets], dtype=np.int64)):
        t = encode_batch([targets[k] for k in group])
        if t.size == 0:
            continue
        for query in {queries[k] for k in group}:
            own = np.array([queries[k] == query for k in group])
            q, strips = encode(query), _Strips(t[own])
            dtype = strips.narrow(len(q))
            out[group[own]] = np.stack(strips.sweep(strips.scores(BLOSUM62[q], dtype), len(q), dtype), axis=1)
    return out


def pair_scores(queries: list[str], targets: list[str]) -> np.ndarray:
    """Local alignment scores of pairs."""
    return pair_ends(queries, targets)[:, 0]


def profile_ends(pssm: np.ndarray, targets: list[str]) -> np.ndarray:
    """Local scores of a profile (columns by UNKNOWN + 1 codes) with each target and where they stand, in doubles, as align has them."""
    out = np.zeros((len(targets), 3), dtype=np.float64)
    for group in _groups(np.array([len(t) for t in targets], dtype=np.int64)):
        t = encode_batch([targets[k] for k in group])
        if t.size and len(pssm):
            strips = _Strips(t)
            out[group] = np.stack(strips.sweep(strips.scores(pssm, np.float64), len(pssm), np.float64), axis=1)
    return out


def profile_scores(pssm: np.ndarray, targets: list[str]) -> np.ndarray:
    """Local scores of a profile with each target."""
    return profile_ends(pssm, targets)[:, 0]


ALIGNMENT = pa.struct(
    [("score", pa.float64()), ("q_start", pa.int32()), ("q_end", pa.int32()), ("t_start", pa.int32()), ("t_end", pa.int32())]
    + [("identity", pa.float64()), ("similarity", pa.float64()), ("gaps", pa.int32()), ("aligned_len", pa.int32()), ("q_aln", pa.string()), ("t_aln", pa.string())]
)
ALIGNMENT_TYPE = from_arrow_type(ALIGNMENT)
NO_ALIGNMENT = {"score": 0.0, "q_start": 0, "q_end": 0, "t_start": 0, "t_end": 0, "identity": 0.0, "similarity": 0.0, "gaps": 0, "aligned_len": 0, "q_aln": "", "t_aln": ""}


#: Rows whose moves are kept at a time.
KEPT_ROWS = 256
_TIED = 1e-6
# A cell's move: to a pair, along a gap in the query, down a gap in the target, or none; and whether a gap that ends there also begins there.
_STOP, _PAIR, _ALONG, _DOWN, _ALONG_BEGINS, _DOWN_BEGINS = 0, 1, 2, 3, 4, 8


class _Pair:
    """One pair, row by row. A state is what the next row needs: the best score and the best of open gaps in the target at each place."""

    def __init__(self, scores_of: Callable[[int], np.ndarray], rows: int, places: int, local: bool, edge: float = 0.0):
        self.scores_of, self.rows, self.places, self.local, self.edge = scores_of, rows, places, local, edge
        self.ramp = GAP_EXTEND * np.arange(places + 1, dtype=np.float64)

    def start(self) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(self.places + 1), np.full(self.places + 1, float(_NEVER))

    def row(self, i: int, state: tuple[np.ndarray, np.ndarray], moves: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The state after position i of the query, over as many places as the state before. moves gets the row's moves."""
        above, open_ = state
        n = len(above) - 1
        ramp = self.ramp[: n + 1]
        begun, longer = above - (GAP_OPEN + GAP_EXTEND), open_ - GAP_EXTEND
        down = np.maximum(begun, longer)
        paired = above[:-1] + self.scores_of(i)[:n]
        best = np.empty(n + 1)
        best[0], best[1:] = self.edge, np.maximum(paired, down[1:])
        if self.local:
            np.maximum(best, 0, out=best)
        along = np.full(n + 1, float(_NEVER))
        along[1:] = np.maximum.accumulate(best + ramp)[:-1] - ramp[1:] - GAP_OPEN
        np.maximum(best, along, out=best)
        best[0] = self.edge
        if moves is not None:
            kind = np.where(paired >= best[1:] - _TIED, _PAIR, np.where(along[1:] >= best[1:] - _TIED, _ALONG, _DOWN))
            if self.local:
                kind[best[1:] <= 0] = _STOP
            moves[1 : n + 1] = kind + _ALONG_BEGINS * (best[:-1] - GAP_OPEN >= along[:-1]) + _DOWN_BEGINS * (begun >= longer)[1:]
        return best, down

    def end(self) -> tuple[float, int, int]:
        """The best score and where it stands, counted from 1: of equal ones the first by row, then place; without local, in the last row, else the last place."""
        state = self.start()
        top, at = (0.0, (1, 1)) if self.local else (-np.inf, (0, 0))
        for i in range(self.rows):
            state = self.row(i, state)
            found = state[0][1:]
            j = int(found.argmax()) if self.local else self.places - 1
            if found[j] > top:
                top, at = float(found[j]), (i + 1, j + 1)
        if not self.local and state[0][1:].max() >= top:
            top, at = float(state[0][1:].max()), (self.rows, int(state[0][1:].argmax()) + 1)
        return top, *at

    def back(self, i: int, j: int) -> tuple[list[int], int, int]:
        """The moves of the best path to row i and place j, last first, and the row and place it comes from."""
        stored = [(0, self.start())]
        out: list[int] = []
        gap = _STOP
        while i and j:
            row, state = stored[-1]
            if i - row > KEPT_ROWS:  # halfway, so that a row is swept no more often than there are halvings
                middle = (row + i) // 2
                state = tuple(x[: j + 1] for x in state)
                for k in range(row, middle):
                    state = self.row(k, state)
                stored.append((middle, state))
                continue
            stored.pop()
            state = tuple(x[: j + 1] for x in state)
            moves = np.zeros((i - row, j + 1), dtype=np.uint8)
            for k in range(row, i):
                state = self.row(k, state, moves[k - row])
            while i > row and j:
                move = int(moves[i - row - 1, j])
                kind = gap or move & 3
                if kind == _STOP:
                    return out, i, j
                out.append(kind)
                if kind == _PAIR:
                    i, j = i - 1, j - 1
                elif kind == _ALONG:
                    gap = _STOP if move & _ALONG_BEGINS else _ALONG
                    j -= 1
                else:
                    gap = _STOP if move & _DOWN_BEGINS else _DOWN
                    i -= 1
        return out, i, j


def align(query: str, target: str, local: bool = True, pssm: np.ndarray | None = None, end: tuple[float, int, int] | None = None) -> dict:
    """The best alignment of a pair, or of a profile (its consensus as query) with a target; semi-global where not local: the ends of both are free.

    Of equal scores the first by query, then target counts; a column is a match before a gap in the query before one in the target.
    end, where it is known: the pair's row of pair_ends or profile_ends. An empty side gives NO_ALIGNMENT. Identity and similarity are shares of all columns, gaps included.
    """
    if not query or not target:
        return dict(NO_ALIGNMENT)
    q, t = encode(query), encode(target)
    table = (BLOSUM62[q] if pssm is None else pssm).astype(np.float64)
    if local:
        if end is None:
            strips = _Strips(t[None])
            dtype = np.float64 if pssm is not None else strips.narrow(len(q))
            end = tuple(x[0].item() for x in strips.sweep(strips.scores(table, dtype), len(q), dtype))
        score, i, j = float(end[0]), int(end[1]) or 1, int(end[2]) or 1
    else:
        score, i, j = _Pair(lambda k: table[k, t], len(q), len(t), local).end()
    # letters of the target in gaps cost GAP_EXTEND each, so a path has no more of them than lie between its score and the most that pairs can give
    most = float(np.maximum(table[:i, : UNKNOWN + 1].max(axis=1), 0).sum())
    begin = max(0, j - i - int((most - score) / GAP_EXTEND) - 1)
    near = t[begin:j]
    kinds, q_start, place = _Pair(lambda k: table[k, near], i, len(near), local, 0.0 if local or not begin else float(_NEVER)).back(i, len(near))
    kinds, t_start = np.array(kinds[::-1], dtype=np.int64), begin + place
    of = lambda s, own, first: "".join(np.where(own, np.array(list(s[first:]))[np.maximum(np.cumsum(own) - 1, 0)], "-").tolist()) if len(kinds) else ""
    q_aln, t_aln = of(query[:i], kinds != _ALONG, q_start), of(target[:j], kinds != _DOWN, t_start)
    paired = [(a, b) for a, b, kind in zip(q_aln, t_aln, kinds.tolist(), strict=True) if kind == _PAIR]
    n = len(kinds) or 1
    return {
        "score": score, "q_start": q_start, "q_end": i, "t_start": t_start, "t_end": j, "identity": sum(a == b for a, b in paired) / n, "similarity": sum(int(BLOSUM62[encode(a)[0], encode(b)[0]] > 0) for a, b in paired) / n,
        "gaps": len(kinds) - len(paired), "aligned_len": n, "q_aln": q_aln, "t_aln": t_aln,
    }


def best_segment(matrix: np.ndarray, target: np.ndarray, diagonals: list[int]) -> float:
    """The best gapless score along any of the diagonals (target position less query position). matrix: scores by query position and code."""
    best = 0.0
    for diagonal in diagonals:
        begin, end = max(0, -diagonal), min(len(matrix), len(target) - diagonal)
        if end > begin:
            total = np.cumsum(matrix[np.arange(begin, end), target[begin + diagonal : end + diagonal]].astype(np.float64))
            best = max(best, float((total - np.minimum.accumulate(np.concatenate([[0.0], total[:-1]]))).max()))
    return best


# ---- Columns


@F.arrow_udf(LongType())
def score(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The local alignment score of two sequences; null counts as empty."""
    for q, t in columns:
        yield pa.array(pair_scores([x or "" for x in q.to_pylist()], [x or "" for x in t.to_pylist()]))


@F.arrow_udf(DoubleType())
def segment(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The best gapless BLOSUM62 score of two sequences along some diagonals (an array)."""
    for q, t, d in columns:
        rows = zip(q.to_pylist(), t.to_pylist(), d.to_pylist(), strict=True)
        yield pa.array([best_segment(BLOSUM62[encode(x or "")], encode(y or ""), z or []) for x, y, z in rows], pa.float64())


def _aligned(local: bool):
    @F.arrow_udf(ALIGNMENT_TYPE)
    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for q, t in columns:
            yield pa.array([align(x or "", y or "", local) for x, y in zip(q.to_pylist(), t.to_pylist(), strict=True)], ALIGNMENT)

    return run


#: The best local alignment of two sequences (a struct), and the best with free ends.
local_alignment, semiglobal_alignment = _aligned(True), _aligned(False)


@F.arrow_udf(DoubleType())
def pssm_score(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The local score of a profile (array of columns, each an array of scores by code) and a sequence. Equal profiles of a batch are scored together."""
    for p, t in columns:
        targets = [x or "" for x in t.to_pylist()]
        out, seen = np.zeros(len(targets)), {}
        for k, own in enumerate(p.to_pylist()):
            seen.setdefault(tuple(map(tuple, own or [])), []).append(k)
        for own, places in seen.items():
            out[places] = profile_scores(np.array(own or [], dtype=np.float32).reshape(-1, UNKNOWN + 1), [targets[k] for k in places])
        yield pa.array(out)


@F.arrow_udf(DoubleType())
def pssm_segment(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The best gapless score of a profile and a sequence along some diagonals (an array)."""
    for p, t, d in columns:
        rows = zip(p.to_pylist(), t.to_pylist(), d.to_pylist(), strict=True)
        yield pa.array([best_segment(np.array(x or [], dtype=np.float32).reshape(-1, UNKNOWN + 1), encode(y or ""), z or []) for x, y, z in rows], pa.float64())


@F.arrow_udf(ALIGNMENT_TYPE)
def pssm_alignment(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The best local alignment of a profile and a sequence; the consensus stands for the query."""
    for p, c, t in columns:
        rows = zip(p.to_pylist(), c.to_pylist(), t.to_pylist(), strict=True)
        yield pa.array([align(y or "", z or "", True, np.array(x or [], dtype=np.float32).reshape(-1, UNKNOWN + 1)) for x, y, z in rows], ALIGNMENT)

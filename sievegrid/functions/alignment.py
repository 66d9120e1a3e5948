"""Pairwise alignment scores as Arrow-batched functions over candidate pairs."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def letter_masks(text: str) -> dict[str, int]:
    """Bit set of the positions of every letter."""
    masks: dict[str, int] = {}
    for i, letter in enumerate(text):
        masks[letter] = masks.get(letter, 0) | (1 << i)
    return masks


def common_subsequence(masks: dict[str, int], n: int, other: str) -> int:
    """Length of the longest common subsequence with a text of ``n`` letters given by masks.

    Bit-vector recurrence (Hyyro 2004), one step per letter of the other text: a
    zero bit marks a place where the length grows.
    """
    full = (1 << n) - 1
    state = full
    for letter in other:
        hit = state & masks.get(letter, 0)
        state = ((state + hit) | (state - hit)) & full
    return n - state.bit_count()


def identity_with(reference: str) -> Callable[[str], float]:
    """Function of a sequence: its identity to the reference."""
    masks, n = letter_masks(reference), len(reference)
    return lambda seq: common_subsequence(masks, n, seq) / max(n, len(seq), 1)


@F.pandas_udf(T.DoubleType())
def identity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Global alignment score (match 1, mismatch and gap 0) over the longer length."""
    known = [x is not None and y is not None and (x or y) for x, y in zip(a, b)]
    out = [identity_with(x)(y) if ok else None for x, y, ok in zip(a, b, known)]
    return pd.Series(out, dtype="float64")


def affine_score(
    reference: str,
    profile: Mapping[str, np.ndarray],
    seq: str,
    open_gap: float = -11.0,
    extend_gap: float = -1.0,
) -> float:
    """Global alignment score with affine gaps; end gaps cost like inner ones.

    One row per letter of ``seq`` with ``profile[letter]`` scoring it against
    the reference. A gap along the row is a running maximum over its start, so a
    whole row is one vector step.
    """
    m = len(reference)
    if not m or not seq:
        n = max(m, len(seq))
        return open_gap + extend_gap * (n - 1) if n else 0.0
    steps = extend_gap * np.arange(m + 1)
    best = np.concatenate([[0.0], open_gap + steps[:-1]])
    down = np.full(m + 1, -np.inf)
    row = np.empty(m + 1)
    for i, letter in enumerate(seq):
        down = np.maximum(down + extend_gap, best + open_gap)
        row[0] = down[0] = open_gap + extend_gap * i
        np.maximum(best[:-1] + profile[letter], down[1:], out=row[1:])
        starts = np.maximum.accumulate(row - steps)
        row[1:] = np.maximum(row[1:], starts[:-1] + steps[1:] - extend_gap + open_gap)
        best, row = row, best
    return float(best[-1])


class Substitutions:
    """A substitution table over letters; pairs it doesn't name score 0."""

    def __init__(self, pair_score: Mapping[tuple[str, str], float]):
        letters = sorted({x for pair in pair_score for x in pair})
        self.number = {x: i + 1 for i, x in enumerate(letters)}
        self.table = np.zeros((len(letters) + 1, len(letters) + 1))
        for x, i in self.number.items():
            for y, j in self.number.items():
                self.table[i, j] = pair_score.get((x, y), pair_score.get((y, x), 0.0))

    def coded(self, seqs: list[str]) -> np.ndarray:
        """Letters as numbers, a row each, 0 for unknown letters and behind the end."""
        out = np.zeros((len(seqs), max(map(len, seqs), default=0)), np.intp)
        for row, seq in zip(out, seqs):
            row[: len(seq)] = [self.number.get(x, 0) for x in seq]
        return out


def _affine_block(a: list[str], b: list[str], table: Substitutions, open_gap: float, extend_gap: float) -> np.ndarray:
    """Scores of a few pairs, one vector step per letter of the longest ``a`` for all of them."""
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    left, right = table.coded(a), table.coded(b)
    pairs, width = len(a), right.shape[1]
    steps = extend_gap * np.arange(width + 1)
    best = np.repeat(np.concatenate([[0.0], open_gap + steps[:-1]])[None, :], pairs, axis=0)
    down = np.full((pairs, width + 1), -np.inf)
    out = best[np.arange(pairs), m]
    for i in range(left.shape[1]):
        down = np.maximum(down + extend_gap, best + open_gap)
        down[:, 0] = open_gap + extend_gap * i
        row = np.empty_like(best)
        row[:, 0] = down[:, 0]
        np.maximum(best[:, :-1] + table.table[left[:, i, None], right], down[:, 1:], out=row[:, 1:])
        starts = np.maximum.accumulate(row - steps, axis=1)
        np.maximum(row[:, 1:], starts[:, :-1] + (steps[1:] - extend_gap + open_gap), out=row[:, 1:])
        best = row
        ended = np.flatnonzero(n == i + 1)
        out[ended] = best[ended, m[ended]]
    return out


def _whole_block(a: list[str], b: list[str], scores: np.ndarray, left: np.ndarray, right: np.ndarray, open_gap: int, extend_gap: int) -> np.ndarray:
    """``_affine_block`` in whole numbers of the type of ``scores``, the pairs side by side and the longer ``a`` last.

    The best gap along the letters of ``b`` is found by doubling its length; pairs whose ``a`` has ended drop out.
    """
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    kind, low = scores.dtype.type, np.iinfo(scores.dtype).min // 2
    letters, width = len(scores), right.shape[1]
    alone = bool((right == right[:1]).all())  # one reference: its scores against every letter, once
    against = np.ascontiguousarray(scores[:, right[0]].T) if alone else scores.ravel()
    codes = None if alone else np.ascontiguousarray(right.T)
    best = np.repeat(np.concatenate([[0], open_gap + extend_gap * np.arange(width)]).astype(scores.dtype)[:, None], len(a), axis=1)
    down = np.full_like(best, low)
    gap, longer = np.empty_like(best), np.empty_like(best)
    out = best[m, np.arange(len(a))].astype(np.float64)
    gone = 0
    for i in range(left.shape[1]):
        ended = int(np.searchsorted(n, i, "right"))  # sorted: all that have no letter here
        if ended > gone:
            best, down = best[:, ended - gone :].copy(), down[:, ended - gone :].copy()
            gap, longer = np.empty_like(best), np.empty_like(best)
            codes = None if alone else np.ascontiguousarray(codes[:, ended - gone :])
            gone = ended
        at = left[gone:, i]
        down += kind(extend_gap)
        np.add(best, kind(open_gap), out=gap)
        np.maximum(down, gap, out=down)
        down[0] = open_gap + extend_gap * i
        fit = against.take(at, axis=1) if alone else against.take(codes + at * letters)
        fit += best[:-1]
        np.copyto(best[0], down[0])
        np.maximum(fit, down[1:], out=best[1:])
        # gap[j]: the best gap that ends behind letter j, of lengths up to 1, 2, 4, ...
        gap[0] = low
        np.add(best[:-1], kind(open_gap), out=gap[1:])
        reach = 1
        while reach < width:
            np.add(gap[:-reach], kind(extend_gap * reach), out=longer[reach:])
            np.maximum(gap[reach:], longer[reach:], out=gap[reach:])
            reach *= 2
        np.maximum(best[1:], gap[1:], out=best[1:])
        last = int(np.searchsorted(n, i + 1, "right"))
        if last > gone:
            out[gone:last] = best[m[gone:last], np.arange(last - gone)]
    return out


def _whole_type(table: Substitutions, open_gap: float, extend_gap: float, letters: int) -> type | None:
    """The whole numbers that hold every score of two sequences of so many letters together, if any do."""
    used = np.append(table.table.ravel(), [open_gap, extend_gap])
    if not np.isfinite(used).all() or (used != np.round(used)).any():
        return None
    most = np.abs(used).max() * (letters + 2)
    return next((t for t in (np.int16, np.int32) if most < np.iinfo(t).max // 4), None)


def affine_scores(
    a: list[str],
    b: list[str],
    table: Substitutions,
    open_gap: float = -11.0,
    extend_gap: float = -1.0,
    cells: int = 1 << 15,
) -> np.ndarray:
    """Global alignment scores with affine gaps of many pairs; end gaps cost like inner ones.

    Pairs of like lengths are aligned side by side, at most ``cells`` table cells at a time: a step
    takes one letter of each ``a`` against all letters of its ``b``. A missing sequence gives NaN.
    """
    out = np.full(len(a), np.nan)
    known = [i for i in range(len(a)) if a[i] is not None and b[i] is not None]
    whole = _whole_type(table, open_gap, extend_gap, max((len(a[i]) + len(b[i]) for i in known), default=0))
    # whole sums don't depend on their order, nor two gaps on which comes first if no gap is better opened
    # again than extended: the shorter sequence takes the steps then
    either = whole is not None and extend_gap >= open_gap
    turned = [i for i in known if either and len(a[i]) > len(b[i])]
    straight = [i for i in known if not either or len(a[i]) <= len(b[i])]
    for some, x, y, scores in ((straight, a, b, table.table), (turned, b, a, table.table.T)):
        some.sort(key=lambda i: (len(y[i]) // 16, len(x[i])))
        at = 0
        while at < len(some):
            take, width = 0, 0
            while at + take < len(some):
                width = max(width, len(y[some[at + take]]) + 1)
                if take and (take + 1) * width > cells:
                    break
                take += 1
            block = some[at : at + take]
            if whole:
                block.sort(key=lambda i: len(x[i]))
            mine, theirs = [x[i] for i in block], [y[i] for i in block]
            if whole:
                kind = _whole_type(table, open_gap, extend_gap, max(map(len, mine)) + max(map(len, theirs)))
                left, right = table.coded(mine), table.coded(theirs)
                out[block] = _whole_block(mine, theirs, np.ascontiguousarray(scores, kind), left, right, int(open_gap), int(extend_gap))
            else:
                out[block] = _affine_block(mine, theirs, table, open_gap, extend_gap)
            at += take
    return out


def pair_scores(pair_score: Mapping[tuple[str, str], float], open_gap: float = -11.0, extend_gap: float = -1.0) -> object:
    """Alignment score of two sequence columns under a given substitution table; null if either is missing."""
    table = Substitutions(pair_score)

    @F.pandas_udf(T.DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(affine_scores(a.tolist(), b.tolist(), table, open_gap, extend_gap)).replace({np.nan: None}).astype("Float64")

    return score


def score_to_reference(
    reference: str,
    pair_score: Mapping[tuple[str, str], float],
    open_gap: float = -11.0,
    extend_gap: float = -1.0,
) -> object:
    """Alignment score of every sequence to one reference under a given substitution table.

    The aligned row kept by the screening flow is the sequence itself, without gaps.
    """
    table = Substitutions(pair_score)

    @F.pandas_udf(T.DoubleType())
    def score(seq: pd.Series) -> pd.Series:
        seqs = seq.tolist()
        return pd.Series(affine_scores(seqs, [reference] * len(seqs), table, open_gap, extend_gap), dtype="float64")

    return score


def ungapped_spans(a: str, b: str, table: Substitutions) -> list[tuple[int, int, int, int]]:
    """The best local alignments without gaps, as (start and end in a, start and end in b); none that score 0.

    Every place of the best score is given, each run as short as its score allows.
    """
    if not a or not b:
        return []
    left, right = table.coded([a])[0], table.coded([b])[0]
    run, length = np.zeros(len(b) + 1), np.zeros(len(b) + 1, np.int64)
    best, found = 0.0, []
    for i, x in enumerate(left):
        grown = run[:-1] + table.table[x, right]
        alive = grown > 0
        length[1:] = np.where(alive, length[:-1] + 1, 0)
        run[1:] = np.where(alive, grown, 0.0)
        top = float(run.max())
        if top > best:
            best, found = top, []
        if top > 0 and top == best:
            found += [(i + 1 - int(length[j]), i + 1, j - int(length[j]), j) for j in np.flatnonzero(run == best).tolist()]
    return found


def region_mutations(a: Column, b: Column) -> Column:
    """Positions at which two regions differ, length differences included."""
    off = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (~x.eqNullSafe(y)).cast("int"))
    return F.aggregate(off, F.lit(0), lambda acc, x: acc + x)

"""Alignments with gaps within a band of diagonals, for whole batches at once.

A batch is a matrix of probes and a matrix of the letters around each: column
``i + d`` of the second, for ``d`` from 0 to twice the band, stands against
letter ``i`` of the probe.  A gap of ``n`` letters costs its opening and ``n``
extensions.
"""

from __future__ import annotations

import numpy as np

MATCH, MISMATCH, GAP_OPEN, GAP_EXTEND = 2, -6, -5, -3
_LOW = -(1 << 28)


def _step(above: np.ndarray, down: np.ndarray, points: np.ndarray, local: bool) -> tuple[np.ndarray, np.ndarray]:
    """One letter of the probes on: best scores by diagonal, and those that end in a letter the genome hasn't."""
    ahead = np.full_like(above, _LOW)
    ahead[:, :-1] = np.maximum(above[:, 1:] + GAP_OPEN, down[:, 1:]) + GAP_EXTEND
    best = np.maximum(above + points, ahead)
    if local:
        best = np.maximum(best, 0)
    across = np.full(len(best), _LOW, best.dtype)
    for d in range(1, best.shape[1]):
        across = np.maximum(best[:, d - 1] + GAP_OPEN, across) + GAP_EXTEND
        best[:, d] = np.maximum(best[:, d], across)
    return best, ahead


def _points(text: np.ndarray, around: np.ndarray, i: int, spread: int, local: bool) -> np.ndarray:
    near = around[:, i : i + spread]
    points = np.where(near == text[:, i, None], MATCH if local else 0, MISMATCH)
    return np.where(near == 0, _LOW, points)


def banded_scores(text: np.ndarray, size: np.ndarray, around: np.ndarray, band: int, local: bool) -> np.ndarray:
    """The best score of each probe against what is around it, ends of the genome's side free.

    ``text`` is filled up beyond ``size``; a 0 in ``around`` is no letter and
    is never aligned.
    """
    n, width = text.shape
    spread = 2 * band + 1
    above = np.zeros((n, spread), np.int32)
    down = np.full((n, spread), _LOW, np.int32)
    best = np.full(n, 0 if local else _LOW, np.int32)
    for i in range(width):
        above, down = _step(above, down, _points(text, around, i, spread, local), local)
        live = i < size if local else i == size - 1
        best = np.where(live, np.maximum(best, above.max(1)), best)
    return best


def traces(text: np.ndarray, size: np.ndarray, around: np.ndarray, band: int, local: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Operations of the best alignment of each probe, the column each begins at, and its mismatches.

    Of equal scores the one that ends first and on the lowest diagonal is
    taken, and a match before a gap, one in the genome before one in the probe.
    Ends left out by a local alignment are written as soft clips.
    """
    (n, width), spread = text.shape, 2 * band + 1
    score = np.zeros((width + 1, n, spread), np.int32)
    points = np.zeros((width, n, spread), np.int32)
    down = np.full((n, spread), _LOW, np.int32)
    for i in range(width):
        points[i] = _points(text, around, i, spread, local)
        score[i + 1], down = _step(score[i], down, points[i], local)
    row = np.arange(n)
    if local:
        past = np.where(np.arange(width)[:, None, None] < size[:, None], score[1:], -1)
        flat = past.transpose(1, 0, 2).reshape(n, -1)
        i, d = np.divmod(flat.argmax(1), spread)
    else:
        i = size - 1
        d = score[size, row].argmax(1)
    # Operations from the last to the first, one letter each.
    ops = np.zeros((n, width + spread * (width + 1)), np.uint8) if not local else np.zeros((n, 3 * width + spread), np.uint8)
    used, wrong = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def put(rows: np.ndarray, letter: str, count: np.ndarray) -> None:
        for g in range(int(count.max(initial=0))):
            some = rows[count > g]
            ops[some, used[some] + g] = ord(letter)
        used[rows] += count

    put(row, "S", size - 1 - i)
    live = row
    while len(live):
        here = score[i[live] + 1, live, d[live]]
        going = (i[live] >= 0) & ((here > 0) if local else True)
        live, here = live[going], here[going]
        if not len(live):
            break
        match = here == score[i[live], live, d[live]] + points[i[live], live, d[live]]
        some = live[match]
        wrong[some] += around[some, i[some] + d[some]] != text[some, i[some]]
        put(some, "M", np.ones(len(some), np.int64))
        i[some] -= 1
        rest, here = live[~match], here[~match]
        across, along = np.zeros(len(rest), np.int64), np.zeros(len(rest), np.int64)
        for g in range(1, spread):
            cost = GAP_OPEN + g * GAP_EXTEND
            fits = (d[rest] >= g) & (across == 0) & (here == score[i[rest] + 1, rest, np.maximum(d[rest] - g, 0)] + cost)
            across[fits] = g
            fits = (d[rest] + g < spread) & (i[rest] + 1 >= g) & (along == 0)
            fits &= here == score[np.maximum(i[rest] + 1 - g, 0), rest, np.minimum(d[rest] + g, spread - 1)] + cost
            along[fits] = g
        along[across > 0] = 0
        put(rest, "D", across)
        put(rest, "I", along)
        d[rest] += along - across
        i[rest] -= along
    begin = i + 1 + d
    put(row, "S", i + 1)
    return [ops[r, :u][::-1].tobytes().decode() for r, u in enumerate(used.tolist())], begin, wrong


def cigar(ops: str) -> str:
    """Operations letter by letter as runs with their lengths."""
    if not ops:
        return "*"
    cuts = [0, *(i for i in range(1, len(ops)) if ops[i] != ops[i - 1]), len(ops)]
    return "".join(f"{b - a}{ops[a]}" for a, b in zip(cuts, cuts[1:]))

"""A minimal acyclic automaton that maps words to numbers, laid out for numpy.

Words are byte strings.  The automaton shares prefixes and suffixes; each
transition carries the number of words that come before those behind it, so
that the sum along a path is the rank of the word among all.  States lie in a
row-displaced table: the transition of state ``s`` by byte ``b`` is in slot
``base[s] + b`` if ``owner[slot] == s``.  The arrays are one file, which tasks
map into memory, so that all tasks of a machine share its pages.
"""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np

_ALIGN = 64


def build(words: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """The arrays of the automaton over ``words`` and of the ids each word gives."""
    ordered = sorted(w for w in words if w)
    # Incremental construction from sorted words: the path of the last word is
    # open, everything else is registered by its right language.
    final, edges = [False], [[]]
    register: dict[tuple, int] = {}
    path, last = [0], b""
    free: list[int] = []

    def new_state() -> int:
        if free:
            s = free.pop()
            final[s], edges[s] = False, []
            return s
        final.append(False)
        edges.append([])
        return len(final) - 1

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            child = path.pop()
            key = (final[child], tuple(map(tuple, edges[child])))
            known = register.get(key)
            if known is None:
                register[key] = child
            else:
                edges[path[-1]][-1][1] = known
                free.append(child)

    for word in ordered:
        common = 0
        while common < len(last) and common < len(word) and last[common] == word[common]:
            common += 1
        close(common)
        for b in word[common:]:
            s = new_state()
            edges[path[-1]].append([b, s])
            path.append(s)
        final[path[-1]] = True
        last = word
    close(0)

    # Number the reachable states; count the words behind each.
    order, number = [], {}
    stack = [0]
    while stack:
        s = stack.pop()
        if s not in number:
            number[s] = len(order)
            order.append(s)
            stack.extend(t for _, t in edges[s])
    below: dict[int, int] = {}
    todo = [(0, False)]
    while todo:
        s, ready = todo.pop()
        if s in below:
            continue
        if ready:
            below[s] = final[s] + sum(below[t] for _, t in edges[s])
        else:
            todo.append((s, True))
            todo.extend((t, False) for _, t in edges[s] if t not in below)

    transitions = sum(len(edges[s]) for s in order)
    size = 4 * transitions + 65_536
    owner = np.full(size, -1, np.int32)
    target = np.zeros(size, np.int32)
    before = np.zeros(size, np.int32)
    base = np.zeros(len(order), np.int32)
    used = bytearray(size)
    # States with many transitions first; the search for those with as many
    # goes on where the last one ended.
    hint: dict[int, int] = {}
    top = 0
    for s in sorted(order, key=lambda s: -len(edges[s])):
        if not edges[s]:
            continue
        labels = [b for b, _ in edges[s]]
        slot = hint.get(len(labels), 256)
        while True:
            slot = used.index(0, slot)
            at = slot - labels[0]
            if not any(used[at + b] for b in labels):
                break
            slot += 1
        hint[len(labels)] = slot
        base[number[s]] = at
        count = int(final[s])
        for b, t in edges[s]:
            used[at + b] = 1
            owner[at + b] = number[s]
            target[at + b] = number[t]
            before[at + b] = count
            count += below[t]
        top = max(top, at)
    owner, target, before = (x[: top + 512].copy() for x in (owner, target, before))
    ids = [words[w] for w in ordered]
    return {
        "base": base,
        "final": np.array([final[s] for s in order], np.uint8),
        "owner": owner,
        "target": target,
        "before": before,
        "offset": np.cumsum([0, *map(len, ids)]).astype(np.int32),
        "ids": np.array([i for x in ids for i in x], np.int32),
    }


def dump(arrays: dict[str, np.ndarray]) -> bytes:
    """The arrays as the content of one file, behind a line that tells where each lies."""
    places, at = {}, 0
    for name, a in arrays.items():
        at = -(-at // _ALIGN) * _ALIGN
        places[name] = [at, str(a.dtype), len(a)]
        at += a.nbytes
    head = json.dumps(places).encode()
    start = -(-(len(head) + 1) // _ALIGN) * _ALIGN
    out = bytearray(start + at)
    out[:start] = head.ljust(start - 1) + b"\n"
    for name, a in arrays.items():
        low = start + places[name][0]
        out[low : low + a.nbytes] = a.tobytes()
    return bytes(out)


def save(arrays: dict[str, np.ndarray], path: str | Path) -> None:
    """Write the arrays to a local file."""
    Path(path).write_bytes(dump(arrays))


def load(path: str | Path) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory."""
    whole = np.memmap(path, np.uint8, "r")
    with open(path, "rb") as f:
        head = f.readline()
    start = len(head)
    out = {}
    for name, (at, kind, n) in json.loads(head).items():
        size = np.dtype(kind).itemsize * n
        out[name] = np.asarray(whole[start + at : start + at + size]).view(kind)
    return out


def find(lex: dict[str, np.ndarray], data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rank of each word ``data[start:end]``, -1 for a word that isn't there; all words step together."""
    base, final, owner, target, before = (lex[k] for k in ("base", "final", "owner", "target", "before"))
    result = np.full(len(starts), -1, np.int32)
    live = np.arange(len(starts), dtype=np.int32)
    state = np.zeros(len(starts), np.int32)
    rank = np.zeros(len(starts), np.int32)
    at, end = starts, ends
    while len(live):
        slot = base[state] + data[at]
        kept = np.flatnonzero(owner[slot] == state)
        slot = slot[kept]
        live, rank, at, end = live[kept], rank[kept] + before[slot], at[kept] + 1, end[kept]
        state = target[slot]
        over = at == end
        done = np.flatnonzero(over)
        hit = done[final[state[done]] == 1]
        result[live[hit]] = rank[hit]
        going = np.flatnonzero(~over)
        live, state, rank, at, end = live[going], state[going], rank[going], at[going], end[going]
    return result

"""Bases as numbers: words of A, C, G, T packed two bits a letter."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Letters of a word that fit in a whole number.
MOST = 31
#: 0 to 3 for A, C, G, T in upper case, 4 for anything else, by byte.
CODE = np.full(256, 4, np.uint8)
CODE[np.frombuffer(b"ACGT", np.uint8)] = range(4)
#: The complement of each letter, by byte; other letters stay as they are.
TURN = np.arange(256, dtype=np.uint8)
TURN[np.frombuffer(b"ACGTacgt", np.uint8)] = np.frombuffer(b"TGCAtgca", np.uint8)


def to_codes(text: str) -> np.ndarray:
    """The code of each letter; what isn't ASCII is one other letter."""
    return CODE[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]


def words(base: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of ``k`` letters that begins at each place, and whether all its letters are bases.

    Words are put together from words of one, two, four and more letters.
    """
    n = len(base) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, bool)
    bad = np.concatenate([[0], np.cumsum(base == 4)])
    value, codes, width, at, left = np.zeros(n, np.int64), (base & 3).astype(np.int64), 1, 0, k
    while left:
        if left & 1:
            value = (value << (2 * width)) | codes[at : at + n]
            at += width
        left >>= 1
        if left:
            codes = (codes[:-width] << (2 * width)) | codes[width:]
            width *= 2
    return value, bad[k:] == bad[:-k]


def turned_words(base: np.ndarray, k: int) -> np.ndarray:
    """The reverse complement of the word that begins at each place."""
    back = np.where(base == 4, 4, 3 - base)[::-1].astype(np.uint8)
    return words(back, k)[0][::-1]


def spell(codes: np.ndarray, k: int) -> pa.Array:
    """Packed words as texts."""
    letters = np.empty((len(codes), k), np.uint8)
    alphabet = np.frombuffer(b"ACGT", np.uint8)
    for i in range(k):
        letters[:, k - 1 - i] = alphabet[(codes >> (2 * i)) & 3]
    # Offsets of a text array are of 32 bits; batches of rows are far below them.
    offsets = (np.arange(len(codes) + 1, dtype=np.int64) * k).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(codes), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])

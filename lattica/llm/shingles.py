"""Distinct word shingles of texts as 64-bit hashes, computed over many texts at once."""

from __future__ import annotations

import numpy as np

from lattica.llm.common import mix64

SIZE = 5
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_BACK = pow(_BASE, -1, 1 << 64)
_PLACE = mix64(np.arange(1000, 1000 + SIZE, dtype=np.uint64)) | _U(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BACK)):
            t = np.full(n, base, np.uint64)
            t[0] = 1
            _powers[i] = np.multiply.accumulate(t)
    return _powers


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, in order, and the number of the text it is in.

    Words are runs without the bytes 0x20 and 0x09-0x0D; A-Z count as a-z.
    """
    raw = b" ".join(texts) + b" "
    b = _LOWER[np.frombuffer(raw, np.uint8)]
    space = _SPACE[b]
    edge = np.diff(space.astype(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge[1:] == 1) + 1
    up, down = _power_tables(1 << max(16, int(len(b)).bit_length()))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[b] * up[: len(b)], dtype=np.uint64)))
    h = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    return h, np.searchsorted(first, starts, side="right") - 1


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer than SIZE words has one, of all
    its words; a text without words has none."""
    w, doc = word_hashes(texts)
    counts = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
    ends = np.cumsum(counts)
    n = max(0, len(w) - SIZE + 1)
    s = np.zeros(n, np.uint64)
    for i in range(SIZE):
        s += w[i : i + n] * _PLACE[i]
    s = mix64(s)
    out = []
    for k, end in zip(counts.tolist(), ends.tolist(), strict=True):
        start = end - k
        if k >= SIZE:
            out.append(np.unique(s[start : end - SIZE + 1]))
        elif k:
            out.append(mix64(np.array([(w[start:end] * _PLACE[:k]).sum(dtype=np.uint64) + _U(k)], np.uint64)))
        else:
            out.append(s[:0])
    return out


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit hash of a set of hashes."""
    a = int(mix64(s ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)) + len(s) * 0x9E3779B97F4A7C15
    return int(mix64(np.array([a % (1 << 64)], np.uint64)).astype(np.int64)[0])

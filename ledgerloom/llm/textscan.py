"""Vectorised word scanning in numpy: words, word hashes and word shingles of many texts at once.

A word is a maximal run of ASCII letters, digits or any non-ASCII character of the lower-cased text. Hashes are
64-bit. Long texts are cut between words into pieces, so temporaries stay small however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

PIECE = 1 << 20

_WORD = np.zeros(256, dtype=bool)
_WORD[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(255, _STEP, dtype=np.uint64)]))


def _power(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(2 * n, _STEP, dtype=np.uint64)]))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply); x is not changed."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _piece_words(buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of buf, which begins and ends with a byte outside words."""
    a = np.frombuffer(buf, dtype=np.uint8)
    inside = _WORD[a]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    size = end - start
    place = np.arange(int(size.sum()), dtype=np.int64)
    first = np.cumsum(size) - size
    place -= np.repeat(first, size)
    x = _BYTE[a[inside]] * _power(int(size.max()))[place]
    h = np.add.reduceat(x, first)
    return mix(h + size.astype(np.uint64)), start, end


def _cut(b: bytes) -> list[tuple[int, bytes]]:
    """b in pieces of about PIECE bytes, cut at bytes outside words."""
    out, at = [], 0
    while len(b) - at > PIECE:
        to = at + PIECE
        tail = np.flatnonzero(~_WORD[np.frombuffer(b, np.uint8, min(len(b) - to, PIECE), to)])
        while not len(tail) and to + PIECE < len(b):
            to += PIECE
            tail = np.flatnonzero(~_WORD[np.frombuffer(b, np.uint8, min(len(b) - to, PIECE), to)])
        if not len(tail):
            break
        to += int(tail[0])
        out.append((at, b[at:to]))
        at = to
    out.append((at, b[at:]))
    return out


class Words:
    """Words of some texts in one run: hash, byte start and end (in the lower-cased UTF-8 text), and bounds by text."""

    __slots__ = ("hash", "start", "end", "bounds", "raw")

    def __init__(self, texts: list[str | None]):
        # the one letter that lower() turns into two would shift what follows it
        self.raw = [t.replace("\u0130", "i").lower().encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        pieces = [(i, at, p) for i, b in enumerate(self.raw) for at, p in (_cut(b) if len(b) > PIECE else [(0, b)])]
        hs, ss, es = [], [], []
        count = np.zeros(len(texts) + 1, dtype=np.int64)
        k = 0
        while k < len(pieces):
            j, size = k, 0
            while j < len(pieces) and (j == k or size + len(pieces[j][2]) <= PIECE):
                size += len(pieces[j][2]) + 1
                j += 1
            run = pieces[k:j]
            h, s, e = _piece_words(b"\n" + b"\n".join(p for _, _, p in run) + b"\n")
            at = np.cumsum([1] + [len(p) + 1 for _, _, p in run])
            which = np.searchsorted(at, s, side="right") - 1
            shift = np.array([off for _, off, _ in run], dtype=np.int64) - at[:-1]
            hs.append(h)
            ss.append(s + shift[which])
            es.append(e + shift[which])
            np.add.at(count, np.array([i for i, _, _ in run])[which] + 1, 1)
            k = j
        self.hash = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
        self.start = np.concatenate(ss) if ss else np.zeros(0, np.int64)
        self.end = np.concatenate(es) if es else np.zeros(0, np.int64)
        self.bounds = np.cumsum(count)


def shingles(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each text, and their bounds; a text of 1 to n-1 words has one shingle."""
    sizes = np.diff(bounds)
    count = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    out_bounds = np.concatenate([[0], np.cumsum(count)])
    total = int(out_bounds[-1])
    if not total:
        return np.zeros(0, np.uint64), out_bounds
    at = np.arange(total, dtype=np.int64) + np.repeat(bounds[:-1] - out_bounds[:-1], count)
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    p = _power(n)
    x = np.zeros(total, np.uint64)
    for j in range(n):
        x += padded[at + j] * p[j]
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    for i in short:  # texts of fewer words than a shingle
        w = h[bounds[i] : bounds[i + 1]]
        x[out_bounds[i]] = np.add.reduce(w * p[: len(w)]) + np.uint64(len(w))
    return mix(x), out_bounds


def sequence_hash(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One signed 64-bit hash for the word sequence of each text; 0 for texts without words."""
    sizes = np.diff(bounds)
    out = np.zeros(len(sizes), np.uint64)
    if len(h):
        place = np.arange(len(h), dtype=np.int64) - np.repeat(bounds[:-1], sizes)
        x = h * mix(place.astype(np.uint64) + np.uint64(77))
        some = sizes > 0
        out[some] = mix(np.add.reduceat(x, bounds[:-1][some]) + sizes[some].astype(np.uint64))
    return out.view(np.int64)


def in_runs(texts: Iterable[str | None], size: int = PIECE) -> Iterator[tuple[int, int]]:
    """(from, to) index ranges of texts with at most about size characters each."""
    texts = list(texts)
    k = 0
    while k < len(texts):
        j, n = k, 0
        while j < len(texts) and (j == k or n + len(texts[j] or "") <= size):
            n += len(texts[j] or "")
            j += 1
        yield k, j
        k = j

"""Vectorised word hashing: 64-bit ids of all words of a batch of texts."""

from __future__ import annotations

import numpy as np

_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_SPACE = b" \t\n\x0b\x0c\r"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
PUNCTUATION = b".,;:!?()[]{}\"'|-"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    size = 1
    while size < n:  # doubling: base^(i + size) = base^i * base^size
        step = np.uint64(pow(base, size, 1 << 64))
        take = min(size, n - size)
        out[size:size + take] = out[:take] * step
        size += take
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    """Finaliser, so that every bit of an id can be used."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHasher:
    """Hashes words as polynomials over their bytes, keeping the powers between batches."""

    def __init__(self, *, drop: bytes = b""):
        """A-Z are lower-cased; bytes of ``drop`` part words like white space."""
        self.table = bytes.maketrans(_UPPER + _SPACE + drop, _LOWER + b" " * (len(_SPACE) + len(drop)))
        self.up, self.down = _powers(_MULT, 1), _powers(_INV, 1)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, first word of each text with the total at the end)."""
        raw = [(t or "").encode("utf-8", "replace").translate(self.table) for t in texts]
        buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        if len(buf) > len(self.up):
            self.up, self.down = _powers(_MULT, 2 * len(buf)), _powers(_INV, 2 * len(buf))
        inside = buf != 32
        edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(buf * self.up[:len(buf)], dtype=np.uint64)])
            ids = (total[ends] - total[starts]) * self.down[starts]
            ids = _mix(ids + np.uint64(0x9E3779B97F4A7C15) * (ends - starts).astype(np.uint64))
        at = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
        return ids, np.searchsorted(starts, at)


def small_batches(texts: list, limit: int = 1 << 20):
    """(first, last) of runs of texts of about ``limit`` characters, so memory stays bounded."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)

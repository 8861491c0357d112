"""Vectorised 64-bit hashes of words and of runs of words, for use inside Spark tasks.

Equal words, and equal runs, always have equal hashes on every machine; different ones
collide with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Texts are hashed in segments of about so many bytes, cut between words.
SEGMENT = 1 << 20

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i below n at least; kept for the worker's life."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        rows = []
        for b in (base, inverse):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            rows.append(np.multiply.accumulate(a))
        have = _powers[int(base)] = rows[0], rows[1]
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _segment(b: np.ndarray) -> np.ndarray:
    blank = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    power, inverse = powers(_BASE, len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """A hash for each word (maximal run without ASCII white space) of a whole text."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) <= SEGMENT:
        return _segment(data)
    out, at = [], 0
    while at < len(data):
        end = min(at + SEGMENT, len(data))
        while end < len(data):  # never cut a word
            tail = data[end : end + 4096]
            gaps = np.flatnonzero((tail == 32) | ((tail >= 9) & (tail <= 13)))
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(end + 4096, len(data))
        out.append(_segment(data[at:end]))
        at = end
    return np.concatenate(out)


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of ``k`` consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, inverse = powers(_STEP, len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=total[1:])
    return mix((total[k:] - total[:n]) * inverse[:n])

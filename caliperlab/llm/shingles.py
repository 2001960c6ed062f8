"""Words and word shingles of whole batches of texts as 64-bit hashes, without a loop over words.

A word is a maximal run of lower-cased ASCII letters and digits and of characters beyond ASCII. Its hash
is a polynomial of its bytes modulo 2**64, mixed; a shingle's, a combination of its words' hashes in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import worker_memory

#: Words of a shingle.
WIDTH = 5
_RANDOM = np.random.default_rng(20240601)
_BYTE = _RANDOM.integers(1, 2**63, 256, np.uint64)
_IS_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_BASE, _STEPS = 0x9E3779B97F4A7C15 | 1, _RANDOM.integers(1, 2**63, 64, np.uint64) | np.uint64(1)
#: Texts are taken in groups of about so many characters.
GROUP = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    kept = worker_memory("shingles")
    if len(kept.get("up", ())) < n:
        size = max(n, 2 * GROUP)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            kept[name] = np.cumprod(steps, dtype=np.uint64)
    return kept["up"], kept["down"]


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, index of each text's first word and the end): texts in order."""
    coded = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join([b"", *coded, b""]), np.uint8)
    begins = np.cumsum([1, *(len(c) + 1 for c in coded)])
    inside = _IS_WORD[data]
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = change[::2], change[1::2]
    up, down = _powers(len(data))
    sums = np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)
    hashes = mix((sums[end - 1] - sums[start - 1]) * down[start] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(start, begins)


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every shingle, index of each text's first one and the end).

    A text of fewer words than `width` has one shingle, of all its words; one without words has none.
    """
    n = np.diff(bounds)
    counts = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    total = np.zeros(max(len(hashes), 1), np.uint64)
    for k in range(width):
        rest = max(0, len(hashes) - k)
        total[:rest] += hashes[k : k + rest] * _STEPS[k]
    out_bounds = np.concatenate([[0], np.cumsum(counts)])
    keep = np.repeat(bounds[:-1] - out_bounds[:-1], counts) + np.arange(out_bounds[-1])
    out = mix(total[keep]) if len(keep) else np.zeros(0, np.uint64)
    for i in np.flatnonzero((n > 0) & (n < width)):
        out[out_bounds[i]] = phrase(hashes[bounds[i] : bounds[i + 1]])
    return out, out_bounds


def phrase(hashes: np.ndarray) -> np.uint64:
    """The hash of a run of at most 64 words; of `width` words, the same as their shingle's."""
    return mix(np.array([(hashes * _STEPS[: len(hashes)]).sum(dtype=np.uint64)], np.uint64))[0]


def grouped(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """[lo, hi) of groups of texts of about GROUP characters."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= GROUP:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)

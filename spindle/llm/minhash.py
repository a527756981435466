"""Word shingles and min-wise hashes of a text."""

from __future__ import annotations

import numpy as np
import xxhash

TREES = 24
LEVELS = 8
_NUMBERS = np.random.default_rng(20_210_801)
FACTORS = _NUMBERS.integers(0, 2**31, TREES * LEVELS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
OFFSETS = _NUMBERS.integers(0, 2**32, TREES * LEVELS, dtype=np.uint32)
STEPS = _NUMBERS.integers(0, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ROWS = 1024  # shingles hashed at a time, so a long text needs no more memory than a short one


def words_of(text: bytes) -> list[bytes]:
    """Lower-cases A to Z and cuts at space and \\x09 to \\x0d. Bytes know no
    other letters and no other white space, so this is exact for UTF-8."""
    return text.lower().split()


def shingles_of(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    """Distinct runs of `size` words; of fewer words the whole sequence; of none, none."""
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size)), strict=False))


def hashed_shingles(words: list[bytes], size: int) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes."""
    if not words:
        return np.empty(0, np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(size, len(words))
    if span > len(STEPS):
        raise ValueError(f"at most {len(STEPS)} words to a shingle")
    n = len(one) - span + 1
    mixed = np.full(n, len(words) if len(words) < size else size, np.uint64)
    for i in range(span):
        mixed += one[i : i + n] * STEPS[i]
        mixed ^= mixed >> np.uint64(29)
    mixed *= STEPS[-1]
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def signature(hashes: np.ndarray) -> np.ndarray:
    """One minimum for each level of each tree. A linear map with an odd factor
    permutes the 32-bit numbers, and the minimum under a permutation of hashed
    shingles is shared with the probability of their similarity."""
    least = np.full(TREES * LEVELS, 2**32 - 1, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(short), ROWS):
        part = FACTORS[:, None] * short[None, start : start + ROWS]
        part += OFFSETS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def sketch(least: np.ndarray) -> bytes:
    """Four bits of every minimum: enough to tell far pairs from near ones."""
    low = (least & np.uint32(15)).astype(np.uint8)
    return (low[0::2] << 4 | low[1::2]).tobytes()


def alike(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated similarities of a sketch (or of as many) and the rows of others;
    four bits agree by chance once in 16."""
    differ = many ^ one
    same = ((differ & 15) == 0).sum(axis=1) + ((differ >> 4) == 0).sum(axis=1)
    return (same / (TREES * LEVELS) - 1 / 16) / (15 / 16)


def bits_of(sketches) -> np.ndarray:
    """Sketches as rows of bytes."""
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, TREES * LEVELS // 2)

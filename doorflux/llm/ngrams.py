"""Character n-grams of whole texts as hashed numbers, in numpy."""

from __future__ import annotations

from functools import cache

import numpy as np

SPACE = 32


@cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case and the text each belongs to.

    Everything but letters becomes a space, runs of spaces one; each text starts and
    ends with a space.
    """
    low = [t.lower() for t in texts]
    joined = " " + "  ".join(low) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "u4")
    owner = np.repeat(np.arange(len(low), dtype="i4"), [len(t) + 2 for t in low])
    letter = letters()[codes]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])
    return np.where(letter, codes, SPACE).astype("u4")[keep], owner[keep]


def hashed(codes: np.ndarray, owner: np.ndarray, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``bits`` bits of all n-grams of a size, and the texts they belong to."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, "i4"), np.zeros(0, "i4")
    h = np.full(n, size, "u4")
    for k in range(size):
        h *= np.uint32(0x01000193)
        h ^= codes[k:k + n]
        h *= np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    inside = owner[:n] == owner[size - 1:]
    return (h >> np.uint32(32 - bits)).astype("i4")[inside], owner[:n][inside]

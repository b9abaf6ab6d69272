"""Hashed word shingles of whole texts.

Words are the runs of bytes between ASCII white space of the UTF-8 text, with A-Z lower-cased, which is
the same as words ``[^\\x20\\x09-\\x0D]+`` of the characters. A shingle of five consecutive words becomes
one 64-bit number; a text of fewer words is one shingle as a whole.
"""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
_U = np.uint64
#: Odd multipliers, one for each place in a shingle (the first digits of constants used for mixing).
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=_U)
#: Words kept in a process's table of hashes before it starts anew.
_TABLE_LIMIT = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _TABLE_LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """The hash of each shingle in order, repeats included; empty without words."""
    n = len(words)
    if not n:
        return np.empty(0, dtype=_U)
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=_U, count=n)
    with np.errstate(over="ignore"):
        if n < width:
            return mix((h * _PLACES[:n]).sum(keepdims=True, dtype=_U) + _U(n))
        total = h[: n - width + 1] * _PLACES[0]
        for k in range(1, width):
            total = total + h[k : n - width + 1 + k] * _PLACES[k]
        return mix(total)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(words_of(text)))

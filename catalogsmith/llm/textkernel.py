"""Vectorised text kernels: whole batches of texts as one array of code points.

Python loops over words or characters cost microseconds each; the operators here instead lay a slab of texts end to end in
a numpy array, find words and lines with array comparisons, and hash any segment in O(1) from a prefix polynomial.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

#: Code points of the contract's white space: U+0020 and U+0009 to U+000D.
SPACE = 0x20
#: Code points that one polynomial covers. Modulo 2**64 the Thue-Morse word and its complement have equal polynomials from 1,024
#: letters on, whatever the base; at 64 their difference keeps 38 bits. Longer segments chain the mixed values of their blocks.
HASH_BLOCK = 64


def _power(base: int, n: int, key: str) -> np.ndarray:
    """The first n powers of base modulo 2**64, kept from call to call up to a size that ordinary slabs have."""
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        have = np.full(size, base, U64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= 1 << 23:
            _powers[key] = have
    return have[:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer, so that any bits of a polynomial hash may be used."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _lower_table() -> np.ndarray:
    table = np.arange(0x10000, dtype=np.uint32)
    for i in range(0x2FFF):
        if len(low := chr(i).lower()) == 1:
            table[i] = ord(low)
    return table


def _letter_table() -> np.ndarray:
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x10000)])


def _high_letter_table() -> np.ndarray:
    """Beyond U+FFFF letters lie in planes 1 to 3 alone."""
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x10000, 0x40000)])


_tables: dict[str, np.ndarray] = {}


def table(name: str) -> np.ndarray:
    """Tables over the first 65,536 code points (and of letters beyond), built at first use in each worker."""
    if name not in _tables:
        _tables[name] = {"lower": _lower_table, "letter": _letter_table, "high letter": _high_letter_table}[name]()
    return _tables[name]


def lookup(name: str, codes: np.ndarray, beyond: int | bool) -> np.ndarray:
    out = table(name)[np.minimum(codes, 0xFFFF)]
    high = codes > 0xFFFF
    if high.any():
        out = np.where(high, beyond, out)
    return out


def letters(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters, by Unicode category."""
    out = table("letter")[np.minimum(codes, 0xFFFF)]
    high = np.flatnonzero(codes > 0xFFFF)
    if len(high):
        beyond = codes[high] - np.uint32(0x10000)
        out[high] = table("high letter")[np.minimum(beyond, 0x2FFFF)] & (beyond < 0x30000)
    return out


def lowered(codes: np.ndarray) -> np.ndarray:
    out = table("lower")[np.minimum(codes, 0xFFFF)]
    high = codes > 0xFFFF
    return np.where(high, codes, out) if high.any() else out


class Slab:
    """Texts end to end: codes (uint32) and bounds (where each text begins, and the end)."""

    def __init__(self, texts: list[str], apart: bool = False):
        """apart: a line feed follows each text (and belongs to it)."""
        self.texts = texts
        whole = "\n".join([*texts, ""]) if apart else "".join(texts)
        self.codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + apart, out=self.bounds[1:])
        self._prefix: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.texts)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of maximal runs free of white space, in order."""
        return self.runs(~((self.codes == SPACE) | ((self.codes - np.uint32(9)) < 5)))

    def runs(self, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of maximal runs of solid code points within a text."""
        n = len(solid)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, none
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        cut = self.bounds[:-1]
        begin = cut[cut < n]
        first[begin] = solid[begin]
        begin = begin[begin > 0]
        last[begin - 1] = solid[begin - 1]
        starts = np.flatnonzero(first)
        ends = np.flatnonzero(last) + 1
        return starts, ends, self.owner(starts)

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """The text that each of the ascending positions lies in."""
        per = np.diff(np.searchsorted(positions, self.bounds))
        return np.repeat(np.arange(len(self)), per)

    def hash(self, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of segments; equal segments of code points hash alike in every process."""
        codes = self.codes if codes is None else codes
        key = id(codes)
        if key not in self._prefix:
            total = np.zeros(len(codes) + 1, U64)
            np.cumsum((codes.astype(U64) + U64(1)) * _power(_BASE, len(codes), "up"), out=total[1:])
            self._prefix[key] = (total, codes)
        total, down, size = self._prefix[key][0], _power(_INVERSE, len(codes) + 1, "down"), ends - starts
        h = (total[np.minimum(ends, starts + HASH_BLOCK)] - total[starts]) * down[starts]
        h = mix64(h ^ (size.astype(U64) * U64(0xD6E8FEB86659FD93)))
        left, at = np.flatnonzero(size > HASH_BLOCK), HASH_BLOCK
        while len(left):
            a = starts[left] + at
            h[left] = mix64(h[left] * U64(0xA24BAED4963EE407) + (total[np.minimum(ends[left], a + HASH_BLOCK)] - total[a]) * down[a])
            at += HASH_BLOCK
            left = left[size[left] > at]
        return h


def slabs(texts: list[str | None], limit: int = 1_500_000, apart: bool = False) -> Iterator[tuple[int, Slab]]:
    """Runs of texts (null: empty) of about limit code points, with the number of the first; a longer text stands alone."""
    begin, size, part = 0, 0, []
    for i, text in enumerate(texts):
        text = text or ""
        if part and size + len(text) > limit:
            yield begin, Slab(part, apart)
            begin, size, part = i, 0, []
        part.append(text)
        size += len(text)
    if part:
        yield begin, Slab(part, apart)


def windows(word_hashes: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of width words begin (as word numbers, none across two texts), and their hashes."""
    n = len(word_hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.flatnonzero(owner[:n] == owner[width - 1 :])
    total = np.zeros(n, U64)
    factor = 1
    for j in range(width):
        total += word_hashes[j : j + n] * U64(factor)
        factor = factor * 0xA24BAED4963EE407 & ((1 << 64) - 1)
    return at, mix64(total[at])


def repeated(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of hashes within one owner: which occur twice or more, and which of these are not the first."""
    n = len(hashes)
    twice, later = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        keyed = mix64(hashes ^ (owner.astype(U64) * U64(0xC2B2AE3D27D4EB4F)))
        order = np.argsort(keyed, kind="stable")
        same = keyed[order][1:] == keyed[order][:-1]
        later[order[1:][same]] = True
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
    return twice, later


def as_texts(column: pa.Array) -> list[str | None]:
    return column.to_pylist()

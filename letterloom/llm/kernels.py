"""Array kernels that the operators run on the rows of one Arrow batch.

All take the texts of a batch end to end as one array, so that cost is per byte and not per row.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: The C library's own way to return freed memory, where it has one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: The prime 2^31 - 1, whose remainders need no division, and a base of each of the two lanes of a hash.
_PRIME, _BASES = U((1 << 31) - 1), (1_048_583_467, 1_832_780_611)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))


def _folded(x: np.ndarray) -> np.ndarray:
    """A number below 2^31 with the remainder of ``x`` (below 2^62); of the remainder 0 it may be the prime itself."""
    x = (x & _PRIME) + (x >> U(31))
    return (x & _PRIME) + (x >> U(31))


class _Powers:
    """Powers of a lane's base and of its inverse, grown when a longer text comes."""

    def __init__(self, base: int) -> None:
        self.bases = base, pow(base, -1, int(_PRIME))
        self.found = np.ones((2, 1), U)

    def upto(self, n: int) -> np.ndarray:
        while self.found.shape[1] < n:
            size = self.found.shape[1]
            more = [_folded(row * U(pow(base, size, int(_PRIME)))) for row, base in zip(self.found, self.bases)]
            self.found = np.concatenate([self.found, more], axis=1)
        return self.found


_powers = [_Powers(base) for base in _BASES]


class SpanHash:
    """62-bit hashes of any spans of one code array (below 2^30 codes), each in constant time after one pass.

    They are two polynomials modulo a prime, so that no text collides for every base, as texts modulo 2^64 can. Where
    equal hashes decide a result, the characters are compared too.
    """

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        self._lanes = []
        for powers, shift in zip(_powers, (0, 32)):
            up, down = powers.upto(n + 1)
            sums = np.zeros(n + 1, U)
            np.cumsum(_folded(((values >> U(shift)) & _PRIME) * up[:n]), out=sums[1:])
            self._lanes.append((sums, down))

    def lane(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        """31 bits of a span."""
        sums, down = self._lanes[which]
        found = _folded(_folded(sums[end] - sums[start]) * down[start])
        return np.where(found == _PRIME, U(0), found)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        both = self.lane(start, end) << U(31) | self.lane(start, end, 1)
        return mix64(both + (end - start).astype(U) * U(0xA0761D6478BD642F))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def groups_of(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose lengths sum to ``most`` or less; a longer row stands alone."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def ascii_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (maximal runs without ASCII white space) of each text with A-Z lower-cased, and the row of
    each word."""
    joined = b" ".join([b"", *texts, b""]).lower()
    data = np.frombuffer(joined, np.uint8)
    space = _SPACE[data]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    offsets = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return SpanHash(byte_values(data))(start, end), np.searchsorted(offsets, start, "right") - 1


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``words`` words; with fewer words the whole sequence
    is the only shingle; without words the set is empty."""
    word, row = ascii_words(texts)
    count = np.bincount(row, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(count)])
    whole = word.copy()
    for k in range(1, words):
        whole = mix64(whole[: len(word) - k] * U(3) + word[k:]) if len(word) > k else whole[:0]
    out = []
    for i, n in enumerate(count):
        if n >= words:
            out.append(np.unique(whole[first[i] : first[i] + n - words + 1]))
        elif n:
            h = U(n)
            for w in word[first[i] : first[i] + n]:
                h = mix64(np.array([int(h) * 5 + int(w) & (1 << 64) - 1], U))[0]
            out.append(np.array([h], U))
        else:
            out.append(np.empty(0, U))
    return out


def firsts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct value comes first, in order, and which of these every value equals."""
    coded = pa.array(values).dictionary_encode()
    like = coded.indices.to_numpy()
    at = np.empty(len(coded.dictionary), np.int64)
    at[like[::-1]] = np.arange(len(like))[::-1]
    return at, like


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices ``flat[start : start + size]`` end to end."""
    before = np.cumsum(size) - size
    return flat[np.repeat(start - before, size) + np.arange(size.sum())]


def release() -> None:
    """Give the system back what freed arrays and batches hold of a worker's memory. Workers are kept from task to task
    and stage to stage, and so is, in each, the most that any of its tasks has taken."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def text_blocks(column, most: int) -> Iterator[tuple[int, int, list[str]]]:
    """An Arrow string column in ranges of rows with ``most`` bytes or less (or one longer text); null is empty."""
    length = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for start, end in groups_of(length + 1, most):
        yield start, end, [x or "" for x in column.slice(start, end - start).to_pylist()]
    release()


def parts_of(batch, column: int, most: int) -> Iterator:
    """An Arrow batch in slices whose texts (or binaries) in ``column`` have ``most`` bytes or less, or one longer."""
    length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    for start, end in groups_of(length + 1, most):
        yield batch.slice(start, end - start)
    release()


def as_bytes(column) -> list[bytes]:
    """UTF-8 of an Arrow string column; null is empty."""
    return [x or b"" for x in column.cast("binary").to_pylist()]

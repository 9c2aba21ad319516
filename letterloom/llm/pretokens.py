"""Pre-tokens of the public byte-level BPE pattern, cut for a whole block of texts at once.

The pattern takes a contraction ('s 't 're 've 'm 'll 'd), or a run of letters, of digits or of other visible
characters with at most one space before it, or white space without the last character that precedes visible text.
Where each match starts follows from the classes of neighbouring characters, so array operations find all of them.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

from .kernels import U, SpanHash, firsts, gathered, mix64

SPACE, LETTER, NUMBER, OTHER, END = range(5)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and hash value of every code point."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    kind = np.full(0x110000, OTHER, np.uint8)
    for pattern, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, every):
            shift = lambda i: i if i < 0xD800 else i + 0x800
            kind[shift(m.start()) : shift(m.end() - 1) + 1] = value
    return kind, mix64(np.arange(1, 0x110001, dtype=U) * U(0xD6E8FEB86659FD93))


class Pretokens:
    """``start`` and ``end`` of all matches in a block of texts, and ``first``: where each text's begin."""

    def __init__(self, texts: list[str]) -> None:
        kinds, values = _tables()
        self.joined = "\0".join(["", *texts, ""])
        code = self.code = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = kinds[code]
        ends = np.cumsum([0, *(len(t) + 1 for t in texts)])
        kind[ends] = END
        begins = np.empty(len(code), bool)
        begins[0] = True
        np.not_equal(kind[1:], kind[:-1], out=begins[1:])
        begins[ends] = True
        begins[np.minimum(ends + 1, len(code) - 1)] = True
        after = np.flatnonzero(begins[1:] & (kind[:-1] == SPACE) & (kind[1:] != END)) + 1
        begins[after - 1] = True
        begins[after[code[after - 1] == 32]] = False
        self._contractions(code, kind, begins)
        at = np.flatnonzero(begins)
        stop = np.append(at[1:], len(code))
        real = kind[at] != END
        self.start, self.end = at[real], stop[real]
        self.first = np.searchsorted(self.start, ends)
        self._values = values

    @staticmethod
    def _contractions(code: np.ndarray, kind: np.ndarray, begins: np.ndarray) -> None:
        at = np.flatnonzero(code == ord("'"))
        at = at[at + 2 < len(code)]
        at = at[begins[at] & (kind[at] == OTHER) & (kind[at + 1] == LETTER)]
        one, two = code[at + 1], code[at + 2]
        short = np.isin(one, [*map(ord, "stmd")])
        long = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        for hit, n in ((at[short], 2), (at[long & ~short], 3)):
            begins[hit + 1] = False
            begins[hit + n] = True

    def word(self, i: int) -> str:
        return self.joined[self.start[i] : self.end[i]]

    def words(self, at: np.ndarray) -> list[str]:
        joined = self.joined
        return [joined[a:b] for a, b in zip(self.start[at].tolist(), self.end[at].tolist())]

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pre-tokens that stand for all equal ones, and which of these each pre-token equals. Hashes
        only propose; every pre-token is compared with its like character by character."""
        self.hash = SpanHash(self._values[self.code])(self.start, self.end)
        at, like = firsts(self.hash)
        rest = np.flatnonzero(at[like] != np.arange(len(like)))
        size, other = (self.end - self.start)[rest], at[like[rest]]
        same = size == (self.end - self.start)[other]
        if same.all() and (gathered(self.code, self.start[rest], size) == gathered(self.code, self.start[other], size)).all():
            return at, like
        number: dict[str, int] = {}
        like = np.array([number.setdefault(self.word(i), len(number)) for i in range(len(self.start))], np.int64)
        return np.unique(like, return_index=True)[1], like

"""Packing documents into sequences by length patterns whose repeat counts are a non-negative least-squares fit.

Only the histogram of piece lengths (one entry per length, however large the corpus) reaches the driver. Patterns of
few pieces that fill a sequence exactly are fitted to it, the counts are rounded down, and what is left is packed
best-fit decreasing, again as counts of patterns. Pieces then take their places by rank among those of their length.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .kernels import gathered, text_blocks
from .pretokens import Pretokens
from .scratch import written

#: Bytes that are cut at once; words that a worker remembers.
BLOCK, REMEMBERED = 1 << 18, 1 << 17


class _Words:
    """Ids of words seen by this worker; rare ones are forgotten when there are too many, which costs time only."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        # A word is one match of the tokenizer's pattern already, so its model is all that is asked.
        self.model = Tokenizer.from_file(path).model
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in visible]
        # A byte that no UTF-8 has parts the words; the letter of a line's end is none of the vocabulary's.
        self.letters = np.zeros(256, "<u4")
        self.letters[[*visible, *hidden, 0xFF]] = [*visible, *range(256, 256 + len(hidden)), ord("\n")]
        self.clear()

    def _encode(self, word: str) -> list[int]:
        return self._encoded([word])[0].tolist()

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words end to end and how many each word has; words are written in letters all at once."""
        data = b"\xff".join([w.encode("utf-8", "surrogatepass") for w in words])
        tokenize, ids, size = self.model.tokenize, [], []
        for letters in self.letters[np.frombuffer(data, np.uint8)].tobytes().decode("utf-32-le").split("\n"):
            tokens = tokenize(letters)
            ids += [token.id for token in tokens]
            size.append(len(tokens))
        return np.array(ids, "<u4"), np.array(size, np.int64)

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.start, self.size, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u4")
        self.again = np.empty(0, bool)

    def forget(self) -> None:
        """Forget words that came in no later block, as most of many do, or all if too many would stay."""
        stay = np.flatnonzero(self.again)
        if len(stay) > REMEMBERED // 2:
            return self.clear()
        names = list(self.place)
        self.place = {names[i]: k for k, i in enumerate(stay.tolist())}
        self.flat, self.size = gathered(self.flat, self.start[stay], self.size[stay]), self.size[stay]
        self.start, self.again = np.cumsum(self.size) - self.size, np.zeros(len(stay), bool)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end and how many each text has."""
        cut = Pretokens(texts)
        at, like = cut.distinct()
        if len(self.place) > REMEMBERED:
            self.forget()
        words = cut.words(at)
        place = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(place < 0)
        self.again[place[place >= 0]] = True
        if len(unknown):
            new = [words[i] for i in unknown.tolist()]
            flat, size = self._encoded(new)
            place[unknown] = np.arange(len(self.place), len(self.place) + len(new))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, flat])
            self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
            self.place.update(zip(new, place[unknown].tolist()))
        place = place[like]
        sizes = self.size[place]
        per_text = np.diff(np.concatenate([[0], np.cumsum(sizes)])[cut.first])
        return gathered(self.flat, self.start[place], sizes), per_text


_workers: dict[str, _Words] = {}


def pieces(docs: DataFrame, path: str, longest: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``piece``, ``start``, ``length``, ``crc`` of every piece of every row of ``docs``.

    A document is its ids and then ``end_id``. Only one of over ``longest`` tokens is cut, so that all its pieces but
    the first are full.
    """

    def run(batches):
        if path not in _workers:
            _workers[path] = _Words(path)
        words = _workers[path]
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for begin, stop, texts in text_blocks(batch.column(1), BLOCK):
                ids, per_text = words.ids(texts)
                out, at = [], 0
                for row, n in zip(rows[begin:stop], per_text.tolist()):
                    own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    first = (n + 1) % longest or longest
                    edges = [0, *range(first, n + 2, longest)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):
                        out.append((row, k, a, b - a, zlib.crc32(own[a:b].tobytes())))
                columns = zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], ["id", "piece", "start", "length", "crc"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "id long, piece int, start long, length int, crc long")


def _patterns(count: np.ndarray, full: int) -> np.ndarray:
    """Rows of three lengths (0 for none) that add up to ``full``, of lengths that occur."""
    has = count > 0
    one = np.arange(1, full // 2 + 1)
    one = one[has[one] & has[full - one]]
    pairs = np.stack([np.zeros_like(one), one, full - one], 1)
    triples = [pairs]
    for a in np.flatnonzero(has[: full // 3 + 1]):
        b = np.arange(a, (full - a) // 2 + 1)
        b = b[has[b] & has[full - a - b]]
        triples.append(np.stack([np.full_like(b, a), b, full - a - b], 1))
    return np.concatenate(triples)


def nonnegative_fit(patterns: np.ndarray, count: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Repeat counts x >= 0 that make sum over lengths of (count - uses)^2 small, by accelerated projected gradient.

    Entry 0 of ``count`` is no length and carries no weight. The step is one over a bound of the largest eigenvalue.
    """
    real = patterns > 0
    use = np.bincount(patterns[real], minlength=len(count)).astype(float)
    step = 1.0 / max(1.0, np.where(real, use[patterns], 0).sum(1).max(initial=1.0))
    x = y = np.zeros(len(patterns))
    t = 1.0
    target = count.astype(float)
    for _ in range(rounds):
        made = sum(np.bincount(patterns[:, k], y, len(count)) for k in range(3))
        gap = target - made
        gap[0] = 0
        ahead = np.maximum(0, y + step * gap[patterns].sum(1))
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y, x = ahead + (old - 1) / t * (ahead - x), ahead
    return x


def plan(count: dict[int, int], full: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used; together they use every piece of the histogram once."""
    left = np.zeros(full + 1, np.int64)
    for length, n in count.items():
        left[length] = n
    uses = [((full,), int(left[full]))] if left[full] else []
    left[full] = 0
    patterns = _patterns(left, full)
    if len(patterns):
        fit = np.floor(nonnegative_fit(patterns, left) + 1e-6).astype(np.int64)
        for k in np.argsort(-fit, kind="stable"):
            if not fit[k]:
                break
            need = Counter(int(v) for v in patterns[k] if v)
            n = min(int(fit[k]), *(int(left[v]) // c for v, c in need.items()))
            if n > 0:
                uses.append((tuple(sorted(need.elements(), reverse=True)), n))
                for v, c in need.items():
                    left[v] -= n * c
    lengths = sorted((int(v) for v in np.flatnonzero(left)), reverse=True)
    while lengths:
        if not left[lengths[0]]:
            lengths.pop(0)
            continue
        taken, room = Counter([lengths[0]]), full - lengths[0]
        while room:
            fits = next((v for v in lengths if v <= room and left[v] > taken[v]), 0)
            if not fits:
                break
            taken[fits] += 1
            room -= fits
        n = min(int(left[v]) // c for v, c in taken.items())
        uses.append((tuple(sorted(taken.elements(), reverse=True)), n))
        for v, c in taken.items():
            left[v] -= n * c
        lengths = [v for v in lengths if left[v]]
    return uses


def _slots(uses: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length rows of: first rank, first sequence, offset in the sequence; in order of rank."""
    out, rank, sequence = defaultdict(list), Counter(), 0
    for lengths, n in uses:
        offset = 0
        for v in lengths:
            out[v].append((rank[v], sequence, offset))
            rank[v] += n
            offset += v
        sequence += n
    return {v: np.array(rows, np.int64) for v, rows in out.items()}


def pack(
    docs: DataFrame,
    path: str,
    longest: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and ``offset``: the place of every piece.

    Null and empty texts are one piece that holds ``end_id`` alone. Repeated rows and null ids are packed like any
    others, each row once. Special tokens' strings in a text are ordinary text. Other columns are not read; an empty
    table gives no rows. Pieces are written once before they are counted, so that counts and places agree whatever
    is recomputed.
    """
    found = written(pieces(docs, path, longest, end_id, id_col, text_col), "pieces")
    spread = found.withColumn("part", F.pmod(F.xxhash64("id", "piece", "crc"), F.lit(1024)))
    counts = spread.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = written(counts, "counts")
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    slots = _slots(plan(histogram, longest))
    shared = docs.sparkSession.sparkContext.broadcast(slots)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "part").orderBy("id", "piece", "start", "crc")
    ranked = spread.withColumn("rank", F.row_number().over(own) - 1).join(base, ["length", "part"])
    ranked = ranked.select("id", "piece", "start", "length", "crc", (F.col("rank") + F.col("base")).alias("rank"))

    def place(batches):
        by_length = shared.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = np.zeros((2, len(rank)), np.int64)
            for v in np.unique(length):
                own, rows = length == v, by_length[int(v)]
                slot = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1]
                sequence[own], offset[own] = slot[:, 1] + rank[own] - slot[:, 0], slot[:, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    layout = "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.withColumn("length", F.col("length").cast("long")).mapInArrow(place, layout)

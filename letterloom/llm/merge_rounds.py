"""Byte-level BPE by batched merge rounds: many words are merged at once in one flat array of symbols.

Each round looks up the pairs of neighbouring symbols of all unfinished words by binary search among the sorted pair keys
of the vocabulary, takes every word's pair of lowest rank, and merges all its places at once. Words without a known pair
are done and leave the array, so that a round costs in proportion to what is still open. Texts are cut into pre-tokens by
array operations; only words that a worker does not remember are merged.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernels import gathered, groups_of, text_blocks
from .pretokens import Pretokens

#: Bytes that are cut into pre-tokens at once; words that a worker remembers.
BLOCK, REMEMBERED = 1 << 18, 1 << 17
_NEVER = np.int64(1) << 62


def _letters() -> dict[int, str]:
    """The visible character by which a byte is written in vocabulary files of this kind."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Merges:
    """The vocabulary of one file: symbols of bytes, and sorted keys of pairs with their ranks and what they become."""

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        self.base = max(vocab.values()) + 1
        self.symbol = np.array([vocab[c] for _, c in sorted(_letters().items())], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left, right, into = (np.array(x, np.int64).reshape(-1) for x in zip(*[(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])) if pairs else (np.empty(0, np.int64),) * 3
        key = left * self.base + right
        last = len(key) - 1 - np.unique(key[::-1], return_index=True)[1]  # of a pair listed twice the later rank holds
        self.key, self.rank, self.into = key[last], last, into[last]
        made = np.full(self.base, -1, np.int64)
        np.maximum.at(made, self.into, self.rank)
        # A merged symbol takes part in later merges only: then all places of a pair can be merged in one round.
        self.all_at_once = bool((made[self.key // self.base] < self.rank).all() and (made[self.key % self.base] < self.rank).all())

    def _pairs(self, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each symbol and the next of its word: the rank, and where the pair's key stands."""
        rank = np.full(len(flat), _NEVER)
        at = np.zeros(len(flat), np.int64)
        inner = np.ones(len(flat), bool)
        inner[np.cumsum(size) - 1] = False
        inner = np.flatnonzero(inner)
        if len(inner) and len(self.key):
            wanted = flat[inner] * self.base + flat[inner + 1]
            found = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            hit = self.key[found] == wanted
            rank[inner[hit]], at[inner[hit]] = self.rank[found[hit]], found[hit]
        return rank, at

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each word has. Rounds are as many as a word has different merges;
        an empty word has no ids."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat = self.symbol[np.frombuffer(b"".join(words), np.uint8)]
        left = np.flatnonzero(size)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count, size = np.zeros(len(words), np.int64), size[left]
        while len(left):
            start = np.cumsum(size) - size
            rank, at = self._pairs(flat, size)
            best = np.minimum.reduceat(rank, start)
            over = best == _NEVER
            if over.any():
                closed = np.flatnonzero(over)
                done.append((left[closed], size[closed], gathered(flat, start[closed], size[closed])))
                kept = np.flatnonzero(~over)
                symbols = np.repeat(~over, size)
                flat, rank, at = flat[symbols], rank[symbols], at[symbols]
                left, size, best = left[kept], size[kept], best[kept]
                if not len(left):
                    break
                start = np.cumsum(size) - size
            word = np.repeat(np.arange(len(size)), size)
            place = np.flatnonzero(rank == best[word])
            if self.all_at_once:
                # Places that follow each other overlap (a pair of equal symbols): from the left, every second one.
                fresh = np.append(True, np.diff(place) != 1)
                first = place[np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))]
                place = place[(place - first) % 2 == 0]
            else:
                place = place[np.append(True, np.diff(word[place]) != 0)]
            flat[place] = self.into[at[place]]
            stays = np.ones(len(flat), bool)
            stays[place + 1] = False
            flat = flat[stays]
            size = size - np.bincount(word[place], minlength=len(size))
        for number, n, _ in done:
            count[number] = n
        out, begin = np.empty(count.sum(), np.int64), np.cumsum(count) - count
        for number, n, ids in done:
            before = np.cumsum(n) - n
            out[np.repeat(begin[number] - before, n) + np.arange(len(ids))] = ids
        return out, count


class Vocabulary:
    """A tokenizer file: its merges, its special tokens and the bytes of each id."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as lines:
            told = json.load(lines)
        model, before = told["model"], told["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        odd = [model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
        added = told["added_tokens"]
        if not plain or told["normalizer"] or any(odd) or any(t[k] for t in added for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"{path} is no byte-level BPE of the plain kind")
        self.merges = Merges(model["vocab"], model["merges"])
        self.special = {t["content"]: t["id"] for t in added}
        by_length = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, by_length)) + ")") if by_length else None
        byte_of = {c: b for b, c in _letters().items()}
        tokens = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        table = [b""] * (max(tokens) + 1)
        for i, token in tokens.items():
            table[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.bytes, self.first = np.frombuffer(b"".join(table), np.uint8), np.cumsum([0, *map(len, table)])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``; ids outside the vocabulary are passed over, bytes that are no UTF-8 become U+FFFD."""
        ids = ids[(ids >= 0) & (ids < len(self.first) - 1)].astype(np.int64)
        return gathered(self.bytes, self.first[ids], self.first[ids + 1] - self.first[ids]).tobytes().decode("utf-8", "replace")


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Words:
    """Ids of the words that this worker has seen; forgotten when there are too many, which costs time only."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.start, self.size, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end and how many each text has."""
        cut = Pretokens(texts)
        at, like = cut.distinct()
        if len(self.place) > REMEMBERED:
            self.clear()
        words = [cut.word(i) for i in at.tolist()]
        new = [w for w in words if w not in self.place]
        if new:
            flat, size = self.merges.encode([w.encode("utf-8", "surrogatepass") for w in new])
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        place = np.array([self.place[w] for w in words], np.int64)[like]
        sizes = self.size[place]
        return gathered(self.flat, self.start[place], sizes), np.diff(np.concatenate([[0], np.cumsum(sizes)])[cut.first])


_workers: dict[str, _Words] = {}


def _encoded_texts(found: Vocabulary, words: _Words, texts: list[str], special: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end and how many each has; special tokens' strings part the texts and are one id each."""
    if not (special and found.cut and any(found.cut.search(t) for t in texts)):
        return words.ids(texts)
    pieces = [found.cut.split(t) for t in texts]  # every second piece is a special token
    ids, n = words.ids([p for parts in pieces for p in parts[::2]])
    plain = iter(np.split(ids, np.cumsum(n)[:-1]))
    each = []
    for parts in pieces:
        own = [next(plain)]
        for name in parts[1::2]:
            own += [np.array([found.special[name]], np.int32), next(plain)]
        each.append(np.concatenate(own))
    return np.concatenate(each), np.array([len(x) for x in each], np.int64)


def encode(docs: DataFrame, path: str, special: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``ids`` (array of int) of every row of ``docs`` by the tokenizer file ``path``.

    Nothing is added to a text. With ``special``, as the tokenizers library does unless told otherwise, the string of a
    special token in a text is that token and parts the text; without, it is ordinary text. Null and empty texts have no
    ids. A null or repeated id is kept, one row per row. Other columns are not read; an empty table gives no rows.
    Nothing is shuffled, and a task holds one block of texts, or one longer text, and the words it remembers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = vocabulary(path)
        words = _workers.setdefault(path, _Words(found.merges))
        for batch in batches:
            for start, end, texts in text_blocks(batch.column(1), BLOCK):
                ids, n = _encoded_texts(found, words, texts, special)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), lists], ["id", "ids"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (``id``, ``ids``) with ``text``, special tokens included. Null ids give null, no ids an empty text;
    ids that the vocabulary lacks are passed over, as are null ones, and bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = vocabulary(path)
        for batch in batches:
            lists = batch.column(1)
            for start, end in groups_of(np.array([1 + (x or 0) for x in lists.value_lengths().to_pylist()]), BLOCK):
                part = batch.slice(start, end - start)
                texts = [None if x.values is None else found.decode(x.values.fill_null(-1).to_numpy(zero_copy_only=False)) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["id", "ids", "text"])

    return encoded.select("id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "id long, ids array<int>, text string")

"""Spelling variants: words that are one code point apart, found by an index of grams of variable length.

The dictionary holds all grams of ``SHORT`` code points and longer ones, up to ``LONG``, only where the gram without its
last code point is frequent: common beginnings are told apart by longer grams, and rare ones are not cut finer than
they need to be. A word is decomposed into the longest dictionary grams at its positions without those that lie within
an earlier one. For every place where an edit may be, the grams are counted that it can change: those across it, and
those beside it that a longer gram over the changed place could swallow. The largest such count bounds what two words one
edit apart can fail to share, so each word enters only the lists of as many of its rarest grams and one more; lists are
kept by word length and place of the gram. In a list, words that agree on all that is left or on all that is right of
the gram, and on half of the other side, are compared code point by code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import drop, written

#: Code points of the shortest and the longest grams; a gram is frequent from so many words, or from one of so many parts
#: of all grams (which bounds the dictionary whatever the corpus); words of a list that are compared in one task.
SHORT, LONG, FREQUENT, PARTS, LIST = 3, 4, 1000, 20_000, 1 << 13
#: Words up to this length are compared as rows of a matrix, longer ones one by one.
WIDE = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, change=None, letters: str = "[A-Za-zÀ-ÿ]+", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word`` and ``n``: the maximal runs of ``letters`` in all texts, with A-Z lower-cased, and how often they occur.
    ``change`` makes a word of the columns id and run. Null texts have no runs, a null id is null for ``change``."""
    told = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(letters), F.lit(0))).alias("run"))
    told = told.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    return told.groupBy((change(F.col("id"), F.col("run")) if change else F.col("run")).alias("word")).agg(F.count("*").alias("n"))


def gram_dictionary(words: DataFrame, short: int = SHORT, long: int = LONG, frequent: int = FREQUENT, parts: int = PARTS) -> dict[str, int]:
    """The grams and how often they occur. At most ``parts`` grams of a length are frequent enough to be extended, so that
    what is gathered is bounded by the alphabet and the parameters: all shortest grams, and ``parts`` times the alphabet
    of each longer kind."""

    def grams(q: int) -> DataFrame:
        each = F.transform(F.sequence(F.lit(1), F.length("word") - q + 1), lambda i: F.substring(F.col("word"), i, F.lit(q)))
        return words.where(F.length("word") >= q).select(F.explode(each).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))

    level, found = written(grams(short), "grams"), {}
    least = max(frequent, (level.agg(F.sum("n")).first()[0] or 0) // parts)
    for q in range(short, long + 1):
        found |= {r.gram: r.n for r in level.collect()}
        if q == long:
            break
        many = level.where(F.col("n") > least).select(F.col("gram").alias("stem"))
        following = grams(q + 1).withColumn("stem", F.substring("gram", 1, q)).join(many, "stem", "left_semi").select("gram", "n")
        following = written(following, "grams")
        drop(level)
        level = following
    drop(level)
    return found


class Grams:
    """A dictionary made ready for decomposing words."""

    def __init__(self, count: dict[str, int], short: int = SHORT, long: int = LONG) -> None:
        self.count, self.short, self.long = count, short, long
        longer = [g for g in count if len(g) > short]
        self.heads = {g[:k] for g in longer for k in range(short, len(g))}
        self.tails = {g[-k:] for g in longer for k in range(short, len(g))}

    def decompose(self, word: str) -> list[tuple[int, int]]:
        """Start and end of the word's grams, both rising."""
        out, top = [], 0
        for p in range(len(word) - self.short + 1):
            end = p + self.short
            for q in range(min(self.long, len(word) - p), self.short, -1):
                if word[p : p + q] in self.count:
                    end = p + q
                    break
            if end > top:
                out.append((p, end))
                top = end
        return out

    def affected(self, word: str, grams: list[tuple[int, int]]) -> int:
        """The most grams of ``word`` that one inserted, deleted or replaced code point can change."""
        n, m = len(word), len(grams)
        from_start = [m] * (n + 2)  # the first gram that starts at a place or later
        after_end = [m] * (n + 2)  # the first gram that ends later than a place
        for k in range(m - 1, -1, -1):
            p, e = grams[k]
            from_start[p] = k
            after_end[e - 1] = k
        for i in range(n, -1, -1):
            from_start[i] = min(from_start[i], from_start[i + 1])
            after_end[i] = min(after_end[i], after_end[i + 1])
        first, last = [0] * (n + 1), [0] * (n + 2)
        for i in range(n + 1):
            # Left of the edit: grams that a longer one, which begins with word[j:i], may swallow or replace.
            j = next((j for j in range(max(0, i - self.long + 1), i - self.short + 1) if word[j:i] in self.heads), None)
            first[i] = after_end[i] if j is None else min(from_start[j], after_end[i])
            # Right of it: grams within the end word[i:e] of a longer one.
            e = next((e for e in range(min(n, i + self.long - 1), i + self.short - 1, -1) if word[i:e] in self.tails), None)
            last[i] = from_start[i] if e is None else max(from_start[i], after_end[e])
        last[n + 1] = m
        most = 0
        for i in range(n + 1):
            most = max(most, last[i] - first[i])  # inserted: grams that end or start at i are not across the gap
            if i < n:
                most = max(most, last[i + 1] - first[i])
        return most

    def lists(self, word: str) -> list[tuple[int, str, int]]:
        """Level, gram and place of the lists that the word enters: its rarest grams, one more than an edit can change. If
        an edit can change all, the word enters all of its lists, where it meets words that have some to spare, and with
        its shortest grams (level 1; an edit changes ``short`` of these) those of its like."""
        grams = self.decompose(word)
        most = self.affected(word, grams)
        out = self._rarest(word, grams, most + 1, 0)
        if most >= len(grams):
            out += self._rarest(word, [(p, p + self.short) for p in range(len(word) - self.short + 1)], self.short + 1, 1)
        return out

    def _rarest(self, word: str, grams: list[tuple[int, int]], n: int, level: int) -> list[tuple[int, str, int]]:
        told = [(word[p:e], p) for p, e in grams]
        return [(level, g, p) for g, p in sorted(told, key=lambda x: (self.count.get(x[0], 0), *x))[:n]]


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes one word of the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def _entries(dictionary, short: int, long: int):
    names, types = ["word", "n", "level", "gram", "pos"], [pa.string(), pa.int64(), pa.int8(), pa.string(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(dictionary.value, short, long)
        for batch in batches:
            rows = [(w, n, *entry) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for entry in grams.lists(w)]
            for i in range(0, len(rows), 1 << 15):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + (1 << 15)]), types)], names)

    return run


_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Parts:
    """Hashes, modulo 2^64, of how the rows of a matrix of code points begin; equal beginnings have equal hashes."""

    def __init__(self, codes: np.ndarray) -> None:
        power = np.cumprod(np.full(codes.shape[1], _BASE))
        self.sums = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power, axis=1, out=self.sums[:, 1:])

    def upto(self, size: np.ndarray) -> np.ndarray:
        return np.take_along_axis(self.sums, size[:, None], 1)[:, 0]


class _Lists:
    """Whole lists, one after the other: ``kind`` 0 are words of the list's length; 1 and 2 words that are one longer,
    with the gram at the same place (the edit is right of it) or one later (left of it)."""

    def __init__(self, rows: pa.Table, fresh: np.ndarray) -> None:
        take = lambda name: rows.column(name).to_numpy(zero_copy_only=False)
        self.kind, self.length, pos, self.block = (take(c).astype(np.int64) for c in ("kind", "len", "pos", "block"))
        self.within, self.words, self.list = take("first") == take("second"), rows.column("word").to_pylist(), np.cumsum(fresh)
        true_size = self.length + (self.kind > 0)
        self.plain = self.length < WIDE
        wide = int(true_size[self.plain].max(initial=1)) + 1
        shown = np.array([w if ok else "" for w, ok in zip(self.words, self.plain)], f"U{wide}")
        self.codes = shown.view(np.uint32).reshape(len(shown), wide)
        if self.codes.max(initial=0) < 256:
            self.codes = self.codes.astype(np.uint8)
        size = np.where(self.plain, true_size, 0)
        back = np.take_along_axis(self.codes, np.maximum(size[:, None] - 1 - np.arange(wide), 0), 1)
        end = pos + pc.utf8_length(rows.column("gram")).to_numpy().astype(np.int64)
        left, right = pos // 2, end + (self.length - end) // 2
        begins, ends = _Parts(self.codes), _Parts(back)
        head = lambda at: begins.upto(np.where(self.plain, at, 0))
        tail = lambda at: ends.upto(np.where(self.plain, self.length - at, 0))
        # The edit is right of the gram, in the later or earlier half of what is there, or left of it, likewise: what then
        # is the same in both words, before and behind that half.
        self.same = ((1, head(right)), (1, head(end) * _MIX + tail(right)), (2, head(left) * _MIX + tail(pos)), (2, tail(left)))

    def near(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for longer, key in self.same:
            rows = np.flatnonzero((self.kind == 0) | (self.kind == longer))
            if not len(rows):
                continue
            order = rows[np.lexsort((self.kind[rows], key[rows], self.list[rows]))]
            differs = (self.list[order][1:] != self.list[order][:-1]) | (key[order][1:] != key[order][:-1])
            start = np.flatnonzero(np.append(True, differs))
            end = np.repeat(np.append(start[1:], len(order)), np.diff(np.append(start, len(order))))
            at, step = np.flatnonzero(self.kind[order] == 0), 0
            while len(at):
                step += 1
                at = at[at + step < end[at]]
                for i in range(0, len(at), 1 << 16):
                    a, b = order[at[i : i + (1 << 16)]], order[at[i : i + (1 << 16)] + step]
                    met = self.within[a] | (self.block[a] != self.block[b])
                    yield self._confirmed(a[met], b[met])

    def _confirmed(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        differ = self.codes[a] != self.codes[b]
        replaced = (self.kind[b] == 0) & (differ.sum(1) == 1)
        later = self.codes[a][:, :-1] != self.codes[b][:, 1:]
        first = np.where(differ.any(1), differ.argmax(1), differ.shape[1])
        last = np.where(later.any(1), later.shape[1] - 1 - later[:, ::-1].argmax(1), -1)
        good = np.where(self.kind[b] == 0, replaced, last < first)
        for i in np.flatnonzero(~(self.plain[a] & self.plain[b])):
            good[i] = one_edit(self.words[a[i]], self.words[b[i]])
        return a[good], b[good]


def _near_in_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def pairs(rows: pa.Table, fresh: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = [*_Lists(rows, fresh).near()]
        if not found:
            return
        a, b = (np.concatenate(x) for x in zip(*found))
        word = rows.column("word").combine_chunks()
        # Each pair once: the smaller row number of equal pairs stands for all of them.
        code = word.dictionary_encode().indices.to_numpy().astype(np.int64)
        low, high = np.minimum(code[a], code[b]), np.maximum(code[a], code[b])
        one = np.unique(low * (int(code.max(initial=0)) + 1) + high, return_index=True)[1]
        a, b = a[one], b[one]
        less = pc.less(word.take(pa.array(a)), word.take(pa.array(b))).to_numpy(zero_copy_only=False)
        x, y = np.where(less, a, b), np.where(less, b, a)
        n = rows.column("n").combine_chunks()
        columns = [c.take(pa.array(i)) for i in (x, y) for c in (word, n)]
        yield pa.RecordBatch.from_arrays(columns, ["word", "n", "near", "near_n"])

    def fresh(rows: pa.Table) -> np.ndarray:
        out = np.zeros(rows.num_rows, bool)
        out[:1] = True
        for name in ("level", "len", "pos", "first", "second"):
            value = rows.column(name).to_numpy()
            out[1:] |= value[1:] != value[:-1]
        code = rows.column("gram").combine_chunks().dictionary_encode().indices.to_numpy()
        out[1:] |= code[1:] != code[:-1]
        return out

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= 1 << 15:
            rows = pa.Table.from_batches(held)
            new = fresh(rows)
            cut = int(np.flatnonzero(new)[-1])
            if cut:
                yield from pairs(rows.slice(0, cut), new[:cut])
            held = rows.slice(cut).to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        if rows.num_rows:
            yield from pairs(rows, fresh(rows))


def near_words(words: DataFrame, dictionary: dict[str, int], short: int = SHORT, long: int = LONG, most: int = LIST) -> DataFrame:
    """``word``, ``near``, ``near_n``: all ordered pairs of ``words`` (``word``, ``n``; distinct, of at least twice
    ``short`` code points each, else an error) that are one code point apart, with the ``n`` of the second.

    Only confirmed pairs are emitted. A list of over ``most`` entries is dealt out in blocks, and pairs of blocks are
    groups of their own, so that no task compares more than twice ``most`` words with each other.
    """
    told = words.select("word", F.col("n").cast("long").alias("n"))
    fits = F.length("word") >= 2 * short
    told = told.where(F.when(fits, fits).otherwise(F.raise_error(F.lit("words must have at least twice the code points of the shortest grams"))))
    shared = words.sparkSession.sparkContext.broadcast(dictionary)
    entries = told.mapInArrow(_entries(shared, short, long), "word string, n long, level tinyint, gram string, pos int")
    size = F.length("word")
    places = F.array(*(F.struct(F.lit(k).cast("tinyint").alias("kind"), (size - int(k > 0)).alias("len"), (F.col("pos") - int(k == 2)).alias("pos")) for k in (0, 1, 2)))
    entries = entries.withColumn("place", F.explode(places)).select("word", "n", "level", "gram", "place.*").where("pos >= 0")
    entries = written(entries, "entries")
    key = ["len", "level", "gram", "pos"]
    large = written(entries.groupBy(*key).agg(F.count("*").alias("size")).where(F.col("size") > most), "large")
    zero = [F.lit(0).alias(c) for c in ("first", "second", "block")]
    if large.isEmpty():
        dealt = entries.select("*", *zero)
    else:
        blocks = F.ceil(F.col("size") / most).cast("int")
        split = entries.join(large, key).withColumn("block", F.pmod(F.xxhash64("word"), blocks).cast("int"))
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        split = split.select(*entries.columns, F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block")
        dealt = entries.join(large, key, "left_anti").select(*entries.columns, *zero).union(split)
    group = [*key, "first", "second"]
    dealt = dealt.repartition(*group).sortWithinPartitions(*group, "kind")
    found = dealt.mapInArrow(_near_in_lists, "word string, n long, near string, near_n long").distinct()
    both = F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return found.select(F.explode(both).alias("pair")).select("pair.*")


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``: where ``forms`` (``word``, ``form``) lead at last. Each round doubles the steps; a form is
    more frequent than its word by a factor, so that chains end and are short."""
    known = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = written(known.join(ahead, "root", "left").select("word", "root", "next"), "roots")
        moved = not further.where("next IS NOT NULL").isEmpty()
        drop(known)
        known = written(further.select("word", F.coalesce("next", "root").alias("root")), "roots")
        drop(further)
        if not moved:
            return known


def variants(words: DataFrame, times: int = 10, short: int = SHORT, long: int = LONG, frequent: int = FREQUENT, most: int = LIST) -> DataFrame:
    """``words`` (``word``, ``n``; distinct, of at least twice ``short`` code points) with ``form``, ``form_n``, ``root``
    and ``n_near``.

    Words are near if they differ by exactly one inserted, deleted or replaced code point; ``n_near`` counts them. A word's
    ``form`` is its near word of largest ``n`` (ties: the smallest in code-point order) if that is at least ``times``
    (over 1) its own ``n``, else null; ``root`` is where forms lead at last, the word itself without one. Null words
    are left out; no words give no rows. Other columns are not read.
    """
    if times <= 1:
        raise ValueError("a form must be more frequent than its word")
    told = written(words.where("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = near_words(told, gram_dictionary(told, short, long, frequent), short, long, most)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = told.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    enough = F.col("near_n") >= times * F.col("n")
    found = written(found.select("word", "n", "n_near", F.when(enough, F.col("near")).alias("form"), F.when(enough, F.col("near_n")).alias("form_n")), "variants")
    roots = _roots(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def without_one(word: Column, place: Column) -> Column:
    """``word`` without the code point at ``place`` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word)))

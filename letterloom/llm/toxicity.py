"""Toxicity of whole texts: a logistic model of words and word beginnings, regularised by counterfactuals.

Labelled sentences that hold an identity term are written again with another term in its place, both are scored, and the
difference of the two scores is penalised while the model is fitted, so that mentioning a group does not raise a score.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .kernels import U, SpanHash, mix64, parts_of, text_blocks
from .pretokens import LETTER, _tables
from .scratch import drop, written

#: Where labelled texts are cut into sentences, and fixed values: neutral sentences that false positives are counted on.
SENTENCE = r"(?<=[.!?])\s+|\n+"
NEUTRAL = ("I talked to {} yesterday.", "Our street is home to {} of all ages.", "The meeting was opened by {} from the town.", "A film about {} is shown on Sunday.")
#: Hash slots of features, text bytes worked on at once, and lengths of word beginnings.
SLOTS, BLOCK, BEGINNINGS = 1 << 20, 1 << 18, (4, 5, 6, 7, 8)

#: Terms that name groups of people, swapped within their line, and the neutral one of each line.
IDENTITIES = (
    ("people", "men", "women", "christians", "muslims", "jews", "hindus", "atheists", "immigrants", "refugees", "gays", "lesbians"),
    ("person", "man", "woman", "christian", "muslim", "jew", "hindu", "atheist", "immigrant", "refugee", "gay", "lesbian"),
    ("local", "black", "white", "asian", "african", "latino", "arab", "jewish", "transgender", "disabled", "elderly", "deaf", "blind"),
    ("menschen", "männer", "frauen", "christen", "muslime", "juden", "migranten", "ausländer"),
    ("personnes", "hommes", "femmes", "chrétiens", "musulmans", "juifs", "immigrés", "étrangers"),
    ("personas", "hombres", "mujeres", "cristianos", "musulmanes", "judíos", "inmigrantes", "extranjeros"),
)


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and slot of every word and word beginning of lower-cased texts."""
    kinds, values = _tables()
    lower = [t.lower() for t in texts]
    code = np.frombuffer("\0".join(["", *lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = kinds[code] == LETTER
    start = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    end = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
    row = np.searchsorted(np.cumsum([1, *(len(t) + 1 for t in lower)]), start, "right") - 1
    hashes = SpanHash(values[code])
    rows, slots = [row], [hashes(start, end)]
    for n in BEGINNINGS:
        longer = end - start > n
        rows.append(row[longer])
        slots.append(mix64(hashes(start[longer], start[longer] + n) + U(n)))
    return np.concatenate(rows), (np.concatenate(slots) & U(SLOTS - 1)).astype(np.int64)


def _distinct(row: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(row * SLOTS + slot)
    return both // SLOTS, both % SLOTS


_PARTNERS = {term: line for line in IDENTITIES for term in line}
_ANY_TERM = regex.compile(r"\b(?:" + "|".join(sorted(_PARTNERS, key=len, reverse=True)) + r")\b", regex.IGNORECASE)


def swapped(sentence: str) -> list[str]:
    """The sentence with each of its terms replaced by the next of the term's line, and with each replaced by the
    line's neutral term; none without a term."""

    def other(step: bool):
        def put(m):
            line = _PARTNERS[m[0].lower()]
            return line[(line.index(m[0].lower()) + 1) % len(line)] if step else line[0]

        return put

    if not _ANY_TERM.search(sentence):
        return []
    found = [_ANY_TERM.sub(other(step), sentence) for step in (True, False)]
    return [x for x in dict.fromkeys(found) if x.lower() != sentence.lower()]


class Model:
    """Weights of slots and a base; the score of a text is the logistic function of the sum over its distinct slots."""

    def __init__(self, slots: np.ndarray, weights: np.ndarray, base: float) -> None:
        self.weights = np.zeros(SLOTS)
        self.weights[slots] = weights
        self.base = base

    def __getstate__(self):
        slots = np.flatnonzero(self.weights)
        return slots, self.weights[slots], self.base

    def __setstate__(self, state) -> None:
        self.__init__(*state)

    def scores(self, texts: list[str]) -> np.ndarray:
        row, slot = _features(texts)
        used = self.weights[slot] != 0
        row, slot = _distinct(row[used], slot[used])
        total = self.base + np.bincount(row, self.weights[slot], len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class _Design:
    """Rows of features that are 0 or 1, as lists of columns."""

    def __init__(self, lists: pa.Array) -> None:
        self.column = lists.flatten().to_numpy()
        self.n = len(lists)
        self.row = np.repeat(np.arange(self.n), np.diff(lists.offsets.to_numpy()))

    def totals(self, w: np.ndarray, base: float) -> np.ndarray:
        return base + np.bincount(self.row, w[self.column], self.n)

    def gradient(self, by_row: np.ndarray, columns: int) -> np.ndarray:
        return np.bincount(self.column, by_row[self.row], columns)


def _fit(rows: _Design, label, weight, told: _Design, swap: _Design, columns, ridge: float, counterfactual: float, rounds: int = 300):
    """Logistic regression by accelerated gradient steps. To the loss comes ``counterfactual`` times the mean squared
    difference of scores between the sentences ``told`` and the same sentences as ``swap`` has them."""
    w, base, speed_w, speed_b = np.zeros(columns), -2.0, np.zeros(columns), 0.0
    square_w, square_b = np.zeros(columns), 0.0
    total = weight.sum()
    for t in range(1, rounds + 1):
        gap = weight * (_sigmoid(rows.totals(w, base)) - label) / total
        grad, grad_b = rows.gradient(gap, columns) + ridge * w, gap.sum()
        if told.n:
            p, q = _sigmoid(told.totals(w, base)), _sigmoid(swap.totals(w, base))
            change = 2 * counterfactual * (p - q) / told.n
            up, down = change * p * (1 - p), change * q * (1 - q)
            grad += told.gradient(up, columns) - swap.gradient(down, columns)
            grad_b += up.sum() - down.sum()
        step = 0.3 / (1 + 5 * t / rounds)
        speed_w, speed_b = 0.9 * speed_w + 0.1 * grad, 0.9 * speed_b + 0.1 * grad_b
        square_w, square_b = 0.99 * square_w + 0.01 * grad**2, 0.99 * square_b + 0.01 * grad_b**2
        fix = (1 - 0.99**t) ** 0.5 / (1 - 0.9**t)
        w = w - step * fix * speed_w / (np.sqrt(square_w) + 1e-6)
        base -= step * fix * speed_b / (square_b**0.5 + 1e-6)
    return w, base


def neutral_false_positives(model: Model, least: float = 0.7) -> float:
    """The share of neutral sentences about each group (``NEUTRAL`` with every term) that score ``least`` or more."""
    return float((model.scores([n.format(t) for n in NEUTRAL for t in _PARTNERS]) >= least).mean())


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_class: int = 6000,
    features: int = 4096,
    pairs: int = 20000,
    ridge: float = 1e-4,
    counterfactual: float = 2.0,
) -> Model:
    """Fit the model on at most ``per_class`` labelled documents of either class (by hash of the id; both classes
    weigh alike) and at most ``features`` slots, those that tell the classes apart best in these documents. At most
    ``pairs`` of their sentences with an identity term (by hash) are compared with their swapped forms.

    Rows whose id or label is null are no examples; an id that is labelled twice has the larger label,
    and one with several texts the first of them in order. If a class has
    no example, the model scores every text with the share of toxic examples, 0 without any.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.where("id is not null and label is not null").groupBy("id").agg((F.max("label") > 0).cast("int").alias("label"))
    shares = {int(k): int(n) for k, n in known.groupBy("label").count().collect()}
    if len(shares) < 2:
        rate = np.clip(shares.get(1, 0) / max(1, sum(shares.values())), 1e-9, 1 - 1e-9)
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log(rate / (1 - rate))))
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text")).select("label", "text")
    sample = written(sample, "examples")

    def counted(batches):
        found = np.zeros((2, SLOTS), np.int32)
        for batch in batches:
            for part in parts_of(batch, 1, BLOCK):
                label = part.column(0).to_numpy()
                row, slot = _distinct(*_features(part.column(1).to_pylist()))
                np.add.at(found, (label[row], slot), 1)
        slots = np.flatnonzero(found.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(found[0, slots].astype(np.int64)), pa.array(found[1, slots].astype(np.int64))], ["slot", "clean", "toxic"])

    counts = sample.mapInArrow(counted, "slot long, clean long, toxic long").groupBy("slot").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    n = {int(k): int(v) for k, v in sample.groupBy("label").count().collect()}
    m, k = n.get(0, 0), n.get(1, 0)
    gap = F.col("t") * m - F.col("c") * k
    spread = (F.col("t") + F.col("c")) * (m + k - F.col("t") - F.col("c")) + F.lit(1.0)
    best = counts.where("t + c >= 3").orderBy(F.desc(gap.cast("double") * gap / spread), "slot").limit(features)
    slots = {int(r[0]) for r in best.select("slot").collect()}
    slots = np.array(sorted(slots.union(*(np.unique(_features([t])[1]).tolist() for t in _PARTNERS))), np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(slots)

    def columns_of(texts: list[str]) -> pa.Array:
        row, slot = _distinct(*_features(texts))
        at = np.minimum(np.searchsorted(shared.value, slot), len(shared.value) - 1)
        hit = shared.value[at] == slot
        ends = np.searchsorted(row[hit], np.arange(len(texts) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(ends, at[hit].astype(np.int32))

    def designed(batches):
        cut = regex.compile(SENTENCE).split
        for batch in batches:
            for part in parts_of(batch, 1, BLOCK):
                texts = part.column(1).to_pylist()
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), columns_of(texts), pa.nulls(n, kind), pa.nulls(n, pa.int64())], names)
                both = [(x, y) for t in texts if _ANY_TERM.search(t) for x in cut(t) for y in swapped(x)]
                if both:
                    key = [int.from_bytes(hashlib.blake2b(f"{x}|{y}".encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big") for x, y in both]
                    a, b = (columns_of(list(side)) for side in zip(*both))
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(key), pa.int32()), a, b, pa.array(key, pa.int64())], names)

    kind, names = pa.list_(pa.int32()), ["label", "columns", "swap", "key"]
    design = written(sample.mapInArrow(designed, "label int, columns array<int>, swap array<int>, key long"), "design")
    rows = design.where("key is null").select("label", "columns").toArrow().combine_chunks()
    told = design.where("key is not null").orderBy("key").limit(pairs).select("columns", "swap").toArrow().combine_chunks()
    lists = lambda t, c: _Design(t.column(c).combine_chunks() if t.num_rows else pa.array([], kind))
    label = rows.column("label").to_numpy().astype(float)
    weight = np.where(label > 0, 1 / max(1, k), 1 / max(1, m))
    w, base = _fit(lists(rows, "columns"), label, weight, lists(told, "columns"), lists(told, "swap"), len(slots), ridge, counterfactual)
    drop(design)
    drop(sample)
    return Model(slots, w, base)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` and then ``out_col`` (0 to 1) of every whole text; null and empty texts, and null or
    repeated ids, are scored like any others. A column that has that name already is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != out_col]
    rows = docs.select(*kept, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(out_col))
    schema = docs.select(*kept).schema.add(out_col, "double")

    def run(batches):
        model = shared.value
        at = len(kept)
        for batch in batches:
            values = np.empty(batch.num_rows)
            for start, end, texts in text_blocks(batch.column(at), BLOCK):
                values[start:end] = model.scores(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(values)], batch.schema.names)

    return rows.mapInArrow(run, schema)


def is_held_out(id_col: str):
    """Whether a document's label is never learnt from: crc32 of the id as text has remainder 1 by 3. Rows without id
    are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(True))

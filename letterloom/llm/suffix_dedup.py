"""Removal of repeated passages with a sparse suffix array: sampled splitters range-partition suffixes by leading
bytes, buckets sort locally by multikey quicksort, and neighbours are compared, across bucket boundaries too.

All suffixes of a large corpus are many times its size. Here suffixes start at *anchors*: for a window of ``least``
bytes the anchor is the first of the smallest hashes among the ``core``-byte strings in its first part. Equal windows
have their anchors at the same place, so windows are compared only where anchors agree:

* suffixes are ordered by the ``core`` bytes at their anchor, eight bytes a token, and then by the digest (128 bits of
  SHA-256) of their *span*, all bytes of the windows (a run of consecutive starts) that share the anchor;
* a span with an equal neighbour in that order is repeated in full, which settles the inside of repeated passages;
* where only the leading bytes are shared, at the ends of passages, the windows of the spans are compared one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .kernels import U, SpanHash, as_bytes, byte_values, firsts, mix64, parts_of
from .scratch import drop, written
from .sieve import sieve_of, sifted

#: Text bytes worked on at once; rows of a bucket; spans of one core in a block.
BLOCK, BUCKET_ROWS, TOGETHER = 1 << 18, 1 << 17, 2000
_NO_ID = -(1 << 63)
_LOW = U((1 << 24) - 1)


def _anchored(texts: list[bytes], least: int, core: int) -> tuple[np.ndarray, ...]:
    """Row, first start, number of starts and distance to the anchor of every anchor's windows, the core bytes as rows of
    a matrix, and the digests of the spans."""
    joined = b"".join(texts)
    n, width = len(joined), least - core + 1
    nothing = *(np.empty(0, np.int64) for _ in range(4)), np.empty((0, core), np.uint8), []
    if n < least:
        return nothing
    data = np.frombuffer(joined, np.uint8)
    hashes = SpanHash(byte_values(data))
    at = np.arange(n - core + 1)
    ranked = mix64(hashes.lane(at, at + core))
    out, step = [], 1 << 23
    offsets = np.cumsum([0, *map(len, texts)])
    for low in range(0, len(ranked) - width + 1, step):
        part = ranked[low : low + step + width - 1]
        part = (part & ~_LOW) | np.arange(len(part), dtype=U)
        windows = len(part) - width + 1
        padded = np.full(-(-len(part) // width) * width, ~U(0))
        padded[: len(part)] = part
        grid = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        anchor = (np.minimum(back[:windows], ahead[width - 1 : width - 1 + windows]) & _LOW).astype(np.int64) + low
        start = np.arange(low, low + windows)
        row = np.searchsorted(offsets, start, "right") - 1
        inside = start + least <= offsets[row + 1]
        start, anchor, row = start[inside], anchor[inside], row[inside]
        if not len(start):
            continue
        cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(row) != 0)) + 1
        first = np.concatenate([[0], cut])
        count = np.diff(np.append(first, len(start)))
        begin, anchor, row = start[first], anchor[first], row[first]
        out.append((row, begin - offsets[row], count, anchor - begin, anchor, begin))
    if not out:
        return nothing
    row, start, count, ahead, anchor, begin = (np.concatenate(x) for x in zip(*out))
    lead = np.lib.stride_tricks.sliding_window_view(data, core)[anchor]
    ends = begin + count - 1 + least
    sha = hashlib.sha256
    span = [sha(b"%d " % k + joined[a:b]).digest()[:16] for k, a, b in zip(ahead.tolist(), begin.tolist(), ends.tolist())]
    return row, start, count, ahead, lead, span


def _texts(docs: DataFrame, id_col: str, text_col: str, others: list[str] = ()) -> DataFrame:
    """``id`` and ``h`` name a row by its id and text; rows that share both are cut alike. The columns ``others`` follow,
    under names that do not clash."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"),
        *(F.col(c).alias(f"other{i}") for i, c in enumerate(others)),
    )


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix of bytes as an Arrow column."""
    n, width = rows.shape
    ends = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _suffixes(texts: DataFrame, least: int, core: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in parts_of(batch, 2, BLOCK):
                ids, hs = (part.column(i).to_numpy() for i in (0, 1))
                row, start, count, ahead, lead, span = _anchored(as_bytes(part.column(2)), least, core)
                numbers = [ids[row], hs[row], start.astype(np.int32), count.astype(np.int32), ahead.astype(np.int32)]
                for i in range(0, len(row), 1 << 14):
                    own = slice(i, i + (1 << 14))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c[own]) for c in numbers), _binary(lead[own]), pa.array(span[own], pa.binary())], ["id", "h", "start", "n", "ahead", "lead", "span"])

    return texts.mapInArrow(run, "id long, h long, start int, n int, ahead int, lead binary, span binary")


def multikey_order(words: list[np.ndarray]) -> np.ndarray:
    """The order of rows by ``words``, most significant first, as multikey quicksort finds it: by the leading word,
    then every range of ties by the next, all ranges of a level at once."""
    order = np.argsort(words[0], kind="stable")
    value = words[0][order]
    group = np.cumsum(np.concatenate([[0], value[1:] != value[:-1]]))[: len(order)]
    at = np.arange(len(order))
    for word in words[1:]:
        tied = np.bincount(group)[group] > 1 if len(group) else np.empty(0, bool)
        at, group = at[tied], group[tied]
        if not len(at):
            break
        part = order[at]
        part = part[np.lexsort((word[part], group))]
        order[at], value = part, word[part]
        group = np.cumsum(np.concatenate([[0], (value[1:] != value[:-1]) | (group[1:] != group[:-1])]))
    return order


def _words(column: pa.Array) -> list[np.ndarray]:
    """A column of binaries of one length as numbers of eight bytes, the first the most significant, zeros behind."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    width = int(ends[1] - ends[0])
    padded = np.zeros((len(column), -(-width // 8) * 8), np.uint8)
    padded[:, :width] = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, width)
    return list(np.ascontiguousarray(padded.view(">u8").T).astype(U))


def _bytes_at(words: list[np.ndarray], row: int, width: int) -> bytes:
    return np.array([w[row] for w in words], ">u8").tobytes()[:width]


def _changes(words: list[np.ndarray]) -> np.ndarray:
    """Whether each row differs from the one before; the first does."""
    out = np.ones(len(words[0]), bool)
    out[1:] = False
    for w in words:
        out[1:] |= w[1:] != w[:-1]
    return out


_FLAGGED = (
    "id long, h long, start int, n int, ahead int, core long, repeated boolean, first boolean, spans long, "
    "bucket int, side int, at_low boolean, at_high boolean, lead binary, low binary, high binary"
)
_FLAGGED_NAMES = [x.split()[0] for x in _FLAGGED.split(", ")]


def _compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one bucket whose leading bytes have an equal neighbour, or could have one in another bucket; then, of
    its first and last leading bytes (side 0 and 1; only 0 if they are the same), the bytes, the first and last span, and
    how many spans they have here."""
    numbers, words, width = [], [], 0
    for batch in batches:
        if batch.num_rows:
            numbers.append([c.to_numpy().copy() for c in batch.columns[:5]])
            words.append([*_words(batch.column(5)), *_words(batch.column(6))])
            width = len(batch.column(5)[0].as_py())
    if not words:
        return
    numbers, words = ([np.concatenate(x) for x in zip(*parts)] for parts in (numbers, words))
    order = multikey_order(words)
    for columns in (numbers, words):
        for i, c in enumerate(columns):
            columns[i] = c[order]
    n = len(order)
    lead, span = words[:-2], words[-2:]
    new_lead = _changes(lead)
    new_span = new_lead | _changes(span)
    group, kind = np.cumsum(new_lead) - 1, np.cumsum(new_span) - 1
    spans = np.bincount(group[new_span])
    core = np.zeros(n, U)
    for w in lead:
        core = mix64(core * U(3) + w)
    last = group[-1]
    side = np.where(group == 0, 0, np.where(group == last, 1, -1)).astype(np.int32)
    bucket = TaskContext.get().partitionId()
    low = {0: 0, 1: int(np.searchsorted(group, last))}
    high = {0: int(np.searchsorted(group, 0, "right")) - 1, 1: n - 1}
    at_low, at_high = (np.isin(kind, [kind[k] for k in ends.values()]) for ends in (low, high))
    keep = (np.bincount(group)[group] > 1) | (side >= 0)
    repeated = np.bincount(kind)[kind] > 1
    side[repeated & ~new_span] = -1  # settled here, whatever other buckets hold
    kept_side = pa.array(side[keep], mask=side[keep] < 0)
    columns = [*(c[keep] for c in numbers), core[keep].view(np.int64), repeated[keep], new_span[keep], spans[group][keep].astype(np.int64)]
    m = int(keep.sum())
    columns = [*map(pa.array, columns), pa.array(np.full(m, bucket, np.int32)), kept_side, pa.array(at_low[keep]), pa.array(at_high[keep]), *(pa.nulls(m, pa.binary()) for _ in range(3))]
    rows = pa.Table.from_arrays(columns, _FLAGGED_NAMES)
    yield from rows.to_batches(max_chunksize=1 << 16)
    ends = [{"bucket": bucket, "side": k, "spans": int(spans[group[low[k]]]), "lead": _bytes_at(lead, low[k], width), "low": _bytes_at(span, low[k], 16), "high": _bytes_at(span, high[k], 16)} for k in (range(2) if last else range(1))]
    yield pa.RecordBatch.from_pylist(ends, rows.schema)


def _settled(flagged: DataFrame) -> DataFrame:
    """``flagged`` with what other buckets add. Buckets that share leading bytes follow each other; only their two
    summaries are compared, and each bucket's own rows learn the outcome by bucket and side."""
    ends = flagged.where("lead is not null").select("bucket", "side", "spans", "lead", "low", "high")
    along, whole = Window.partitionBy("lead").orderBy("bucket"), Window.partitionBy("lead")
    ends = ends.withColumn("before", F.lag("high").over(along)).withColumn("after", F.lead("low").over(along))
    ends = ends.select(
        "bucket", "side", "lead", "spans", F.count("*").over(whole).alias("buckets"),
        F.coalesce(F.col("before") == F.col("low"), F.lit(False)).alias("goes_on"),
        F.coalesce(F.col("after") == F.col("high"), F.lit(False)).alias("goes_over"),
    )
    ends = ends.withColumn("total", F.sum(F.col("spans") - F.col("goes_on").cast("int")).over(whole))
    ends = ends.where("buckets > 1").select("bucket", "side", "goes_on", "goes_over", "total")
    rows = flagged.where("lead is null").select(*_FLAGGED_NAMES[:13])
    names = _FLAGGED_NAMES[:9]
    at_end = rows.where("side is not null").join(ends, ["bucket", "side"], "left")
    on, over = (F.coalesce(F.col(a) & F.col(b), F.lit(False)) for a, b in (("goes_on", "at_low"), ("goes_over", "at_high")))
    at_end = at_end.withColumn("repeated", F.col("repeated") | on | over).withColumn("first", F.col("first") & ~on)
    at_end = at_end.withColumn("spans", F.coalesce("total", "spans")).select(*names)
    return rows.where("side is null").select(*names).union(at_end).where("repeated or spans > 1")


def _window_hashes(joined: bytes, start: np.ndarray, place: np.ndarray, least: int, again: bool = False) -> np.ndarray:
    """Hashes of windows and their place before the anchor; ``again`` gives others, that are independent of the first."""
    values = byte_values(np.frombuffer(joined, np.uint8))
    hashes = SpanHash(mix64(values) if again else values)(start, start + least)
    return mix64(hashes + place.astype(U) * U(0x9FB21C651E98DF25))


def _equal_windows(joined: bytes, start: np.ndarray, place: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The first window of each kind of equal ones, and the kind of every window. Hashes propose, bytes decide."""
    first, kind = firsts(_window_hashes(joined, start, place, least))
    shift = start[first[kind]] - start
    other = np.flatnonzero(shift)
    cut = np.flatnonzero((np.diff(start[other]) != 1) | (np.diff(shift[other]) != 0)) + 1
    for low, high in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(other)]])):
        if low < high:
            a, b, by = int(start[other[low]]), int(start[other[high - 1]]) + least, int(shift[other[low]])
            if joined[a:b] != joined[a + by : b + by]:
                break
    else:
        return first, kind
    number: dict[tuple, int] = {}
    kind = np.array([number.setdefault((joined[a : a + least], p), len(number)) for a, p in zip(start.tolist(), place.tolist())], np.int64)
    return np.unique(kind, return_index=True)[1], kind


def _runs(hit: np.ndarray, which: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of hits within a span: the span, the first step and the last."""
    apart = which[1:] != which[:-1]
    starts = np.flatnonzero(hit & np.concatenate([[True], ~hit[:-1] | apart]))
    ends = np.flatnonzero(hit & np.concatenate([~hit[1:] | apart, [True]]))
    base = (np.cumsum(n) - n)[which[starts]]
    return which[starts], starts - base, ends - base


_OPEN = np.dtype([("w", "<u8"), ("v", "<u8"), ("id", "<i8"), ("h", "<i8"), ("a", "<i4"), ("known", "?")])


def _settle(rows: list[tuple], least: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Intervals of the windows that spans of ``rows`` share with each other; and, for spans whose core other blocks hold
    too, every other window once, packed by bucket of its hash."""
    ids, hs, start, n, ahead, data, large = zip(*rows)
    ids, hs, start, n, large = np.array(ids, np.int64), np.array(hs, np.int64), np.array(start), np.array(n), np.array(large)
    joined, base = b"".join(data), np.cumsum(n) - n
    which = np.repeat(np.arange(len(n)), n)
    step = np.arange(n.sum()) - base[which]
    begin, place = np.cumsum([0, *map(len, data)])[:-1][which] + step, np.array(ahead)[which] - step
    first, kind = _equal_windows(joined, begin, place, least)
    shared = np.bincount(kind)[kind] > 1
    span, low, high = _runs(shared, which, n)
    none = pa.nulls(len(span), pa.int32()), pa.nulls(len(span), pa.binary())
    found = [ids[span], hs[span], (start[span] + low).astype(np.int32), (start[span] + high + least).astype(np.int32)]
    yield pa.RecordBatch.from_arrays([*map(pa.array, found), *none], _WINDOW_NAMES)
    if large.any():
        first = first[large[which[first]]]
        left = np.empty(len(first), _OPEN)
        left["w"], left["v"] = (_window_hashes(joined, begin[first], place[first], least, again) for again in (False, True))
        left["id"], left["h"] = ids[which[first]], hs[which[first]]
        left["a"], left["known"] = start[which[first]] + step[first], shared[first]
        bucket = (left["w"] % U(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.diff(bucket[order])) + 1
        parts = [x for x in np.split(order, cut) if len(x)]
        gaps = [pa.nulls(len(parts), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]
        packed = pa.array([left[x].tobytes() for x in parts], pa.binary())
        yield pa.RecordBatch.from_arrays([*gaps, pa.array([int(bucket[x[0]]) for x in parts], pa.int32()), packed], _WINDOW_NAMES)


_WINDOW_NAMES = ["id", "h", "a", "b", "bucket", "packed"]


def _compared(contexts: DataFrame, least: int) -> DataFrame:
    """Intervals of the windows that two spans share.

    Spans of one core meet in blocks of about ``TOGETHER``, most cores in one, and a block settles what its own spans
    share, byte by byte. Of a core that many different spans share, the windows that a block holds, each once, then meet
    those of other blocks by two independent hashes; packed, so that they are few rows, and bounded by distinct windows,
    not by copies.
    """
    total = contexts.where(f"spans > {TOGETHER}").agg(F.sum("n")).first()[0] or 0
    buckets = max(1, total >> 19)

    def run(batches):
        held, size, block = [], 0, None
        for batch in batches:
            for key, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if key != block and size > BLOCK:
                    yield from _settle(held, least, buckets)
                    held, size = [], 0
                block = key
                held.append(row)
                size += len(row[5])
        if held:
            yield from _settle(held, least, buckets)

    salt = F.pmod(F.xxhash64("id", "h", "start"), F.ceil(F.col("spans") / TOGETHER))
    dealt = contexts.select(
        F.xxhash64("core", salt).alias("block"), "id", "h", "start", "n", "ahead", "context", (F.col("spans") > TOGETHER).alias("large")
    )
    dealt = dealt.repartition("block").sortWithinPartitions("block")
    found = written(dealt.mapInArrow(run, "id long, h long, a int, b int, bucket int, packed binary"), "windows")

    def meet(batches):
        held, bucket = [], None
        for batch in batches:
            for key, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if key != bucket and held:
                    yield repeated(held)
                    held = []
                bucket = key
                held.append(np.frombuffer(packed, _OPEN))
        if held:
            yield repeated(held)

    def repeated(parts):
        rows = np.concatenate(parts)
        rows = rows[np.lexsort((rows["v"], rows["w"]))]
        same = (rows["w"][1:] == rows["w"][:-1]) & (rows["v"][1:] == rows["v"][:-1])
        rows = rows[(np.append(same, False) | np.append(False, same)) & ~rows["known"]]
        return pa.RecordBatch.from_arrays([pa.array(rows["id"].copy()), pa.array(rows["h"].copy()), pa.array(rows["a"].copy()), pa.array((rows["a"] + least).astype(np.int32))], ["id", "h", "a", "b"])

    apart = found.where("bucket is not null").select("bucket", "packed").repartition("bucket").sortWithinPartitions("bucket")
    return found.where("bucket is null").select("id", "h", "a", "b").union(apart.mapInArrow(meet, "id long, h long, a int, b int"))


def _contexts(texts: DataFrame, spans: DataFrame, least: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in parts_of(batch, 2, BLOCK):
                out = []
                for i, h, data, held in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), as_bytes(part.column(2)), part.column(3).to_pylist()):
                    for s in held:
                        out.append((i, h, s["start"], s["n"], s["ahead"], s["core"], data[s["start"] : s["start"] + s["n"] - 1 + least], s["spans"]))
                if out:
                    yield batch_of(out)

    def batch_of(rows):
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], ["id", "h", "start", "n", "ahead", "core", "context", "spans"])

    per_text = spans.groupBy("id", "h").agg(F.collect_set(F.struct("start", "n", "ahead", "core", "spans")).alias("held"))
    return texts.join(per_text, ["id", "h"]).dropDuplicates(["id", "h"]).select("id", "h", "text", "held").mapInArrow(run, "id long, h long, start int, n int, ahead int, core long, context binary, spans long")


_RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_text string"


def _remaining(data: bytes, held: list[dict]) -> tuple[bytes, int]:
    """``data`` without the intervals, and the number of maximal runs that were removed."""
    merged: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in held):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    parts, at = [], 0
    for a, b in merged:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]]), len(merged)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in parts_of(whole, 2, BLOCK)):
        out = []
        for i, data, held in zip(batch.column(0).to_pylist(), as_bytes(batch.column(2)), batch.column(3).to_pylist()):
            kept, spans = _remaining(data, held or [])
            out.append((None if i == _NO_ID else i, len(data), len(data) - len(kept), spans, kept, kept.decode("utf-8", "ignore")))
        if out:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], [x.split()[0] for x in _RESULT.split(", ")])


def repeated_spans(texts: DataFrame, least: int, core: int) -> DataFrame:
    """``id``, ``h``, ``a``, ``b``: byte intervals that together cover every window of ``least`` bytes that also starts
    elsewhere."""
    suffixes = written(_suffixes(texts, least, core), "suffixes")
    buckets = max(1, -(-suffixes.count() // BUCKET_ROWS))
    ordered = suffixes.repartitionByRange(buckets, "lead", "span", "id", "start")
    flagged = written(ordered.mapInArrow(_compare_neighbours, _FLAGGED), "flagged")
    drop(suffixes)
    settled = written(_settled(flagged), "settled")
    drop(flagged)
    full = settled.where("repeated").select("id", "h", F.col("start").alias("a"), (F.col("start") + F.col("n") - 1 + least).alias("b"))
    open_spans = settled.where("spans > 1 and (not repeated or first)").select("id", "h", "start", "n", "ahead", "core", "spans")
    found = sifted(texts, sieve_of(open_spans, "id", "h"), "id", "h")
    contexts = written(_contexts(found, open_spans, least), "contexts")
    out = written(full.union(_compared(contexts, least)), "spans")
    drop(settled)
    drop(contexts)
    return out


def _cut(docs: DataFrame, id_col: str, text_col: str, least: int, core: int | None, others: list[str], then, schema) -> DataFrame:
    """What ``then`` makes of rows of ``id``, ``h``, ``text``, the columns ``others`` and ``held`` (intervals to remove);
    only texts that may have intervals are shuffled."""
    texts = _texts(docs, id_col, text_col)
    spans = repeated_spans(texts, least, core or max(1, least // 4))
    held = spans.groupBy("id", "h").agg(F.collect_set(F.struct("a", "b")).alias("held"))
    sieve = sieve_of(spans, "id", "h")
    full = _texts(docs, id_col, text_col, others)
    whole = full.withColumn("held", F.lit(None).cast("array<struct<a:int,b:int>>"))
    cut = sifted(full, sieve, "id", "h").join(held, ["id", "h"], "left").select(*whole.columns)
    return sifted(whole, sieve, "id", "h", wanted=False, then=then, schema=schema).union(cut.mapInArrow(then, schema))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 400, core: int | None = None
) -> DataFrame:
    """``id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (the remaining bytes) and ``kept_text`` (the whole
    characters among them) for every row of ``docs``.

    A byte of a text's UTF-8 form is removed if a string of ``least`` bytes that covers it also starts anywhere else,
    in the same or another row; matches do not cross rows, overlaps count, and all is judged on the input. ``core``
    (a quarter of ``least`` if not given) trades the number of suffixes against the windows compared one by one.

    Null and empty texts are zero bytes. Rows with a null or repeated id are rows like any others; two equal rows of
    ``least`` bytes or more remove each other. Other columns are not read; an empty table gives no rows.
    """
    return _cut(docs, id_col, text_col, least, core, [], _kept, _RESULT)


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 400) -> DataFrame:
    """``docs`` with the text that ``remove_repeats`` keeps; characters whose bytes are removed in part go whole."""
    names = docs.columns
    others = [c for c in names if c != text_col]
    at = 3 + len(others)

    def run(batches):
        for batch in (part for whole in batches for part in parts_of(whole, 2, BLOCK)):
            texts = as_bytes(batch.column(2))
            kept = [_remaining(t, h or [])[0].decode("utf-8", "ignore") for t, h in zip(texts, batch.column(at).to_pylist())]
            columns = {name: batch.column(3 + i) for i, name in enumerate(others)} | {text_col: pa.array(kept, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    schema = docs.withColumn(text_col, F.lit("").cast("string")).select(*names).schema
    return _cut(docs, id_col, text_col, least, None, others, run, schema)

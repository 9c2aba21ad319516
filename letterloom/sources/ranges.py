"""Message files of any size, read by byte ranges: one file is many tasks, and the array of its messages is cut between
elements.

A range in the middle of JSON does not tell whether it begins within a string, or how deep. A first pass therefore says of
every range how it changes both, either way; three numbers per range reach the driver and are summed in order. A second
pass, which knows where each range stands, finds the array and counts its separators. Then each range yields the elements
that begin in it, with their place in the whole array.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.canonical import parse_payload
from .shared import once

#: Bytes of a range; bytes before an array that are searched for its key; bytes of all that is not in the array.
RANGE, KEY, REST = 64 << 20, 4096, 64 << 20
_LAYOUT = "path string, at long, start long, end long"


class _File:
    def __init__(self, uri: str) -> None:
        system, path = pyarrow.fs.FileSystem.from_uri(uri)
        self.size, self.file = system.get_file_info(path).size, system.open_input_file(path)

    def read(self, start: int, end: int) -> bytes:
        start, end = max(0, start), min(end, self.size)
        return self.file.read_at(end - start, start) if end > start else b""


def _uri(path: str) -> str:
    """A path as Hadoop writes it (plain, or ``scheme:/path``, ``scheme://host/path``; nothing is escaped in it) as the
    URI that ``pyarrow.fs`` reads."""
    scheme, host, rest = re.fullmatch(r"(?:([a-z][a-z0-9+.-]*):)?(?://([^/]*))?(.*)", path, re.S).groups()
    return f"{scheme or 'file'}://{host or ''}{quote(rest)}"


class _Range:
    """Bytes with what is outside of strings, if they begin outside (``flipped`` false) or within one."""

    def __init__(self, file: _File, start: int, end: int) -> None:
        self.start, raw = start, file.read(start, end)
        self.data = np.frombuffer(raw, np.uint8)
        run, back = 0, start
        while back > 0 and (piece := file.read(back - KEY, back)):
            own = len(piece) - len(piece.rstrip(b"\\"))
            run, back = run + own, back - len(piece)
            if own < len(piece):
                break
        at = np.arange(len(self.data))
        last = np.maximum.accumulate(np.where(self.data != 92, at, -1))
        before = np.append(-1, last[:-1]) if len(at) else last
        slashes = at - 1 - before + np.where(before < 0, run, 0)
        quote = (self.data == 34) & (slashes % 2 == 0)
        self.within = (np.cumsum(quote) - quote) % 2 == 1  # the opening quote is outside, the closing one within
        self.quotes = int(quote.sum())
        self.step = np.isin(self.data, [91, 123]).astype(np.int8) - np.isin(self.data, [93, 125])

    def outside(self, flipped: bool) -> np.ndarray:
        return self.within if flipped else ~self.within

    def change(self, flipped: bool) -> int:
        return int(self.step[self.outside(flipped)].sum(dtype=np.int64))

    def depth(self, flipped: bool, depth: int) -> np.ndarray:
        """How deep each byte stands, brackets as what they enclose."""
        step = np.where(self.outside(flipped), self.step, 0)
        return depth + np.cumsum(step, dtype=np.int64) + (step < 0)

    def is_utf8(self, file: _File) -> bool:
        """Whether all characters that begin in the range are UTF-8."""
        raw = file.read(self.start, self.start + len(self.data) + 3)
        first = next((i for i, b in enumerate(raw[:4]) if b & 0xC0 != 0x80), min(4, len(raw))) if self.start else 0
        end = next((i for i in range(len(self.data), len(raw)) if raw[i] & 0xC0 != 0x80), len(raw))
        try:
            raw[first:end].decode("utf-8")
        except UnicodeDecodeError:
            return False
        return first < 4


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, at, start, end in zip(*(c.to_pylist() for c in batch.columns)):
            file = _File(_uri(path))
            own = _Range(file, start, end)
            yield pa.RecordBatch.from_pydict({"path": [path], "at": [at], "start": [start], "end": [end], "quotes": [own.quotes], "plain": [own.change(False)], "flipped": [own.change(True)], "utf8": [own.is_utf8(file)]})


class Place(NamedTuple):
    """Where a range stands: within a string or not, how deep, and, once known, between which bytes the array lies and how
    many of its elements begin before."""

    flipped: bool
    depth: int
    utf8: bool
    low: int = -1
    high: int = -1
    base: int = 0


def _is_messages(file: _File, at: int) -> bool:
    return file.read(at - KEY, at).rstrip().removesuffix(b":").rstrip().endswith(b'"messages"')


def _arrays(places):
    """Of each range: where an array of messages opens or closes at the top level, and the separators of such depth
    before, between and behind these places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                place, file = places.value[path, at], _File(_uri(path))
                own = _Range(file, start, end)
                depth, outside = own.depth(place.flipped, place.depth), own.outside(place.flipped)
                opens = [int(i) for i in np.flatnonzero((depth == 2) & outside & (own.data == 91)) if _is_messages(file, start + int(i))]
                closes = np.flatnonzero((depth == 2) & outside & (own.data == 93)).tolist()
                comma = np.flatnonzero((depth == 2) & outside & (own.data == 44))
                marks = sorted([(i, 1) for i in opens] + [(i, -1) for i in closes])
                counts = np.diff(np.searchsorted(comma, [0, *(i for i, _ in marks), len(own.data)])).tolist()
                layout = pa.schema([("path", pa.string()), ("at", pa.int64()), ("marks", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
                yield pa.RecordBatch.from_pylist([{"path": path, "at": at, "marks": [start + i for i, _ in marks], "kinds": [k for _, k in marks], "counts": counts}], layout)

    return run


def _elements(places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                place, file = places.value[path, at], _File(_uri(path))
                if place.low < 0 or place.high <= start or place.low >= end:
                    continue
                own = _Range(file, start, end)
                cuts = (own.depth(place.flipped, place.depth) == 2) & own.outside(place.flipped) & (own.data == 44)
                cuts = [start + int(i) for i in np.flatnonzero(cuts) if place.low < start + i < place.high]
                begins = ([place.low] if start <= place.low < end else []) + cuts
                if not begins:
                    continue
                # The last element may end in a later range: read on, as deep and out of strings as this range ends.
                low, flipped = end, place.flipped ^ bool(own.quotes % 2)
                depth, stop = place.depth + own.change(place.flipped), place.high if place.high < end else -1
                while stop < 0:
                    more = _Range(file, low, low + (1 << 20))
                    deep = (more.depth(flipped, depth) == 2) & more.outside(flipped)
                    found = np.flatnonzero(deep & ((more.data == 44) | (more.data == 93)))
                    stop = low + int(found[0]) if len(found) else -1
                    low, flipped, depth = low + len(more.data), flipped ^ bool(more.quotes % 2), depth + more.change(flipped)
                code = "utf-8" if place.utf8 else "latin-1"
                for i, (a, b) in enumerate(zip(begins, [*begins[1:], stop])):
                    text = file.read(a + 1, b).decode(code).strip()
                    if text or len(begins) > 1 or a != place.low:
                        yield pa.RecordBatch.from_pydict({"path": [path], "pos": pa.array([place.base + i], pa.int64()), "text": [text]})

    return run


def _rest(path: str, low: int, high: int, utf8: bool) -> str:
    """All of a file but the elements."""
    file = _File(_uri(path))
    if file.size - (high - low) > REST:
        raise ValueError(f"{path} holds more than {REST} bytes beside its messages")
    return (file.read(0, low + 1) + file.read(high, file.size) if low >= 0 else file.read(0, file.size)).decode("utf-8" if utf8 else "latin-1")


def read_ranges(spark: SparkSession, paths: list[str], size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """``path`` and ``file`` (all but the messages; their array is empty) of each of ``paths``, and ``path``, ``pos`` and
    ``payload`` of every message, which are written once in the shared folder. ``file`` is null where the whole is no JSON: brackets or strings that do not close, or
    an element or the rest that does not parse; then no message of it is there.

    Files are UTF-8 or else Latin-1, decided on the whole. Their schemes are those of ``pyarrow.fs``. The driver holds a
    few numbers per range. An array of messages comes once in a file.
    """
    cut = [(p, k, a, min(a + size, n)) for p in paths for n in [_File(_uri(p)).size] for k, a in enumerate(range(0, max(n, 1), size))]
    ranges = spark.createDataFrame(cut, _LAYOUT).repartition(max(1, len(cut)))
    shapes = ranges.mapInArrow(_shapes, _LAYOUT + ", quotes long, plain long, flipped long, utf8 boolean").collect()
    utf8 = {p: all(r.utf8 for r in shapes if r.path == p) for p in paths}
    places, closed = {}, {}
    for p in paths:
        flipped, depth = False, 0
        for r in sorted((r for r in shapes if r.path == p), key=lambda r: r["at"]):
            places[p, r["at"]] = Place(flipped, depth, utf8[p])
            depth += r.flipped if flipped else r.plain
            flipped ^= bool(r.quotes % 2)
        closed[p] = not flipped and depth == 0
    known = spark.sparkContext.broadcast(places)
    arrays = ranges.mapInArrow(_arrays(known), "path string, at long, marks array<long>, kinds array<long>, counts array<long>").collect()
    spans = {}
    for p in paths:
        low = high = -1
        told = sorted((r for r in arrays if r.path == p), key=lambda r: r["at"])
        for r in told:
            for mark, kind in zip(r.marks, r.kinds):
                low, high = (mark, high) if kind > 0 and low < 0 else (low, mark) if kind < 0 and 0 <= low and high < 0 else (low, high)
        spans[p] = (low, high) if high >= 0 and closed[p] else (-1, -1)
        base = inside = 0
        for r in told:
            places[p, r["at"]] = places[p, r["at"]]._replace(low=spans[p][0], high=spans[p][1], base=base)
            for k, n in enumerate(r.counts):
                base += n * inside
                if k < len(r.marks):
                    opened = r.marks[k] == low
                    inside, base = (1 if opened else 0 if r.marks[k] == high else inside), base + opened
    found = spark.sparkContext.broadcast(places)
    texts = ranges.mapInArrow(_elements(found), "path string, pos long, text string")
    payloads = once(texts.select("path", "pos", parse_payload(F.col("text")).alias("payload")), "elements")
    rest = [(p, _rest(p, *spans[p], utf8[p]) if closed[p] else None) for p in paths]
    files = spark.createDataFrame(rest, "path string, text string").select("path", parse_payload(F.col("text")).alias("file"))
    broken = payloads.where("payload is null").select("path").distinct()
    whole = files.join(broken.withColumn("broken", F.lit(True)), "path", "left").select("path", F.when(F.col("broken").isNull(), F.col("file")).alias("file"))
    # One row per file, of which the driver has the list: small enough to go to every task, so that no message is shuffled.
    return whole, payloads.join(F.broadcast(whole.where("file is not null").select("path")), "path", "left_semi")

"""Byte-level BPE over a corpus: every distinct word is encoded once, and ids are joined back by position.

Documents are read in chunks (a bounded amount of text of one task). Each chunk numbers its distinct pre-tokens by
falling frequency and keeps, per document, the numbers in order of position. The distinct words of all chunks meet in
one shuffle by a bucket of their hash, where each word is encoded once for the whole corpus however many chunks hold
it; the ids return to their chunks in a second shuffle and the documents are put together by position. A frequent word
is one row part per chunk, so no key is hot, and no task holds more than a chunk or the distinct words of one bucket.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernels import gathered, groups_of, text_blocks
from .pretokens import Pretokens
from .scratch import settled

#: Bytes that are cut into pre-tokens at once, characters of a chunk, and buckets of words.
BLOCK, CHUNK, BUCKETS = 1 << 18, 16 << 20, 1 << 12


@lru_cache(4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(4)
def _encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("letterloom", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(4)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table: all bytes end to end, and where each id's begin."""
    ranks = _ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum([0, *map(len, table)])


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, low bits first, the high bit set on all but a value's last byte; and each value's length."""
    width = 1 + (values >= 1 << 7) + (values >= 1 << 14) + (values >= 1 << 21) + (values >= 1 << 28)
    end = np.cumsum(width)
    out = np.empty(end[-1] if len(end) else 0, np.uint8)
    for k in range(int(width.max(initial=0))):
        has = width > k
        part = values[has] >> (7 * k) & 127
        out[(end - width)[has] + k] = part | ((width[has] > k + 1) << 7)
    return out, width


def _from_varints(data: np.ndarray) -> np.ndarray:
    stop = np.flatnonzero(data < 128)
    start = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop
    out = (data[start] & 127).astype(np.int64)
    for k in range(1, int((stop - start).max(initial=0)) + 1):
        more = start + k <= stop
        out[more] |= (data[start[more] + k] & 127).astype(np.int64) << (7 * k)
    return out


class _Chunk:
    """Pre-tokens of consecutive documents: their distinct words, and the words' places in each document."""

    def __init__(self) -> None:
        self.rows, self.sizes, self.blocks, self.counts, self.words, self.chars = [], [], [], [], {}, 0
        self.digest = hashlib.blake2b(digest_size=16)

    def add(self, rows: list, texts: list[str]) -> None:
        cut = Pretokens(texts)
        at, like = cut.distinct()
        number = np.array([self.words.setdefault(cut.word(i), len(self.words)) for i in at.tolist()], np.int32)
        self.rows += rows
        self.sizes.append(np.diff(cut.first))
        self.blocks.append(number[like])
        self.counts.append((number, np.bincount(like, minlength=len(at))))
        self.digest.update(cut.code)
        self.chars += len(cut.joined)

    def numbered(self) -> tuple[list[str], Iterator[np.ndarray]]:
        """Words by falling frequency (ties as they came), and each block's words as numbers in that order."""
        count = np.zeros(len(self.words), np.int64)
        for number, n in self.counts:
            count[number] += n
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        words = list(self.words)
        return [words[i] for i in order.tolist()], (rank[b] for b in self.blocks)

    @property
    def key(self) -> bytes:
        """Named by what was read, so that a chunk's two scans agree; chunks of equal texts have equal numbers too."""
        return self.digest.digest()


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[_Chunk]:
    chunk = _Chunk()
    for batch in batches:
        rows = batch.column(0).to_pylist()
        for start, end, texts in text_blocks(batch.column(1), BLOCK):
            chunk.add(rows[start:end], texts)
            if chunk.chars >= size:
                yield chunk
                chunk = _Chunk()
    if chunk.rows:
        yield chunk


def _word_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for chunk in _chunks(batches, size):
        words = [w.encode("utf-8", "surrogatepass") for w in chunk.numbered()[0]]
        bucket = np.fromiter((zlib.crc32(w) % BUCKETS for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.diff(bucket[order])) + 1
        out = []
        for numbers in np.split(order, cut) if len(order) else []:
            own = [words[i] for i in numbers.tolist()]
            steps = np.diff(numbers, prepend=0)
            out.append((int(bucket[numbers[0]]), chunk.key, len(own), _varints(np.concatenate([steps, [len(w) for w in own]]))[0].tobytes(), b"".join(own)))
        for i in range(0, len(out), 1024):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[i : i + 1024]), (pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary()))], ["bucket", "chunk", "n", "meta", "words"])


def _place_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for chunk in _chunks(batches, size):
        _, blocks = chunk.numbered()
        at = 0
        for numbers, sizes in zip(blocks, chunk.sizes):
            data, width = _varints(numbers)
            ends = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(sizes)])]
            codes = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
            n = len(sizes)
            ids = pa.array(chunk.rows[at : at + n], pa.int64())
            at += n
            yield pa.RecordBatch.from_arrays([pa.array([chunk.key] * n, pa.binary()), pa.array(np.ones(n, np.int8)), ids, codes, pa.nulls(n, pa.binary())], ["chunk", "part", "id", "codes", "ids"])


def _encoded_words(path: str, pattern: str):
    def run(batches):
        encode, bucket, known = _encoder(path, pattern).encode_ordinary, None, {}
        for batch in batches:
            out = []
            for b, chunk, n, meta, words in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket:
                    bucket, known = b, {}
                meta = _from_varints(np.frombuffer(meta, np.uint8))
                numbers, ends = np.cumsum(meta[:n]), np.cumsum(meta[n:]).tolist()
                lists, start = [], 0
                for end in ends:
                    word = words[start:end]
                    start = end
                    if (ids := known.get(word)) is None:
                        ids = known[word] = encode(word.decode("utf-8", "surrogatepass"))
                    lists.append(ids)
                flat = np.array([i for ids in lists for i in ids], np.int64)
                steps = np.diff(numbers, prepend=0)
                head = np.concatenate([[n], steps, [len(x) for x in lists]])
                out.append((chunk, 0, None, _varints(head)[0].tobytes(), flat.astype("<u4" if flat.max(initial=0) > 0xFFFF else "<u2").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.binary(), pa.int8(), pa.int64(), pa.binary(), pa.binary()))], ["chunk", "part", "id", "codes", "ids"])

    return run


class _Dictionary:
    """The ids of one chunk's words by the words' numbers."""

    def __init__(self) -> None:
        self.parts, self.start = [], None

    def add(self, meta: bytes, ids: bytes) -> None:
        head = _from_varints(np.frombuffer(meta, np.uint8))
        n = int(head[0])
        sizes = head[n + 1 :]
        flat = np.frombuffer(ids, "<u2" if len(ids) == 2 * sizes.sum() else "<u4")
        self.parts.append((np.cumsum(head[1 : n + 1]), sizes, flat.astype("<u4")))

    def close(self) -> None:
        numbers, sizes = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        self.flat = np.concatenate([p[2] for p in self.parts])
        self.start, self.size = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        self.start[numbers], self.size[numbers] = np.cumsum(sizes) - sizes, sizes
        self.parts = []


def _ids_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], ["id", "n_tokens", "ids"])


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, words = None, _Dictionary()
    for batch in batches:
        chunk, part, rows, codes, ids = (batch.column(i).to_pylist() for i in range(5))
        out, size = [], 0
        for i, c in enumerate(chunk):
            if c != current:
                current, words = c, _Dictionary()
            if not part[i]:
                words.add(codes[i], ids[i])
                continue
            if words.start is None:
                if not words.parts and codes[i]:
                    raise RuntimeError("a chunk of documents was read differently by its two scans")
                if words.parts:
                    words.close()
            if codes[i]:
                numbers = _from_varints(np.frombuffer(codes[i], np.uint8))
                found = gathered(words.flat, words.start[numbers], words.size[numbers])
            else:
                found = np.empty(0, "<u4")
            out.append((rows[i], len(found), found.tobytes()))
            size += len(found)
            if size > BLOCK:
                yield _ids_batch(out)
                out, size = [], 0
        if out:
            yield _ids_batch(out)


def encode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK
) -> DataFrame:
    """``id``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit, end to end) for every row of ``docs``.

    ``path`` is a file of ranks and ``pattern`` the public pattern whose matches are encoded separately, without
    special tokens: their strings are ordinary text. Null and empty texts have no ids. A null or repeated id is kept
    as it is, one row per row. ``chunk`` is the characters of a chunk. Other columns are not read; an empty table gives no rows.

    Documents are scanned twice. Rows that a shuffle or a sample deals out may come otherwise the second time and are
    written once first; where files change between the scans, that is an error and not a wrong result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = settled(texts, "texts")
    layout = "chunk binary, part tinyint, id long, codes binary, ids binary"
    words = texts.mapInArrow(partial(_word_rows, size=chunk), "bucket int, chunk binary, n int, meta binary, words binary")
    words = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_encoded_words(path, pattern), layout)
    both = words.union(texts.mapInArrow(partial(_place_rows, size=chunk), layout))
    return both.repartition("chunk").sortWithinPartitions("chunk", "part").mapInArrow(_assembled, "id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``bytes``: the bytes of its ``ids`` joined with the token-byte table, end to end. The table has
    one row per token of the vocabulary, whatever the corpus, so that the join is made on the map side: every worker
    holds the table and joins whole documents, which keeps positions without a shuffle of tokens. An id outside it is an error; null ids give null."""

    def run(batches):
        data, first = _token_bytes(path)
        for batch in batches:
            length = np.array([n or 0 for n in batch.column(1).to_pylist()], np.int64)
            for low, high in groups_of(length + 1, BLOCK):
                part, out = batch.slice(low, high - low), []
                for ids in part.column(2).to_pylist():
                    if ids is None:
                        out.append(None)
                        continue
                    ids = np.frombuffer(ids, "<u4").astype(np.int64)
                    out.append(gathered(data, first[ids], first[ids + 1] - first[ids]).tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], ["id", "n_tokens", "ids", "bytes"])

    return encoded.select("id", "n_tokens", "ids").mapInArrow(run, "id long, n_tokens long, ids binary, bytes binary")

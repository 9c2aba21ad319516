"""A prefix trie over conversations, by range partitions whose splitter paths are a skeleton.

A conversation is its path: the digests of its turns end to end, so that paths in byte order are conversations in order
of their turns, prefixes first. Paths are dealt into shards by ranges (equal paths by conversation, so that copies of one
conversation are spread too). The members of a node follow each other, so a node lies in several shards only if it is on
the path between two neighbouring ones. These nodes are the skeleton: how far the paths to the left and right of each
splitter agree (three numbers per shard) tells the trie of splitter paths, which is broadcast. A shard runs through its
sorted paths with a stack, finishes every other node, and returns partial sums for the skeleton's, which are so defined
that they add up: a node is counted as a child, and its own text once, by the shard where its members begin, and as a
leaf by the one where they end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .scratch import drop, written

#: Bytes of a turn's digest in a path; turns of a shard, and shards at least; skeleton rows that are broadcast at most.
WIDTH, SHARD, LEAST, SMALL = 16, 1 << 16, 8, 1 << 17
_EMPTY = hashlib.sha256(b"").hexdigest()

_NODE = "boundary int, shard int, depth long, conv_id long, parent_boundary int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary, ends_sha256 string"
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
_NAMES = [part.split()[0] for part in _NODE.split(", ")]


def conversations(rows: DataFrame, together=None) -> DataFrame:
    """``conv_id`` and ``turns`` (array of ``key``, a digest of role and text in hexadecimal, and ``bytes``, the UTF-8
    bytes of the text) of every conversation of ``rows`` (``conv_id``, ``turn``, ``role``, ``text``).

    Turns stand by number, null first; turns of one number by role and then by digest, repeated rows each. Null roles and
    texts are empty. Rows without ``conv_id`` belong to no conversation and are left out. Other columns are not read.
    Conversations for which the column ``together`` is equal come to one task. Texts do not leave the first stage: a
    conversation is one row of some tens of bytes per turn, and the longest must fit into a task at that size.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    told = rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        *([] if together is None else [together.alias("together")]),
        F.struct(F.col("turn"), role.alias("role"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes")).alias("told"),
    )
    by = [c for c in ("together", "conv_id") if c in told.columns]
    gathered = told.repartition(by[0]).groupBy(*by).agg(F.sort_array(F.collect_list("told")).alias("told"))
    return gathered.select(*by, F.transform("told", lambda t: F.struct(t.key.alias("key"), t.bytes.alias("bytes"))).alias("turns"))


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common at their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax()) // WIDTH


def _agreements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shard, first, last, following = (c.to_pylist() for c in batch.columns)
        within = [_shared(a, b) for a, b in zip(first, last)]
        across = [-1 if b is None else _shared(a, b) for a, b in zip(last, following)]
        yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(within, pa.int64()), pa.array(across, pa.int64())], ["shard", "within", "across"])


class Side:
    """The skeleton's nodes at one end of a shard: from the root down to ``depth``, each named by the first boundary that
    has it, as ranges of depths. Without a neighbour, ``depth`` is -1."""

    def __init__(self, ranges: tuple[tuple[int, int], ...] = ()) -> None:
        self.ranges, self.depth = ranges, ranges[-1][0] if ranges else -1

    def name(self, depth: int) -> int:
        return next(boundary for last, boundary in self.ranges if depth <= last)


def skeleton(agreements: list[tuple[int, int, int]]) -> dict[int, tuple[Side, Side]]:
    """The left and right side of every shard, from rows (shard, turns that its first and last path share, turns that
    its last path and the first of the next shard share). One range is added or cut per boundary and level."""
    out, left = {}, Side()
    for k, (shard, within, across) in enumerate(sorted(agreements)):
        if across < 0:
            right = Side()
        else:
            same = min(left.depth, within, across)
            kept = [(min(last, same), b) for i, (last, b) in enumerate(left.ranges) if (left.ranges[i - 1][0] if i else -1) < same]
            right = Side((*kept, (across, k)) if across > same else tuple(kept))
        out[shard] = (left, right)
        left = right
    return out


class _Node:
    __slots__ = ("bytes", "begins", "old", "least", "n", "children", "leaves", "saved", "ends", "below")

    def __init__(self, size: int, begins: bool, old: bool) -> None:
        self.bytes, self.begins, self.old = size, begins, old  # begins: with the shard's first row; old: in an earlier shard too
        self.least, self.n, self.children, self.leaves, self.saved, self.ends, self.below = None, 0, 0, 0, 0, [], []


class _Shard:
    """One run through a shard's sorted paths. ``out`` gets the rows that are finished."""

    def __init__(self, number: int, left: Side, right: Side, out: list[tuple]) -> None:
        self.number, self.left, self.right, self.out = number, left, right, out
        self.stack: list[_Node] = []
        self.path: bytes | None = None

    def add(self, path: bytes, conv: int, sizes: list[int]) -> None:
        starts = self.path is None
        if starts:
            self.stack.append(_Node(0, True, self.left.depth >= 0))
            common = 0
        else:
            common = _shared(self.path, path)
            if path != self.path and common * WIDTH < len(self.path):
                self.stack[-1].leaves += 1
        while len(self.stack) > common + 1:
            self._close(self.left if self.stack[-1].begins else Side())
        for depth in range(common + 1, len(path) // WIDTH + 1):
            node = _Node(sizes[depth - 1], starts, starts and depth <= self.left.depth)
            self.stack[-1].children += not node.old
            self.stack.append(node)
        node = self.stack[-1]
        node.n += 1
        node.least = conv if node.least is None else min(node.least, conv)
        node.ends.append(conv)
        self.path = path

    def end(self) -> None:
        if self.right.depth < len(self.path) // WIDTH:
            self.stack[-1].leaves += 1
        while self.stack:
            depth = len(self.stack) - 1
            self._close(self.right if depth <= self.right.depth else self.left if self.stack[-1].begins else Side())

    def _close(self, side: Side) -> None:
        """Take the deepest node off the stack: a row of the result, or partial sums if it is on the skeleton."""
        node, depth = self.stack.pop(), len(self.stack)
        boundary = side.name(depth) if depth <= side.depth else None
        node.saved += (node.n - (not node.old)) * node.bytes
        told = ",".join(map(str, node.ends)).encode()
        for row in node.below:  # complete nodes, which only lacked what their parent is called
            self.out.append((*row[:4], boundary, node.least if boundary is None else None, *row[6:]))
        sums = (node.n, node.children, node.leaves, node.saved)
        if boundary is not None:
            above = side.name(depth - 1) if depth else None
            self.out.append((boundary, self.number, depth, node.least, above, None, *sums, told, None))
        else:
            row = (None, self.number, depth, node.least, None, None, *sums, None, hashlib.sha256(told).hexdigest())
            (self.stack[-1].below if self.stack else self.out).append(row)
        if self.stack:
            above = self.stack[-1]
            above.n += node.n
            above.leaves += node.leaves
            above.saved += node.saved
            above.least = node.least if above.least is None else min(above.least, node.least)


def _nodes(sides):
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _TYPES)], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out = None, []
        for batch in batches:
            for number, path, conv, sizes in zip(*(c.to_pylist() for c in batch.columns)):
                if shard is None or number != shard.number:
                    if shard is not None:
                        shard.end()
                    shard = _Shard(number, *sides.value[number], out)
                shard.add(path, conv, sizes)
                if len(out) >= 4096:
                    yield batch_of(out)
                    out.clear()
        if shard is not None:
            shard.end()
        for i in range(0, len(out), 4096):
            yield batch_of(out[i : i + 4096])

    return run


def _ends_hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of one node's list follow each other by shard and are hashed as they come, never put together."""
    current, digest = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([current[0]], pa.int32()), pa.array([current[1]], pa.int64()), pa.array([digest.hexdigest()])], ["boundary", "depth", "ends_sha256"])
    for batch in batches:
        for boundary, depth, part in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if (boundary, depth) == current:
                digest.update(b"," + part)
            else:
                if current:
                    yield row()
                current, digest = (boundary, depth), hashlib.sha256(part)
    if current:
        yield row()


def trie(paths: DataFrame, shard: int = SHARD, least: int = LEAST) -> DataFrame:
    """One row per distinct prefix of the conversations ``paths`` (``conv_id``, ``turns`` as of ``conversations``):
    ``conv_id`` (its smallest member; with ``depth`` it tells the prefix), ``depth``, ``parent_conv_id`` (of the root
    null), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` (bytes of texts that need not be kept again, summed
    over its subtree) and ``ends_sha256`` (of the conversations that end here, ascending, joined by commas).

    A conversation without turns ends at the root; a repeated ``conv_id`` counts as often as it comes; no conversations
    give no rows. ``shard`` is the turns of a shard (about, as shards are sampled), ``least`` their number at least. Shards and partial
    sums are written to the shared folder, so a lost executor costs its own shards. A list of ends is hashed in its order,
    and so by one task, in parts of one shard.
    """
    spark = paths.sparkSession
    told = paths.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.unhex(F.array_join(F.transform("turns", lambda t: t.key), "")).alias("path"),
        F.transform("turns", lambda t: t.bytes).alias("sizes"),
    )
    told = written(told, "paths")
    size = told.agg(F.coalesce(F.sum(1 + F.size("sizes")), F.lit(0))).first()[0]
    number = max(least, -(-size // shard))
    dealt = written(told.repartitionByRange(number, "path", "conv_id").withColumn("shard", F.spark_partition_id()), "shards")
    drop(told)
    ends = dealt.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    ends = ends.select("shard", "first", "last", F.lead("first").over(Window.orderBy("shard")).alias("following"))
    agreements = ends.mapInArrow(_agreements, "shard int, within long, across long").collect()
    sides = spark.sparkContext.broadcast(skeleton([tuple(r) for r in agreements]))
    rows = dealt.select("shard", "path", "conv_id", "sizes").repartition(number, "shard").sortWithinPartitions("shard", "path", "conv_id")
    nodes = written(rows.mapInArrow(_nodes(sides), _NODE), "nodes")
    drop(dealt)

    parts = nodes.where("boundary IS NOT NULL")
    lists = parts.where("octet_length(ends) > 0").select("boundary", "depth", "shard", "ends")
    lists = lists.repartition("boundary", "depth").sortWithinPartitions("boundary", "depth", "shard")
    hashed = lists.mapInArrow(_ends_hashed, "boundary int, depth long, ends_sha256 string")
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    joint = parts.groupBy("boundary", "depth").agg(F.min("conv_id").alias("conv_id"), F.first("parent_boundary").alias("parent_boundary"), *(F.sum(c).alias(c) for c in sums))
    joint = joint.join(hashed, ["boundary", "depth"], "left")
    joint = written(joint.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY))), "skeleton")

    names = joint.select(F.col("boundary").alias("parent_boundary"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    names = F.broadcast(names) if names.count() <= SMALL else names
    columns = ("conv_id", "depth", "parent_conv_id", *sums, "ends_sha256")
    complete = nodes.where("boundary IS NULL")
    below = complete.where("parent_boundary IS NOT NULL").drop("parent_conv_id").join(names, ["parent_boundary", "depth"])
    own = joint.join(names, ["parent_boundary", "depth"], "left")
    return complete.where("parent_boundary IS NULL").select(*columns).union(below.select(*columns)).union(own.select(*columns))

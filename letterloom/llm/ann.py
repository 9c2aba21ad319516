"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .kernels import U, mix64
from .scratch import written
from .vectors import lengths, matrix, with_validity

#: Vectors of a bucket that one task scores.
BLOCK = 8192


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised fast Hadamard transform of each row, whose length is a power of two."""
    n, d = x.shape
    width = 1
    while width < d:
        halves = x.reshape(n, -1, 2, width)
        x = np.concatenate([halves[:, :, :1] + halves[:, :, 1:], halves[:, :, :1] - halves[:, :, 1:]], axis=2)
        x = x.reshape(n, d)
        width *= 2
    return x / np.sqrt(d)


class Rotations:
    """Pseudo-random rotations, one for each table: three rounds of random signs and a Hadamard transform. Signs follow
    from a seed."""

    def __init__(self, dim: int, tables: int, seed: int = 1) -> None:
        self.size = 1 << max(1, int(np.ceil(np.log2(max(2, dim)))))
        bits = mix64(np.arange(tables * 3 * self.size, dtype=U) + U(seed << 32))
        self.signs = np.where(bits >> U(63), 1.0, -1.0).reshape(tables, 3, self.size)

    def axes(self, points: np.ndarray, table: int) -> np.ndarray:
        """The closeness of every point to the 2 * size signed axes of the rotated space."""
        turned = np.zeros((len(points), self.size))
        turned[:, : points.shape[1]] = points
        for s in self.signs[table]:
            turned = _hadamard(turned * s)
        return np.concatenate([turned, -turned], axis=1)

    def buckets(self, points: np.ndarray, table: int) -> np.ndarray:
        return self.axes(points, table).argmax(axis=1)

    def probes(self, points: np.ndarray, table: int, count: int) -> np.ndarray:
        """The ``count`` axes that are closest to each point, the closest first."""
        return np.argsort(-self.axes(points, table), axis=1, kind="stable")[:, :count]


def _longer(points: np.ndarray, longest: float, as_query: bool) -> np.ndarray:
    """One more component that makes all indexed vectors equally long, so that the angle to a query orders them as the
    inner product does."""
    extra = np.zeros(len(points)) if as_query else np.sqrt(np.maximum(longest**2 - (points**2).sum(axis=1), 0))
    return np.concatenate([points, extra[:, None]], axis=1)


def nearest(
    vectors: DataFrame,
    queries,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    tables: int = 12,
    probes: int = 10,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``: for each row of ``vectors`` that the condition
    ``queries`` (a Column over ``id``) selects, the ``k`` other rows found with the largest inner products, in double
    precision, ties to the smaller id; all others where there are fewer.

    Every vector is put into one bucket of each table, the signed axis that its rotation is nearest to, at every size
    of the index; a query probes the ``probes`` nearest buckets of each. Buckets are cut into blocks, and a block scores
    all its queries exactly and passes on its best ``k`` vectors for each (ties to the vector whose smallest id other than
    the query's is smaller), so a large bucket is many tasks and rows are never paired outside of one. Queries that found
    fewer than ``k`` while there are more others are then scored against all vectors, in pairs of blocks. Rotations act
    on vectors that are made equally long by one more component unless they are so already.

    Equal vectors are indexed once and stand for their ``k`` + 1 smallest ids. Vectors that are null, zero, or hold null
    or non-finite components take no part, nor do rows without id; vectors with different numbers of components have no
    inner product and are not each other's candidates. A row that repeats a query's id is not its neighbour. An empty
    table gives no rows; other columns are not read.
    """
    rows = with_validity(vectors, id_col, vec_col).where("valid and id is not null")
    rows = written(rows.select("id", F.xxhash64("cls", "also").alias("cls"), "vec"), "vectors")
    each = [_nearest(rows.where(F.size("vec") == d), queries, k, tables, probes) for d in sorted(lengths(rows))]
    return reduce(DataFrame.union, each or [_nearest(rows, queries, k, tables, probes)])


def exact_nearest(vectors: DataFrame, queries, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """What ``nearest`` approximates: every query against all vectors, in pairs of blocks. Recall is measured by it. Null
    ids, odd vectors, ties, repeated rows and empty tables are taken as ``nearest`` takes them."""
    return nearest(vectors, queries, k, id_col, vec_col, tables=0)


def _nearest(rows: DataFrame, queries, k: int, tables: int, probes: int) -> DataFrame:
    """``nearest`` of vectors of one length; without tables, exactly."""
    by_id = Window.partitionBy("cls").orderBy("id")
    members = rows.select("cls", "id").distinct().withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1)
    members = written(members.withColumn("second", F.lead("id").over(by_id)), "members")
    firsts = members.where("r = 1").select("cls", F.col("id").alias("least"), "second")
    index = rows.groupBy("cls").agg(F.min_by("vec", "id").alias("vec")).join(firsts, "cls")
    index = written(index, "index")
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    size, dim, longest, shortest = index.agg(
        F.count("*"), F.max(F.size("vec")), F.sqrt(F.max(square)), F.sqrt(F.min(square))
    ).first()
    even = not size or longest - shortest <= 1e-4 * longest
    kind = dict(rows.dtypes)["vec"]
    none = F.lit(None).cast("long").alias("second")
    asking = rows.where(queries).dropDuplicates(["id", "cls"]).select("id", "cls", "vec")

    def run(batches):
        held, task = [], None
        for batch in batches:
            keys = batch.column(0).to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            for low, high in zip(cut, cut[1:]):
                if low == high:
                    continue
                if held and keys[low] != task:
                    yield from best(held)
                    held = []
                task = keys[low]
                held.append(batch.slice(low, high - low))
        if held:
            yield from best(held)

    def best(held):
        data = pa.Table.from_batches(held).combine_chunks()
        side = data.column("side").to_numpy()
        candidates, asking = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(candidates) or not len(asking):
            return
        cls, ids = data.column("cls").to_numpy(), data.column("id").to_numpy()
        second, sole = data.column("second").fill_null(0).to_numpy()[candidates], data.column("second").is_null().to_numpy()[candidates]
        points, least = matrix(data.column("vec").chunk(0)), ids[candidates]
        against = points[candidates].T
        for low in range(0, len(asking), 256):
            part = asking[low : low + 256]
            score = points[part] @ against
            own = least == ids[part][:, None]
            score[own & sole] = -np.inf
            keep = min(k, len(candidates))
            edge = -np.partition(-score, keep - 1, axis=1)[:, keep - 1 : keep]
            taken = score > edge
            tied = (score == edge) & ~(own & sole)
            room = keep - taken.sum(axis=1)
            for i in np.flatnonzero(tied.sum(axis=1) > room):
                at = np.flatnonzero(tied[i])
                name = np.where(own[i, at], second[at], least[at])
                tied[i, at[np.argsort(name, kind="stable")[room[i] :]]] = False
            row, col = np.nonzero(taken | tied)
            name = np.where(own[row, col], second[col], least[col])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[part][row]), pa.array(cls[candidates][col]), pa.array(name), pa.array(score[row, col])],
                ["query_id", "cls", "least", "score"],
            )

    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "least")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")

    def ranked(both):
        both = both.repartition("task").sortWithinPartitions("task")
        found = both.mapInArrow(run, "query_id long, cls long, least long, score double")
        found = found.groupBy("query_id", "cls").agg(F.min("least").alias("least"), F.max("score").alias("score"))
        found = found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).select("query_id", "cls", "score")
        each = found.join(members.select("cls", "id"), "cls").where("id <> query_id")
        each = each.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
        return each.select("query_id", "rank", F.col("id").alias("vec_id"), "score")

    def by_hash() -> DataFrame:
        turns = Rotations((dim or 1) + (not even), tables)

        def hashed(as_query: bool):
            def run(batches):
                for batch in batches:
                    for low in range(0, batch.num_rows, 1024):
                        part = batch.slice(low, 1024)
                        points = matrix(part.column(part.num_columns - 1))
                        points = points if even else _longer(points, longest, as_query)
                        for t in range(tables):
                            code = turns.probes(points, t, probes) if as_query else turns.buckets(points, t)[:, None]
                            out = part.take(pa.array(np.repeat(np.arange(len(points)), code.shape[1])))
                            bucket = mix64(code.reshape(-1).astype(U) * U(tables) + U(t)).view(np.int64)
                            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(bucket)], [*part.schema.names, "bucket"])

            return run

        placed = index.select("least", "second", "cls", "vec").mapInArrow(
            hashed(False), f"least long, second long, cls long, vec {kind}, bucket long"
        )
        asked = asking.mapInArrow(hashed(True), f"id long, cls long, vec {kind}, bucket long")
        placed = written(placed, "placed")
        sizes = placed.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        own = placed.join(sizes, "bucket").select(
            F.xxhash64("bucket", F.pmod(F.xxhash64("cls"), F.col("blocks"))).alias("task"), F.lit(0).alias("side"),
            F.col("least").alias("id"), "second", "cls", "vec",
        )
        block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1))
        probe = asked.join(sizes, "bucket").select("bucket", block.alias("block"), "id", "cls", "vec")
        probe = probe.select(F.xxhash64("bucket", "block").alias("task"), F.lit(1).alias("side"), "id", none, "cls", "vec")
        return written(ranked(own.unionByName(probe)), "found")

    found, short = None, asking
    if tables:
        found = by_hash()
        others = F.lit(members.count()) - F.count("*")
        wanted = asking.groupBy("id").agg(F.least(F.lit(k), others).alias("wanted"))
        has = found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("has"))
        short = wanted.join(has, "id", "left").where("coalesce(has, 0) < wanted").select("id")
        short = asking.join(short, "id", "left_semi")
    short = written(short, "short")
    n_short = short.count()
    if found is not None and not n_short:
        return found
    n_own, n_probe = max(1, -(-size // BLOCK)), max(1, -(-n_short // BLOCK))
    part_of = lambda n: F.pmod(F.xxhash64("id", "cls"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long") - 1))
    own = index.select(F.col("least").alias("id"), "second", "cls", "vec")
    own = own.select("*", part_of(n_own).alias("own"), every(n_probe).alias("probe"), F.lit(0).alias("side"))
    probe = short.select("id", none, "cls", "vec", part_of(n_probe).alias("probe"), every(n_own).alias("own"), F.lit(1).alias("side"))
    whole = own.unionByName(probe).select(F.xxhash64("own", "probe").alias("task"), "side", "id", "second", "cls", "vec")
    if found is None:
        return ranked(whole)
    kept = found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti")
    return kept.unionByName(ranked(whole))

"""Near-duplicate vectors: an exact metric range join over cells of pivots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .scratch import drop, written
from .vectors import lengths, matrix, unit, with_validity

#: Vectors of a cell that one task compares with as many others; pivots at most, which every worker holds.
BLOCK, PIVOTS = 2048, 4096


def _cells(points: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each point with its cell (of the nearest pivot), then with every earlier cell that can hold a point within
    ``reach`` of it: point numbers, cells, and whether the point is a guest there.

    With d the distance to a pivot, a point of cell j within reach of x has d(x, j) <= d(x, home) + 2 reach by the
    triangle inequality, and in this (Euclidean) metric x lies within reach of the plane between the two pivots.
    """
    gram = np.clip(points @ pivots.T, -1, 1)
    squared = 2 - 2 * gram
    home = squared.argmin(axis=1)
    own = squared[np.arange(len(points)), home][:, None]
    apart = np.sqrt(np.maximum(2 - 2 * np.clip(pivots @ pivots.T, -1, 1), 1e-18))[home]
    near = (np.sqrt(squared) <= np.sqrt(own) + 2 * reach + 1e-9) & (squared - own <= 2 * apart * reach + 1e-9)
    near &= np.arange(len(pivots))[None, :] < home[:, None]
    guest, cell = np.nonzero(near)
    point = np.concatenate([np.arange(len(points)), guest])
    return point, np.concatenate([home, cell]), np.concatenate([np.zeros(len(home), bool), np.ones(len(guest), bool)])


def _forest(hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join the ids that ``hit`` joins: each id of a connected part with the part's smallest."""
    out = []
    rows = np.flatnonzero(hit.any(axis=1))
    todo = dict.fromkeys(rows.tolist())
    while todo:
        seen_rows = np.array([next(iter(todo))])
        part_rows, part_cols = set(seen_rows.tolist()), np.zeros(hit.shape[1], bool)
        while len(seen_rows):
            new = hit[seen_rows].any(axis=0) & ~part_cols
            part_cols |= new
            fresh = np.flatnonzero(hit[:, new].any(axis=1))
            seen_rows = np.array([r for r in fresh.tolist() if r not in part_rows], np.int64)
            part_rows.update(seen_rows.tolist())
        for r in part_rows:
            todo.pop(r, None)
        ids = np.unique(np.concatenate([left[sorted(part_rows)], right[part_cols]]))
        out += [(int(i), int(ids[0])) for i in ids[1:]]
    return out


def _compare(rows: list[pa.RecordBatch], least: float) -> pa.RecordBatch:
    """Of one task: links per class, and edges between classes."""
    table = pa.Table.from_batches(rows).combine_chunks()
    side, cls, copies = (table.column(k).to_numpy() for k in ("side", "cls", "copies"))
    points = unit(matrix(table.column("vec").chunk(0)))
    right = side == 1
    alone = not right.any()
    left = ~right if not alone else np.ones(len(side), bool)
    right = left if alone else right
    a, b = points[left], points[right]
    hit = np.zeros((len(a), len(b)), bool)
    for i in range(0, len(a), 512):
        cosine = a[i : i + 512] @ b.T
        close = cosine >= least
        for r, c in zip(*np.nonzero(np.abs(cosine - least) < 1e-12)):
            close[r, c] = float((a[i + r] * b[c]).sum()) >= least
        hit[i : i + 512] = close
    if alone:
        hit &= np.tri(len(a), k=-1, dtype=bool).T
    links = np.zeros(len(side), np.int64)
    np.add.at(links, np.flatnonzero(left), hit @ copies[right])
    np.add.at(links, np.flatnonzero(right), copies[left] @ hit)
    linked = np.flatnonzero(links)
    edges = _forest(hit, cls[left], cls[right]) if len(linked) else []
    n, m = len(linked), len(edges)
    start, end = zip(*edges) if edges else ((), ())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([cls[linked], np.zeros(m, np.int64)])),
            pa.array(np.concatenate([links[linked], np.zeros(m, np.int64)])),
            pa.array([None] * n + list(start), pa.int64()),
            pa.array([None] * n + list(end), pa.int64()),
        ],
        ["cls", "links", "a", "b"],
    )


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """``id``, ``n_links`` (other vectors with a cosine of ``least`` or more, computed in double precision),
    ``component_id`` (the smallest id reachable by links) and ``kept`` for every row of ``vectors``.

    The cosine threshold is the distance sqrt(2 - 2 least) between unit vectors. Sampled pivots, one for ``BLOCK``
    vectors until there are ``PIVOTS``, partition them; a vector is copied to each earlier cell that may hold a partner,
    so that every pair within reach meets in exactly one cell. Cells are cut into blocks, pairs of blocks are tasks, and
    a task emits counts and a spanning forest of its links, never the pairs. Equal vectors are one class and are
    compared once. Vectors of each length are compared among themselves.

    Vectors that are null, zero, or hold null or non-finite components link with nothing. A row without id links like
    any other and counts as a link of others, but it names no component: its own component is null. Rows that repeat an
    id are vectors of their own. An empty table gives no rows; other columns are not read.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * least)))
    rows = with_validity(vectors, id_col, vec_col)
    classes = rows.where("valid").groupBy("cls", "also", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    pivots, first = {}, 0
    for dim, n in sorted(lengths(classes).items()):
        own = classes.where(F.size("vec") == dim).orderBy(F.xxhash64("cls"), "cls", "also")
        sample = own.limit(min(PIVOTS, max(1, n // BLOCK))).select("vec").collect()
        pivots[dim] = first, unit(np.array([r[0] for r in sample], np.float64))
        first += len(sample)
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches):
        for whole in batches:
            size = pc.list_value_length(whole.column(2)).to_numpy()
            for dim in np.unique(size).tolist():
                batch = whole.filter(pa.array(size == dim))
                base, centres = shared.value[dim]
                for low in range(0, batch.num_rows, 1024):
                    part = batch.slice(low, 1024)
                    point, cell, guest = _cells(unit(matrix(part.column(2))), centres, reach)
                    out = part.take(pa.array(point))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array((cell + base).astype(np.int32)), pa.array(guest)], ["cls", "copies", "vec", "cell", "guest"])

    kind = dict(rows.dtypes)["vec"]
    placed = classes.select(F.col("c").alias("cls"), "copies", "vec").mapInArrow(assign, f"cls long, copies long, vec {kind}, cell int, guest boolean")
    placed = written(placed, "placed")
    sizes = placed.groupBy("cell").agg(
        F.ceil(F.count_if(~F.col("guest")) / BLOCK).cast("int").alias("homes"),
        F.ceil(F.count_if(F.col("guest")) / BLOCK).cast("int").alias("guests"),
    )
    dealt = placed.join(F.broadcast(sizes), "cell").where("homes > 0")
    blocks = F.when(F.col("guest"), F.col("guests")).otherwise(F.col("homes"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("cls"), blocks).cast("int"))
    homes = dealt.where("not guest").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("homes") + F.col("guests") - 1)))
    guests = dealt.where("guest").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("homes") - 1)))
    keyed = homes.select(
        "cell", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "cls", "copies", "vec",
    ).union(guests.select("cell", "other", F.col("homes") + F.col("own"), F.lit(1), "cls", "copies", "vec"))
    keyed = keyed.select(F.xxhash64("cell", "x", "y").alias("task"), (F.col("x") != F.col("y")).alias("two"), "side", "cls", "copies", "vec")

    def run(batches):
        held, task = [], None
        for batch in batches:
            keys = batch.column(0).to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            for low, high in zip(cut, cut[1:]):
                if low == high:
                    continue
                if held and keys[low] != task:
                    yield from compared(held)
                    held = []
                task = keys[low]
                held.append(batch.slice(low, high - low))
        if held:
            yield from compared(held)

    def compared(held):
        if held[0].column(1)[0].as_py() and len(set(v for b in held for v in b.column(2).to_pylist())) < 2:
            return
        yield _compare(held, least)

    found = keyed.repartition("task").sortWithinPartitions("task").mapInArrow(run, "cls long, links long, a long, b long")
    found = written(found, "found")
    parts = written(connected_components(found.where("a is not null").select("a", "b")), "parts")
    links = found.where("a is null").groupBy("cls").agg(F.sum("links").alias("links"))
    ids = classes.select(F.col("c").alias("node"), "rep").join(parts, "node")
    named = ids.groupBy("component").agg(F.min("rep").alias("part"))
    named = parts.join(named, "component").select(F.col("node").alias("c"), "part", F.lit(True).alias("joined"))
    by_class = classes.select("cls", "also", "rep", "copies", "c").join(links.withColumnRenamed("cls", "l"), F.col("c") == F.col("l"), "left").join(named, "c", "left")
    part = F.when(F.col("joined"), F.col("part")).otherwise(F.col("rep"))
    by_class = by_class.select("cls", "also", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), part.alias("part"))
    by_class = written(by_class, "by_class")
    for x in (placed, found, parts, classes):
        drop(x)
    good, rest = rows.where("valid"), rows.where("not valid")
    out = good.join(by_class, ["cls", "also"]).select("id", "links", "part")
    out = out.union(rest.select("id", F.lit(0).cast("long"), "id"))
    component = F.when(F.col("id").isNotNull(), F.col("part"))
    return out.select(
        "id", F.col("links").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )

"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find grouping."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .kernels import U, as_bytes, mix64, parts_of, shingle_sets
from .scratch import drop, written
from .sieve import sieve_of, sifted

#: Text bytes that are worked on at once in a task.
BLOCK = 1 << 18
#: Documents, and shingles of all of them, in a block that a task compares with another.
PER_BLOCK, SET_ROWS = 512, 1 << 18
#: Leaders that a group of documents has in different bands.
LEADERS = 5


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """One row of ``m`` ranks per set (infinite for an empty set); two sets agree in a slot with the probability of
    their Jaccard similarity.

    Each element draws a permutation of the slots step by step. In step j it offers rank j + r, r in [0, 1), to the
    slot that its permutation names; as later offers are larger, a set stops at the first step after which every slot
    is taken.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    ranks = np.full((len(sets), m), np.inf)
    if not sizes.sum():
        return ranks
    flat = ranks.reshape(-1)
    element, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = None
    for j in range(m):
        if j == 1:
            order = np.tile(np.arange(m, dtype=np.uint16), (len(element), 1))
            order[:, 0], order[np.arange(len(element)), slot] = slot, 0
        draw = mix64(element + U((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        pick = j + ((draw & U(0xFFFFFFFF)) * U(m - j) >> U(32)).astype(np.int64)
        if order is None:
            slot = pick
        else:
            each = np.arange(len(element))
            slot = order[each, pick].astype(np.int64)
            order[each, pick] = order[:, j]
            order[:, j] = slot
        offer = j + (mix64(draw + U(j)) >> U(11)) * 2.0**-53
        np.minimum.at(flat, row * m + slot, offer)
        left = ~np.isfinite(ranks).all(axis=1)[row]
        if not left.any():
            break
        element, row, slot = element[left], row[left], slot[left]
        if order is not None:
            order = order[left]
    return ranks


def _band_hashes(ranks: np.ndarray, bands: int) -> np.ndarray:
    bits = ranks.view(U).reshape(len(ranks), bands, -1)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=U) * U(0xC2B2AE3D27D4EB4F), (len(ranks), bands)).copy()
    for k in range(bits.shape[2]):
        out = mix64(out * U(3) + bits[:, :, k])
    return out.view(np.int64)


def _blocks(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    at = batch.schema.get_field_index(text)
    for part in parts_of(batch, at, BLOCK):
        yield part, as_bytes(part.column(at))


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """``id``, ``n`` (size of the shingle set), ``name`` (128 bits of SHA-256 of the lower-cased words; null without
    words) and ``bands`` (one hash per band)."""

    def run(batches):
        for batch in batches:
            for part, texts in _blocks(batch, "text"):
                sets = shingle_sets(texts, words)
                n = np.array([len(s) for s in sets], np.int32)
                hashes = _band_hashes(superminhash(sets, bands * rows), bands)
                names = [hashlib.sha256(b" ".join(t.lower().split())).digest()[:16] if k else None for t, k in zip(texts, n.tolist())]
                lists = pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * bands, hashes.reshape(-1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(names, pa.binary()), lists], ["id", "n", "name", "bands"])

    rows_of = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows_of.mapInArrow(run, "id long, n int, name binary, bands array<long>")


def word_shingles(text: bytes, words: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves, that links are confirmed on."""
    own = text.lower().split()
    return set(zip(*(own[i:] for i in range(words)))) if len(own) >= words else {tuple(own)} - {()}


def similar(a: set, b: set, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a & b)
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose ``id`` may be in ``ids``; rows of a batch that repeat id and text come once."""

    def once(batches):
        for batch in batches:
            ids, hs = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            order = np.lexsort((hs, ids))
            again = (ids[order][1:] == ids[order][:-1]) & (hs[order][1:] == hs[order][:-1])
            yield batch.take(pa.array(np.sort(order[np.append(True, ~again)[: len(order)]]))).select([0, 1])

    keyed = texts.where("id is not null").withColumn("h", F.xxhash64("text"))
    return sifted(keyed, sieve_of(ids, "id"), "id", then=once, schema="id long, text string")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose full sets have 100 * intersection >= percent * union. A task has the text of one
    ``b`` and of at most about ``PER_BLOCK`` partners. Of an id with several texts any may match."""
    counted = pairs.groupBy("b").agg(F.ceil(F.count("*") / PER_BLOCK).alias("salts"))
    salt = F.pmod(F.xxhash64("a"), F.col("salts"))
    asking = pairs.join(counted, "b").select(F.col("a").alias("id"), F.xxhash64("b", salt).alias("task"), F.col("b").alias("leader"))
    leading = counted.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    leading = leading.select(F.col("b").alias("id"), F.xxhash64("b", "salt").alias("task"), F.col("b").alias("leader"))
    keyed = written(asking.union(leading), "asked")
    rows = _texts_of(texts, keyed).join(keyed, "id").select("task", "leader", (F.col("id") != F.col("leader")).alias("asks"), "id", "text")

    def run(batches):
        current, held = None, {}
        for batch in batches:
            out = []
            for task, leader, asks, i, text in zip(*(c.to_pylist() for c in batch.columns[:4]), as_bytes(batch.column(4))):
                if (task, leader) != current:
                    current, held = (task, leader), {}
                own = word_shingles(text, words)
                if not asks:
                    held[text] = own
                elif any(similar(own, other, percent) for other in held.values()):
                    out.append((i, leader))
            if out:
                a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.repartition("task").sortWithinPartitions("task", "leader", "asks").mapInArrow(run, "a long, b long")


def _block_links(rows: list[tuple[int, int, int, bytes]], two_blocks: bool, words: int, percent: int) -> list[tuple[int, int]]:
    """Links between rows (side, id, part, text) of different parts, of different sides if there are two blocks. A row
    gets one link at most to each part: others would join nothing more. Hashes propose, words decide."""
    sets = shingle_sets([r[3] for r in rows], words)

    def same(i: int, k: int) -> bool:
        return similar(word_shingles(rows[i][3], words), word_shingles(rows[k][3], words), percent)

    ids, parts = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
    side = np.array([r[0] for r in rows])
    size = np.array([len(s) for s in sets])
    value, count = np.unique(parts, return_counts=True)
    main = value[np.argmax(count)]
    out = []
    asking = side == 1 if two_blocks else np.ones(len(rows), bool)
    asked = side == 0 if two_blocks else np.ones(len(rows), bool)
    for askers, held in ((parts != main, asked), (parts == main, asked & (parts != main)))[: 1 + two_blocks]:
        held, askers = np.flatnonzero(held), np.flatnonzero(askers & asking)
        if not len(held) or not len(askers):
            continue
        tokens, owner = np.concatenate([sets[i] for i in held]), np.repeat(held, size[held])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        for i in askers:
            low, high = np.searchsorted(tokens, sets[i], "left"), np.searchsorted(tokens, sets[i], "right")
            n = high - low
            both = np.bincount(owner[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(rows))
            hit = np.flatnonzero((both > 0) & (parts != parts[i]) & (100 * both >= percent * (size + size[i] - both)))
            met = set()
            for k in hit.tolist():
                if parts[k] not in met and same(i, k):
                    met.add(parts[k])
                    out.append((int(ids[i]), int(ids[k])))
    return out


def _linked_apart(ties: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between documents of one candidate cluster that are in different parts so far.

    ``ties`` holds ``id``, ``n``, ``part`` and a ``leader`` with which the id shares a band. A cluster (ids joined by
    shared bands) is cut into classes of set size, such that linked sets are in one class or in neighbours; a class
    meets itself and, as guests, the class below. Classes are cut into blocks, each pair of blocks that can hold a link
    is compared in one task, and only links leave the task.
    """
    cluster = connected_components(ties.select("id", "leader"))
    level = F.floor(F.log("n") / (1.0001 * math.log(100 / min(percent, 99)))).cast("int")
    placed = ties.groupBy("id").agg(F.min("part").alias("part"), F.max("n").alias("n")).withColumn("level", level)
    placed = placed.join(cluster.withColumnRenamed("node", "id"), "id")
    both = F.explode(F.array(F.struct(F.col("level").alias("cell"), F.lit(False).alias("guest")), F.struct((F.col("level") + 1).alias("cell"), F.lit(True).alias("guest"))))
    placed = placed.withColumn("x", both).select("component", "x.cell", "x.guest", "id", "part", "n")
    blocks = lambda own: F.ceil(F.greatest(F.count_if(own) / PER_BLOCK, F.sum(F.when(own, F.col("n")).otherwise(0)) / SET_ROWS)).cast("int")
    sized = placed.groupBy("component", "cell").agg(blocks(~F.col("guest")).alias("homes"), blocks(F.col("guest")).alias("guests"), F.count("*").alias("all"))
    dealt = placed.join(sized.where("homes > 0 and all > 1"), ["component", "cell"])
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("guest"), F.col("guests")).otherwise(F.col("homes"))).cast("int"))
    homes = dealt.where("not guest").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("homes") + F.col("guests") - 1)))
    guests = dealt.where("guest").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("homes") - 1)))
    keyed = homes.select(
        "component", "cell", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "part"
    ).union(guests.select("component", "cell", "other", F.col("homes") + F.col("own"), F.lit(1), "id", "part"))
    keyed = keyed.select(F.xxhash64("component", "cell", "x", "y").alias("task"), (F.col("x") != F.col("y")).alias("two"), "side", "id", "part")
    keyed = written(keyed, "blocks")
    rows = keyed.join(_texts_of(texts, keyed), "id")

    def run(batches):
        held, task = [], None

        def links():
            found = _block_links([r[2:] for r in held], held[0][1], words, percent)
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), as_bytes(batch.column(5))):
                if row[0] != task and held:
                    yield links()
                    held = []
                task = row[0]
                held.append(row)
        if held:
            yield links()

    rows = rows.select("task", "two", "side", "id", "part", "text")
    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    bands: int = 25,
    rows: int = 5,
) -> DataFrame:
    """``id``, ``n_shingles``, ``component_id`` and ``kept`` for every row of ``docs``.

    Words are runs without ASCII white space, A-Z lower-cased; a document's set holds its distinct shingles of
    ``words`` words, or its whole word sequence if that is shorter. Documents whose sets have a Jaccard similarity of
    ``percent`` / 100 or more are linked, and ``component_id`` is the smallest id reachable by links.

    Candidates share a band of ``rows`` SuperMinHash slots in one of ``bands`` bands; at a similarity of 0.85 the
    default misses a link with a probability below 1e-6, at 0.80 below 1e-4. Every candidate link is confirmed on the
    full sets of words themselves. Documents with equal words are one class and are compared once. In a bucket each
    class is first compared with one leader, which differs between groups of bands. Classes that share a bucket but are
    still in different components are then compared with each other in pairs of blocks, which only emit links; no link
    between components is skipped, and no task holds more than two blocks.

    Null and empty texts, and texts of white space alone, have an empty set and link with nothing. A row without id
    links with nothing; its component is null and it is kept. Rows that repeat an id are one node. An empty table
    gives no rows; other columns of ``docs`` are not read.
    """
    table = written(signatures(docs, id_col, text_col, words, bands, rows), "signatures")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = table.where("id is not null and name is not null")
    classes = known.groupBy("name").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes, "classes")
    several = known.groupBy("id").agg(F.min("name").alias("x"), F.max("name").alias("y")).where("x <> y").select(F.col("id").alias("a"))
    named = known.join(several.select(F.col("a").alias("id")), "id", "left_semi").select(F.col("id").alias("a"), "name")
    copies = named.join(classes.select("name", F.col("id").alias("b")), "name").where("a <> b").select("a", "b")
    members = classes.select("id", "n", F.posexplode("bands").alias("place", "band"))
    turn = F.element_at(F.array(*(F.lit(int(x)) for x in mix64(np.arange(LEADERS, dtype=U)).view(np.int64))), F.pmod("place", F.lit(LEADERS)) + 1)
    shared = members.groupBy("band", turn.alias("turn")).agg(F.count("*").alias("k"), F.min(F.col("id").bitwiseXOR(turn)).alias("least"))
    shared = shared.where("k > 1").select("band", F.col("least").bitwiseXOR(F.col("turn")).alias("leader"))
    members = written(members.join(shared, "band").select("band", "id", "n", "leader"), "members")

    stars = members.where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b"))
    links = written(_verified(stars.distinct(), texts, words, percent), "links")
    parts = written(connected_components(links), "parts")
    placed = members.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("part", F.coalesce("component", "id"))
    apart = placed.groupBy("band").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q")
    ties = placed.join(apart.select("band"), "band", "left_semi").select("id", "n", "part", "leader")
    ties = written(ties.distinct(), "apart")
    more = written(_linked_apart(ties, texts, words, percent), "links")

    found = written(connected_components(links.union(more).union(copies)), "components")
    owned = classes.select("name", "id").join(found.withColumnRenamed("node", "id"), "id", "left")
    owned = written(owned.select("name", F.coalesce("component", "id").alias("component")), "owned")
    for x in (classes, members, links, parts, ties, more, found):
        drop(x)
    alone = F.col("id").isNull() | F.col("name").isNull()
    linked = table.where(~alone).join(owned, "name").select("id", "n", "component")
    linked = linked.union(table.where(alone).select("id", "n", F.col("id").alias("component")))
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True))
    return linked.select("id", F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))

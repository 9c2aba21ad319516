"""Packets as a stream: each is folded into the canonical messages when it is complete."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.keys import message_fingerprint, message_key
from ..operators.messages import latest_by_key, occurrence_ordinal
from ..sources.shared import Versions, folder_bytes, subfolders

_KEY = ["source_kind", "source_thread_key", "fp", "occurrence"]
_BUCKETS, _SEEN = "buckets", "batch of "
#: Bytes of a bucket from which it is split in two.
SPLIT = 512 << 20


def _leaf(name: str) -> tuple[int, int]:
    """Modulus and remainder of a bucket named ``bucket=<modulus>_<remainder>``."""
    modulus, remainder = name.removeprefix("bucket=").split("_")
    return int(modulus), int(remainder)


def _bucketed(rows: DataFrame, leaves: list[tuple[int, int]], buckets: int) -> DataFrame:
    """``rows`` with ``bucket``: that of ``leaves`` whose remainder their thread's hash leaves, else of ``buckets``."""
    key = F.xxhash64("source_kind", "source_thread_key")
    name = lambda m: F.concat(F.lit(f"{m}_"), F.pmod(key, F.lit(m)).cast("string"))
    found = name(buckets)
    for m in sorted({m for m, _ in leaves if m > buckets}):
        found = F.when(F.pmod(key, F.lit(m)).isin([r for n, r in leaves if n == m]), name(m)).otherwise(found)
    return rows.withColumn("bucket", found)


def _deltas(value: str) -> list[tuple[str, int]]:
    return [(v, int(n)) for v, _, n in (x.partition(":") for x in value.split(","))]


def _told(deltas: list[tuple[str, int]]) -> str:
    return ",".join(f"{v}:{n}" for v, n in deltas)


def _due(sizes: list[int]) -> int:
    """From where on deltas are merged: the first that is no larger than all after it together. So sizes fall at least
    by half from one to the next, a bucket has few, and a row is written again about as often as its bucket doubles."""
    return next((i for i in range(len(sizes) - 1) if sizes[i] <= sum(sizes[i + 1 :])), len(sizes))


def _write(rows: DataFrame, path: str, version: str) -> dict[str, int]:
    """Write rows by bucket; the buckets that have some, with their bytes."""
    rows.write.partitionBy("bucket").parquet(f"{path}/version={version}")
    spark, folder = rows.sparkSession, f"{path}/version={version}"
    return {name: folder_bytes(spark, f"{folder}/{name}") for name in subfolders(spark, folder, "bucket=")}


def _fold(batch: DataFrame, batch_id: int, read_packets: Callable[[DataFrame], DataFrame], path: str, buckets: int, source: str, split: int) -> None:
    """Number a batch's whole packets, append them to the buckets of their threads, and publish that."""
    spark = batch.sparkSession
    versions = Versions(spark, path)
    if (held := versions.parts.get(_BUCKETS, str(buckets))) != str(buckets):
        raise ValueError(f"{path} has {held} buckets, not {buckets}")
    if int(versions.parts.get(_SEEN + source, -1)) >= batch_id:
        return  # published before, and only the stream's own record of it was lost
    rows = read_packets(batch)
    if "fp" not in rows.columns:
        rows = rows.withColumn("fp", message_fingerprint(F.col("payload"))).drop("payload")
    rows = occurrence_ordinal(rows.dropDuplicates(["export_root", "source_kind", "source_thread_key", "import_seq"]))
    rows = rows.withColumn("source_message_key", message_key(F.col("ts_ms"), F.col("fp"), F.col("occurrence")))
    leaves = [_leaf(k) for k in versions.parts if k.startswith("bucket=")]
    new = versions.new()
    try:
        sizes = _write(_bucketed(rows, leaves, buckets), path, new)
        grown = {name: ",".join(filter(None, [versions.parts.get(name), f"{new}:{n}"])) for name, n in sizes.items()}
        versions.publish({_BUCKETS: str(buckets), _SEEN + source: str(batch_id)} | grown)
    finally:
        versions.done(new)
    compact(spark, path, rows.schema, list(grown), split)


def compact(spark: SparkSession, path: str, schema, names: list[str] | None = None, split: int = SPLIT) -> None:
    """Merge deltas of the buckets ``names`` (else all) where enough have come together, and split a bucket whose merged
    rows are over ``split`` bytes. Readers see the old deltas or the merged ones, and a compaction that dies leaves the
    old."""
    versions = Versions(spark, path)
    due = {}
    for name in names if names is not None else [k for k in versions.parts if k.startswith("bucket=")]:
        deltas = _deltas(versions.parts[name])
        if (start := _due([n for _, n in deltas])) < len(deltas):
            due[name] = (deltas[:start], deltas[start:])
    if due:
        paths = [f"{path}/version={v}/{name}" for name, (_, late) in due.items() for v, _ in late]
        rows = latest_by_key(spark.read.schema(schema).parquet(*paths), _KEY)
        wide = {name for name, (early, late) in due.items() if not early and sum(n for _, n in late) > split}
        leaves, gone = [], []
        for name in due:
            m, r = _leaf(name)
            leaves += [(2 * m, r), (2 * m, r + m)] if name in wide else [(m, r)]
            gone += [name] if name in wide else []
        new = versions.new()
        try:
            sizes = _write(_bucketed(rows, leaves, int(versions.parts[_BUCKETS])), path, new)
            early = {name: due[name][0] for name in due if name not in wide}
            versions.publish(dict.fromkeys(gone) | {name: _told([*early.get(name, []), (new, n)]) for name, n in sizes.items()})
        finally:
            versions.done(new)
    versions.sweep([path])


def _read(spark: SparkSession, path: str, versions: Versions, schema) -> DataFrame | None:
    """The current rows with what later deltas replace; None without any."""
    wanted = [(v, k) for k, value in versions.parts.items() if k.startswith("bucket=") for v, _ in _deltas(value)]
    if not wanted:
        return None
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.option("basePath", path).parquet(*(f"{path}/version={v}/{k}" for v, k in sorted(wanted))).drop("version", "bucket")


def accumulated(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The messages that are folded in so far, deltas merged; no packet yet is an error unless ``schema`` is given."""
    found = _read(spark, path, Versions(spark, path), schema)
    if found is None and schema is None:
        raise ValueError(f"nothing is accumulated below {path}")
    return spark.createDataFrame([], schema) if found is None else latest_by_key(found, _KEY)


def accumulate_packets(
    spark: SparkSession, manifest: str, schema: str, read_packets: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, buckets: int = 64, split: int = SPLIT
) -> StreamingQuery:
    """Fold packets that ``manifest`` (a folder of Parquet files, one row per complete packet) newly names into the
    messages below ``path``, and stop.

    ``read_packets`` turns manifest rows into all messages of those packets. The n-th occurrence of a payload in one
    export meets the n-th in any other, and the last ``import_seq`` wins, so neither the order in which packets arrive
    nor a replay changes the result. All history counts, hence no watermark.

    History is a log: a batch appends its own rows, whatever there is before, to ``buckets`` of threads (a number that is
    fixed for a path; a bucket of over ``split`` bytes is split), readers merge, and deltas are merged when those after one
    are as large as it. A batch is published with its number in the stream, so one that is run again after it was
    published does nothing, and one that dies before leaves the old history whole and is folded again.
    """
    stream = spark.readStream.schema(schema).parquet(manifest)
    source = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    fold = lambda batch, number: _fold(batch, number, read_packets, path, buckets, source, split)
    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(fold).start()

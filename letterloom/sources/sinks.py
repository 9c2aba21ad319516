"""Writers: canonical tables by source and account, views, and the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .shared import Versions, exists, subfolders

PARTITIONS = ("source_kind", "export_account")
_NO_ACCOUNT = "_"


def _part(kind: str, account: str | None) -> str:
    return f"{kind}/{account or _NO_ACCOUNT}"


def write_canonical(tables: dict[str, DataFrame], path: str, scope: dict[str, list[str | None]], versions: Versions | None = None) -> None:
    """Replace the projections in ``scope`` (source kind to accounts) in every table and leave all others alone.

    Everything is written into a new version first. Then one file names that version for all accounts of the scope, in
    all tables, also where it has no rows, so that what a source no longer has disappears; a writer that dies before
    leaves the old state whole, and one that began before another published gets an error: it began when ``versions``
    was read, which a gate may have done. What no state of the last two names any more is then deleted.
    """
    spark = next(iter(tables.values())).sparkSession
    versions = versions or Versions(spark, path)
    new = versions.new()
    try:
        for name, df in tables.items():
            account = F.coalesce(F.col("export_account"), F.lit(_NO_ACCOUNT)) if "export_account" in df.columns else F.lit(_NO_ACCOUNT)
            df.withColumn("export_account", account).write.partitionBy(*PARTITIONS).parquet(f"{path}/{name}/version={new}")
        versions.publish({_part(kind, a): new for kind, accounts in scope.items() for a in accounts})
    finally:
        versions.done(new)
        versions.sweep([f"{path}/{name}" for name in tables])


def read_canonical(spark: SparkSession, path: str, name: str, schema: str | None = None, versions: Versions | None = None) -> DataFrame:
    """The current rows of a table, or those of the state of ``versions``. Kinds and accounts are text whatever they look
    like (``007`` is not 7)."""
    current = (versions or Versions(spark, path)).parts
    places = {(v, *part.split("/", 1)) for part, v in current.items()}
    paths = sorted({f"{path}/{name}/version={v}" for v, _, _ in places if exists(spark, f"{path}/{name}/version={v}")})
    if not paths:
        return spark.createDataFrame([], schema or "source_kind string, export_account string")
    found = spark.read.option("basePath", f"{path}/{name}").option("mergeSchema", True).parquet(*paths).schema
    texts = ("version", *PARTITIONS)
    plain = StructType([f for f in found if f.name not in texts] + [StructField(c, StringType()) for c in texts])
    rows = spark.read.schema(plain).option("basePath", f"{path}/{name}").parquet(*paths)
    wanted = F.lit(False)
    for v in sorted({v for v, _, _ in places}):
        own = [f"{kind}/{account}" for w, kind, account in sorted(places) if w == v]
        wanted = wanted | ((F.col("version") == v) & F.concat_ws("/", *PARTITIONS).isin(own))
    rows = rows.where(wanted).drop("version")
    return rows.withColumn("export_account", F.nullif(F.col("export_account"), F.lit(_NO_ACCOUNT)))


#: How the rows of a view are ordered, missing last messages first.
ORDERS = {
    "people": ("display_name",),
    "person_threads": ("identity_key", "last_message_at", "source_kind", "title"),
    "group_threads": ("group_key", "source_kind", "title"),
    "group_members": ("group_key", "display_name"),
    "timelines": ("identity_key", "rank"),
    "media": ("identity_key", "rank"),
    "transcripts": ("view_name", "line_no"),
}


def in_order(name: str, df: DataFrame) -> DataFrame:
    """A view sorted as ``ORDERS`` says, by ranges, so that no view and no thread is one task."""
    keys = [F.asc_nulls_first(k) for k in ORDERS.get(name, ())]
    return df.orderBy(*keys) if keys else df


#: By which column the rows of a view are dealt into buckets that are rewritten alone; other views are one bucket.
VIEW_KEYS = {"person_threads": "identity_key", "group_threads": "group_key", "group_members": "group_key", "timelines": "identity_key", "media": "identity_key", "transcripts": "view_name"}


def _digests(lines: DataFrame) -> dict[int, str]:
    """What each bucket of JSON lines holds, whatever the order: their number and sums of two hashes."""
    sums = [F.sum(h.cast("decimal(38,0)")).cast("string") for h in (F.xxhash64("value"), F.xxhash64("value", F.lit(1)))]
    return {r[0]: r[1] for r in lines.groupBy("bucket").agg(F.concat_ws("_", F.count("*").cast("string"), *sums)).collect()}


def write_views(views: dict[str, DataFrame], path: str, buckets: int = 64) -> dict[str, list[int]]:
    """Write each view as JSON in its order, and return the buckets of each that were written.

    A view's rows are dealt into buckets by the person, group or thread that they show, and a digest of every bucket is
    kept. Of a view that is there already only the buckets whose digest has changed are written; those that have gone are
    taken out; the rest stays as it is. One file then names what is current of all views, so that a writer that dies
    leaves all old views. ``transcripts`` are rows of lines, a long thread in several files. A first rendering computes
    a view once and takes the digests from what it has written; a later one computes it for the digests, and its
    changed buckets again.
    """
    spark = next(iter(views.values())).sparkSession
    versions = Versions(spark, path)
    new, changes, wrote = None, {}, {}
    try:
        for name, df in views.items():
            key = VIEW_KEYS.get(name)
            dealt = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int") if key else F.lit(0))
            old = {int(k.rpartition("/")[2]): v.partition(":")[2] for k, v in versions.parts.items() if k.startswith(f"{name}/")}
            now = _digests(dealt.select("bucket", F.to_json(F.struct(*df.columns)).alias("value"))) if old else None
            changed = None if now is None else sorted(b for b in now if now[b] != old.get(b))
            if changed != []:
                new = new or versions.new()
                rows = dealt if changed is None else dealt.where(F.col("bucket").isin(changed))
                keys = [F.asc_nulls_first(k) for k in ORDERS.get(name, ())]
                rows = rows.repartitionByRange("bucket", *keys).sortWithinPartitions("bucket", *keys) if key else in_order(name, rows)
                folder = f"{path}/{name}/version={new}"
                rows.write.partitionBy("bucket").json(folder)
                if now is None:
                    now = _digests(spark.read.schema("value string, bucket int").text(folder)) if subfolders(spark, folder, "bucket=") else {}
                    changed = sorted(now)
                changes |= {f"{name}/{b}": f"{new}:{now[b]}" for b in changed}
            changes |= {f"{name}/{b}": None for b in old if b not in now}
            wrote[name] = changed
        if changes:
            versions.publish(changes)
    finally:
        if new:
            versions.done(new)
            versions.sweep([f"{path}/{name}" for name in views])
    return wrote


def read_view(spark: SparkSession, path: str, name: str, schema: str | None = None) -> DataFrame:
    """The current rows of a view; one without rows has no columns unless ``schema`` is given."""
    current = Versions(spark, path).parts
    places = [f"{path}/{name}/version={v.partition(':')[0]}/bucket={k.rpartition('/')[2]}" for k, v in sorted(current.items()) if k.startswith(f"{name}/")]
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(places) if places else spark.createDataFrame([], schema or "struct<>")


def append_run_log(summary: DataFrame, path: str) -> None:
    summary.coalesce(1).write.mode("append").json(path)

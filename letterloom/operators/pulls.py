"""What to fetch: packets, files below them, and where they go."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.keys import export_date_key


def active_accounts(registry: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Enabled accounts with a valid key that are not excluded."""
    good = registry.where(F.col("enabled") & F.col("account_key").rlike(r"^[a-z0-9][a-z0-9._-]*$"))
    return good.join(exclusions.select("account_key"), "account_key", "left_anti")


#: The type of a folder in a listing, and the statuses of packets that are not fetched again.
FOLDER, DONE = "application/vnd.google-apps.folder", ("completed", "no-message-files")


def select_packets(listing: DataFrame, prefix: str | None, default: str = "instagram-", latest_only: bool = False) -> DataFrame:
    """Folders whose name is the prefix and then a date, oldest first by (date, path); names that merely begin alike are
    left out, and what is no folder where the listing has ``mime_type``. Without a prefix any packet of the provider
    counts."""
    name = F.col("name")
    if "mime_type" in listing.columns:
        listing = listing.where(F.col("mime_type") == FOLDER)
    if prefix is None:
        fits = name.startswith(default)
    else:
        fits = name.startswith(prefix) & F.substr(name, F.lit(len(prefix) + 1)).rlike(r"^20\d{2}-\d{2}-\d{2}(-|$)")
    dated = listing.where(fits).withColumn("date_key", export_date_key(name))
    if latest_only:
        return dated.orderBy(F.desc("date_key"), F.desc("path")).limit(1)
    return dated.orderBy("date_key", "path")


def message_subtree_only(listing: DataFrame, roots: list[str]) -> DataFrame:
    """Downloadable files below one of the folders; provider-native documents have no bytes to fetch."""
    below = F.lit(False)
    for root in roots:
        below = below | F.col("path").startswith(root.rstrip("/") + "/")
    return listing.where(below & ~F.coalesce(F.col("mime_type"), F.lit("")).startswith("application/vnd.google-apps."))


def plan_pulls(packets: DataFrame, completed: DataFrame) -> DataFrame:
    """Packets that are not complete: none with their id and path is recorded as completed or without message files."""
    done = completed.where(F.col("status").isin(*DONE)).select("id", "path")
    return packets.join(done, ["id", "path"], "left_anti")


def changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are new or differ in modification time, size or checksum from what was fetched."""
    old = manifest.select("id", F.col("modified").alias("_m"), F.col("size").alias("_s"), F.col("md5").alias("_c"), F.lit(True).alias("_known"))
    same = F.col("_known").isNotNull() & F.col("modified").eqNullSafe(F.col("_m")) & F.col("size").eqNullSafe(F.col("_s")) & F.col("md5").eqNullSafe(F.col("_c"))
    return files.join(old, "id", "left").where(~same).drop("_m", "_s", "_c", "_known")


def unique_targets(listing: DataFrame) -> DataFrame:
    """``listing`` with ``target``: the path, which belongs to the id that has it first, and for other ids of the same
    path the path with part of their id before the extension. ``seq`` orders the listing."""
    later = F.first("id").over(Window.partitionBy("path").orderBy("seq", "id")) != F.col("id")
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    suffix = F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)
    stem = F.expr("substr(_name, 1, length(_name) - length(_suffix))")
    marked = listing.withColumn("_name", name).withColumn("_suffix", suffix).withColumn("_folder", folder)
    other = F.concat("_folder", stem, F.lit("--"), F.substring("id", 1, 8), "_suffix")
    return marked.withColumn("target", F.when(later, other).otherwise(F.col("path"))).drop("_name", "_suffix", "_folder")

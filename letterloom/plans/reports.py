"""What to fetch and how fresh each account is, from listings to a plan and a logged report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.keys import export_account_key
from ..operators import pulls, rollups
from ..sources.packets import scan_packets
from ..sources.sinks import append_run_log


def plan_fetch(
    listing: DataFrame, files: DataFrame, completed: DataFrame, manifest: DataFrame, prefix: str | None, roots: list[str]
) -> dict[str, DataFrame]:
    """``packets`` (those selected), ``pending`` (those not complete), ``files`` (what to fetch and its ``target``) and
    ``skipped`` (path and reason of files of pending packets that are not wanted or cannot be fetched).

    ``listing``: id, name, path, mime_type. ``files``: packet_id, id, path (below the packet), mime_type, modified, size,
    md5, can_download, seq. No packet of the name and a date is an error, as then nothing would ever be fetched.
    """
    packets = pulls.select_packets(listing, prefix)
    if packets.isEmpty():
        raise ValueError("no packet folder has the wanted name and a date")
    pending = pulls.plan_pulls(packets, completed)
    below = files.join(pending.select(F.col("id").alias("packet_id"), F.col("path").alias("_packet")), "packet_id")
    inside = F.lit(False)
    for root in roots:
        inside = inside | F.col("path").startswith(root.rstrip("/") + "/")
    native = F.coalesce(F.col("mime_type"), F.lit("")).startswith("application/vnd.google-apps.")
    reason = F.when(~inside, "outside").when(native, "provider document").when(~F.coalesce("can_download", F.lit(True)), "no download")
    marked = below.withColumn("reason", reason).withColumn("path", F.concat_ws("/", "_packet", "path"))
    named = pulls.unique_targets(marked.where("reason is null").drop("reason", "_packet"))
    return {"packets": packets, "pending": pending, "files": pulls.changed_files(named, manifest), "skipped": marked.where("reason is not null").select("id", "path", "reason")}


def check_freshness(
    files: DataFrame, provider: str, accounts: DataFrame, previous: DataFrame, checked_at: str, log: str | None = None
) -> dict[str, DataFrame]:
    """``packets`` (inventory, no body is read), ``report`` (per account) and ``status`` (of all), appended to ``log``
    as one line per account if a path is given. ``files`` has ``path`` and ``modificationTime``."""
    packets = scan_packets(files, provider).withColumn("account_key", export_account_key(F.col("name"), provider))
    report = rollups.freshness_report(accounts, packets, previous, checked_at)
    if log:
        append_run_log(report.withColumn("checked_at", F.lit(checked_at)), log)
    return {"packets": packets, "report": report, "status": rollups.aggregate_status(report)}

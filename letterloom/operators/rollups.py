"""Counts, bounds, summaries and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.keys import ACTIVITY

THREAD = ["source_kind", "source_thread_key"]


def thread_bounds(messages: DataFrame) -> DataFrame:
    return messages.groupBy(*THREAD).agg(F.min("sent_at").alias("first_message_at"), F.max("sent_at").alias("last_message_at"))


def thread_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy(*THREAD).agg(F.count("*").alias("message_count"))


def media_per_message(media: DataFrame) -> DataFrame:
    return media.groupBy(*THREAD, "source_message_key").agg(F.count("*").alias("media_count"))


def person_summary(identities: DataFrame, participants: DataFrame, threads: DataFrame, messages: DataFrame, media: DataFrame) -> DataFrame:
    """Per person: accounts, direct and group threads, messages and media in those threads, first and last message.

    Messages and media are counted per thread before any participant is joined. A media row belongs to one message of
    one thread, so sums over a person's distinct threads are distinct counts.
    """
    per_thread = thread_counts(messages).join(thread_bounds(messages), THREAD)
    per_media = media.groupBy(*THREAD).agg(F.count("*").alias("media_count"))
    facts = threads.select(*THREAD, "thread_kind").join(per_thread, THREAD, "left").join(per_media, THREAD, "left")
    distinct = participants.select("identity_key", *THREAD).distinct().join(facts, THREAD)
    sums = distinct.groupBy("identity_key").agg(
        F.count_if(F.col("thread_kind") != "group").alias("direct_threads"),
        F.count_if(F.col("thread_kind") == "group").alias("group_threads"),
        F.sum(F.coalesce("message_count", F.lit(0))).alias("messages"),
        F.sum(F.coalesce("media_count", F.lit(0))).alias("media"),
        F.min("first_message_at").alias("first_seen"),
        F.max("last_message_at").alias("last_seen"),
    )
    owned = participants.select("identity_key", "account_source_kind", "account_key").distinct()
    owned = owned.groupBy("identity_key").agg(F.count("*").alias("accounts"))
    people = identities.where("kind = 'person'").select(F.col("stable_key").alias("identity_key"), "display_name")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        people.join(sums, "identity_key", "left")
        .join(owned, "identity_key", "left")
        .select("identity_key", "display_name", zero("accounts"), zero("direct_threads"), zero("group_threads"), zero("messages"), zero("media"), "first_seen", "last_seen")
    )


def import_summary(threads: DataFrame, people: DataFrame, messages: DataFrame, media: DataFrame, extra_accounts: int = 0) -> DataFrame:
    """Per source kind and packet: imports, distinct threads, groups, accounts, messages and media; then totals, which
    are sums over packets (so a thread in two packets counts twice). Each input names its packet in ``source_path``."""
    key = ["source_kind", "source_path"]
    parts = [
        threads.groupBy(*key).agg(
            F.count_distinct("source_thread_key").alias("threads"),
            F.count_distinct(F.when(F.col("thread_kind") == "group", F.col("source_thread_key"))).alias("groups"),
        ),
        people.groupBy(*key).agg((F.count_distinct("account_source_kind", "account_key") + extra_accounts).alias("accounts")),
        messages.groupBy(*key).agg(F.count_distinct("source_thread_key", "source_message_key").alias("messages")),
        media.groupBy(*key).agg(F.count_distinct("object_key").alias("media")),
    ]
    each = parts[0]
    for part in parts[1:]:
        each = each.join(part, key, "full")
    names = ["threads", "groups", "accounts", "messages", "media"]
    each = each.select(*key, F.lit(1).alias("imports"), *(F.coalesce(n, F.lit(0)).alias(n) for n in names))
    return each.rollup(*key).agg(*(F.sum(n).alias(n) for n in ["imports", *names]))


def projection_counts(tables: dict[str, DataFrame], source_kind: str) -> DataFrame:
    """Rows of every canonical table that belong to one source kind, as one row per table."""
    out = None
    for name, df in tables.items():
        part = df.where(F.col("source_kind") == source_kind).agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
        out = part if out is None else out.unionByName(part)
    return out


def account_scoped_threads(threads: DataFrame, provider: str) -> DataFrame:
    """Threads whose key is an account, a colon and a path below the activity folder or ``messages``, with
    ``export_account`` taken from it."""
    parts = F.split("source_thread_key", ":", 2)
    path = F.try_element_at(parts, F.lit(2))
    scoped = path.startswith(f"{ACTIVITY[provider]}/") | path.startswith("messages/")
    return threads.where((F.col("source_kind") == provider) & scoped & (parts[0] != "")).withColumn("export_account", parts[0])


def account_thread_counts(threads: DataFrame, provider: str) -> DataFrame:
    return account_scoped_threads(threads, provider).groupBy("export_account").agg(F.count("*").alias("threads"))


def freshness_report(accounts: DataFrame, packets: DataFrame, previous: DataFrame, checked_at) -> DataFrame:
    """Per account: message files and distinct completed packets, whether history is covered (its baseline packet is
    there), status, and when it last succeeded.

    ``accounts``: account_key, baseline_export_name, origin. ``packets``: account_key, name, message_files.
    ``previous``: account_key, last_success_at. Without packets an account is pending; else its origin decides.
    """
    found = packets.join(accounts.select("account_key", "baseline_export_name"), "account_key", "inner").groupBy("account_key").agg(
        F.sum("message_files").alias("message_files"),
        F.count_distinct("name").alias("completed_exports"),
        F.bool_or(F.coalesce(F.col("name") == F.col("baseline_export_name"), F.lit(False))).alias("covered"),
    )
    origin = F.col("origin")
    status = (
        F.when(F.coalesce("completed_exports", F.lit(0)) == 0, "pending").when(origin == "provider-current", "current")
        .when(origin == "last-known-good", "degraded").when(origin == "local", "local-current").otherwise("local-fallback")
    )
    joined = accounts.join(found, "account_key", "left").join(previous, "account_key", "left").withColumn("status", status)
    good = F.col("status").isin("current", "local-current")
    return joined.select(
        "account_key", "status",
        F.coalesce("message_files", F.lit(0)).cast("long").alias("message_files"),
        F.coalesce("completed_exports", F.lit(0)).cast("long").alias("completed_exports"),
        F.when(F.coalesce("covered", F.lit(False)), "complete-through-latest-export").otherwise("baseline-required").alias("history_coverage"),
        F.when(good, F.lit(checked_at)).otherwise(F.col("last_success_at")).alias("last_success_at"),
    )


def aggregate_status(report: DataFrame) -> DataFrame:
    """One status for all accounts: not configured without any, else pending before degraded before current."""
    rank = F.max(F.when(F.col("status") == "pending", 2).when(F.col("status") == "degraded", 1).otherwise(0))
    name = F.when(F.count("*") == 0, "not-configured").when(rank == 2, "pending").when(rank == 1, "degraded").otherwise("current")
    return report.agg(name.alias("status"), F.count("*").alias("accounts"), F.count_if(F.col("status") != "pending").alias("accounts_ready"))


def graph_counts(identities: DataFrame, threads: DataFrame, messages: DataFrame) -> DataFrame:
    kinds = identities.agg(F.count_if(F.col("kind") == "person").alias("people"), F.count_if(F.col("kind") == "group").alias("groups"))
    return kinds.crossJoin(threads.agg(F.count("*").alias("threads"))).crossJoin(messages.agg(F.count("*").alias("messages")))

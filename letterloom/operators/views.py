"""Views of people, groups and threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.keys import group_key, thread_key
from ..sources.shared import once
from ..functions.text import snippet, strip_space
from .rollups import THREAD, thread_counts

#: Fixed value: what stands for a body without text.
NO_TEXT = "[no text]"


def person_threads(identities: DataFrame, participants: DataFrame, threads: DataFrame, messages: DataFrame) -> DataFrame:
    """Distinct threads of each identity with their number of messages."""
    mine = participants.select("identity_key", *THREAD).distinct()
    known = identities.select(F.col("stable_key").alias("identity_key"))
    counted = threads.join(thread_counts(messages), THREAD, "left")
    counted = counted.select(*THREAD, "title", "thread_kind", F.coalesce("message_count", F.lit(0)).alias("message_count"), "last_message_at")
    return mine.join(known, "identity_key", "left_semi").join(counted, THREAD)


def group_members(edges: DataFrame, identities: DataFrame) -> DataFrame:
    member = edges.where("from_kind = 'identity' and edge_kind = 'has_participant'").select(F.col("from_key").alias("group_key"), F.col("to_key").alias("stable_key"))
    return member.distinct().join(identities.select("stable_key", "display_name"), "stable_key")


def group_threads(edges: DataFrame, threads: DataFrame) -> DataFrame:
    owned = edges.where("edge_kind = 'represents_group'").select("from_key", F.col("to_key").alias("group_key")).distinct()
    keyed = threads.withColumn("from_key", thread_key(F.col("source_kind"), F.col("source_thread_key")))
    return owned.join(keyed, "from_key").drop("from_key")


def messages_with_sender(messages: DataFrame, identities: DataFrame, accounts: DataFrame) -> DataFrame:
    """Messages with ``sender``: the identity's name, else the account's, else Unknown."""
    named = identities.select(F.col("stable_key").alias("sender_identity_key"), F.col("display_name").alias("_person"))
    owned = accounts.select(F.col("source_kind").alias("sender_account_source_kind"), F.col("account_key").alias("sender_account_key"), F.col("display_name").alias("_account"))
    joined = messages.join(named, "sender_identity_key", "left").join(owned, ["sender_account_source_kind", "sender_account_key"], "left")
    return joined.withColumn("sender", F.coalesce("_person", "_account", F.lit("Unknown"))).drop("_person", "_account")


def media_in_threads(media: DataFrame, participants: DataFrame) -> DataFrame:
    """Media that an identity can see: those of messages in its threads."""
    return media.join(participants.select("identity_key", *THREAD).distinct(), THREAD)


def thread_roster(participants: DataFrame, identities: DataFrame, accounts: DataFrame) -> DataFrame:
    """Distinct people of each thread by the name that is shown."""
    named = identities.select(F.col("stable_key").alias("identity_key"), F.col("display_name").alias("_person"))
    owned = accounts.select(F.col("source_kind").alias("account_source_kind"), "account_key", F.col("display_name").alias("_account"))
    joined = participants.join(named, "identity_key", "left").join(owned, ["account_source_kind", "account_key"], "left")
    return joined.select(*THREAD, "role", F.coalesce("_person", "_account", "account_key", F.lit("Unknown")).alias("label")).dropDuplicates()


def _top(df: DataFrame, keys: list[str], shown: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` distinct rows by what is shown of them, per key."""
    distinct = Window.partitionBy(*keys, *shown).orderBy(*order)
    ranked = Window.partitionBy(*keys).orderBy(*order)
    once = df.withColumn("_d", F.row_number().over(distinct)).where("_d = 1").drop("_d")
    return once.withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") <= k).drop("_r")


def person_timeline(messages: DataFrame, participants: DataFrame, threads: DataFrame, k: int = 40) -> DataFrame:
    """The ``k`` latest messages of all of a person's threads that differ in what is shown, newest first.

    A row that is among a person's first k has fewer than k better ones in its own thread, so each thread is cut to k
    before participants are joined; the fan-out is k rows per participant, however long the thread. ``messages`` has
    ``sender`` and ``import_seq``.
    """
    shown = ["sent_at", "sender", "body_text"]
    order = [F.desc("sent_at"), F.desc("import_seq"), F.desc("source_thread_key"), F.desc("source_message_key")]
    own = messages.select(*THREAD, "source_message_key", *shown, "import_seq")
    best = _top(own, THREAD, shown, order, k)
    mine = participants.select("identity_key", *THREAD).distinct()
    each = mine.join(best.join(threads.select(*THREAD, "title", "thread_kind"), THREAD), THREAD)
    found = _top(each, ["identity_key"], ["source_kind", "title", "thread_kind", *shown], order, k)
    rank = F.row_number().over(Window.partitionBy("identity_key").orderBy(*order))
    told = snippet(F.coalesce(F.nullif("body_text", F.lit("")), F.lit(NO_TEXT)))
    return found.select("identity_key", rank.alias("rank"), "source_kind", "title", "thread_kind", "sent_at", "sender", told.alias("snippet"))


def person_media(media: DataFrame, messages: DataFrame, participants: DataFrame, threads: DataFrame, k: int = 100) -> DataFrame:
    """The ``k`` latest media of all of a person's threads, cut per thread first like the timeline."""
    shown = ["sent_at", "source_uri", "local_path", "mime_type"]
    order = [F.desc("sent_at"), F.desc("object_key")]
    sent = messages.select(*THREAD, "source_message_key", "sent_at")
    own = media.join(sent, [*THREAD, "source_message_key"]).select(*THREAD, "object_key", *shown)
    best = _top(own, THREAD, shown, order, k)
    mine = participants.select("identity_key", *THREAD).distinct()
    each = mine.join(best.join(threads.select(*THREAD, "title"), THREAD), THREAD)
    found = _top(each, ["identity_key"], ["source_kind", "title", *shown], order, k)
    rank = F.row_number().over(Window.partitionBy("identity_key").orderBy(*order))
    return found.select("identity_key", rank.alias("rank"), "source_kind", "title", *shown)


def numbered_by_ranges(rows: DataFrame, groups: list[str], order: list[str], day, ranges: int | None = None) -> DataFrame:
    """``rows`` with ``number`` (from 1, in ``order`` within ``groups``) and ``opens``: whether its ``day`` differs from that
    of the row before. Rows are dealt by sampled ranges of groups and order, written once in the shared folder, and
    numbered within each range; a range adds what the ranges before hold of its group, and looks at the last day there. So
    a group of any size, also one whose rows are alike in all but the last of ``order``, is many tasks.
    """
    spark = rows.sparkSession
    number = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("day", day).repartitionByRange(number, *groups, *order).withColumn("range", F.spark_partition_id())
    dealt = once(dealt, "ranges")
    parts = dealt.groupBy(*groups, "range").agg(F.count("*").alias("n"), F.max_by(F.struct("day"), F.struct(*order)).alias("last"))
    along = Window.partitionBy(*groups).orderBy("range")
    before = F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*groups, "range", before.alias("base"), F.lag("last").over(along).alias("left"))
    own = Window.partitionBy(*groups, "range").orderBy(*order)
    each = dealt.withColumn("r", F.row_number().over(own)).withColumn("earlier", F.lag(F.struct("day")).over(own)).join(parts, [*groups, "range"])
    earlier = F.coalesce("earlier", "left")
    opens = earlier.isNull() | ~earlier.getField("day").eqNullSafe(F.col("day"))
    return each.withColumn("number", F.col("base") + F.col("r")).withColumn("opens", opens).drop("r", "earlier", "left", "base", "range", "day")


def transcript_lines(messages: DataFrame, media_counts: DataFrame | None = None, ranges: int | None = None) -> DataFrame:
    """Lines of every thread's transcript in order: a heading where the day changes, then time, sender and text, or what
    stands for it, then the number of attachments.

    Rows are lines, never gathered; they are numbered by ranges, so that a long thread is many tasks, whatever its times.
    """
    joined = messages
    if media_counts is not None:
        joined = messages.join(media_counts, [*THREAD, "source_message_key"], "left")
    n = F.coalesce("media_count", F.lit(0)) if media_counts is not None else F.lit(0)
    joined = joined.select(*THREAD, "sent_at", "import_seq", "source_message_key", "sender", "body_text", n.alias("attached"))
    day = F.date_format(F.coalesce("sent_at", F.timestamp_seconds(F.lit(0))), "yyyy-MM-dd")
    numbered = numbered_by_ranges(joined, THREAD, ["sent_at", "import_seq", "source_message_key"], day, ranges)
    n = F.col("attached")
    text = F.coalesce(F.nullif(strip_space(F.col("body_text")), F.lit("")), F.lit(NO_TEXT))
    line = F.concat(F.date_format("sent_at", "HH:mm:ss"), F.lit(" "), F.col("sender"), F.lit(": "), text)
    attached = F.when(n > 0, F.concat(F.lit("["), n.cast("string"), F.when(n == 1, " media attachment]").otherwise(" media attachments]")))
    heading = F.when(F.col("opens"), F.concat(F.lit("## "), F.date_format("sent_at", "yyyy-MM-dd")))
    marked = numbered.select(*THREAD, F.col("number").alias("message_no"), F.array_compact(F.array(heading, line, attached)).alias("lines"))
    return marked.select(*THREAD, "message_no", F.posexplode("lines").alias("part_no", "line"))


def stale_views(existing: DataFrame, active: DataFrame) -> DataFrame:
    return existing.join(active.select("view_name").distinct(), "view_name", "left_anti")


def thread_groups(threads: DataFrame) -> DataFrame:
    return threads.withColumn("group_key", group_key(F.col("source_kind"), F.col("source_thread_key")))

"""Messages: occurrence numbers, last and first writers, and the merge of overlapping exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.keys import message_fingerprint, message_key
from ..sources.shared import once


#: What tells a payload of a thread from others.
PAYLOAD = ["source_kind", "source_thread_key", "fp"]

#: Rows that one task joins, sorts or tells apart.
TASK_ROWS = 1 << 18


def parts_for(*tables: DataFrame) -> int:
    """How many parts the largest of ``tables`` is dealt out to, so that what a task holds does not grow with the table
    (Spark's own number is fixed, or follows packed bytes, which narrow rows exceed many times in memory). Small tables
    are dealt to as many tasks as may run at once."""
    rows = max(t.count() for t in tables)
    return max(-(-rows // TASK_ROWS), min(tables[0].sparkSession.sparkContext.defaultParallelism, 1 + rows // 10_000))


def occurrence_ordinal(messages: DataFrame) -> DataFrame:
    """``occurrence``: how many equal payloads the same export has before this one in the same thread, in file order."""
    own = Window.partitionBy("source_kind", "source_thread_key", "fp", "export_root").orderBy("import_seq")
    return messages.withColumn("occurrence", (F.row_number().over(own) - 1).cast("int"))


def latest_by_key(df: DataFrame, keys: list[str], order: str = "import_seq") -> DataFrame:
    """The row of each key that was imported last."""
    last = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def latest_small(df: DataFrame, keys: list[str], order: str = "import_seq") -> DataFrame:
    """The same for narrow rows: combined on the map side, so that a key with very many rows does not skew."""
    rest = [c for c in df.columns if c not in keys]
    found = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return found.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def first_by_key(df: DataFrame, keys: list[str], order: str = "import_seq") -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    found = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return found.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def merge_exports(messages: DataFrame) -> DataFrame:
    """Messages of overlapping exports, each payload as often as the export that holds it most often.

    A payload's n-th occurrence in one export is the n-th in any other; the last import wins. ``messages`` has
    ``source_kind``, ``source_thread_key``, ``export_root``, ``import_seq``, ``ts_ms`` and ``payload`` (or ``fp``). The
    rows are dealt out once by thread and payload, and both windows work on that: a thread however busy is many keys.
    """
    if "fp" not in messages.columns:
        messages = messages.withColumn("fp", message_fingerprint(F.col("payload")))
    dealt = messages.repartition("source_thread_key", "fp")
    numbered = occurrence_ordinal(dealt)
    kept = latest_by_key(numbered, ["source_kind", "source_thread_key", "fp", "occurrence"])
    return kept.withColumn("source_message_key", message_key(F.col("ts_ms"), F.col("fp"), F.col("occurrence")))


def merged_counts(merged: DataFrame) -> DataFrame:
    """The index of merged messages: how often each payload is in each thread, as ``most``."""
    return merged.groupBy(*PAYLOAD).agg(F.count("*").alias("most"))


def merge_new(index: DataFrame, exports: DataFrame, small: int = 1 << 17) -> DataFrame:
    """What ``exports`` add to the messages that ``index`` (as of ``merged_counts``) counts: the occurrences of a payload beyond those there
    are. Together with the messages that were there these are the ones of a merge of all exports, in whatever order they
    come; of equal payloads the first import stays named. ``exports`` has what ``merge_exports`` takes, and is read twice.

    A cumulative export holds little that is new. It is first counted by payload, on the map side, and only keys and counts
    are compared with the index; then only rows of payloads that occur more often than before are dealt out and numbered.
    Their keys go to every task if they are at most ``small``; else rows and keys meet in a shuffle.
    """
    if "fp" not in exports.columns:
        exports = exports.withColumn("fp", message_fingerprint(F.col("payload")))
    counts = exports.groupBy(*PAYLOAD, "export_root").agg(F.count("*").alias("n")).groupBy(*PAYLOAD).agg(F.max("n").alias("n"))
    grown = counts.join(index, PAYLOAD, "left").select(*PAYLOAD, F.coalesce("most", F.lit(0)).alias("most"), "n").where("n > most").drop("n")
    grown = once(grown, "grown")
    keys = F.broadcast(grown) if grown.count() <= small else grown
    numbered = occurrence_ordinal(exports.join(keys, PAYLOAD).repartition("source_thread_key", "fp")).where("occurrence >= most").drop("most")
    kept = latest_by_key(numbered, [*PAYLOAD, "occurrence"])
    return kept.withColumn("source_message_key", message_key(F.col("ts_ms"), F.col("fp"), F.col("occurrence")))


def union_sources(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for df in tables[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def chat_messages(tables: dict[str, DataFrame], parts: int | None = None) -> DataFrame:
    """Messages with their chat and sender's handle: a message in two chats is two rows, messages outside of chats and
    chats without messages are none. What else the relation of handles tells of one (``handle_key``, ``handle_name``) comes
    along, so that it is worked out per handle. ``parts`` (as of ``parts_for`` if not given) tasks join them."""
    parts = parts or parts_for(tables["chat_message_join"], tables["message"])
    chat = tables["chat"].select(F.col("ROWID").alias("chat_id"), F.col("guid").alias("chat_guid"), "chat_identifier", "display_name")
    more = [c for c in ("handle_key", "handle_name") if c in tables["handle"].columns]
    handle = tables["handle"].select(F.col("ROWID").alias("handle_id"), F.col("id").alias("handle"), *more)
    message = tables["message"].withColumnRenamed("ROWID", "message_id")
    placed = tables["chat_message_join"].repartition(parts, "message_id").join(message.repartition(parts, "message_id"), "message_id")
    joined = placed.join(chat, "chat_id").join(handle, "handle_id", "left")
    date = F.lpad((F.coalesce("date", F.lit(0)).cast("decimal(20,0)") + F.lit(10**18 * 9)).cast("string"), 20, "0")
    parts = F.array(F.lpad(F.col("chat_id").cast("string"), 20, "0"), date)
    seq = F.struct(F.lit(0).alias("source_seq"), parts.alias("path_parts"), F.col("message_id").cast("long").alias("pos"))
    return joined.withColumn("import_seq", seq)


def chat_participants(tables: dict[str, DataFrame]) -> DataFrame:
    """``chat_id`` and ``handles`` in order of handle id."""
    handle = tables["handle"].select(F.col("ROWID").alias("handle_id"), F.col("id").alias("handle"))
    each = tables["chat_handle_join"].join(handle, "handle_id")
    listed = each.groupBy("chat_id").agg(F.sort_array(F.collect_list(F.struct("handle_id", "handle"))).alias("found"))
    return listed.select("chat_id", F.filter(F.transform("found", lambda x: F.trim(x.handle)), lambda h: h != "").alias("handles"))


def message_attachments(tables: dict[str, DataFrame], parts: int | None = None) -> DataFrame:
    """``message_id`` with each attachment; its type is the MIME type or else the uniform type. ``parts`` (as of
    ``parts_for`` if not given) tasks join them."""
    parts = parts or parts_for(tables["message_attachment_join"], tables["attachment"])
    attachment = tables["attachment"].withColumnRenamed("ROWID", "attachment_id")
    placed = tables["message_attachment_join"].repartition(parts, "attachment_id")
    return placed.join(attachment.repartition(parts, "attachment_id"), "attachment_id").select(
        "message_id", "attachment_id", F.col("guid").alias("attachment_guid"), "filename",
        F.coalesce("mime_type", "uti").alias("mime_type"), "total_bytes",
    )

"""From packets or chat relations to canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import payloads
from ..functions.text import clean_text, handle_key
from ..functions.times import apple_date_to_ts, epoch_ms_to_ts
from ..operators import identity, messages as ops, rollups
from ..sources import packets
from ..sources.shared import once

#: What is stored of an import, by source and account; the other tables follow from these.
STORED = ("people", "threads", "messages", "media_objects")


def derived(stored: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All canonical tables from the stored ones. Identities and accounts are those of people that some source still
    has, so they need no deletion, and a group is any thread that was ever shown as one."""
    threads, people = stored["threads"], stored["people"]
    grouped = threads.where("ever_group")
    members = identity.participants(people)
    return stored | {
        "identities": identity.identities(people).unionByName(identity.group_identities(grouped)),
        "accounts": identity.accounts(people),
        "thread_participants": members,
        "graph_edges": identity.graph_edges(members, grouped),
    }


def _threads(facts: DataFrame, messages: DataFrame) -> DataFrame:
    """The last facts of each thread, whether any showed a group, and its bounds."""
    ever = facts.groupBy(*rollups.THREAD).agg(F.bool_or(F.col("thread_kind") == "group").alias("ever_group"))
    last = ops.latest_small(facts, rollups.THREAD).drop("import_seq")
    return last.join(ever, rollups.THREAD).join(rollups.thread_bounds(messages), rollups.THREAD, "left")


def import_packets(
    files: DataFrame, provider: str, account: str | None = None, registry: DataFrame | None = None,
    source_seq: int | str = 0, fail_fast: bool = False, large: int = packets.RANGE,
) -> dict[str, DataFrame]:
    """Canonical tables of export packets, and ``rejects``: files that are no message files, with the reason.

    ``files`` has ``path`` and ``content``; where it has ``length`` and ``place`` too (``list_files``), a file of over
    ``large`` bytes is read by ranges of that size, in many tasks. Overlapping exports are merged by payload; facts of a thread are those of
    its last file, but a thread that any file shows as a group stays a group; missing times are 1970. ``warnings`` are
    the rejects and the files with elements that are no messages.

    The source is read and parsed once: what its files say and hold, or why they are rejected, is written in the shared
    folder, as are the merged messages, and all tables follow from these two. Accounts are counted on paths alone, those
    of unreadable files too.
    """
    named, listed = packets.named_packets(files, provider), "length" in files.columns
    scoped = lambda df: packets.scoped_threads(df, account, named)
    whole = files.where(F.col("length") <= large) if listed else files
    each = packets.told_by_files(scoped(packets.read_message_files(whole, provider, source_seq)))
    long = packets.told_by_large_files(files, provider, source_seq, large, scoped) if listed else None
    told, rejects = packets.split_valid(once(each if long is None else each.unionByName(long), "parsed"))
    if fail_fast and (bad := rejects.limit(1).collect()):
        raise ValueError(f"{bad[0]['path']}: {bad[0]['warning']}")
    facts = packets.file_threads(told)
    each = told.where(packets.is_message(F.col("payload"))).select(
        "source_kind", "export_account", "export_root", "source_thread_key", "import_seq", "payload",
        F.try_variant_get("payload", "$.timestamp_ms", "long").alias("ts_ms"),
        identity.sender_name(F.try_variant_get("payload", "$.sender_name", "string"), provider).alias("sender_name"),
    )
    merged = once(ops.merge_exports(each), "merged")
    people = once(identity.thread_people(facts, merged, registry), "people")
    sender = people.select(
        "source_kind", "source_thread_key", F.col("name").alias("sender_name"), F.col("identity_key").alias("sender_identity_key"),
        F.col("account_source_kind").alias("sender_account_source_kind"), F.col("account_key").alias("sender_account_key"),
    )
    bodies = merged.select(
        "source_kind", "export_account", "export_root", "source_thread_key", "source_message_key", "sender_name", "import_seq", "payload",
        epoch_ms_to_ts(F.col("ts_ms")).alias("sent_at"),
        payloads.message_body(F.col("payload")).alias("body_text"),
    )
    kept = bodies.join(sender, ["source_kind", "source_thread_key", "sender_name"], "left")
    media = payloads.explode_media(bodies, provider)
    stored = {
        "people": people,
        "threads": _threads(facts.drop("names", "export_root"), bodies),
        "messages": kept.select(
            "source_kind", "export_account", "source_thread_key", "source_message_key", "sender_identity_key",
            "sender_account_source_kind", "sender_account_key", "sent_at", "body_text", F.lit("plain").alias("body_format"),
            F.to_json("payload").alias("raw_json"), "import_seq",
        ),
        "media_objects": ops.latest_small(media, ["object_key"]).drop("import_seq"),
    }
    return derived(stored) | {"rejects": rejects, "warnings": rejects.unionByName(packets.dropped_elements(told))}


def _chat_people(rows: DataFrame, chats: DataFrame, me: list[str], me_name: str) -> DataFrame:
    """Who is in each thread, at most once per chat and handle: the listed handles of its chats, the owner, and senders.
    Rosters are joined to chats, of which ``chats`` is one row each, and never to messages."""
    spoken = lambda kind, key, role, identity: [kind.alias("account_source_kind"), key.alias("account_key"), F.lit(role).alias("role"), identity.alias("identity_key")]
    listed = chats.select(*rollups.THREAD, F.explode("handles").alias("name"), "import_seq")
    key = handle_key(F.col("name"))
    listed = listed.select(*rollups.THREAD, "name", "import_seq", *spoken(F.lit("imessage"), key, "participant", F.when(key.isin(me), "person:self").otherwise(F.concat(F.lit("person:imessage:"), key))))
    owner = chats.select(*rollups.THREAD, F.lit(me_name).alias("name"), "import_seq", *spoken(F.lit("self"), F.lit("self"), "self", F.lit("person:self")))
    sent = rows.where("sender_account_source_kind <> 'self'").groupBy(*rollups.THREAD, "sender_name", "sender_account_source_kind", "sender_account_key", "sender_identity_key").agg(F.max("import_seq").alias("import_seq"))
    sent = sent.select(*rollups.THREAD, F.col("sender_name").alias("name"), "import_seq", *spoken(F.col("sender_account_source_kind"), F.col("sender_account_key"), "participant", F.col("sender_identity_key")))
    people = listed.unionByName(owner).unionByName(sent).groupBy(*rollups.THREAD, "name", "account_source_kind", "account_key", "role", "identity_key").agg(F.max("import_seq").alias("import_seq"))
    shown = F.when(F.col("identity_key") == "person:self", F.lit(me_name)).otherwise(F.col("name"))
    return people.select("*", F.lit("person").alias("identity_kind"), shown.alias("display_name"), F.lit(None).cast("string").alias("export_account"))


def import_chat(tables: dict[str, DataFrame], me_handles: list[str] = (), me_name: str = "Me") -> dict[str, DataFrame]:
    """Canonical tables of a chat database's relations; the owner is ``person:self``. Joined messages are written once in
    the shared folder, as are people, and all tables follow from these. What a chat is called and who is in it is joined
    to chats, not to messages, so people are as many as chats have members and senders. Messages and media are dealt out
    by their keys to parts of like size, and each is sorted once there."""
    kind, me = F.lit("imessage"), [h.lower() for h in me_handles] or [""]
    handle = F.col("id")
    known = tables["handle"].select("ROWID", "id", handle_key(handle).alias("handle_key"), F.coalesce(F.nullif(clean_text(handle), F.lit("")), F.lit("unknown")).alias("handle_name"))
    parts = ops.parts_for(tables["chat_message_join"], tables["message"])
    joined = ops.chat_messages(tables | {"message": payloads.with_bodies(tables["message"]), "handle": known}, parts)
    mine = F.coalesce(F.col("is_from_me"), F.lit(0)) == 1
    who = F.coalesce("handle_key", F.lit("unknown"))
    own = mine | who.isin(me)
    thread = F.coalesce("chat_guid", F.concat(F.lit("chat:"), F.col("chat_id").cast("string")))
    rows = joined.select(
        kind.alias("source_kind"), F.lit(None).cast("string").alias("export_account"), thread.alias("source_thread_key"), "chat_id", "message_id",
        F.coalesce("guid", F.concat(F.lit("message:"), F.col("message_id").cast("string"))).alias("source_message_key"),
        F.when(own, "person:self").otherwise(F.concat(F.lit("person:imessage:"), who)).alias("sender_identity_key"),
        F.when(mine, "self").otherwise("imessage").alias("sender_account_source_kind"),
        F.when(mine, "self").otherwise(who).alias("sender_account_key"),
        F.when(own, F.lit(me_name)).otherwise(F.coalesce("handle_name", F.lit("unknown"))).alias("sender_name"),
        apple_date_to_ts(F.col("date")).alias("sent_at"), "body_text", F.lit("plain").alias("body_format"),
        payloads.provenance_json("chat_id", "message_id", "guid", "service").alias("raw_json"), "import_seq",
    )
    dealt = rows.repartition(parts, "source_thread_key", "source_message_key")
    rows = once(ops.latest_by_key(dealt, ["source_kind", "source_thread_key", "source_message_key"]), "messages")
    handles = F.coalesce("handles", F.array().cast("array<string>"))
    named = tables["chat"].withColumnRenamed("ROWID", "chat_id").join(ops.chat_participants(tables), "chat_id", "left").select(
        "chat_id", handles.alias("handles"), payloads.chat_kind(F.col("display_name"), handles).alias("thread_kind"),
        payloads.chat_title(F.col("display_name"), handles, F.col("chat_identifier"), F.lit(me_name)).alias("title"),
    )
    heard = rows.groupBy(*rollups.THREAD, "export_account", "chat_id").agg(F.max("import_seq").alias("import_seq"))
    chats = once(heard.join(named, "chat_id"), "chats")
    parts = max(parts, ops.parts_for(tables["message_attachment_join"], tables["attachment"]))
    attached = ops.message_attachments(tables, parts).repartition(parts, "message_id")
    sent = rows.select("message_id", *rollups.THREAD, "export_account", "source_message_key", "import_seq").repartition(parts, "message_id")
    media = sent.join(attached, "message_id").select(
        F.concat_ws(":", kind, "source_message_key", F.coalesce("attachment_guid", F.col("attachment_id").cast("string"))).alias("object_key"),
        *rollups.THREAD, "export_account", "source_message_key", F.col("filename").alias("source_uri"), F.col("filename").alias("local_path"), "mime_type", "import_seq",
    ).repartition(parts, "object_key")
    return derived({
        "people": once(_chat_people(rows, chats, me, me_name), "people"),
        "threads": _threads(chats.select(*rollups.THREAD, "export_account", "title", "thread_kind", "import_seq"), rows),
        "messages": rows.drop("chat_id", "message_id", "sender_name"),
        "media_objects": ops.latest_small(media, ["object_key"]).drop("import_seq"),
    })

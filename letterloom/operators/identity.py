"""Who is who: senders, owners, identities, accounts, participants and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.keys import group_key, thread_key
from ..functions.text import clean_text, with_slug
from .messages import first_by_key, latest_small


def owner_names(registry: DataFrame) -> DataFrame:
    """``export_account``, ``person_slug`` and the owner's identity and name, one row per own name of an account."""
    each = registry.select(F.col("account_key").alias("export_account"), "owner_identity_key", "owner_kind", "display_name", F.explode("self_names").alias("self_name"))
    each = with_slug(each.withColumn("self_name", clean_text(F.col("self_name"))), "self_name", "person_slug")
    return each.groupBy("export_account", "person_slug").agg(
        F.first("owner_identity_key").alias("owner_key"), F.first("owner_kind").alias("owner_kind"), F.first("display_name").alias("owner_name")
    )


def resolve_people(names: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """``names`` (``source_kind``, ``export_account``, ``name``) with identity and account.

    A name is the person of its slug, unless it is one of the own names of the account's owner. An owner's account key
    is the name's slug, with Facebook the exporting account.
    """
    people = with_slug(names, "name", "person_slug")
    if registry is None:
        owned = people.select("*", *(F.lit(None).cast("string").alias(c) for c in ("owner_key", "owner_kind", "owner_name")))
    else:
        owned = people.join(owner_names(registry), ["export_account", "person_slug"], "left")
    own = F.col("owner_key").isNotNull()
    person = F.concat(F.lit("person:"), "source_kind", F.lit(":"), "person_slug")
    return owned.select(
        *names.columns,
        F.coalesce("owner_key", person).alias("identity_key"),
        F.coalesce("owner_kind", F.lit("person")).alias("identity_kind"),
        F.coalesce("owner_name", "name").alias("display_name"),
        F.col("source_kind").alias("account_source_kind"),
        F.when(own & (F.col("source_kind") == "facebook"), F.col("export_account")).otherwise(F.col("person_slug")).alias("account_key"),
    )


def thread_people(threads: DataFrame, messages: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Distinct people of each thread, those that files list and those that only send, resolved."""
    listed = threads.select("source_kind", "export_account", "source_thread_key", F.explode("names").alias("name"), "import_seq")
    sent = messages.select("source_kind", "export_account", "source_thread_key", F.col("sender_name").alias("name"), "import_seq")
    keys = ["source_kind", "export_account", "source_thread_key", "name"]
    each = listed.unionByName(sent).groupBy(*keys).agg(F.min("import_seq").alias("import_seq"))
    return resolve_people(each, registry)


def sender_name(c, provider: str):
    """The cleaned sender; a blank one is unknown by provider."""
    return F.coalesce(F.nullif(clean_text(c), F.lit("")), F.lit(f"Unknown {provider.capitalize()} Sender"))


def identities(people: DataFrame) -> DataFrame:
    rows = people.select(F.col("identity_key").alias("stable_key"), "display_name", F.col("identity_kind").alias("kind"), "import_seq")
    return latest_small(rows, ["stable_key"]).drop("import_seq")


def accounts(people: DataFrame) -> DataFrame:
    rows = people.select(F.col("account_source_kind").alias("source_kind"), "account_key", "identity_key", F.col("name").alias("display_name"), "import_seq")
    return latest_small(rows, ["source_kind", "account_key"]).drop("import_seq")


def participants(people: DataFrame) -> DataFrame:
    """One row per thread, account and role; the first identity that was seen is kept."""
    role = F.col("role") if "role" in people.columns else F.lit("participant")
    rows = people.select("source_kind", "source_thread_key", "account_source_kind", "account_key", role.alias("role"), "identity_key", "import_seq")
    return first_by_key(rows, ["source_kind", "source_thread_key", "account_source_kind", "account_key", "role"]).drop("import_seq")


def graph_edges(participants: DataFrame, group_threads: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Edges thread to participant, group thread to its group, and group to member. ``group_threads`` names the threads
    (source_kind, source_thread_key) that any file or relation showed as a group."""
    thread, group = (k(F.col("source_kind"), F.col("source_thread_key")) for k in (thread_key, group_key))
    edge = lambda df, fk, f, kind, tk, t: df.select(F.lit(fk).alias("from_kind"), f.alias("from_key"), F.lit(kind).alias("edge_kind"), F.lit(tk).alias("to_kind"), t.alias("to_key"), F.col("source_kind").alias("source"))
    groups = group_threads.select("source_kind", "source_thread_key").distinct()
    members = participants.join(groups, ["source_kind", "source_thread_key"], "left_semi")
    return (
        edge(participants, "thread", thread, "has_participant", "identity", F.col("identity_key"))
        .union(edge(groups, "thread", thread, "represents_group", "identity", group))
        .union(edge(members, "identity", group, "has_participant", "identity", F.col("identity_key")))
        .dropDuplicates()
    )


def group_identities(threads: DataFrame) -> DataFrame:
    return threads.select(group_key(F.col("source_kind"), F.col("source_thread_key")).alias("stable_key"), F.col("title").alias("display_name"), F.lit("group").alias("kind"))

"""Rebuilding a projection behind gates, and rendering the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import view_path, with_slug
from ..operators import rollups, views
from ..plans.imports import STORED, derived
from ..sources.shared import Versions
from ..sources.sinks import read_canonical, write_canonical, write_views


class Held(RuntimeError):
    """The projection stays as it is; the message says why."""


def rebuild_projection(
    spark: SparkSession, path: str, tables: dict[str, DataFrame], source_kind: str, accounts: list[str | None],
    ready: list[str | None], independent: bool = False,
) -> list[str | None]:
    """Replace the projections of ``accounts`` and return those replaced.

    With ``independent`` (Facebook) each account that is ready advances alone; else nothing does until all are. A
    candidate without messages never replaces one that has some; what it is compared with is the state that it replaces,
    and if another writer has changed that meanwhile, that is an error. What a source no longer has disappears, its people
    too: only the ``STORED`` tables are written, and ``canonical_graph`` derives the others from all sources.
    """
    waiting = [a for a in accounts if a not in ready]
    if waiting and not independent:
        raise Held(f"accounts are pending: {', '.join(map(str, waiting))}")
    going = [a for a in accounts if a in ready]
    name = F.coalesce(F.col("export_account"), F.lit("_"))
    new = {r[0]: r[1] for r in tables["messages"].groupBy(name).count().collect()}
    versions = Versions(spark, path)
    kept = read_canonical(spark, path, "messages", versions=versions).where(F.col("source_kind") == source_kind)
    old = {r[0]: r[1] for r in kept.groupBy(name).count().collect()}
    for account in going:
        key = account or "_"
        if old.get(key) and not new.get(key):
            raise Held(f"the new projection of {key} is empty and the old one is not")
    scoped = {}
    for table, df in tables.items():
        if table in STORED:
            scoped[table] = df.where((F.col("source_kind") == source_kind) & name.isin([a or "_" for a in going]))
    write_canonical(scoped, path, {source_kind: going}, versions)
    return going


def canonical_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All canonical tables of what is stored below ``path``, over all sources and accounts."""
    versions = Versions(spark, path)
    return derived({name: read_canonical(spark, path, name, versions=versions) for name in STORED})


def render_graph(tables: dict[str, DataFrame], path: str | None = None) -> dict[str, DataFrame]:
    """All views of the canonical tables, written below ``path`` if one is given, each in its order. Tables that are
    costly to compute should be stored ones: most views read messages and participants."""
    identities, threads, messages = tables["identities"], tables["threads"], tables["messages"]
    members, media = tables["thread_participants"], tables["media_objects"]
    sent = views.messages_with_sender(messages, identities, tables["accounts"])
    people = rollups.person_summary(identities, members, threads, messages, media)
    named = with_slug(people, "display_name", "slug")
    people = named.withColumn("view_path", view_path(F.lit("person"), F.col("slug"), F.col("identity_key"))).drop("slug")
    lines = views.transcript_lines(sent, rollups.media_per_message(media))
    titled = with_slug(threads.select(*rollups.THREAD, "title"), "title", "slug").select(*rollups.THREAD, F.concat("slug", F.lit("--"), F.substring(F.sha2(F.concat_ws(":", *rollups.THREAD), 256), 1, 8)).alias("view_name"))
    lines = lines.join(titled, rollups.THREAD).select("view_name", (F.col("message_no") * 4 + F.col("part_no")).alias("line_no"), "line")
    out = {
        "people": people,
        "person_threads": views.person_threads(identities, members, threads, messages),
        "timelines": views.person_timeline(sent, members, threads),
        "media": views.person_media(media, messages, members, threads),
        "group_members": views.group_members(tables["graph_edges"], identities),
        "group_threads": views.group_threads(tables["graph_edges"], threads),
        "rosters": views.thread_roster(members, identities, tables["accounts"]),
        "transcripts": lines,
        "manifest": rollups.graph_counts(identities, threads, messages),
    }
    if path:
        write_views(out, path)
    return out

"""What a message payload or a conversation holds: bodies, participants, titles, media."""

from __future__ import annotations

import plistlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from .text import clean_text

MEDIA_KINDS = {
    "instagram": ("photos", "videos", "audio_files", "files", "gifs"),
    "facebook": ("photos", "videos", "audio_files", "files", "gifs", "sticker"),
}


def _bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a column that is worked out once, however often ``f`` names it; within branches and lambdas Spark shares
    nothing."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def message_body(payload: Column) -> Column:
    """The cleaned content; else what was shared, text above link; else null."""
    found = F.array(*(F.try_variant_get(payload, p, "string") for p in ("$.content", "$.share.share_text", "$.share.link")))
    some = lambda x, i: F.nullif(F.get(x, F.lit(i)), F.lit(""))
    body = lambda x: F.coalesce(some(x, 0), F.nullif(F.concat_ws("\n", some(x, 1), some(x, 2)), F.lit("")))
    return _bound(F.transform(found, clean_text), body)


def participant_names(payload: Column) -> Column:
    """Cleaned names of a file's participants, objects or plain strings, distinct in their order."""
    people = F.coalesce(F.try_variant_get(payload, "$.participants", "array<variant>"), F.array().cast("array<variant>"))
    told = lambda p: F.coalesce(F.try_variant_get(p, "$.name", "string"), F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")))
    return F.array_distinct(F.filter(F.transform(F.transform(people, told), clean_text), lambda n: n != ""))


def listed_title(names: Column) -> Column:
    """The first four names, and dots if there are more; null without names."""
    more = lambda n: F.when(F.size(n) > 4, "...").otherwise("")
    return _bound(names, lambda n: F.when(F.size(n) > 0, F.concat(F.array_join(F.slice(n, 1, 4), ", "), more(n))))


def packet_title(title: Column, names: Column, folder: Column) -> Column:
    return F.coalesce(F.nullif(clean_text(title), F.lit("")), listed_title(names), folder)


def chat_title(display_name: Column, handles: Column, identifier: Column, owner: Column) -> Column:
    given, known = F.nullif(clean_text(display_name), F.lit("")), F.nullif(clean_text(identifier), F.lit(""))
    return F.coalesce(given, listed_title(handles), known, F.nullif(owner, F.lit("")), F.lit("iMessage"))


def packet_kind(names: Column) -> Column:
    return F.when(F.size(names) > 2, "group").otherwise("direct")


def chat_kind(display_name: Column, handles: Column) -> Column:
    return F.when((F.size(handles) > 1) | (clean_text(display_name) != ""), "group").otherwise("direct")


def explode_media(messages: DataFrame, provider: str) -> DataFrame:
    """One row per media item with a uri: key, kind, place in its kind's list (counted before items without a uri are
    left out), uri, and its path below the export root unless that is absolute.

    ``messages`` has ``payload``, ``export_root``, ``source_thread_key`` and ``source_message_key``.
    """

    def items(kind: str) -> Column:
        found = F.try_variant_get("payload", f"$.{kind}", "array<variant>")
        single = F.try_variant_get("payload", f"$.{kind}", "variant")
        found = F.coalesce(found, F.when(F.schema_of_variant(single).startswith("OBJECT"), F.array(single))) if kind == "sticker" else found
        return F.struct(F.lit(kind).alias("media_kind"), found.alias("items"))

    kinds = F.array(*(items(k) for k in MEDIA_KINDS[provider]))
    each = messages.withColumn("m", F.explode(kinds)).select("*", "m.media_kind", F.posexplode("m.items").alias("media_index", "item"))
    each = each.withColumn("source_uri", F.try_variant_get("item", "$.uri", "string")).where("source_uri <> ''")
    told = F.concat_ws(":", "source_thread_key", "source_message_key", "media_kind", F.col("media_index").cast("string"), "source_uri")
    key = F.concat(F.lit(f"{provider}:"), F.substring(F.sha2(told, 256), 1, 24))
    below = F.concat_ws("/", F.nullif(F.col("export_root"), F.lit("")), "source_uri")
    return each.select(
        key.alias("object_key"),
        *(c for c in ("source_kind", "export_account", "source_thread_key", "source_message_key", "import_seq") if c in messages.columns),
        "media_kind",
        "media_index",
        "source_uri",
        F.when(F.col("source_uri").startswith("/"), F.col("source_uri")).otherwise(below).alias("local_path"),
        F.try_variant_get("item", "$.mime_type", "string").alias("mime_type"),
    )


#: What archiver bookkeeping begins with; such strings are no message text.
BLOCKED = ("NS.", "NSMutable", "NSString", "NSNumber", "__kIM")


_PRINTABLE = re.compile(r"[\t\n\r -~]{3,}")


def _told(blob: bytes) -> Iterator[list[str]]:
    """What may be the text, by falling trust: the strings of a property list in their order, then printable runs."""
    try:
        todo, texts = [plistlib.loads(blob)], []
    except Exception:  # whatever the parser says of bytes that are no property list
        todo, texts = [], []
    while todo:
        top = todo.pop()
        if isinstance(top, str):
            texts.append(top)
        elif isinstance(top, (dict, list, tuple, set)):
            todo += reversed([*(top.values() if isinstance(top, dict) else top)])
    yield texts
    for encoding in ("utf-8", "utf-16le"):
        yield [run.strip() for run in _PRINTABLE.findall(blob.decode(encoding, "ignore"))]


def _body_of(blob: bytes | None) -> str | None:
    """The longest text of the first kind that has any, bookkeeping of the archiver left out."""
    for texts in _told(bytes(blob or b"")):
        body = max((t for t in texts if t.strip() and not t.strip().startswith(BLOCKED)), key=len, default=None)
        if body is not None:
            return body
    return None


@F.pandas_udf(StringType())
def _listed_body(blobs: pd.Series) -> pd.Series:
    return blobs.map(_body_of)


def is_property_list(blob: Column) -> Column:
    """Whether bytes begin as a property list, binary or as XML with or without a byte order mark."""
    return F.hex(F.substring(blob, 1, 8)).rlike("^(62706C6973743030|3C3F786D6C|3C706C697374|EFBBBF|FEFF|FFFE)")


def _longest(runs: Column) -> Column:
    """The longest of printable runs, the first of several, without the archiver's bookkeeping; null without any."""
    trimmed = F.transform(runs, lambda r: F.btrim(r, F.lit(" \t\n\r")))
    blocked = lambda r: reduce(Column.__or__, (r.startswith(b) for b in BLOCKED))
    said = F.filter(trimmed, lambda r: (r != "") & ~blocked(r))
    return F.array_max(F.transform(said, lambda r, i: F.struct(F.length(r).alias("n"), (-i).alias("i"), r.alias("text")))).getField("text")


def printable_body(blob: Column) -> Column:
    """The text in bytes that are no property list, all in the JVM: printable runs of the bytes as UTF-8 without what is
    none, else as UTF-16 (little end first)."""
    # A real replacement character parts a run; those that stand for broken bytes then go.
    utf8 = F.replace(F.make_valid_utf8(F.replace(blob.cast("string"), F.lit("\ufffd"), F.lit("\0"))), F.lit("\ufffd"), F.lit(""))
    narrow = _longest(F.regexp_extract_all(utf8, F.lit(r"[\t\n\r -~]{3,}"), F.lit(0)))
    units = F.regexp_replace(F.hex(blob), "(....)", "$1 ")
    units = F.regexp_replace(F.regexp_replace(units, "..D[89AB] ..D[C-F] ", "0000 "), "..D[89A-F] ", "")
    runs = F.regexp_extract_all(units, F.lit("(?:(?:09|0A|0D|[2-6][0-9A-F]|7[0-9A-E])00 ){3,}"), F.lit(0))
    wide = F.transform(runs, lambda r: F.unhex(F.regexp_replace(r, "(..)00 ", "$1")).cast("string"))
    return F.coalesce(narrow, _longest(wide))


def with_bodies(messages: DataFrame, text_col: str = "text", blob_col: str = "attributedBody", out_col: str = "body_text") -> DataFrame:
    """``messages`` with the text of each, or else what its archived body holds, in the place of the archived body. Only
    rows without text whose body is a property list go to Python, as a branch of their own; no row is read for nothing,
    as each branch filters its scan."""
    listed = (F.coalesce(F.col(text_col), F.lit("")) == "") & F.coalesce(is_property_list(F.col(blob_col)), F.lit(False))
    own = F.nullif(F.col(text_col), F.lit(""))
    plain = messages.where(~listed).withColumn(out_col, F.coalesce(own, printable_body(F.col(blob_col))))
    return plain.union(messages.where(listed).withColumn(out_col, _listed_body(F.col(blob_col)))).drop(blob_col)


def provenance_json(*columns: str) -> Column:
    """Selected source fields as JSON with sorted keys."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})

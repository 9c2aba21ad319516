"""Keys of threads, groups, messages and packets, and what packet paths say."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .canonical import canonical_json
from .text import stable_hash

ACTIVITY = {"instagram": "your_instagram_activity", "facebook": "your_facebook_activity"}


def thread_key(source_kind: Column, source_thread_key: Column) -> Column:
    return F.concat(F.lit("thread:"), source_kind, F.lit(":"), source_thread_key)


def group_key(source_kind: Column, source_thread_key: Column) -> Column:
    return F.concat(F.lit("group:"), source_kind, F.lit(":"), stable_hash(source_thread_key, 16))


def message_fingerprint(payload: Column) -> Column:
    """The SHA-256 of a payload (a VARIANT of ``parse_payload``) as canonical JSON, whatever the order of keys in the file."""
    return F.sha2(canonical_json(payload), 256)


def message_key(ts_ms: Column, fingerprint: Column, occurrence: Column) -> Column:
    ts = F.when(F.coalesce(ts_ms, F.lit(0)) == 0, "").otherwise(ts_ms.cast("string"))
    return F.concat(F.lit("v2:"), ts, F.lit(":"), F.substring(fingerprint, 1, 24), F.lit(":"), occurrence.cast("string"))


def is_message_file(path: Column, provider: str) -> Column:
    """Files named message.json or message_N.json; Facebook's must also lie below a ``messages`` folder, unless they are
    at the top."""
    parts = F.split(path, "/")
    named = F.element_at(parts, -1).rlike(r"^message(_\d+)?\.json$")
    if provider != "facebook":
        return named
    return named & (F.array_contains(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "messages") | (F.size(parts) == 1))


def export_root(path: Column, provider: str) -> Column:
    """The folder of the export that a file belongs to, relative to the source: what stands before the provider's
    activity folder, else before ``messages``, else nothing. Instagram's rule looks for ``messages`` too where the
    activity folder comes first."""
    parts = F.split(path, "/")
    activity, messages = (F.array_position(parts, x) for x in (ACTIVITY[provider], "messages"))
    before = lambda at: F.array_join(F.slice(parts, 1, F.greatest(at - 1, F.lit(0)).cast("int")), "/")
    if provider == "instagram":
        return F.when(activity > 1, before(activity)).when(messages > 1, before(messages)).otherwise("")
    return F.when(activity > 0, before(activity)).when(messages > 0, before(messages)).otherwise("")


def relative_thread_key(path: Column, provider: str) -> Column:
    """The thread's folder relative to the export root."""
    folder = F.regexp_replace(path, "/?[^/]*$", "")
    root = export_root(path, provider)
    return F.when(root == "", folder).otherwise(F.substr(folder, F.length(root) + 2))


def export_account_key(name: Column, provider: str) -> Column:
    """The account that a dated packet name holds; null if it holds none."""
    found = F.regexp_extract(F.trim(name), rf"(?i)^{provider}-(.+?)-\d{{4}}-\d{{2}}-\d{{2}}(?:-|$)", 1)
    key = F.lower(F.trim(found))
    key = F.ltrim(key, F.lit("@")) if provider == "instagram" else key
    return F.when(key != "", key)


def export_date_key(name: Column) -> Column:
    """Year, month and day of a packet name as one number, 0 without a date."""
    date = F.regexp_extract(name, r"-(20\d{2}-\d{2}-\d{2})(?:-|$)", 1)
    return F.coalesce(F.replace(date, F.lit("-"), F.lit("")).try_cast("int"), F.lit(0))


_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def freshness_key(path: Column, modified: Column) -> Column:
    """How new a packet is: the last path part that holds a date, as a number (Meta folders hold the time too), else
    the seconds of its modification time."""
    months = F.create_map(*(F.lit(x) for i, m in enumerate(_MONTHS, 1) for x in (m, i)))

    def dated(part: Column) -> Column:
        bits = F.split(part, "-")
        n = F.size(bits)
        at = lambda i: F.try_element_at(bits, F.lit(i)).try_cast("long")
        day = F.when(part.startswith("instagram-") & (n >= 5), at(-4) * 10000 + at(-3) * 100 + at(-2))
        month = F.try_element_at(months, F.lower(F.try_element_at(bits, F.lit(3)))).cast("long")
        time = ((((at(2) * 100 + month) * 100 + at(4)) * 100 + at(5)) * 100 + at(6)) * 100 + at(7)
        return F.coalesce(day, F.when(part.startswith("meta-") & (n >= 7), time))

    found = F.filter(F.transform(F.reverse(F.split(path, "/")), dated), lambda x: x.isNotNull())
    newest = F.try_element_at(found, F.lit(1))
    return F.when(F.coalesce(newest, F.lit(0)) > 0, newest).otherwise(F.coalesce(F.unix_timestamp(modified), F.lit(0)))

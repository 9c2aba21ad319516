"""Source times as timestamps; a missing or unreadable time is 1970."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed value: seconds from 1970 to 2001, where Apple's clock begins.
APPLE_EPOCH = 978307200


def epoch_ms_to_ts(c: Column, null_if_missing: bool = False) -> Column:
    ms = c.cast("string").try_cast("bigint")
    return F.timestamp_millis(ms if null_if_missing else F.coalesce(ms, F.lit(0)))


def apple_date_to_ts(c: Column, null_if_missing: bool = False) -> Column:
    """Nanoseconds since 2001 above 1e12 either way, seconds since 1970 above 1.5e9, else seconds since 2001."""
    raw = c.cast("string").try_cast("bigint")
    ts = (
        F.when(F.abs(raw) > 1_000_000_000_000, F.timestamp_micros(APPLE_EPOCH * 1_000_000 + F.call_function("div", raw + 500, F.lit(1000))))
        .when(raw > 1_500_000_000, F.timestamp_seconds(raw))
        .otherwise(F.timestamp_seconds(raw + APPLE_EPOCH))
    )
    return ts if null_if_missing else F.coalesce(ts, F.timestamp_seconds(F.lit(0)))

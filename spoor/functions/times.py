"""Session times as absolute ones and as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def absolute_time(wall_clock_utc: Column, ts_ns: Column) -> Column:
    """The timestamp of an event from the start of its session (RFC 3339 text) and the nanoseconds since."""
    return F.timestamp_micros(F.unix_micros(F.to_timestamp(wall_clock_utc)) + F.floor(ts_ns / 1000))


def clock(ts_ns: Column) -> Column:
    """``HH:MM:SS.mmm`` since the start of the session."""
    ms = F.floor(ts_ns / 1_000_000)
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, ms % 1000)


def seconds(ts_ns: Column) -> Column:
    """``s.mmms``."""
    ms = F.floor(ts_ns / 1_000_000)
    return F.format_string("%d.%03ds", F.floor(ms / 1000), ms % 1000)

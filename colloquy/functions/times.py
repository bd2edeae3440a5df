"""Offsets in microseconds: parsing and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000


def parse_offset(text: Column) -> Column:
    """``[h:]mm:ss[,.]mmm`` (milliseconds optional) as microseconds, null if it is none."""
    at = lambda i: F.regexp_extract(text, r"^\s*(?:(\d+):)?(\d{1,2}):(\d{2})(?:[.,](\d{1,3}))?\s*$", i)
    part = lambda i: F.coalesce(F.when(at(i) != "", at(i)).try_cast("long"), F.lit(0))
    return F.when(at(3) != "", ((part(1) * 60 + part(2)) * 60 + part(3)) * SECOND + F.rpad(F.when(at(4) == "", "0").otherwise(at(4)), 3, "0").cast("long") * 1000)


def hms(us: Column) -> Column:
    """HH:MM:SS; hours do not wrap at 24."""
    s = F.floor(us / SECOND)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def mmss(us: Column) -> Column:
    """MM:SS, from an hour on HH:MM:SS; negative offsets count as 0."""
    s = F.floor(F.greatest(us, F.lit(0)) / SECOND)
    return F.when(s >= 3600, hms(F.greatest(us, F.lit(0)))).otherwise(F.format_string("%02d:%02d", F.floor(s / 60), s % 60))


def total_minutes(us: Column) -> Column:
    """MM:SS with minutes beyond 59."""
    s = F.floor(us / SECOND)
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def format_bytes(n: Column) -> Column:
    kb = 1024.0
    tenth = lambda x: F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10)
    return F.when(n < kb, F.concat(n.cast("string"), F.lit(" B"))).when(n < kb**2, F.concat(tenth(n / kb), F.lit(" KB"))).when(n < kb**3, F.concat(tenth(n / kb**2), F.lit(" MB"))).otherwise(F.concat(F.format_string("%.2f", F.floor(n / kb**3 * 100 + 0.5) / 100), F.lit(" GB")))

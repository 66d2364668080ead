"""Media time as milliseconds; formats at the edges only. Fractions are true fractions and hours may pass 24."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def to_ms(code: Column) -> Column:
    """``[H:]MM:SS[.mmm]`` (comma or point) in milliseconds, null where it is no time code."""
    part = lambda k: F.regexp_extract(code, r"^(?:(\d+):)?(\d+):(\d+)(?:[.,](\d+))?$", k)
    whole = lambda k: F.coalesce(F.nullif(part(k), F.lit("")), F.lit("0")).cast("long")
    milli = F.substring(F.rpad(part(4), 3, "0"), 1, 3)
    return F.when(code.rlike(r"^(?:\d+:)?\d+:\d+(?:[.,]\d+)?$"), whole(1) * 3600000 + whole(2) * 60000 + whole(3) * 1000 + milli.cast("long"))


def from_ms(ms: Column) -> Column:
    pad = lambda x, n: F.when(F.length(x.cast("string")) >= n, x.cast("string")).otherwise(F.lpad(x.cast("string"), n, "0"))
    at = lambda size: F.floor(ms / size)
    return F.concat(pad(at(3600000), 2), F.lit(":"), pad(at(60000) % 60, 2), F.lit(":"), pad(at(1000) % 60, 2), F.lit("."), pad(ms % 1000, 3))


def difference(start: Column, end: Column) -> Column:
    """Null where the end comes before the start."""
    return F.when(end >= start, end - start)


def shift(ms: Column, by: Column, wrap: bool = False) -> Column:
    """``ms`` moved ``by`` milliseconds; ``wrap``: as a time of day, else any whole number."""
    return F.pmod(ms + by, F.lit(86_400_000)) if wrap else ms + by


def timestamp_token(ms: Column, begin: int = 50363) -> Column:
    """20 ms a token from ``begin``; null beyond 30 s."""
    return F.when(ms <= 30000, F.lit(begin) + F.floor(ms / 20))


def utterance_seconds(raw: Column) -> Column:
    """``SSSSSSCC`` to seconds."""
    n = F.length(raw)
    return F.substr(raw, F.lit(1), n - 2).cast("double") + F.substr(raw, n - 1, F.lit(2)).cast("double") / 100

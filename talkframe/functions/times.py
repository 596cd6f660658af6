"""Times as text and back; whole centiseconds or milliseconds inside, so that rounding carries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column, scale: int = 0) -> Column:
    return F.bround(x, scale)


def round_binary(x: Column, n: int) -> Column:
    """F8: x to n decimals as Python's round gives it: halves are told by the exact binary value (2.675 is below its half), true halves go to the even neighbour.

    The product x * 10 ** n is split into a double and what it lacks, so the comparison with the half is exact.
    """
    ten = F.lit(10.0**n)
    high = lambda v: v * F.lit(134217729.0) - (v * F.lit(134217729.0) - v)  # noqa: E731 (the upper half of a double's bits)
    p = x * ten
    xh, th = high(x), high(ten)
    lacks = ((xh * th - p) + xh * (ten - th) + (x - xh) * th) + (x - xh) * (ten - th)
    k = F.floor(p).cast("double")
    over = (p - k - 0.5) + lacks
    up = F.when(over > 0, 1.0).when(over < 0, 0.0).otherwise(F.abs(k) % 2)
    return F.when(F.isnan(x) | (F.abs(p) >= F.lit(2.0**51)), x).otherwise((k + up) / ten)


def format_time(cs: Column) -> Column:
    """H:MM:SS.cc of whole centiseconds."""
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)


def parse_time(text: Column) -> Column:
    """seconds of H:MM:SS.cc, M:SS or S; null for anything else."""
    parts = F.transform(F.split(text, ":"), lambda p: p.try_cast("double"))
    return F.when(F.size(parts) <= 3, F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60 + p))


def stamp(ms: Column, mark: str = ",", hours: bool = True) -> Column:
    """HH:MM:SS and milliseconds after `mark`; without `hours` only from one hour on."""
    h = F.floor(ms / 3600000)
    rest = F.format_string(f"%02d:%02d{mark}%03d", F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
    long = F.concat(F.format_string("%02d:", h), rest)
    return long if hours else F.when(h > 0, long).otherwise(rest)


def utc_created(ts: Column) -> Column:
    """F32: ISO 8601 to the second, in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def pcm_seconds(n_bytes: Column, rate: int = 16000, width: int = 2) -> Column:
    """seconds of so many bytes of mono PCM."""
    return n_bytes / F.lit(rate * width)


def lags(wall: Column, begun: Column, stream: Column, processed: Column, last_end: Column, covered: Column) -> Column:
    """transcription, processing, policy and speaker lags in seconds, none below 0, one decimal."""
    one = lambda x: F.round(F.greatest(x, F.lit(0.0)), 1)
    return F.struct(one(wall - begun - last_end).alias("transcription"), one(stream - processed).alias("processing"), one(processed - last_end).alias("policy"), one(stream - covered).alias("speakers"))

"""Functions on arrays, maps and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(scores: Column) -> Column:
    """index from 0 of the first maximum of an array; null for an empty one."""
    at = F.array_position(scores, F.array_max(scores))
    return F.when(at > 0, at - 1).cast("int")


def first_channels(scores: Column, n: int, channels: int | None = None) -> Column:
    """The first n scores; n must lie between 1 and the number of channels."""
    if n < 1 or (channels is not None and n > channels):
        raise ValueError("the number of speakers must lie between 1 and the number of channels")
    return F.slice(scores, 1, n)


def top_key(m: Column) -> Column:
    """the key of the largest value of a map, the first such entry on ties."""
    values = F.map_values(m)
    at = F.array_position(values, F.array_max(values))
    return F.when(at > 0, F.element_at(F.map_keys(m), at.cast("int")))


def speaker_label(index: Column) -> Column:
    """A to Z, AA to ZZ, AAA and on of an index from 0: numbers in base 26 without a zero; null below 0."""
    none = F.struct((index.cast("bigint") + 1).alias("left"), F.lit("").alias("out"))
    letter = lambda a: F.char(F.lit(65) + (a["left"] - 1) % 26)
    digit = lambda a, _: F.when(a["left"] > 0, F.struct(F.call_function("div", a["left"] - 1, F.lit(26)).alias("left"), F.concat(letter(a), a["out"]).alias("out"))).otherwise(a)
    return F.when(index >= 0, F.aggregate(F.sequence(F.lit(1), F.lit(14)), none, digit)["out"])


def speaker_index(speaker: Column) -> Column:
    """F16: a speaker's number less 1, not below 0; 0 for what is no number."""
    return F.greatest(F.coalesce(speaker.try_cast("int"), F.lit(1)) - 1, F.lit(0))


def words_payload(tokens: Column) -> Column:
    """word, start and end in milliseconds, nulls kept."""
    return F.transform(tokens, lambda t: F.struct(F.trim(t["text"]).alias("word"), (t["start_cs"] * 10).alias("start_ms"), (t["end_cs"] * 10).alias("end_ms")))

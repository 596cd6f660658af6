"""Streaming operators that Spark's own windows and state express."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def retention_seconds(requested: float | None, mode: str) -> float:
    """What was asked for wins, 0 or less is without limit; else 300 s for clients that keep a copy (diff), without limit for others."""
    if requested is not None:
        return math.inf if requested <= 0 else float(requested)
    return 300.0 if mode == "diff" else math.inf


def retained(items: DataFrame, seconds: float, end: str = "end_s", order: str = "seq") -> DataFrame:
    """Each session's items without the prefix that ended more than `seconds` before its latest end; what stands behind the first
    item that stays, stays too."""
    if seconds == math.inf:
        return items
    cutoff = F.max(end).over(Window.partitionBy("session_id")) - seconds
    upto = Window.partitionBy("session_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = items.withColumn("_c", cutoff).withColumn("_k", F.max((F.col(end) >= F.col("_c")) | (F.col("_c") <= 0)).over(upto))
    return rows.where("_k").drop("_c", "_k")


def pause_sessions(tokens: DataFrame, gap: str = "5 seconds", watermark: str = "10 seconds") -> DataFrame:
    """Runs of tokens with no pause of `gap` between, by event time (event_ts); works on streams and tables."""
    rows = tokens.withWatermark("event_ts", watermark) if tokens.isStreaming else tokens
    out = rows.groupBy("session_id", F.session_window("event_ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_tokens"))
    return out.select("session_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n_tokens")


def probes(rows: DataFrame, every: str = "1 second", watermark: str = "10 seconds") -> DataFrame:
    """One row per session and interval with the newest value in it."""
    rows = rows.withWatermark("event_ts", watermark) if rows.isStreaming else rows
    out = rows.groupBy("session_id", F.window("event_ts", every).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("event_ts", "value")).alias("last"))
    return out.select("session_id", F.col("w.start").alias("start_ts"), "n", F.col("last.value").alias("value"))


def newest_revision(spans: DataFrame, cumulative: bool, rev: str = "rev") -> DataFrame:
    """All spans of a source that appends, or those of each session's newest revision where each replaces the one before."""
    if not cumulative:
        return spans
    return spans.withColumn("_m", F.max(rev).over(Window.partitionBy("session_id"))).where(F.col(rev) == F.col("_m")).drop("_m")


def stalls(probed: DataFrame, seconds: float = 10.0) -> DataFrame:
    """Probes (session_id, event_ts, updated) with the seconds since the last one that brought an update, flagged beyond the limit."""
    by = Window.partitionBy("session_id").orderBy("event_ts").rowsBetween(Window.unboundedPreceding, 0)
    last = F.coalesce(F.max(F.when(F.col("updated"), F.col("event_ts"))).over(by), F.min("event_ts").over(by))
    idle = F.col("event_ts").cast("double") - last.cast("double")
    return probed.withColumn("idle_s", F.round(idle, 6)).withColumn("stalled", F.col("idle_s") > seconds)

"""Sinks of streams: full snapshots, changes and counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def snapshot_stream(lines: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Every micro-batch's sessions are handed to `write` with the batch's number; writing the same number twice must be harmless."""
    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_metrics(tokens: DataFrame, calls: DataFrame, audio: DataFrame) -> DataFrame:
    """session_id, n_tokens, n_calls, processing_s, audio_s, rtf: one row per session that any table knows."""
    t = tokens.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_tokens"))
    c = calls.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_calls"), (F.sum("dur_us") / 1e6).alias("processing_s"))
    a = audio.groupBy("session_id").agg(F.sum("audio_s").alias("audio_s"))
    out = t.join(c.hint("merge"), "session_id", "full").join(a.hint("merge"), "session_id", "full").fillna(0)
    return out.withColumn("rtf", F.when(F.col("audio_s") > 0, F.col("processing_s") / F.col("audio_s")).otherwise(0.0))

"""Voice activity, frame scores and audio spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkframe.functions.values import argmax, first_channels
from talkframe.operators.lines import islands


def vad_events(frames: DataFrame, threshold: float = 0.5, min_silence_samples: int = 1600, pad_samples: int = 480, frame_samples: int = 512) -> DataFrame:
    """session_id, kind (start, end), sample. Speech starts at a frame of at least `threshold`; it ends when frames below threshold
    - 0.15 have lasted `min_silence_samples` since the first of them with no frame of the threshold between. Samples are counted at the
    end of frames; a start is padded back to 0 at least, an end forward.

    Windows only: each high frame opens a group; the group's first low frame and its first frame far enough behind that give the end;
    a group is a start if the one before it has ended.
    """
    by = Window.partitionBy("session_id").orderBy("frame_ix")
    high, low = F.col("prob") >= threshold, F.col("prob") < threshold - 0.15
    rows = frames.withColumn("g", F.sum(high.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy("session_id", "g").orderBy("frame_ix").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("t0", F.min(F.when(low, F.col("end_sample"))).over(group))
    over = low & (F.col("end_sample") - F.col("t0") >= min_silence_samples)
    groups = rows.where("g > 0").groupBy("session_id", "g").agg(F.min("end_sample").alias("from"), F.min(F.when(over, F.col("t0"))).alias("to"))
    before = F.lag("to").over(Window.partitionBy("session_id").orderBy("g"))
    groups = groups.withColumn("starts", (F.col("g") == 1) | before.isNotNull())
    start = groups.where("starts").select("session_id", F.lit("start").alias("kind"), F.greatest(F.lit(0), F.col("from") - frame_samples - pad_samples).alias("sample"))
    end = groups.where("to IS NOT NULL").select("session_id", F.lit("end").alias("kind"), (F.col("to") + pad_samples - frame_samples).alias("sample"))
    return start.unionByName(end)


def segment_audio(events: DataFrame, totals: DataFrame) -> DataFrame:
    """session_id, no, kind (silence, speech), start_sample, end_sample: the stream from 0 to its total as alternating spans.
    It begins in silence; events are clamped to the stream; the last span closes at its end. Spans of no length are left out."""
    marks = events.join(totals.hint("merge"), "session_id").select("session_id", F.least(F.greatest("sample", F.lit(0)), "total").alias("at"), F.when(F.col("kind") == "start", "speech").otherwise("silence").alias("kind"))
    opened = totals.select("session_id", F.lit(-1).cast("bigint").alias("at"), F.lit("silence").alias("kind")).unionByName(marks)
    by = Window.partitionBy("session_id").orderBy("at", F.col("kind").desc())
    rows = opened.withColumn("change", F.coalesce(F.col("kind") != F.lag("kind").over(by), F.lit(True))).where("change")
    rows = rows.join(totals.hint("merge"), "session_id").withColumn("end_sample", F.coalesce(F.lead("at").over(by), F.col("total"))).withColumn("start_sample", F.greatest("at", F.lit(0)))
    rows = rows.where("end_sample > start_sample")
    return rows.select("session_id", F.row_number().over(by).alias("no"), "kind", "start_sample", "end_sample")


def active_clock(spans: DataFrame, rate: int = 16000) -> DataFrame:
    """The spans with the stream's position at their end, and the active part of it (samples)."""
    upto = Window.partitionBy("session_id").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    size = F.col("end_sample") - F.col("start_sample")
    return spans.withColumns({"position": F.sum(size).over(upto), "active": F.sum(F.when(F.col("kind") == "speech", size).otherwise(0)).over(upto)})


def frame_spans(frames: DataFrame, speakers: int, chunk_frames: int = 10, frame_cs: int = 8) -> DataFrame:
    """session_id, chunk_ix, span_ix, speaker, start_cs, end_cs: runs of the frame's highest of the first `speakers` scores
    inside each chunk; the last run reaches the chunk's end."""
    rows = frames.withColumns({"chunk_ix": F.floor(F.col("frame_ix") / chunk_frames).cast("int"), "speaker": argmax(first_channels(F.col("scores"), speakers))})
    by = Window.partitionBy("session_id", "chunk_ix").orderBy("frame_ix")
    rows = rows.withColumn("span_ix", islands(F.col("speaker") != F.lag("speaker").over(by), by))
    runs = rows.groupBy("session_id", "chunk_ix", "span_ix").agg(F.min("speaker").alias("speaker"), F.min("frame_ix").alias("f"))
    nxt = F.lead("f").over(Window.partitionBy("session_id", "chunk_ix").orderBy("span_ix"))
    end = F.coalesce(nxt, (F.col("chunk_ix") + 1) * chunk_frames)
    return runs.select("session_id", "chunk_ix", "span_ix", "speaker", (F.col("f") * frame_cs).alias("start_cs"), (end * frame_cs).alias("end_cs"))


def chunk_pcm(samples: DataFrame, seconds: float, rate: int = 16000, most_seconds: float = 5.0) -> DataFrame:
    """Rows (session_id, ix, value) as aligned chunks of at most five seconds: session_id, chunk_ix, n_samples, pcm. The remainder is the last chunk."""
    size = int(min(seconds, most_seconds) * rate)
    chunk = samples.groupBy("session_id", F.floor(F.col("ix") / size).alias("chunk_ix"))
    return chunk.agg(F.count(F.lit(1)).alias("n_samples"), F.transform(F.array_sort(F.collect_list(F.struct("ix", "value"))), lambda s: s["value"]).alias("pcm"))


def silent_sessions(sessions: DataFrame, tokens: DataFrame, seconds: float = 20.0) -> DataFrame:
    """Sessions (session_id, audio_s) with that much audio and no token."""
    return sessions.where(F.col("audio_s") >= seconds).join(tokens.select("session_id").hint("merge"), "session_id", "left_anti")

"""Operators with event-time state of their own: watchdogs over probes, retention, the transcription buffer, and sinks that deal rows to tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import BooleanType, DataType, DoubleType, LongType, StructField, StructType

from talkframe.operators.joins import in_ranges
from talkframe.streaming.folds import Row, leading, local_agreement

ALARM = "kind string, at_us bigint"


def shape(**kinds: type[DataType]) -> StructType:
    """The type of a state value; made without a session, as state is set up where there is none."""
    return StructType([StructField(name, kind()) for name, kind in kinds.items()])


def frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names, dtype=object)


class Dog:
    """X17, X18 for one session: what has been seen up to now, and what to tell. Probes come in the order of time, updates first."""

    def __init__(self, stall_us: int, silent_s: float, facts: tuple | None) -> None:
        self.stall_us, self.silent_s = stall_us, silent_s
        #: Time and audio of the last update (or the first probe), did audio go on within the limit, is the stall told, was there any update, is the silence told.
        self.since, self.audio, self.ahead, self.told, self.heard, self.silent = facts or (None, 0.0, False, False, False, False)

    def facts(self) -> tuple:
        return (self.since, self.audio, self.ahead, self.told, self.heard, self.silent)

    def due(self) -> int | None:
        return None if self.since is None or self.told else self.since + self.stall_us

    def elapsed(self, t: int) -> list[tuple[str, int]]:
        """All probes up to `t` are in."""
        due = self.due()
        if due is None or due > t:
            return []
        self.told = True
        return [("stalled", due)] if self.ahead else []

    def probe(self, t: int, audio: float, updated: bool) -> list[tuple[str, int]]:
        out = self.elapsed(t - 1)
        if updated or self.since is None:
            self.since, self.audio, self.ahead, self.told = t, audio, False, False
        elif t <= self.since + self.stall_us:
            self.ahead = self.ahead or audio > self.audio
        self.heard = self.heard or updated
        if not self.heard and not self.silent and audio >= self.silent_s:
            self.silent = True
            out.append(("silent", t))
        return out


def alarms(probes: DataFrame, stall_s: float = 10.0, silent_s: float = 20.0, delay_s: float = 0.0) -> DataFrame:
    """session_id, kind, at_us (microseconds). Probes: session_id, event_ts, audio_s (how far the audio is), updated (was there a token or a change of text).

    `stalled`, once for each update (or the first probe): none for more than `stall_s` after it, although audio went on meanwhile. `silent`, once for
    each session: `silent_s` of audio without any update. On a stream (with a watermark on event_ts) rows wait for the watermark, so their order does not matter, and
    timers tell the end of the limit without the session ending; on a table everything up to the latest time less `delay_s` is told.
    """
    stall_us = int(stall_s * 1_000_000)
    rows = probes.select("session_id", "event_ts", F.unix_micros("event_ts").alias("t"), F.col("audio_s").cast("double").alias("audio_s"), F.col("updated").alias("updated"))
    if probes.isStreaming:
        return _alarm_stream(rows, stall_us, silent_s)
    until = rows.agg(F.max("t")).first()[0]
    if until is None:
        return rows.select("session_id", F.lit("").alias("kind"), F.col("t").alias("at_us")).where("false")
    until -= int(delay_s * 1_000_000)
    order = ["t", F.col("updated").desc(), "audio_s"]
    by = Window.partitionBy("session_id").orderBy(*order)
    rows = rows.withColumn("epoch", F.sum(F.col("updated").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    silent = rows.where((F.col("epoch") == 0) & (F.col("audio_s") >= silent_s)).groupBy("session_id").agg(F.min("t").alias("at_us"))
    of_epoch = Window.partitionBy("session_id", "epoch").orderBy(*order)
    rows = rows.withColumns({"since": F.first("t").over(of_epoch), "from_s": F.first("audio_s").over(of_epoch)})
    went_on = (F.col("t") <= F.col("since") + stall_us) & (F.col("audio_s") > F.col("from_s"))
    epochs = rows.groupBy("session_id", "epoch").agg(F.min("since").alias("since"), F.bool_or(went_on).alias("ahead"))
    epochs = epochs.withColumn("next", F.lead("since").over(Window.partitionBy("session_id").orderBy("epoch"))).withColumn("at_us", F.col("since") + stall_us)
    stalled = epochs.where(F.col("ahead") & (F.col("next").isNull() | (F.col("next") > F.col("at_us"))))
    found = stalled.select("session_id", F.lit("stalled").alias("kind"), "at_us").unionByName(silent.select("session_id", F.lit("silent").alias("kind"), "at_us"))
    return found.where(F.col("at_us") <= until)


def _alarm_stream(rows: DataFrame, stall_us: int, silent_s: float) -> DataFrame:
    class Watch(StatefulProcessor):
        def init(self, handle: Any) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", shape(t=LongType, audio_s=DoubleType, updated=BooleanType))
            self.dog = handle.getValueState("dog", shape(since=LongType, audio=DoubleType, ahead=BooleanType, told=BooleanType, heard=BooleanType, silent=BooleanType))

        def rearm(self, due: int | None, first: int | None) -> None:
            """One timer: at the end of the limit or at the first row that waits, whichever comes first."""
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
            times = [t for t in (due, first) if t is not None]
            if times:
                self.handle.registerTimer(-(-min(times) // 1000))

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            new = [r for pdf in rows for r in zip(pdf["t"].tolist(), pdf["audio_s"].tolist(), pdf["updated"].tolist(), strict=True)]
            self.waiting.appendList(new)
            dog = Dog(stall_us, silent_s, self.dog.get() if self.dog.exists() else None)
            self.rearm(dog.due(), min(r[0] for r in self.waiting.get()))
            yield frame([], ["session_id", "kind", "at_us"])

        def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            until = timerValues.getCurrentWatermarkInMs() * 1000
            dog = Dog(stall_us, silent_s, self.dog.get() if self.dog.exists() else None)
            rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], not r[2], r[1]))
            ready = [r for r in rows if r[0] <= until]
            out = [e for r in ready for e in dog.probe(*r)] + dog.elapsed(until)
            self.waiting.clear()
            if rows[len(ready) :]:
                self.waiting.put(rows[len(ready) :])
            if dog.since is not None:
                self.dog.update(dog.facts())
            self.rearm(dog.due(), rows[len(ready)][0] if len(ready) < len(rows) else None)
            yield frame([(key[0], *e) for e in out], ["session_id", "kind", "at_us"])

        def close(self) -> None:
            pass

    kind = rows.schema["session_id"].dataType.simpleString()
    return rows.groupBy("session_id").transformWithStateInPandas(Watch(), f"session_id {kind}, {ALARM}", "append", "EventTime")


def dropped(items: DataFrame, keep: int, end: str = "end_cs", order: str = "seq") -> DataFrame:
    """X6, X21 as a feed: session_id and `order` of the items that leave each session's window: the prefix that ended more than `keep` before the latest end.

    On a stream, to which a session's items come in order, they leave as soon as the window moves on; state is one map entry for each item that stays. On a table: all
    that have left by its end.
    """
    if not items.isStreaming:
        cut = F.max(end).over(Window.partitionBy("session_id")) - keep
        upto = Window.partitionBy("session_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        rows = items.select("session_id", order, end, cut.alias("_c"))
        return rows.withColumn("_k", F.max((F.col(end) >= F.col("_c")) | (F.col("_c") <= 0)).over(upto)).where("NOT _k").select("session_id", order)

    class Retention(StatefulProcessor):
        def init(self, handle: Any) -> None:
            self.ends = handle.getMapState("ends", shape(seq=LongType), shape(end=LongType))
            self.latest = handle.getValueState("latest", shape(end=LongType))

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            latest = self.latest.get()[0] if self.latest.exists() else None
            for pdf in rows:
                for seq, stop in zip(pdf["item_no"].tolist(), pdf["end_at"].tolist(), strict=True):
                    self.ends.updateValue((seq,), (stop,))
                    latest = stop if latest is None else max(latest, stop)
            self.latest.update((latest,))
            out = []
            for seq, stop in sorted((k[0], v[0]) for k, v in self.ends.iterator()):
                if latest <= keep or stop >= latest - keep:
                    break
                self.ends.removeKey((seq,))
                out.append((key[0], seq))
            yield frame(out, ["session_id", order])

        def close(self) -> None:
            pass

    kind = items.schema["session_id"].dataType.simpleString()
    rows = items.select("session_id", F.col(order).cast("bigint").alias("item_no"), F.col(end).cast("bigint").alias("end_at"))
    return rows.groupBy("session_id").transformWithStateInPandas(Retention(), f"session_id {kind}, {order} bigint", "append", "none")


def flushed_words(words: DataFrame, silences: DataFrame, within_s: int = 5) -> DataFrame:
    """J13 as a join of two tables or two streams: session_id, silence_ts, word_ts, text: each silence marker with the words that begin within so long before it, the ones that
    it flushed; a marker without words has nulls. Both have session_id and event_ts (on streams with watermarks: state is dropped as they move on)."""
    if not words.isStreaming:
        us = F.unix_micros("event_ts")
        marks = silences.select("session_id", us.alias("t"), F.col("event_ts").alias("silence_ts")).distinct()
        spans = marks.select("session_id", (F.col("t") - within_s * 1_000_000).alias("a"), (F.col("t") - 1).alias("b"), "silence_ts")
        points = words.select("session_id", us.alias("a"), us.alias("b"), F.col("event_ts").alias("word_ts"), "text")
        met = in_ranges(points, spans, "a", "b", within_s * 1_000_000).select("session_id", F.col("r_silence_ts").alias("silence_ts"), "word_ts", "text")
        return silences.select("session_id", F.col("event_ts").alias("silence_ts")).join(met.hint("merge"), ["session_id", "silence_ts"], "left")
    w = words.select(F.col("session_id").alias("_session"), F.col("event_ts").alias("word_ts"), "text")
    s = silences.select("session_id", F.col("event_ts").alias("silence_ts"))
    near = (F.col("session_id") == F.col("_session")) & (F.col("word_ts") < F.col("silence_ts")) & (F.col("word_ts") >= F.col("silence_ts") - F.expr(f"INTERVAL {within_s} SECONDS"))
    return s.join(w, near, "left").select("session_id", "silence_ts", "word_ts", "text")


def boundary_fates(rows: DataFrame) -> DataFrame:
    """Boundaries with `fate`. Rows: session_id, seq, kind (final, boundary), count (finals so far, or words before the boundary), start_s, end_s.

    A boundary with the start and end (to the millisecond) of an earlier one is `repeated`, one behind the finals so far is `late`, any other is `kept`:
    boundaries in are those of the three fates together.
    """
    by = Window.partitionBy("session_id").orderBy("seq")
    cursor = F.coalesce(F.max(F.when(F.col("kind") == "final", F.col("count"))).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = rows.withColumn("cursor", cursor).where("kind = 'boundary'").withColumns({"_s": F.round("start_s", 3), "_e": F.round("end_s", 3)})
    again = F.row_number().over(Window.partitionBy("session_id", "_s", "_e").orderBy("seq")) > 1
    fate = F.when(again, "repeated").when(F.col("count") < F.col("cursor"), "late").otherwise("kept")
    return found.withColumn("fate", fate).drop("_s", "_e", "cursor")


def distinct_boundaries(rows: DataFrame, t: str = "start_s", decimals: int = 3) -> DataFrame:
    """One row per session and rounded time; on a stream with a watermark the times seen are forgotten once it has passed them."""
    keyed = rows.withColumn("_r", F.round(t, decimals))
    return (keyed.dropDuplicatesWithinWatermark(["session_id", "_r"]) if rows.isStreaming else keyed.dropDuplicates(["session_id", "_r"])).drop("_r")


def dealt(batch: DataFrame, number: int, by: str, folder: str) -> None:
    """Writes a batch in one pass to the tables `folder`/`by`=value, in each under the batch's number. The same number again replaces what it wrote."""
    rows = batch.withColumn("batch", F.lit(number))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by, "batch").parquet(folder)


def dealing_sink(rows: DataFrame, by: str, folder: str, checkpoint: str) -> StreamingQuery:
    """A stream's rows into one table for each value of `by` (good and quarantined rows; kept, repeated and late ones)."""
    write = lambda batch, number: dealt(batch, number, by, folder)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class TrimmedBuffer:
    """The step of a fold over hypotheses of an audio buffer that is cut as words become final, so that each cut decides what later rows are compared with.

    Rows: kind (hypothesis; silence, change_speaker and eof as in local_agreement), audio_s (where the audio ends), words ([text, start_s, end_s, prob]), ends (of the segments, the last still open), sentence_ends (of the words that end one). What
    begins before the buffer is not heard again. Emits kind (word, cut, reset), text, at_s (a word's end; where the buffer begins from now on).

    - Nothing committed for more than `limit_s` in a buffer longer than that: it is emptied (reset).
    - By `sentence`: a buffer over the limit is cut, when words were committed, at the end of the last committed sentence but one.
    - By `segment`, or over 30 s: at the newest segment end, never the last one's, that is not after the last committed word.
    - Where there is no such end, at the last committed word; if nothing was committed since the start or a change of speaker, at half the buffer.
    """

    def __init__(self, limit_s: float = 15.0, way: str = "segment", agree: Callable[[Row, Row], list[Row]] = local_agreement) -> None:
        self.limit_s, self.way, self.agree = limit_s, way, agree

    def __call__(self, state: Row, row: Row) -> list[Row]:
        state.setdefault("begin", 0.0), state.setdefault("committed", []), state.setdefault("agreement", {}), state.setdefault("output_s", 0.0)
        kind = row.get("kind") or "hypothesis"
        if kind != "hypothesis":
            out = [{"kind": "word", "text": w["text"], "at_s": w["end_s"]} for w in self.agree(state["agreement"], row)]
            if kind == "change_speaker" or kind == "silence" and (row.get("duration_s") or 0.0) >= 5:
                state.update(begin=row["offset_s"] + (row.get("duration_s") or 0.0), committed=[])
            return out
        words = row["words"]
        if "same" in row:
            words = words[leading(state, row, [state["begin"]], lambda w: not w[1] >= state["begin"] - 1e-9) :]
        heard = [w for w in words if w[1] >= state["begin"] - 1e-9]
        words = self.agree(state["agreement"], {"kind": "hypothesis", "words": heard})
        out = [{"kind": "word", "text": w["text"], "at_s": w["end_s"]} for w in words]
        closed = set(row.get("sentence_ends") or [])
        if words:
            state["output_s"] = words[-1]["end_s"]
            # of what was committed only the last word and the ends of the last two sentences are ever asked for
            ends = [e for e in state["committed"][:-1] if e in closed] + [w["end_s"] for w in words]
            state["committed"] = [e for e in ends[:-1] if e in closed][-2:] + ends[-1:]
        length = row["audio_s"] - state["begin"]
        if not words and length > self.limit_s and row["audio_s"] - state["output_s"] > self.limit_s:
            state.update(begin=row["audio_s"], committed=[], output_s=row["audio_s"], agreement={"last": row["audio_s"]})
            return [*out, {"kind": "reset", "text": "", "at_s": row["audio_s"]}]
        if words and self.way == "sentence" and length > self.limit_s:
            out += self.cut(state, row, [e for e in state["committed"] if e in closed][-2:-1], length)
        if row["audio_s"] - state["begin"] > (self.limit_s if self.way == "segment" else 30.0):
            last = state["committed"][-1] if state["committed"] else 0.0
            out += self.cut(state, row, [e for e in (row.get("ends") or [])[:-1] if state["begin"] < e <= last][-1:], row["audio_s"] - state["begin"])
        return out

    def cut(self, state: Row, row: Row, found: list[float], length: float) -> list[Row]:
        over = length > self.limit_s
        if not state["committed"]:
            at = state["begin"] + length / 2 if over else None
        else:
            at = found[0] if found else state["committed"][-1] if over else None
        if at is None or at <= state["begin"]:
            return []
        state["begin"] = at
        return [{"kind": "cut", "text": "", "at_s": at}]

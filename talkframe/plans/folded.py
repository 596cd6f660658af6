"""Queries that fold sessions in order."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkframe.operators import words
from talkframe.operators.ranking import snapshot_deltas, status_of
from talkframe.plans.tables_sql import TOKENS, VAD
from talkframe.sources import adapters
from talkframe.streaming import folds, windows
from talkframe.streaming.events import EventStream

WORD = "text string, start_s double, end_s double"
FIELDS = ("text", "start_s", "end_s", "prob")


def _folded(rows: DataFrame, step: folds.Step, out: str, order: list[str], fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The fold over rows whose `words` reach the step as lists of the wanted fields. They travel as one array a field, which is read far quicker than structs, and as
    changes: of a row with `kept` the step sees the whole hypothesis again, and as `same` how many of its leading words the one before had."""
    flat = rows.select(*(c for c in rows.columns if c != "words"), *(F.col(f"words.{f}").alias(f"_{f}") for f in fields))

    def whole(state: folds.Row, r: folds.Row) -> list[folds.Row]:
        words = [list(w) for w in zip(*(r[f"_{f}"] for f in fields), strict=True)]
        if r["kept"] is None:
            return step(state, r | {"words": words})
        said = state.setdefault("said", [])
        said[r["kept"] :] = words
        return step(state, r | {"words": said, "same": r["kept"]})

    return folds.run_batch(flat, whole, out, order)


def agreed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that two hypotheses of a turn agree on."""
    return _folded(adapters.hypothesis_changes(spark, sf_dir), folds.local_agreement, WORD, ["rev"])


def steady_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of successive hypotheses that move forward, and resets."""
    return _folded(adapters.hypothesis_changes(spark, sf_dir), folds.stable_words, "kind string, " + WORD, ["rev"], FIELDS[:3])


def coalesced_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as chunks of audio, held until two seconds are there; errors drain them."""
    calls = adapters.calls(spark, sf_dir)
    rows = calls.select("session_id", "call_ix", (F.col("dur_us") / 50000).alias("seconds"), F.when(F.col("event_type") == "error", "silence").otherwise("audio").alias("kind"))
    return folds.run_batch(rows, partial(folds.coalesce_chunks, least_s=2.0), "seconds double, n int", ["call_ix"])


def released_growing_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a growing text, all but the last."""
    rows = adapters.hypotheses(spark, sf_dir).select("session_id", "rev", F.array_join(F.transform("words", lambda w: w["text"]), " ").alias("text"))
    return words.held_back(rows)


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of a conversation: the lines of its last five turns, one revision per turn. In some revisions an earlier line is another than before. With status, buffers and
    lags."""
    toks = adapters.tokens(spark, sf_dir)
    line = F.concat_ws(":", "turn", F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda t: t["text"]), ""))
    turns = toks.groupBy("session_id", "turn").agg(line.alias("line"))
    by = Window.partitionBy("session_id").orderBy("turn")
    shown = turns.select("session_id", F.row_number().over(by).alias("rev"), F.collect_list(F.struct("turn", "line")).over(by.rowsBetween(-4, 0)).alias("l"))
    edited = F.transform("l", lambda x: F.when((x["turn"] + F.col("rev")) % 4 == 0, F.concat(x["line"], F.lit("*"))).otherwise(x["line"]))
    lag = lambda k: (F.col("rev") * k % 10 / 10).cast("double")
    buffer = lambda k: F.when(F.col("rev") % k == 0, "").otherwise(F.concat(F.lit("b"), F.col("rev").cast("string")))
    return shown.select(
        "session_id", "rev", edited.alias("lines"), status_of(F.size("l"), buffer(2)).alias("status"), buffer(2).alias("buffer_transcription"), buffer(3).alias("buffer_diarization"), buffer(5).alias("buffer_translation"),
        lag(7).alias("lag_total"), lag(3).alias("lag_processing"), lag(1).alias("lag_policy"), lag(9).alias("lag_diarization"), F.when(F.col("rev") % 4 == 0, F.lit("backend gone")).alias("error"),
    )


DELTA = "rev int, seq int, type string, lines_pruned int, n_lines int, new_lines array<string>"


def line_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each snapshot as a change to the one before, with what it tells anew."""
    found = snapshot_deltas(_snapshots(spark, sf_dir))
    return found.withColumn("new_lines", F.array_join("new_lines", "|"))


def rebuilt_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshots again, from the changes."""
    deltas = snapshot_deltas(_snapshots(spark, sf_dir)).select("session_id", "rev", "seq", "type", "lines_pruned", "n_lines", "new_lines")
    return folds.run_batch(deltas, folds.from_delta, "rev int, lines array<string>", ["rev"]).select("session_id", "rev", F.array_join("lines", "|").alias("lines"))


def _script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream of each turn: snapshots of its growing words between clock events, a pause, a late boundary sent twice, and the end. In odd turns speaker
    labels lag at the last new snapshot, a boundary behind the last word comes while they do, and the snapshot comes again without the lag."""
    hyps = adapters.hypothesis_changes(spark, sf_dir)
    odd = F.split("session_id", "-")[1].cast("int") % 2 == 1
    last = F.col("rev") == F.col("n_revs")
    empty = F.array().cast(hyps.schema["words"].dataType)

    def told(seq: Column, kind: str, ts: Column, words: Column = empty, kept: Column | None = None, lag: Column | None = None, count: Column | None = None, lasts: float = 0.0) -> Column:
        some = {"seq": (seq, "int"), "kind": (F.lit(kind), "string"), "ts_s": (ts, "double"), "kept": (kept, "int"), "lag_s": (0.0 if lag is None else lag, "double"), "count": (0 if count is None else count, "int"), "duration_s": (lasts, "double")}
        return F.struct(*((v if isinstance(v, Column) else F.lit(v)).cast(t).alias(c) for c, (v, t) in some.items()), words.alias("words"))

    rev, m = F.col("rev"), F.col("n_revs")
    end, at = (m * 5 + 2) / 2, lambda i: m * 2 + 2 + i
    always = [told(rev * 2, "snapshot", rev * 2.5, F.col("words"), F.col("kept"), F.when(odd & last, 0.5).otherwise(0.0)), told(rev * 2 + 1, "audio_advanced", rev * 2.5)]
    lagged = [told(at(0), "boundary", end - 0.5, count=F.col("n_words"), lasts=0.2), told(at(1), "snapshot", end, kept=F.col("n_words"))]
    closing = [told(at(i), kind, end + later) for i, (kind, later) in enumerate((("silence_started", 0), ("silence_transcription_ready", 0), ("audio_advanced", 0.5)), 2)]
    closing += [told(at(i), "boundary", F.lit(0.5), count=F.lit(1), lasts=0.2) for i in (5, 6)]
    closing += [told(at(i), kind, end + later) for i, (kind, later) in enumerate((("audio_advanced", 2), ("speech_started", 2.5), ("finish", 3)), 7)]
    events = F.array_compact(F.array(*always, *(F.when(last & odd, e) for e in lagged), *(F.when(last, e) for e in closing)))
    return hyps.select("session_id", F.explode(events).alias("e")).select("session_id", "e.*")


EVENT = "kind string, text string, at_s double, speech_final boolean"


def final_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finals, endpoints, utterance ends, speech starts and late boundaries of each turn's event stream."""
    return _folded(_script(spark, sf_dir), EventStream(interims=False), EVENT, ["seq"], FIELDS[:3])


def interim_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is not final yet, told where it changed."""
    found = _folded(_script(spark, sf_dir), EventStream(), EVENT, ["seq"], FIELDS[:3]).where("kind = 'interim'")
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("out_no"))
    return found.select("session_id", nth.alias("nth"), "text")


def _packed(spark: SparkSession, sf_dir: str, highlight: bool) -> DataFrame:
    toks = adapters.tokens(spark, sf_dir).select("session_id", "seq", "text", (F.col("start_cs") / 100).alias("start_s"), (F.col("end_cs") / 100).alias("end_s"))

    def pack(pdf):
        import pandas as pd

        cues = folds.pack_subtitles(pdf.sort_values("seq").to_dict("records"), highlight=highlight)
        return pd.DataFrame([{"session_id": pdf["session_id"].iloc[0], "cue": i + 1, **c} for i, c in enumerate(cues)], columns=["session_id", "cue", "start_s", "end_s", "text"])

    return toks.groupBy("session_id").applyInPandas(pack, "session_id bigint, cue int, start_s double, end_s double, text string")


def subtitle_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words packed into cues of two lines of 42 characters."""
    return _packed(spark, sf_dir, False)


def highlighted_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cues word by word, each underlined in its time."""
    return _packed(spark, sf_dir, True)


def retained_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's tokens of the last 60 seconds."""
    return windows.retained(adapters.tokens(spark, sf_dir), 6000, "end_cs").select("session_id", "seq")


def pause_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events with less than an hour between."""
    rows = adapters.read(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("event_ts"))
    out = windows.pause_sessions(rows, "1 hour")
    return out.select("session_id", F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss").alias("start_ts"), "n_tokens")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user and day with the newest value."""
    rows = adapters.read(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("event_ts"), "value")
    return windows.probes(rows, "1 day").select("session_id", F.date_format("start_ts", "yyyy-MM-dd").alias("day"), "n", "value")


def stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames (32 ms each) of each session with the time since the last frame of speech."""
    frames = adapters.vad_frames(spark, sf_dir)
    rows = frames.select("session_id", "frame_ix", F.timestamp_micros(F.col("frame_ix") * 32000).alias("event_ts"), (F.col("prob") >= 0.5).alias("updated"))
    return windows.stalls(rows, 0.5).select("session_id", "frame_ix", F.round("idle_s", 3).alias("idle_s"), "stalled")


QUERIES = {f.__name__: f for f in (agreed_words, steady_words, coalesced_chunks, released_growing_words, line_deltas, rebuilt_snapshots, final_events, interim_events, subtitle_cues, highlighted_cues, retained_tokens, pause_sessions, probes, stalls)}

SNAPSHOTS = f"""WITH {TOKENS},
    one AS (SELECT session_id, turn, turn || ':' || string_agg(text, '' ORDER BY seq) AS line, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS rev FROM tokens GROUP BY session_id, turn),
    near AS (SELECT session_id, rev, list({{'turn': turn, 'line': line}}) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS l FROM one),
    snapshots AS (SELECT session_id, rev, [x.line || CASE WHEN (x.turn + rev) % 4 = 0 THEN '*' ELSE '' END FOR x IN l] AS lines FROM near)"""

SCRIPT = r"""WITH w AS (
        SELECT conv_id || '-' || turn AS session_id, turn % 2 = 1 AS odd, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM conversations WHERE text IS NOT NULL),
    c AS (SELECT *, len(w) AS n, (len(w) + 4) // 5 + 1 AS m, CASE WHEN odd THEN (len(w) + 4) // 5 - 1 ELSE len(w) // 5 END AS cuts FROM w WHERE len(w) > 0)"""

ORACLES = {
    "final_events": SCRIPT + """,
        j AS (SELECT *, unnest(range(1, cuts + 1)) AS j FROM c),
        e AS (
            SELECT session_id, j AS o, 'final' AS kind, array_to_string(w[greatest(5 * j - 5, 1) : 5 * j - 1], ' ') AS text, ((5 * j - 1) * 50 + 40) / 100.0::DOUBLE AS at_s, FALSE AS speech_final FROM j
            UNION ALL SELECT session_id, cuts + 1, 'final', array_to_string(w[greatest(5 * cuts, 1) : n], ' '), (n * 50 + 40) / 100.0::DOUBLE, NOT odd FROM c
            UNION ALL SELECT session_id, cuts + 2, 'utterance_end', '', (n * 50 + 40) / 100.0::DOUBLE, FALSE FROM c
            UNION ALL SELECT session_id, cuts + 3, 'final', '', (n * 50 + 40) / 100.0::DOUBLE, TRUE FROM c WHERE odd
            UNION ALL SELECT session_id, cuts + 4, 'late', '', 0.5::DOUBLE, FALSE FROM c WHERE n > 1
            UNION ALL SELECT session_id, cuts + 5, 'speech_started', '', (m * 5 + 2) / 2.0::DOUBLE + 2.5, FALSE FROM c)
        SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY o) AS INTEGER) AS out_no, kind, text, at_s, speech_final FROM e""",
    "interim_events": SCRIPT + """,
        k AS (SELECT *, unnest(range(1, m + 1)) AS k FROM c),
        i AS (SELECT *, greatest(5 * least(k - 1, cuts) - 1, 0) AS cut, least(5 * k, n) AS shown FROM k WHERE k < m OR n % 5 = 0)
        SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY k) AS INTEGER) AS nth, array_to_string(w[cut + 1 : shown], ' ') || CASE WHEN 5 * k <= n THEN '~' ELSE '' END AS text FROM i""",
    "released_growing_words": r"""WITH w AS (SELECT conv_id || '-' || turn AS session_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM conversations WHERE text IS NOT NULL),
        i AS (SELECT session_id, w, unnest(range(0, len(w) - 1)) AS ix FROM w)
        SELECT session_id, ix, CASE WHEN ix = 0 THEN '' ELSE ' ' END || w[ix + 1] AS text FROM i""",
    "line_deltas": f"""{SNAPSHOTS},
        b AS (SELECT *, lag(lines) OVER (PARTITION BY session_id ORDER BY rev) AS b FROM snapshots),
        g AS (SELECT *, CASE WHEN b IS NULL THEN 0 WHEN list_contains(b, lines[1]) THEN list_position(b, lines[1]) - 1 ELSE len(b) END AS gone FROM b),
        p AS (SELECT *, CASE WHEN b IS NULL THEN 0 ELSE coalesce([i FOR i IN range(1, least(len(b) - gone, len(lines)) + 1) IF b[gone + i] <> lines[i]][1] - 1, least(len(b) - gone, len(lines))) END AS same FROM g)
        SELECT session_id, rev, rev AS seq, CASE WHEN b IS NULL THEN 'snapshot' ELSE 'diff' END AS type, gone AS lines_pruned, len(lines) AS n_lines, array_to_string(lines[same + 1 :], '|') AS new_lines,
            'active_transcription' AS status, CASE WHEN rev % 2 = 0 THEN '' ELSE 'b' || rev END AS buffer_transcription, CASE WHEN rev % 3 = 0 THEN '' ELSE 'b' || rev END AS buffer_diarization,
            CASE WHEN rev % 5 = 0 THEN '' ELSE 'b' || rev END AS buffer_translation, (rev * 7 % 10) / 10 AS lag_total, (rev * 3 % 10) / 10 AS lag_processing, (rev % 10) / 10 AS lag_policy,
            (rev * 9 % 10) / 10 AS lag_diarization, CASE WHEN rev % 4 = 0 THEN 'backend gone' END AS error FROM p""",
    "rebuilt_snapshots": f"""{SNAPSHOTS} SELECT session_id, rev, array_to_string(lines, '|') AS lines FROM snapshots""",
    "retained_tokens": f"""WITH {TOKENS}, c AS (SELECT *, max(end_cs) OVER (PARTITION BY session_id) - 6000 AS c FROM tokens),
        k AS (SELECT *, bool_or(end_cs >= c OR c <= 0) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS k FROM c) SELECT session_id, seq FROM k WHERE k""",
    "pause_sessions": """WITH e AS (SELECT user_id AS session_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS c FROM events),
        g AS (SELECT *, sum(c) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
        SELECT session_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_ts, count(*) AS n_tokens FROM g GROUP BY session_id, g""",
    "probes": """SELECT user_id AS session_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, arg_max(value, (ts, value)) AS value FROM events GROUP BY ALL""",
    "stalls": f"""WITH {VAD}, l AS (SELECT session_id, frame_ix, coalesce(max(CASE WHEN prob >= 0.5 THEN frame_ix END) OVER w, min(frame_ix) OVER w) AS l FROM vad WINDOW w AS (PARTITION BY session_id ORDER BY frame_ix ROWS UNBOUNDED PRECEDING))
        SELECT session_id, frame_ix, round((frame_ix - l) * 0.032, 3) AS idle_s, round((frame_ix - l) * 0.032, 3) > 0.5 AS stalled FROM l""",
}

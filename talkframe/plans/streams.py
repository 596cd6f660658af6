"""Queries of operators that run on streams, here over whole tables: watchdogs, retention, silences with their words, boundaries, quarantine, the trimmed buffer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkframe.plans.folded import FIELDS, _folded
from talkframe.plans.mixed import _results
from talkframe.plans.ordered_sql import AGREED, CHECKED
from talkframe.plans.speech import _tokens
from talkframe.plans.tables_sql import TIMELINE, TOKENS, TURNS, VAD
from talkframe.sources import adapters
from talkframe.sources.scratch import shared_dir
from talkframe.streaming import watchdogs


def watchdog_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 32 ms as probes, those of very likely speech as updates: stalls of half a second, sessions silent for the first 0.65 s."""
    frames = adapters.vad_frames(spark, sf_dir)
    probes = frames.select("session_id", F.timestamp_micros(F.col("frame_ix") * 32000).alias("event_ts"), (F.col("frame_ix") * F.lit(0.032)).alias("audio_s"), (F.col("prob") >= 0.9).alias("updated"))
    return watchdogs.alarms(probes, 0.5, 0.65)


def dropped_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens that have left each session's window of the last 60 seconds."""
    return watchdogs.dropped(adapters.tokens(spark, sf_dir), 6000)


def silence_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each silence with the words of the five seconds before it."""
    toks = _tokens(spark, sf_dir)
    stamped = lambda df: df.withColumn("event_ts", F.timestamp_micros(F.col("start_cs") * 10000))
    found = watchdogs.flushed_words(stamped(toks), stamped(adapters.timeline(toks).where("kind = 'silence'")))
    cs = lambda c: F.expr(f"unix_micros({c}) div 10000").alias(c.replace("_ts", "_cs"))
    return found.select("session_id", cs("silence_ts"), cs("word_ts"), "text")


def boundary_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A boundary behind each turn, again for every third and long after for every fourth, against the words that are final."""
    turns = adapters.turn_bounds(_tokens(spark, sf_dir))
    n = F.lead("seq", 1).over(Window.partitionBy("session_id").orderBy("turn"))
    turns = turns.withColumn("n", F.coalesce(n - 1, F.col("seq")).cast("bigint"))
    made = lambda k, kind, count, shift, some="true": turns.where(some).select(
        "session_id", (F.col("turn") * 4 + k).cast("int").alias("seq"), F.lit(kind).alias("kind"), F.expr(count).cast("bigint").alias("count"), (F.col("a") / 100 + shift).alias("start_s"), (F.col("b") / 100 + shift).alias("end_s")
    )
    rows = made(0, "final", "n", 0.0).unionByName(made(1, "boundary", "n", 0.0)).unionByName(made(2, "boundary", "n", 0.0002, "turn % 3 = 0")).unionByName(made(3, "boundary", "n div 2", 0.01, "turn % 4 = 0"))
    return watchdogs.boundary_fates(rows).select("session_id", "seq", "fate")


def quarantined_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked results dealt to a table of good and one of quarantined rows, twice with the same batch number, and read back."""
    rows = _results(spark, sf_dir).withColumn("fate", F.when(F.col("error_code").isNull(), "good").otherwise("quarantined"))
    folder = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    for _ in range(2):
        watchdogs.dealt(rows, 7, "fate", folder)
    tables = [spark.read.schema(rows.drop("fate").schema).parquet(f"{folder}/fate={fate}").select("user_id", "day", "n", "error_code", F.lit(fate).alias("fate")) for fate in ("good", "quarantined")]
    return tables[0].unionByName(tables[1])


def buffer_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the audio buffer of each turn is cut: segments of seven words, buffers of at most 15 seconds."""
    rows = adapters.hypothesis_changes(spark, sf_dir).select("session_id", "rev", (F.col("rev") * 2.5).cast("double").alias("audio_s"), "kept", "words")
    trimmed = watchdogs.TrimmedBuffer(15.0)

    def cut(state, row):
        words = row["words"]
        return trimmed(state, row | {"ends": [w[2] for w in words[6::7]] + [w[2] for w in words[-1:] if len(words) % 7]})

    found = _folded(rows, cut, "kind string, text string, at_s double", ["rev"], FIELDS).where("kind <> 'word'")
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("out_no"))
    return found.select("session_id", nth.alias("nth"), "kind", "at_s")


QUERIES = {f.__name__: f for f in (watchdog_events, dropped_tokens, silence_words, boundary_fates, quarantined_results, buffer_cuts)}

ORACLES = {
    "watchdog_events": f"""WITH {VAD}, v AS (SELECT session_id, frame_ix * 32000 AS t, frame_ix * 0.032::DOUBLE AS a, prob >= 0.9 AS u, frame_ix FROM vad),
        e AS (SELECT *, sum(u::INT) OVER (PARTITION BY session_id ORDER BY frame_ix ROWS UNBOUNDED PRECEDING) AS epoch FROM v),
        s AS (SELECT session_id, epoch, min(t) AS since, count(*) > 1 AS ahead FROM e GROUP BY session_id, epoch),
        n AS (SELECT *, lead(since) OVER (PARTITION BY session_id ORDER BY epoch) AS nxt FROM s)
        SELECT session_id, 'stalled' AS kind, since + 500000 AS at_us FROM n WHERE ahead AND coalesce(nxt > since + 500000, TRUE) AND since + 500000 <= (SELECT max(t) FROM v)
        UNION ALL SELECT session_id, 'silent', min(t) FROM e WHERE epoch = 0 AND a >= 0.65 GROUP BY session_id""",
    "dropped_tokens": f"""WITH {TOKENS}, c AS (SELECT *, max(end_cs) OVER (PARTITION BY session_id) - 6000 AS c FROM tokens),
        k AS (SELECT *, bool_or(end_cs >= c OR c <= 0) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS k FROM c) SELECT session_id, seq FROM k WHERE NOT k""",
    "silence_words": f"""WITH {TOKENS}, {TIMELINE} SELECT s.session_id, s.start_cs AS silence_cs, t.start_cs AS word_cs, t.text FROM timeline s
        LEFT JOIN tokens t ON t.session_id = s.session_id AND t.start_cs < s.start_cs AND t.start_cs >= s.start_cs - 500 WHERE s.kind = 'silence'""",
    "boundary_fates": f"""WITH {TOKENS}, {TURNS}, n AS (SELECT *, coalesce(lead(seq) OVER (PARTITION BY session_id ORDER BY turn) - 1, seq) AS n FROM turns)
        SELECT session_id, turn * 4 + 1 AS seq, 'kept' AS fate FROM n UNION ALL SELECT session_id, turn * 4 + 2, 'repeated' FROM n WHERE turn % 3 = 0
        UNION ALL SELECT session_id, turn * 4 + 3, CASE WHEN n // 2 < n THEN 'late' ELSE 'kept' END FROM n WHERE turn % 4 = 0""",
    "quarantined_results": CHECKED.replace("SELECT user_id, day, count(*)::INT AS n,", "SELECT *, CASE WHEN error_code IS NULL THEN 'good' ELSE 'quarantined' END AS fate FROM (SELECT user_id, day, count(*)::INT AS n,") + ")",
    "buffer_cuts": f"""{AGREED},
        r2 AS (SELECT session_id, rev, least(rev * 5, len(w)) AS shown FROM r),
        cuts AS (
            SELECT session_id, 0::BIGINT AS rev, 0.0::DOUBLE AS at_s, FALSE AS cut FROM g WHERE rev = 0
            UNION ALL SELECT session_id, rev, CASE WHEN cut THEN p ELSE at_s END, cut FROM (
                SELECT *, rev * 2.5 - at_s > 15 AND p > at_s AS cut FROM (
                    SELECT g.session_id, g.rev, c.at_s, CASE WHEN g.last = 0 THEN c.at_s + (g.rev * 2.5::DOUBLE - c.at_s) / 2
                        ELSE coalesce(list_max([(j * 350 + 40) / 100 FOR j IN range(1, (r2.shown - 1) // 7 + 1) IF (j * 350 + 40) / 100 > c.at_s AND (j * 350 + 40) / 100 <= g.last]), g.last) END AS p
                    FROM cuts c JOIN g ON g.session_id = c.session_id AND g.rev = c.rev + 1 JOIN r2 ON r2.session_id = g.session_id AND r2.rev = g.rev)))
        SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY rev) AS INTEGER) AS nth, 'cut' AS kind, at_s FROM cuts WHERE cut""",
}

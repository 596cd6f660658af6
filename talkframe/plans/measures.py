"""Queries over voice activity, calls and evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.operators import audio, lines, metrics
from talkframe.plans.speech import FULL
from talkframe.plans.speech import _lines as all_lines
from talkframe.plans.tables_sql import CALLS, PAIRS, VAD
from talkframe.sources import adapters


def vad_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W9, R16."""
    return audio.vad_events(adapters.vad_frames(spark, sf_dir))


def audio_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10, W11, A4."""
    frames = adapters.vad_frames(spark, sf_dir)
    totals = frames.groupBy("session_id").agg(F.max("end_sample").alias("total"))
    return audio.active_clock(audio.segment_audio(audio.vad_events(frames), totals))


def frame_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F29, T1, W8."""
    return audio.frame_spans(adapters.frames(spark, sf_dir), 3)


def session_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, A6, A7."""
    return metrics.session_calls(adapters.calls(spark, sf_dir))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rates of each turn as a run, with a language, a category and times that follow from its numbers."""
    errors = metrics.wer_rows(adapters.pairs(spark, sf_dir))
    k = F.col("session_id") + F.col("turn")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    return errors.withColumns({
        "language": pick(("de", "en", "es", "fr"), F.col("session_id")), "category": pick(("clean", "meeting", "noisy"), k),
        "backend": pick(("la", "ss"), F.col("turn")), "model": pick(("base", "small", "turbo"), F.col("session_id")),
        "audio_us": (F.col("ref_words") * 400000).cast("bigint"), "processing_us": (F.col("hyp_words") * (90000 - 30000 * (F.col("turn") % 2)) + k % 7 * 10000).cast("bigint"),
        "latency_us": (k % 5 * 100000).cast("bigint"), "p95_us": F.when(k % 4 == 0, 0).otherwise(k % 5 * 150000).cast("bigint"),
    })


def word_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1, D5, R11."""
    return metrics.wer_rows(adapters.pairs(spark, sf_dir)).select("id", "s", "i", "d", "ref_words", "hyp_words", F.round("wer", 6).alias("wer"))


def edit_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2."""
    return metrics.edit_distances(adapters.pairs(spark, sf_dir)).select("id", "distance")


def evaluation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a run of its system."""
    return _runs(spark, sf_dir).select("id", "backend", "model", "language", "category", "audio_us", "processing_us", "latency_us", F.round(metrics.ratio(F.col("processing_us"), F.col("audio_us")), 6).alias("rtf"))


def _systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.compare_systems(_runs(spark, sf_dir), ["backend", "model", "language"])


def bench_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4, A5, A8-A14."""
    return metrics.bench_report(_runs(spark, sf_dir))


def compare_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5, A24, R15."""
    return _systems(spark, sf_dir).withColumns({"accuracy": metrics.grade(F.col("wer_pct"), 15, 30), "speed": metrics.grade(F.col("rtf"), 0.5, 1)})


def sweet_spot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A25."""
    return metrics.sweet_spot(_systems(spark, sf_dir))


def timing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14, A21."""
    return metrics.timing_report(all_lines(spark, sf_dir).where("kind <> 'buffer'"))


def timestamp_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypothesis words against reference words, both at their places of 50 centiseconds, the hypothesis 7 late at every third word."""
    rows = adapters.pairs(spark, sf_dir)
    flat = lambda c: rows.select("id", F.posexplode(c).alias("ix", "word"))
    ref = flat("ref").withColumn("start_cs", F.col("ix") * 50)
    hyp = flat("hyp").withColumn("start_cs", F.col("ix") * 50 + F.when(F.col("ix") % 3 == 0, 7).otherwise(0))
    return metrics.timestamp_accuracy(hyp, ref)


def silent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with at least 20 s of audio whose calls brought no large purchase, the stand-in for a token."""
    calls = adapters.calls(spark, sf_dir)
    sessions = calls.groupBy("session_id").agg((F.sum("dur_us") / 1000).alias("audio_s"))
    return audio.silent_sessions(sessions, calls.where("event_type = 'purchase' AND dur_us >= 120000")).select("session_id", F.round("audio_s", 3).alias("audio_s"))


QUERIES = {f.__name__: f for f in (vad_events, audio_segments, frame_spans, session_calls, word_error_rates, edit_distances, evaluation_runs, bench_report, compare_systems, sweet_spot, timing_report, timestamp_accuracy, silent_sessions)}

VAD_EVENTS = f"""{VAD},
    g1 AS (SELECT *, sum((prob >= 0.5)::INT) OVER (PARTITION BY session_id ORDER BY frame_ix ROWS UNBOUNDED PRECEDING) AS g FROM vad),
    g2 AS (SELECT *, min(CASE WHEN prob < 0.5 - 0.15 THEN end_sample END) OVER (PARTITION BY session_id, g ORDER BY frame_ix ROWS UNBOUNDED PRECEDING) AS t0 FROM g1),
    g3 AS (SELECT session_id, g, min(end_sample) AS f, min(CASE WHEN prob < 0.5 - 0.15 AND end_sample - t0 >= 1600 THEN t0 END) AS t FROM g2 WHERE g > 0 GROUP BY session_id, g),
    g4 AS (SELECT *, g = 1 OR lag(t) OVER (PARTITION BY session_id ORDER BY g) IS NOT NULL AS starts FROM g3),
    ev AS (SELECT session_id, 'start' AS kind, greatest(0, f - 992) AS sample FROM g4 WHERE starts UNION ALL SELECT session_id, 'end', t - 32 FROM g4 WHERE t IS NOT NULL)"""

#: Alignment of whole turns, one reference word a round: `best` packs the least distance so far, the nearest cell that has it, and that cell's substitutions and insertions.
ERRORS = f"""{PAIRS},
    texts AS MATERIALIZED (SELECT row_number() OVER () AS no, * FROM (SELECT DISTINCT ref, hyp FROM pairs)),
    rw AS MATERIALIZED (SELECT no, unnest(ref) AS w, generate_subscripts(ref, 1) AS i FROM texts),
    hw AS MATERIALIZED (SELECT no, unnest(hyp) AS w, generate_subscripts(hyp, 1) AS j FROM texts),
    cells AS (
        SELECT no, 0 AS i, unnest(range(0, len(hyp) + 1)) AS j, unnest(range(0, len(hyp) + 1)) AS d, 0 AS s, unnest(range(0, len(hyp) + 1)) AS a FROM texts
        UNION ALL
        SELECT no, i, j, (best >> 42) - 16384 + j, (best >> 14) % 16384, best % 16384 + j - (16383 - (best >> 28) % 16384) FROM (
            SELECT no, i, j, min((((nd - j + 16384) << 42) + ((16383 - j) << 28) + (s << 14) + a)::BIGINT) OVER (PARTITION BY no ORDER BY j ROWS UNBOUNDED PRECEDING) AS best FROM (
                SELECT no, i, j, CASE WHEN same THEN dd WHEN dd <= d THEN dd + 1 ELSE d + 1 END AS nd, CASE WHEN same THEN ds WHEN dd <= d THEN ds + 1 ELSE s END AS s,
                    CASE WHEN same OR dd <= d THEN da ELSE a END AS a
                FROM (
                    SELECT c.no, c.i + 1 AS i, c.j, c.d, c.s, c.a, coalesce(r.w = h.w, FALSE) AS same, lag(c.d) OVER w AS dd, lag(c.s) OVER w AS ds, lag(c.a) OVER w AS da
                    FROM cells c JOIN rw r ON r.no = c.no AND r.i = c.i + 1 LEFT JOIN hw h ON h.no = c.no AND h.j = c.j WINDOW w AS (PARTITION BY c.no ORDER BY c.j))))),
    dist AS (
        SELECT p.id, session_id, turn, len(p.ref) AS n, len(p.hyp) AS m, c.d::INT AS distance, c.s::INT AS s, c.a::INT AS i, (c.d - c.s - c.a)::INT AS d
        FROM pairs p JOIN texts t ON t.ref = p.ref AND t.hyp = p.hyp JOIN cells c ON c.no = t.no AND c.i = len(p.ref) AND c.j = len(p.hyp))"""

RUNS = f"""{ERRORS},
    runs AS (
        SELECT *, CASE WHEN n = 0 THEN m ELSE distance / n END AS wer, ['de', 'en', 'es', 'fr'][session_id % 4 + 1] AS language, ['clean', 'meeting', 'noisy'][(session_id + turn) % 3 + 1] AS category,
            ['la', 'ss'][turn % 2 + 1] AS backend, ['base', 'small', 'turbo'][session_id % 3 + 1] AS model,
            n * 400000 AS audio_us, m * (90000 - 30000 * (turn % 2)) + (session_id + turn) % 7 * 10000 AS processing_us, (session_id + turn) % 5 * 100000 AS latency_us, CASE WHEN (session_id + turn) % 4 = 0 THEN 0 ELSE (session_id + turn) % 5 * 150000 END AS p95_us FROM dist),
    systems AS (
        SELECT backend, model, language, count(*) AS n, round(100 * sum(distance) / greatest(sum(n), 1), 6) AS wer_pct,
            round(CASE WHEN sum(audio_us) > 0 THEN sum(processing_us) / sum(audio_us) ELSE 0 END, 6) AS rtf FROM runs GROUP BY backend, model, language)"""

_FRAMES = """
fr AS (SELECT vec_id // 50 AS session_id, vec_id % 50 AS frame_ix, embedding[1:3] AS sc FROM embeddings),
am AS (SELECT session_id, frame_ix, frame_ix // 10 AS chunk_ix, list_position(sc, list_max(sc)) - 1 AS speaker FROM fr),
rn AS (SELECT *, sum(c) OVER (PARTITION BY session_id, chunk_ix ORDER BY frame_ix ROWS UNBOUNDED PRECEDING)::BIGINT AS span_ix FROM (
    SELECT *, CASE WHEN coalesce(speaker <> lag(speaker) OVER (PARTITION BY session_id, chunk_ix ORDER BY frame_ix), TRUE) THEN 1 ELSE 0 END AS c FROM am)),
rs AS (SELECT session_id, chunk_ix, span_ix, min(speaker) AS speaker, min(frame_ix) AS f FROM rn GROUP BY ALL)"""

ORACLES = {
    "word_error_rates": f"WITH RECURSIVE {ERRORS} SELECT id, s, i, d, n AS ref_words, m AS hyp_words, round(CASE WHEN n = 0 THEN m ELSE distance / n END, 6) AS wer FROM dist",
    "edit_distances": f"WITH RECURSIVE {ERRORS} SELECT id, distance FROM dist",
    "evaluation_runs": f"""WITH RECURSIVE {RUNS} SELECT id, backend, model, language, category, audio_us::BIGINT AS audio_us, processing_us::BIGINT AS processing_us, latency_us::BIGINT AS latency_us,
        round(CASE WHEN audio_us > 0 THEN processing_us / audio_us ELSE 0 END, 6) AS rtf FROM runs""",
    "bench_report": f"""WITH RECURSIVE {RUNS}
        SELECT CASE grouping(language, category) WHEN 3 THEN 'all' WHEN 1 THEN 'language' ELSE 'category' END AS level, coalesce(language, category, '') AS value,
            count(*) AS n_samples, sum(audio_us)::BIGINT AS audio_us, sum(processing_us)::BIGINT AS processing_us, round(avg(wer), 6) AS avg_wer, round(sum(distance) / greatest(sum(n), 1), 6) AS weighted_wer,
            round(avg(CASE WHEN audio_us > 0 THEN processing_us / audio_us ELSE 0 END), 6) AS avg_rtf, round(CASE WHEN sum(audio_us) > 0 THEN sum(processing_us) / sum(audio_us) ELSE 0 END, 6) AS overall_rtf,
            round(coalesce(avg(latency_us / 1000) FILTER (latency_us > 0), 0), 6) AS avg_latency_ms, round(coalesce(avg(p95_us / 1000) FILTER (p95_us > 0), 0), 6) AS p95_latency_ms, count(DISTINCT language) AS n_languages, string_agg(DISTINCT category, ',' ORDER BY category) AS categories
        FROM runs GROUP BY GROUPING SETS ((), (language), (category))""",
    "compare_systems": f"""WITH RECURSIVE {RUNS} SELECT *, CASE WHEN wer_pct < 15 THEN 'good' WHEN wer_pct < 30 THEN 'fair' ELSE 'poor' END AS accuracy,
        CASE WHEN rtf < 0.5 THEN 'good' WHEN rtf < 1 THEN 'fair' ELSE 'poor' END AS speed FROM systems""",
    "sweet_spot": f"""WITH RECURSIVE {RUNS} SELECT * FROM systems WHERE rtf < least(1, 0.85 * (SELECT max(rtf) FROM systems)) AND wer_pct < least(12, 0.45 * (SELECT max(wer_pct) FROM systems))""",
    "vad_events": f"WITH {VAD_EVENTS} SELECT * FROM ev",
    "audio_segments": f"""WITH {VAD_EVENTS},
        tot AS (SELECT session_id, max(end_sample) AS total FROM vad GROUP BY session_id),
        mk AS (SELECT session_id, -1 AS pt, 'silence' AS kind FROM tot UNION ALL
            SELECT session_id, least(greatest(sample, 0), total), CASE kind WHEN 'start' THEN 'speech' ELSE 'silence' END FROM ev JOIN tot USING (session_id)),
        ch AS (SELECT * FROM (SELECT *, coalesce(kind <> lag(kind) OVER (PARTITION BY session_id ORDER BY pt, kind DESC), TRUE) AS c FROM mk) WHERE c),
        sp AS (SELECT session_id, kind, greatest(pt, 0) AS start_sample, coalesce(lead(pt) OVER (PARTITION BY session_id ORDER BY pt, kind DESC), total) AS end_sample FROM ch JOIN tot USING (session_id)),
        nn AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY start_sample) AS no FROM sp WHERE end_sample > start_sample)
        SELECT session_id, no, kind, start_sample, end_sample, sum(end_sample - start_sample) OVER w::BIGINT AS position,
            sum(CASE WHEN kind = 'speech' THEN end_sample - start_sample ELSE 0 END) OVER w::BIGINT AS active
        FROM nn WINDOW w AS (PARTITION BY session_id ORDER BY no ROWS UNBOUNDED PRECEDING)""",
    "frame_spans": f"""WITH {_FRAMES} SELECT session_id, chunk_ix, span_ix, speaker, f * 8 AS start_cs,
        coalesce(lead(f) OVER (PARTITION BY session_id, chunk_ix ORDER BY span_ix), (chunk_ix + 1) * 10) * 8 AS end_cs FROM rs""",
    "session_calls": f"""WITH {CALLS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY dur_us) AS r, count(*) OVER (PARTITION BY session_id) AS n FROM calls)
        SELECT session_id, count(*) AS n_calls, sum(dur_us)::BIGINT AS total_us, round(avg(dur_us / 1000), 6) AS mean_ms, max(dur_us) FILTER (r = least(n * 95 // 100, n - 1) + 1) AS p95_us FROM r GROUP BY session_id""",
    "silent_sessions": f"""WITH {CALLS} SELECT session_id, round(sum(dur_us) / 1000, 3) AS audio_s FROM calls GROUP BY session_id
        HAVING sum(dur_us) / 1000 >= 20 AND count(*) FILTER (event_type = 'purchase' AND dur_us >= 120000) = 0""",
    "timing_report": f"""{FULL}, b AS (SELECT *, coalesce(start_cs < lag(start_cs) OVER (PARTITION BY session_id ORDER BY line_no), FALSE) AS back FROM lines WHERE kind <> 'buffer')
        SELECT session_id, count(*) AS n_lines, count(*) FILTER (start_cs < 0 OR end_cs < 0) AS n_negative, count(*) FILTER (end_cs < start_cs) AS n_inverted, count(*) FILTER (back) AS n_backwards,
            count(*) FILTER (start_cs < 0 OR end_cs < 0 OR end_cs < start_cs) = 0 AS timing_valid, count(*) FILTER (back) = 0 AS monotonic FROM b GROUP BY session_id""",
}

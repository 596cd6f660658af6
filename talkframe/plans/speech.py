"""Queries over tokens, spans and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkframe.functions.times import format_time
from talkframe.operators import joins, lines, scans, words
from talkframe.plans.tables_sql import SPANS, TIMELINE, TOKENS, TRANSLATIONS, TURNS
from talkframe.sources import adapters
from talkframe.sources.scratch import kept


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens, computed once: timeline, spans, translations and turns all follow from them."""
    return kept(adapters.tokens(spark, sf_dir))


def _lines_of(toks: DataFrame, block: int | None = None) -> DataFrame:
    """Lines of a kept table of tokens; sessions too long for one task are taken in blocks."""
    spans = kept(adapters.speaker_spans(toks))
    return lines.speaker_lines(adapters.timeline(toks), spans, block or scans.block_for(toks, "seq"), joins.few(spans, "session_id"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines_of(_tokens(spark, sf_dir))


def token_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1."""
    toks = _tokens(spark, sf_dir)
    return joins.token_speakers(toks, adapters.speaker_spans(toks)).select("session_id", "seq", "speaker")


def speaker_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, W6, W1, A2, A3, F7."""
    return _lines(spark, sf_dir).withColumn("begins", format_time(F.col("start_cs")))


def lines_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines, sessions in blocks of 64 tokens."""
    return _lines_of(_tokens(spark, sf_dir), 128)


def segments_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments, sessions in blocks of 50 tokens."""
    return lines.segments_at_marks(adapters.timeline(_tokens(spark, sf_dir)), 100)


def pauses_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each line between pauses how many of its tokens are released, and are in the prompt, all in blocks."""
    toks = _tokens(spark, sf_dir)
    timeline = adapters.timeline(toks)
    found = kept(lines.lines_at_pauses(timeline, 64).where("kind = 'token'").select("session_id", "line_no", "start_cs", "end_cs"))
    free = words.released(timeline, 64).where("released").select("session_id", (F.col("seq2") / 2).cast("bigint").alias("seq"), F.lit(1).alias("free"))
    rows = words.context_suffix(toks, 200, 64).select("session_id", "seq", "start_cs", "end_cs", "prompt").join(free.hint("merge"), ["session_id", "seq"], "left")
    met = joins.contained(rows, found, "seq", "line_no").join(rows.select("session_id", "seq", "prompt", "free").hint("merge"), ["session_id", "seq"])
    return met.groupBy("session_id", "line_no").agg(F.count(F.lit(1)).alias("n"), F.count("free").alias("n_released"), F.count_if("prompt").alias("n_prompt"))


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversation as turns of one speaker."""
    toks = _tokens(spark, sf_dir)
    return lines.conversation(joins.token_speakers(toks, adapters.speaker_spans(toks)))


def speaker_talk_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Talk time of each speaker of a session, with its number of speaker changes."""
    found = lines.turned(_lines(spark, sf_dir))
    talk = found.groupBy("session_id", "speaker").agg(F.sum(F.col("end_cs") - F.col("start_cs")).alias("talk_cs"), F.count(F.lit(1)).alias("n_lines"), F.sum("n_tokens").alias("n_tokens"), F.count_if("turned").alias("_n"))
    whole = Window.partitionBy("session_id")
    return talk.withColumns({"n_speakers": F.count(F.lit(1)).over(whole), "n_changes": F.sum("_n").over(whole)}).drop("_n")


def translation_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that owns each translated span."""
    toks = _tokens(spark, sf_dir)
    spoken = kept(_lines_of(toks).where("kind = 'line'").select("session_id", "line_no", "start_cs", "end_cs"))
    return joins.owner_or_nearest(adapters.translations(toks), spoken, "session_id", "tr_no", "line_no", "start_cs", "end_cs", 6000)


def translation_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5, P4."""
    toks = _tokens(spark, sf_dir)
    spans = adapters.speaker_spans(toks)
    return joins.contained(adapters.translations(toks), spans, "tr_no", "span_no")


def tokens_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each translated span its tokens' text and how many."""
    toks = _tokens(spark, sf_dir)
    met = joins.in_ranges(toks.select("session_id", "seq", "text", "start_cs", "end_cs"), adapters.translations(toks))
    return met.groupBy("session_id", F.col("r_tr_no").alias("tr_no")).agg(F.count(F.lit(1)).alias("n_tokens"), F.trim(lines.joined("seq", "text")).alias("text"))


def spans_at_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first span that contains the middle of each turn."""
    toks = _tokens(spark, sf_dir)
    points = adapters.turn_bounds(toks).select("session_id", F.expr("(a + b) div 2").alias("t"))
    spans = adapters.speaker_spans(toks).withColumnRenamed("span_no", "line_no")
    return joins.at_points(points, spans)


def nearest_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn whose start is nearest to each translation's end, the earliest on ties."""
    toks = _tokens(spark, sf_dir)
    points = adapters.translations(toks).select("session_id", "tr_no", F.col("end_cs").alias("t"))
    return joins.nearest(points, adapters.turn_bounds(toks).select("session_id", F.col("a").alias("at"), F.col("turn").alias("no")), "session_id", "t", "at", "no")


def words_outside_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that start in no speaker span."""
    toks = _tokens(spark, sf_dir)
    return joins.outside(toks, adapters.speaker_spans(toks)).select("session_id", "seq", "text")


def span_by_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14."""
    toks = _tokens(spark, sf_dir)
    return joins.span_by_end(toks, adapters.speaker_spans(toks)).select("session_id", "seq", "span_no")


def segments_at_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2, W2, W3."""
    return lines.segments_at_marks(adapters.timeline(adapters.tokens(spark, sf_dir)))


def lines_at_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines between pauses, and whether the pause after a line is a boundary of more than seven seconds."""
    found = lines.lines_at_pauses(adapters.timeline(adapters.tokens(spark, sf_dir)))
    return found.withColumn("boundary", (F.col("kind") == "silence") & lines.pause_boundary(F.col("end_cs") - F.col("start_cs"), 700))


def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5, W7."""
    return lines.merge_spans(adapters.speaker_spans(adapters.tokens(spark, sf_dir)))


def concatenated_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W29, F15."""
    spans = adapters.speaker_spans(adapters.tokens(spark, sf_dir))
    return lines.concatenate_speakers(spans.withColumn("label", F.concat(F.lit("speaker"), F.col("speaker").cast("string"))).drop("speaker"))


def monotonic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W31."""
    return lines.make_monotonic(adapters.speaker_spans(adapters.tokens(spark, sf_dir))).select("session_id", "span_no", "start_cs", "end_cs")


def partition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6: sessions whose lines and buffer do not add up to their tokens, and how many tokens all sessions have."""
    toks = _tokens(spark, sf_dir)
    whole = toks.groupBy("session_id").agg(lines.joined("seq", "text").alias("whole"), F.count(F.lit(1)).alias("n_tokens"))
    order = F.when(F.col("kind") == "buffer", F.lit(1 << 62)).otherwise(F.col("line_no"))
    parts = _lines_of(toks).where("kind <> 'silence'").withColumn("o", order).groupBy("session_id").agg(lines.joined("o", "text").alias("parts"))
    both = whole.join(parts.hint("merge"), "session_id", "left")
    return both.agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n_tokens").alias("n_tokens"), F.count_if(~F.col("whole").eqNullSafe(F.col("parts"))).alias("n_broken"))


QUERIES = {f.__name__: f for f in (token_speakers, speaker_lines, lines_in_blocks, segments_in_blocks, pauses_in_blocks, conversation_turns, speaker_talk_time, translation_owners, translation_contained, tokens_in_ranges, spans_at_points, nearest_turn, words_outside_spans, span_by_end, segments_at_marks, lines_at_pauses, merged_spans, concatenated_speakers, monotonic_spans, partition_check)}

SPEAKERS = """
owners AS (
    SELECT t.session_id, t.seq, arg_max(s.speaker, (least(t.end_cs, s.end_cs) - greatest(t.start_cs, s.start_cs), -s.span_no)) AS own
    FROM tokens t JOIN spans s ON t.session_id = s.session_id AND ((s.end_cs > t.start_cs AND s.start_cs < t.end_cs)
        OR (t.start_cs = t.end_cs AND s.start_cs <= t.start_cs AND t.start_cs < s.end_cs)) GROUP BY ALL),
spoken AS (SELECT t.*, coalesce(own + 1, 1)::INT AS speaker FROM tokens t LEFT JOIN owners USING (session_id, seq))"""

LINES = """
cover AS (SELECT session_id, max(end_cs) AS cover FROM spans GROUP BY session_id),
t1 AS (
    SELECT t.*, cover, kind = 'silence' AS silent, sum((kind = 'silence')::INT) OVER w AS epoch
    FROM timeline t LEFT JOIN cover USING (session_id) WINDOW w AS (PARTITION BY t.session_id ORDER BY seq2 ROWS UNBOUNDED PRECEDING)),
t2 AS (
    SELECT *, NOT silent AND regexp_matches(text, '^[.!?]+$')
        AND row_number() OVER (PARTITION BY session_id, epoch, silent ORDER BY seq2) > 1 AS attached FROM t1),
t3 AS (
    SELECT *, coalesce(bool_or(NOT silent AND start_cs >= cover AND NOT attached) OVER (PARTITION BY session_id ORDER BY seq2 ROWS UNBOUNDED PRECEDING), FALSE) AS waits FROM t2),
t4 AS (
    SELECT t3.*, CASE WHEN silent THEN -2 WHEN cover IS NULL THEN -1 ELSE
        last_value(CASE WHEN NOT silent AND NOT attached THEN s.speaker END IGNORE NULLS) OVER (PARTITION BY t3.session_id, epoch ORDER BY t3.seq2 ROWS UNBOUNDED PRECEDING) END AS speaker
    FROM t3 LEFT JOIN (SELECT session_id, seq * 2 AS seq2, speaker FROM spoken) s USING (session_id, seq2)),
t5 AS (
    SELECT *, sum(c) OVER (PARTITION BY session_id ORDER BY seq2 ROWS UNBOUNDED PRECEDING)::BIGINT AS line_no FROM (
        SELECT *, CASE WHEN coalesce(silent OR lag(silent) OVER w OR speaker <> lag(speaker) OVER w, TRUE) THEN 1 ELSE 0 END AS c
        FROM t4 WHERE NOT waits WINDOW w AS (PARTITION BY session_id ORDER BY seq2))),
lines AS (
    SELECT session_id, line_no, CASE WHEN bool_or(silent) THEN 'silence' ELSE 'line' END AS kind, min(speaker)::INT AS speaker, min(start_cs) AS start_cs, max(end_cs) AS end_cs,
        CASE WHEN NOT bool_or(silent) THEN string_agg(text, '' ORDER BY seq2) END AS text, count(*) FILTER (NOT silent) AS n_tokens FROM t5 GROUP BY session_id, line_no
    UNION ALL
    SELECT session_id, 0, 'buffer', NULL, min(start_cs), max(end_cs), string_agg(text, '' ORDER BY seq2), count(*) FROM t4 WHERE waits AND NOT silent GROUP BY session_id)"""

BASE = f"WITH {TOKENS}, {TURNS}, {SPANS}"
FULL = f"{BASE}, {SPEAKERS}, {TIMELINE}, {LINES}"
STAMP = "(start_cs // 360000)::VARCHAR || ':' || lpad(((start_cs // 6000) % 60)::VARCHAR, 2, '0') || ':' || lpad(((start_cs // 100) % 60)::VARCHAR, 2, '0') || '.' || lpad((start_cs % 100)::VARCHAR, 2, '0')"

ORACLES = {
    "token_speakers": f"{BASE}, {SPEAKERS} SELECT session_id, seq, speaker FROM spoken",
    "speaker_lines": f"{FULL} SELECT *, {STAMP} AS begins FROM lines",
    "speaker_talk_time": f"""{FULL},
        turned AS (SELECT session_id, count(DISTINCT speaker) AS n_speakers, count(*) FILTER (changed) AS n_changes FROM (
            SELECT session_id, speaker, speaker <> lag(speaker) OVER (PARTITION BY session_id ORDER BY line_no) AS changed FROM lines WHERE kind = 'line') GROUP BY session_id)
        SELECT session_id, speaker, sum(end_cs - start_cs)::BIGINT AS talk_cs, count(*) AS n_lines, sum(n_tokens)::BIGINT AS n_tokens, any_value(n_speakers) AS n_speakers, any_value(n_changes) AS n_changes
        FROM lines JOIN turned USING (session_id) WHERE kind = 'line' GROUP BY session_id, speaker""",
    "translation_owners": f"""{FULL}, {TRANSLATIONS},
        l AS (SELECT * FROM lines WHERE kind = 'line'),
        m AS (SELECT tr.session_id, tr_no, line_no, least(tr.end_cs, l.end_cs) - greatest(tr.start_cs, l.start_cs) AS o,
                (tr.start_cs < tr.end_cs AND least(tr.end_cs, l.end_cs) > greatest(tr.start_cs, l.start_cs)) OR (tr.start_cs = tr.end_cs AND l.start_cs <= tr.start_cs AND tr.start_cs < l.end_cs) AS hit,
                greatest(l.start_cs - tr.end_cs, tr.start_cs - l.end_cs, 0) AS far FROM tr JOIN l USING (session_id))
        SELECT session_id, tr_no, coalesce(arg_max(line_no, (o, -line_no)) FILTER (hit), arg_min(line_no, (far, line_no))) AS owner FROM m GROUP BY session_id, tr_no""",
    "translation_contained": f"{BASE}, {TRANSLATIONS} SELECT session_id, tr_no, span_no FROM tr JOIN spans s USING (session_id) WHERE s.start_cs <= tr.start_cs AND s.end_cs >= tr.end_cs",
    "tokens_in_ranges": f"""WITH {TOKENS}, {TRANSLATIONS} SELECT session_id, tr_no, count(*) AS n_tokens, trim(string_agg(t.text, '' ORDER BY seq)) AS text
        FROM tokens t JOIN tr USING (session_id) WHERE t.end_cs >= tr.start_cs AND t.start_cs <= tr.end_cs GROUP BY session_id, tr_no""",
    "spans_at_points": f"""{BASE} SELECT p.session_id, t, min(span_no) AS line_no FROM (SELECT session_id, turn, (a + b) // 2 AS t FROM turns) p
        LEFT JOIN spans s ON p.session_id = s.session_id AND t BETWEEN s.start_cs AND s.end_cs GROUP BY p.session_id, turn, t""",
    "nearest_turn": f"""WITH {TOKENS}, {TURNS}, {TRANSLATIONS} SELECT session_id, tr_no, end_cs AS t, arg_min(turn, (abs(a - end_cs), turn)) AS no
        FROM tr JOIN turns USING (session_id) GROUP BY session_id, tr_no, end_cs""",
    "words_outside_spans": f"""{BASE} SELECT session_id, seq, text FROM tokens t WHERE NOT EXISTS (
        SELECT 1 FROM spans s WHERE s.session_id = t.session_id AND t.start_cs BETWEEN s.start_cs AND s.end_cs)""",
    "span_by_end": f"""{BASE} SELECT t.session_id, seq, arg_min(span_no, (s.end_cs, span_no)) AS span_no
        FROM tokens t LEFT JOIN spans s ON s.session_id = t.session_id AND s.end_cs >= t.end_cs GROUP BY t.session_id, seq""",
    "segments_at_marks": f"""WITH {TOKENS}, {TIMELINE},
        e AS (SELECT *, kind = 'silence' OR regexp_matches(text, '[.!?]') AS ends FROM timeline),
        n AS (SELECT *, sum(c) OVER (PARTITION BY session_id ORDER BY seq2 ROWS UNBOUNDED PRECEDING)::BIGINT AS seg_no FROM (
            SELECT *, CASE WHEN coalesce(kind = 'silence' OR lag(ends) OVER (PARTITION BY session_id ORDER BY seq2), TRUE) THEN 1 ELSE 0 END AS c FROM e))
        SELECT session_id, seg_no, min(kind) AS kind, bool_or(ends) OR lead(seg_no) OVER (PARTITION BY session_id ORDER BY seg_no) IS NOT NULL AS complete,
            min(start_cs) AS start_cs, arg_max(end_cs, seq2) AS end_cs, coalesce(string_agg(text, '' ORDER BY seq2), '') AS text FROM n GROUP BY session_id, seg_no""",
    "lines_at_pauses": f"""WITH {TOKENS}, {TIMELINE},
        n AS (SELECT *, sum(c) OVER (PARTITION BY session_id ORDER BY seq2 ROWS UNBOUNDED PRECEDING)::BIGINT AS line_no FROM (
            SELECT *, CASE WHEN coalesce(kind <> lag(kind) OVER (PARTITION BY session_id ORDER BY seq2), TRUE) THEN 1 ELSE 0 END AS c FROM timeline))
        SELECT session_id, line_no, min(kind) AS kind, min(start_cs) AS start_cs, arg_max(end_cs, seq2) AS end_cs, string_agg(text, '' ORDER BY seq2) AS text,
            min(kind) = 'silence' AND arg_max(end_cs, seq2) - min(start_cs) > 700 AS boundary FROM n GROUP BY session_id, line_no""",
    "merged_spans": f"""{BASE},
        n AS (SELECT *, sum(c) OVER (PARTITION BY session_id ORDER BY span_no ROWS UNBOUNDED PRECEDING)::BIGINT AS run_no FROM (
            SELECT *, CASE WHEN coalesce(speaker <> lag(speaker) OVER (PARTITION BY session_id ORDER BY span_no), TRUE) THEN 1 ELSE 0 END AS c FROM spans))
        SELECT session_id, run_no, min(speaker) AS speaker, arg_min(start_cs, span_no) AS start_cs, arg_max(end_cs, span_no) AS end_cs, count(*) AS n_spans FROM n GROUP BY session_id, run_no""",
    "concatenated_speakers": f"""{BASE},
        u AS (SELECT session_id, span_no, start_cs, end_cs, speaker + 1 AS speaker FROM spans UNION ALL SELECT DISTINCT session_id, -1, 0, 0, 1 FROM spans),
        n AS (SELECT *, sum(c) OVER (PARTITION BY session_id ORDER BY span_no ROWS UNBOUNDED PRECEDING)::BIGINT AS run_no FROM (
            SELECT *, CASE WHEN coalesce(speaker <> lag(speaker) OVER (PARTITION BY session_id ORDER BY span_no), TRUE) THEN 1 ELSE 0 END AS c FROM u))
        SELECT session_id, run_no, min(speaker) AS speaker, arg_min(start_cs, span_no) AS start_cs, arg_max(end_cs, span_no) AS end_cs, count(*) AS n_spans FROM n GROUP BY session_id, run_no""",
    "monotonic_spans": f"""{BASE.replace("WITH", "WITH RECURSIVE", 1)},
        o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY span_no) AS i FROM spans),
        f AS (
            SELECT session_id, span_no, i, greatest(1, start_cs) AS s, greatest(start_cs, end_cs, 1) AS e FROM o WHERE i = 1
            UNION ALL SELECT o.session_id, o.span_no, o.i, greatest(f.e + 1, o.start_cs), greatest(f.e + 1, o.start_cs, o.end_cs) FROM f JOIN o ON o.session_id = f.session_id AND o.i = f.i + 1)
        SELECT session_id, span_no, s AS start_cs, e AS end_cs FROM f""",
    "conversation_turns": f"""{BASE}, {SPEAKERS},
        n AS (SELECT *, sum(c) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS turn_no FROM (
            SELECT *, CASE WHEN coalesce(speaker <> lag(speaker) OVER (PARTITION BY session_id ORDER BY seq), TRUE) THEN 1 ELSE 0 END AS c FROM spoken))
        SELECT session_id, turn_no, min(speaker) AS speaker, trim(string_agg(text, '' ORDER BY seq)) AS text FROM n GROUP BY session_id, turn_no""",
    "pauses_in_blocks": f"""WITH {TOKENS}, {TIMELINE},
        n AS (SELECT *, sum(c) OVER (PARTITION BY session_id ORDER BY seq2 ROWS UNBOUNDED PRECEDING)::BIGINT AS line_no, max(seq2) FILTER (kind = 'silence' OR regexp_matches(text, '[.!?]')) OVER (PARTITION BY session_id) AS last,
                coalesce(sum(length(trim(text)) + 1) OVER (PARTITION BY session_id ORDER BY seq2 DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 200 AS prompt FROM (
            SELECT *, CASE WHEN coalesce(kind <> lag(kind) OVER (PARTITION BY session_id ORDER BY seq2), TRUE) THEN 1 ELSE 0 END AS c FROM timeline)),
        l AS (SELECT session_id, line_no, min(start_cs) AS a, max(end_cs) AS b FROM n WHERE kind = 'token' GROUP BY session_id, line_no)
        SELECT l.session_id, l.line_no, count(*) AS n, count(*) FILTER (n.seq2 <= n.last) AS n_released, count(*) FILTER (n.prompt) AS n_prompt
        FROM l JOIN n ON n.session_id = l.session_id AND n.kind = 'token' AND n.start_cs >= l.a AND n.end_cs <= l.b GROUP BY l.session_id, l.line_no""",
    "partition_check": f"WITH {TOKENS} SELECT count(DISTINCT session_id) AS n_sessions, count(*) AS n_tokens, 0::BIGINT AS n_broken FROM tokens",
}
ORACLES["lines_in_blocks"] = f"{FULL} SELECT * FROM lines"
ORACLES["segments_in_blocks"] = ORACLES["segments_at_marks"]

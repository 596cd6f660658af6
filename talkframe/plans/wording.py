"""Queries over words in order, candidates and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkframe.functions import text as T
from talkframe.operators import exports, lines, ranking, words
from talkframe.plans.speech import BASE, FULL
from talkframe.plans.speech import _lines as all_lines
from talkframe.plans.tables_sql import TIMELINE, TOKENS, TURNS
from talkframe.sources import adapters
from talkframe.sources.scratch import kept


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.tokens(spark, sf_dir)


def context_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's last words of at least 200 characters."""
    rows = words.context_suffix(_tokens(spark, sf_dir)).where("prompt")
    return rows.groupBy("session_id").agg(F.trim(lines.joined("seq", "text")).alias("prompt"), F.count(F.lit(1)).alias("n_words"))


def trim_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the audio buffer can be cut, by sentences and by segments."""
    timeline = adapters.timeline(_tokens(spark, sf_dir))
    sentences = lines.segments_at_marks(timeline).where("kind = 'token'")
    committed = sentences.groupBy("session_id").agg(F.expr("max(end_cs) * 3 div 4").alias("committed_cs"))
    by_segment = words.segment_trim(sentences, committed).withColumnRenamed("trim_cs", "segment_cs")
    return words.penultimate_end(sentences).join(by_segment.hint("merge"), "session_id")


def word_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W17, X12 over recorded words: gaps of at least three seconds."""
    return words.word_gaps(_tokens(spark, sf_dir), 300)


def smoothed_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of seven neighbouring word lengths."""
    rows = _tokens(spark, sf_dir).withColumn("v", (F.col("end_cs") - F.col("start_cs")).cast("double"))
    return words.rolling_median(rows, "v", 7).select("session_id", "seq", "smooth")


def clipped_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19, W19."""
    return words.clip_long_words(_tokens(spark, sf_dir)).select("session_id", "seq", "start_cs", "end_cs")


def merged_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks join the words before them."""
    return words.merge_marks(adapters.tokens(spark, sf_dir, "piece"), order=("turn", "pos", "piece"))


def subwords_to_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words from their pieces of at most three characters, a list for each turn."""
    cut = F.flatten(F.transform("tokens", lambda t: F.regexp_extract_all(t, F.lit(r"(?s).{1,3}"), F.lit(0))))
    rows = adapters.turn_tokens(spark, sf_dir).select("session_id", "turn", F.transform(cut, lambda p: F.struct(p.alias("text"), F.lit(False).alias("special"))).alias("pieces"))
    return words.subwords_to_words(rows, "turn")


def word_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends from the next word's start, all shifted by ten seconds."""
    return words.word_end_from_next(_tokens(spark, sf_dir)).select("session_id", "seq", (F.col("start_cs") + 1000).alias("start_cs"), (F.col("end_cs") + 1000).alias("end_cs"))


def interpolated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each speaker line with equal shares of its time."""
    return words.interpolate_words(all_lines(spark, sf_dir).where("kind = 'line'"), ["session_id", "line_no"])


def char_offset_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word's time from the turn fragment that holds its first character."""
    toks = _tokens(spark, sf_dir)
    offset = F.sum(F.length("text")).over(words.upto()) - F.length("text")
    rows = toks.withColumn("offset", offset)
    fragments = rows.groupBy("session_id", "turn").agg(F.min("offset").alias("offset"), F.min("start_cs").alias("t")).drop("turn")
    return words.char_offset_times(rows.select("session_id", "seq", "offset"), fragments)


def released_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W26."""
    return words.released(adapters.timeline(_tokens(spark, sf_dir)))


def language_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language locked at each event of a user, from its type and value."""
    events = adapters.read(spark, sf_dir, "events")
    lang = F.element_at(F.array(*map(F.lit, ("de", "en", "fr", "xx"))), (F.length("event_type") % 4 + 1).cast("int"))
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint")
    rows = events.select(F.col("user_id").alias("session_id"), seq.alias("seq"), lang.alias("lang"), F.least(F.col("value") / 100, F.lit(1.0)).alias("conf"))
    rows = rows.withColumn("audio_s", F.col("seq") * 0.5)
    return words.language_lock(rows, "en", ["de", "en", "fr"]).select("session_id", "seq", "locked")


def position_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W33."""
    rows = _tokens(spark, sf_dir).select("session_id", "seq", F.col("start_cs").alias("s")).withColumn("pos", F.expr("s div 8"))
    return words.word_times_from_positions(rows).select("session_id", "seq", "start_cs", "end_cs")


def snapped_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that end at marks."""
    toks = _tokens(spark, sf_dir)
    return words.snap_to_marks(adapters.speaker_spans(toks), toks)


def sentence_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with the number of their sentence, the sentences found by text length alone."""
    by = words.by()
    toks = kept(_tokens(spark, sf_dir).select("session_id", "seq", "text").withColumn("_s", lines.islands(T.has_mark(F.lag("text").over(by)), by)))
    sentences = toks.groupBy("session_id", F.col("_s").alias("sent_no")).agg(lines.joined("seq", "text").alias("text"))
    return words.words_to_sentences(toks.select("session_id", "seq", "text"), sentences).select("session_id", "seq", "sent_no")


def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's events of a day, as candidates, the best by length penalty and the first acceptable by temperature."""
    events = adapters.read(spark, sf_dir, "events")
    rows = events.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_id").alias("seq"), (F.length("props") + F.length("event_type")).alias("length"), (-F.col("value")).alias("logprob"))
    rows = rows.withColumns({"temperature": (F.col("seq") % 6) / 5, "compression_ratio": F.lit(1.0) + (F.col("seq") % 20) / 10, "avg_logprob": F.greatest(F.col("logprob") / 20, F.lit(-2.0)), "no_speech_prob": (F.col("seq") % 10) / 10})
    best = ranking.best_candidates(rows.where(~ranking.skipped()), ["user_id", "day"], 1.0).select("user_id", "day", F.col("seq").alias("best"))
    first = ranking.first_acceptable(rows, ["user_id", "day"]).select("user_id", "day", F.col("seq").alias("first"))
    return first.join(best.hint("merge"), ["user_id", "day"], "left")


def long_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation until 30 seconds are reached."""
    turns = adapters.turn_bounds(_tokens(spark, sf_dir)).select("session_id", F.col("turn").alias("seq"), (F.col("b") - F.col("a")).alias("duration"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("text"))
    return ranking.long_samples(turns, 3000)


def first_meeting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation the turns of its first role until they exceed 20 seconds."""
    turns = adapters.turn_bounds(_tokens(spark, sf_dir)).select("session_id", "turn", "role", (F.col("b") - F.col("a")).alias("duration"))
    return ranking.first_group_until(turns, "role", "turn", "duration", 2000)


def last_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 80 words of each session and whether they loop."""
    kept = ranking.keep_last(_tokens(spark, sf_dir), ["session_id"], "seq", 80)
    rows = kept.groupBy("session_id").agg(lines.joined("seq", "text").alias("text")).withColumn("w", T.words("text"))
    return rows.select("session_id", F.size("w").alias("n_words"), F.array_join("w", " ").alias("words"), T.repetition_loop(F.col("w")).alias("loops"))


def changed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events whose type differs from the one before."""
    events = adapters.read(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_id", "event_type", F.struct("ts", "event_id").alias("o"))
    return ranking.changed_only(events, "o", "event_type").select("session_id", "event_id", "event_type")


def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 in the JVM, for composed text."""
    return adapters.read(spark, sf_dir, "documents").select("doc_id", T.normalize_text("text", unicode=False).alias("text"))


def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text under each normal form, as SHA-256, and how well it compresses."""
    seen = lambda c: F.sha2(c.cast("binary"), 256)
    docs = adapters.read(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")  # the work on a text outweighs its way; a large file has few splits
    return docs.select(
        "doc_id", seen(T.normalize_text("text")).alias("f1"), seen(T.remove_symbols("text")).alias("f2"), seen(T.remove_symbols_and_diacritics("text")).alias("f3"),
        seen(T.basic_normalize("text", True)).alias("f4"), seen(T.english_normalize("text")).alias("f5"), F.round(T.compression_ratio("text"), 4).alias("f18"),
    )


def repetition_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """turns whose words loop."""
    rows = adapters.read(spark, sf_dir, "conversations").select("conv_id", "turn", T.words("text").alias("w"))
    return rows.select("conv_id", "turn", F.size("w").alias("n_words"), T.repetition_loop(F.col("w")).alias("loops"))


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session's exports, one row per form."""
    found = kept(all_lines(spark, sf_dir))
    forms = [exports.writer(f)(found).select("session_id", F.lit(f).alias("form"), "content") for f in ("srt", "vtt", "txt", "json", "diarized_json", "text", "short_json")]
    out = forms[0]
    for f in forms[1:]:
        out = out.unionByName(f)
    return out


def subtitle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9, R2."""
    return exports.subtitles(all_lines(spark, sf_dir))


def tab_separated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S11."""
    return exports.tab_separated(all_lines(spark, sf_dir))


QUERIES = {f.__name__: f for f in (context_prompt, trim_points, word_gaps, smoothed_lengths, clipped_words, merged_marks, subwords_to_words, word_ends, interpolated_words, char_offset_times, released_words, language_lock, position_times, snapped_spans, sentence_words, best_candidates, long_samples, first_meeting, last_words, changed_events, normalized_texts, normal_forms, repetition_loops, exported, subtitle_files, tab_separated)}

SEGMENTS = f"""WITH {TOKENS}, {TIMELINE},
    e AS (SELECT *, kind = 'silence' OR regexp_matches(text, '[.!?]') AS ends FROM timeline),
    n AS (SELECT *, sum(c) OVER (PARTITION BY session_id ORDER BY seq2 ROWS UNBOUNDED PRECEDING)::BIGINT AS seg_no FROM (
        SELECT *, CASE WHEN coalesce(kind = 'silence' OR lag(ends) OVER (PARTITION BY session_id ORDER BY seq2), TRUE) THEN 1 ELSE 0 END AS c FROM e)),
    segs AS (SELECT session_id, seg_no, arg_max(end_cs, seq2) AS end_cs FROM n WHERE kind = 'token' GROUP BY session_id, seg_no)"""

CUE = "lpad((t // 3600000)::VARCHAR, 2, '0') || ':' || lpad(((t // 60000) % 60)::VARCHAR, 2, '0') || ':' || lpad(((t // 1000) % 60)::VARCHAR, 2, '0') || ',' || lpad((t % 1000)::VARCHAR, 3, '0')"

ORACLES = {
    "context_prompt": f"""WITH {TOKENS}, u AS (SELECT *, coalesce(sum(length(trim(text)) + 1) OVER (PARTITION BY session_id ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM tokens)
        SELECT session_id, trim(string_agg(text, '' ORDER BY seq)) AS prompt, count(*) AS n_words FROM u WHERE used < 200 GROUP BY session_id""",
    "trim_points": f"""{SEGMENTS}, c AS (SELECT session_id, max(end_cs) * 3 // 4 AS committed_cs, max(seg_no) AS last FROM segs GROUP BY session_id)
        SELECT session_id, list(end_cs ORDER BY seg_no)[-2] AS trim_cs, coalesce(max(end_cs) FILTER (seg_no < last AND end_cs <= committed_cs), any_value(committed_cs)) AS segment_cs
        FROM segs JOIN c USING (session_id) GROUP BY session_id""",
    "word_gaps": f"WITH {TOKENS}, g AS (SELECT session_id, end_cs AS last_end_cs, lead(start_cs) OVER (PARTITION BY session_id ORDER BY seq) AS next_start_cs FROM tokens) SELECT * FROM g WHERE next_start_cs - last_end_cs >= 300",
    "smoothed_lengths": f"""WITH {TOKENS}, l AS (SELECT session_id, list((end_cs - start_cs)::DOUBLE ORDER BY seq) AS v FROM tokens GROUP BY session_id),
        p AS (SELECT session_id, v, len(v) AS n, CASE WHEN len(v) > 3 THEN [v[5 - i] for i in range(1, 4)] || v || [v[len(v) - i] for i in range(1, 4)] END AS q FROM l)
        SELECT session_id, unnest(range(1, n + 1)) AS seq, unnest(CASE WHEN n > 3 THEN [list_sort(q[i : i + 6])[4] for i in range(1, n + 1)] ELSE v END) AS smooth FROM p""",
    "clipped_words": f"""WITH {TOKENS}, m AS (SELECT session_id, 2 * least(70.0::DOUBLE, coalesce(median(end_cs - start_cs) FILTER (end_cs <> start_cs), 0)) AS m FROM tokens GROUP BY session_id),
        b AS (SELECT t.*, m, trim(text) IN ('.', '!', '?') AS mark, lag(trim(text) IN ('.', '!', '?')) OVER (PARTITION BY session_id ORDER BY seq) AS was FROM tokens t JOIN m USING (session_id))
        SELECT session_id, seq, (CASE WHEN end_cs - start_cs > m AND NOT mark AND was THEN end_cs - m ELSE start_cs END)::DOUBLE AS start_cs,
            (CASE WHEN end_cs - start_cs > m AND mark AND was IS NOT NULL THEN start_cs + m ELSE end_cs END)::DOUBLE AS end_cs FROM b""",
    "word_ends": f"""WITH {TOKENS} SELECT session_id, seq, start_cs + 1000 AS start_cs, 1000 + greatest(start_cs + 2, coalesce(lead(start_cs) OVER (PARTITION BY session_id ORDER BY seq), start_cs + 10)) AS end_cs FROM tokens""",
    "interpolated_words": f"""{FULL}, w AS (SELECT session_id, line_no, start_cs, end_cs, regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+') AS w FROM lines WHERE kind = 'line'),
        x AS (SELECT *, len(w) AS n, unnest(range(0, len(w))) AS i FROM w)
        SELECT session_id, line_no, i, w[i + 1] AS text, round(start_cs + (end_cs - start_cs) / n * i, 6) AS start_cs,
            round(CASE WHEN i = n - 1 THEN end_cs ELSE start_cs + (end_cs - start_cs) / n * (i + 1) END, 6) AS end_cs FROM x""",
    "char_offset_times": f"""WITH {TOKENS}, o AS (SELECT *, (sum(length(text)) OVER (PARTITION BY session_id ORDER BY seq) - length(text))::BIGINT AS o FROM tokens)
        SELECT session_id, seq, o AS "offset", min(start_cs) OVER (PARTITION BY session_id, turn) AS t FROM o""",
    "released_words": f"""WITH {TOKENS}, {TIMELINE}, e AS (SELECT *, sum((kind = 'silence')::INT) OVER (PARTITION BY session_id ORDER BY seq2 ROWS UNBOUNDED PRECEDING) AS epoch FROM timeline),
        m AS (SELECT *, max(CASE WHEN regexp_matches(text, '[.!?]') THEN seq2 END) OVER (PARTITION BY session_id, epoch) AS l, max(epoch) OVER (PARTITION BY session_id) AS f FROM e)
        SELECT session_id, seq2, epoch < f OR coalesce(seq2 <= l, FALSE) AS released FROM m WHERE kind = 'token'""",
    "language_lock": """WITH e AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ['de', 'en', 'fr', 'xx'][length(event_type) % 4 + 1] AS lang, least(value / 100, 1.0) AS conf FROM events)
        SELECT session_id, seq, coalesce(first_value(CASE WHEN seq * 0.5 >= 2 AND conf >= 0.5 AND lang <> 'xx' THEN lang END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 'en') AS locked FROM e""",
    "position_times": f"""WITH {TOKENS}, p AS (SELECT session_id, seq, greatest(0, start_cs // 8 * 8 - 48) AS start_cs FROM tokens)
        SELECT session_id, seq, start_cs, coalesce(lead(start_cs) OVER (PARTITION BY session_id ORDER BY seq), start_cs + 8) AS end_cs FROM p""",
    "snapped_spans": f"""{BASE}, k AS (SELECT session_id, end_cs AS e FROM tokens WHERE regexp_matches(trim(text), '^[.!?]+$')),
        s AS (SELECT p.session_id, span_no, p.start_cs, coalesce(arg_min(e, (abs(e - p.end_cs), e)), any_value(p.end_cs)) AS end_cs FROM spans p LEFT JOIN k USING (session_id) GROUP BY p.session_id, span_no, p.start_cs)
        SELECT session_id, span_no, coalesce(lag(end_cs) OVER (PARTITION BY session_id ORDER BY span_no), start_cs) AS start_cs, end_cs FROM s""",
    "sentence_words": f"""WITH {TOKENS}, b AS (SELECT *, CASE WHEN coalesce(regexp_matches(lag(text) OVER (PARTITION BY session_id ORDER BY seq), '[.!?]'), TRUE) THEN 1 ELSE 0 END AS c FROM tokens)
        SELECT session_id, seq, sum(c) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS sent_no FROM b""",
    "best_candidates": """WITH r AS (
            SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id AS seq, length(props) + length(event_type) AS length, -value AS logprob, (event_id % 6) / 5 AS temperature,
                1 + (event_id % 20) / 10 AS compression_ratio, greatest(-value / 20, -2.0) AS avg_logprob, (event_id % 10) / 10 AS no_speech_prob FROM events),
        q AS (SELECT *, (compression_ratio > 2.4 OR avg_logprob < -1) AND NOT (no_speech_prob > 0.6 AND avg_logprob < -1) AS bad, no_speech_prob > 0.6 AND NOT avg_logprob > -1 AS skipped FROM r)
        SELECT user_id, day, arg_min(seq, (bad, CASE WHEN bad THEN -temperature ELSE temperature END, seq)) AS first, arg_max(seq, (logprob / ((5 + length) / 6), -seq)) FILTER (NOT skipped) AS best FROM q GROUP BY user_id, day""",
    "long_samples": f"""WITH {TOKENS}, {TURNS}, u AS (SELECT session_id, turn, b - a AS d, coalesce(sum(b - a) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM turns)
        SELECT session_id, count(*) AS n, (sum(d) + (count(*) - 1) * 50)::BIGINT AS duration, string_agg('t' || turn, ' ' ORDER BY turn) AS text FROM u WHERE used < 3000 GROUP BY session_id""",
    "first_meeting": f"""WITH {TOKENS}, {TURNS}, g AS (SELECT session_id, turn, role, b - a AS duration, first_value(role) OVER (PARTITION BY session_id ORDER BY turn) AS r FROM turns),
        u AS (SELECT *, coalesce(sum(duration) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM g WHERE role = r)
        SELECT session_id, turn, role, duration FROM u WHERE used <= 2000""",
    "changed_events": """WITH e AS (SELECT user_id AS session_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
        SELECT session_id, event_id, event_type FROM e WHERE b IS NULL OR b <> event_type""",
    "subtitle_files": f"""{FULL}, c AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS cue FROM lines WHERE kind = 'line' AND text <> '')
        SELECT session_id, string_agg(cue || chr(10) || {CUE.replace("t ", "(start_cs * 10) ")} || ' --> ' || {CUE.replace("t ", "(end_cs * 10) ")} || chr(10) || trim(text) || chr(10), chr(10) ORDER BY cue) AS content FROM c GROUP BY session_id""",
    "tab_separated": f"""{FULL} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS cue, start_cs * 10 AS "start", end_cs * 10 AS "end", trim(text) AS text FROM lines WHERE kind = 'line' AND text <> ''""",
}

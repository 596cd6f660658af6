"""Queries over single functions and small operators: marks, statuses, prefixes, labels, payloads, saved files, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkframe.functions import registered, times, values
from talkframe.functions import text as T
from talkframe.operators import exports, joins, lines, metrics, ranking, words
from talkframe.plans.measures import RUNS, _runs, _systems
from talkframe.plans.speech import FULL, _lines, _tokens
from talkframe.plans.tables_sql import TIMELINE, TOKENS, TURNS
from talkframe.sources import adapters, files
from talkframe.sources.scratch import shared_dir
from talkframe.streaming import sinks

WORD = r"[^\x20\x09-\x0D]+"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.read(spark, sf_dir, "conversations").where("text IS NOT NULL").select(F.col("conv_id").alias("session_id"), "turn", "role", "text")


def mark_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of punctuation alone."""
    return adapters.tokens(spark, sf_dir).where(T.only_marks("text")).select("session_id", "seq", "text")


def visible_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines between pauses with text, those of under 150 characters counted as blank, and silences."""
    found = lines.lines_at_pauses(adapters.timeline(adapters.tokens(spark, sf_dir)))
    found = found.withColumn("text", F.when(F.length("text") >= 150, F.col("text")))
    return ranking.visible_lines(found).select("session_id", "line_no", "kind")


def speech_and_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of speech, silences, and whether there are any, per session."""
    found = _lines(spark, sf_dir).where("kind <> 'buffer'")
    all_of = found.groupBy("session_id").agg(lines.has_silence().alias("has_silence"))
    count = lambda df, name: df.groupBy("session_id").agg(F.count(F.lit(1)).alias(name))
    out = all_of.join(count(lines.speech_lines(found), "n_speech").hint("merge"), "session_id", "left")
    return out.join(count(lines.silence_segments(found), "n_silences").hint("merge"), "session_id", "left").fillna(0)


def clipped_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens in chosen ranges of time, the last of them open."""
    toks = _tokens(spark, sf_dir)
    ranges = [(n, int(s * 100), int(min(e, 1e7) * 100)) for n, (s, e) in enumerate(ranking.clip_ranges("2,10,20.5,31,60"))]
    sessions = toks.groupBy("session_id").agg(F.max("end_cs").alias("last"))
    cut = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.lit(s).cast("bigint").alias("s"), F.least(F.lit(e).cast("bigint"), F.col("last")).alias("e")) for n, s, e in ranges)))
    spans = sessions.select("session_id", cut.alias("r")).select("session_id", F.col("r.n").alias("range_no"), F.col("r.s").alias("start_cs"), F.col("r.e").alias("end_cs")).where("start_cs <= end_cs")
    return joins.in_ranges(toks.select("session_id", "seq", "start_cs", "end_cs"), spans).select("session_id", "seq", F.col("r_range_no").alias("range_no"))


def session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day has a status: its large purchases stand for lines, its errors for what is buffered."""
    events = adapters.read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session_id"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    counted = events.agg(F.count_if(F.expr("event_type = 'purchase' AND value >= 30")).alias("n_lines"), F.array_join(F.collect_list(F.when(F.col("event_type") == "error", "e")), "").alias("buffer"))
    return counted.select("session_id", "day", ranking.status_of(F.col("n_lines"), F.col("buffer")).alias("status"))


def uncommitted_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20: turns as buffers, of which every other begins with the text just committed."""
    rows = _turns(spark, sf_dir)
    new = F.when(F.col("turn") % 2 == 0, F.substring("text", 1, 20)).otherwise(F.substring("text", 3, 20))
    return rows.select("session_id", "turn", T.strip_committed_prefix(F.col("text"), new).alias("buffer"))


def unified_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a foreign source, without spaces and some of them blank, as tokens."""
    word = F.when(F.col("seq") % 50 == 0, F.lit("  ")).otherwise(F.trim("text"))
    foreign = adapters.tokens(spark, sf_dir).select(F.col("session_id").alias("call"), F.col("seq").alias("n"), word.alias("word"), (F.col("start_cs") / 100).alias("begin"), (F.col("end_cs") / 100).alias("stop"), F.length("role").alias("who"))
    names = {"session_id": "call", "seq": "n", "start_s": "begin", "end_s": "stop", "text": "word", "speaker": "who"}
    return ranking.unify_tokens(foreign, names, lead_space=True).select("session_id", "seq", "text", "start_s", "end_s", "speaker", "lang")


def joined_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """words and marks of a turn joined again."""
    pieces = F.regexp_extract_all("text", F.lit(adapters.PIECE), F.lit(0))
    return _turns(spark, sf_dir).select("session_id", "turn", T.join_fragments(pieces).alias("text"))


def shared_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how many words each turn's text shares with the same text of which a word is another."""
    ws = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    rows = _turns(spark, sf_dir).select("session_id", "turn", ws.alias("w"))
    other = F.transform("w", lambda w, i: F.when(i == F.col("turn") * 3, F.lit("other")).otherwise(w))
    return rows.select("session_id", "turn", T.common_prefix_length(F.col("w"), other).alias("n"))


def speaker_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and labels of speakers named by number, by role or not at all."""
    name = F.when(F.col("turn") % 5 == 0, F.col("role")).when(F.col("turn") % 7 != 0, (F.col("turn") * 9 - 2).cast("string"))
    rows = adapters.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", values.speaker_index(name).alias("n"))
    return rows.select("session_id", "turn", F.col("n").cast("int").alias("n"), values.speaker_label(F.col("n")).alias("label"))


def projected_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tagged text with its words projected onto it; a turn in eleven lacks a word, so text is left over."""
    ws = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    kept = F.when(F.col("turn") % 11 == 10, F.filter(ws, lambda w, i: i != 1)).otherwise(ws)
    rows = _turns(spark, sf_dir).select("session_id", "turn", F.concat(F.lit("<|en|><|calm|>"), "text").alias("text"), kept.alias("words"))
    return registered.tagged_tokens(rows).select("session_id", "turn", "lang", F.array_join("tokens", "|").alias("tokens"), F.coalesce("error_code", F.lit("")).alias("error_code"))


def shown_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """turns without replacement characters, with a word underlined, and with the cue arrow escaped."""
    rows = _turns(spark, sf_dir).withColumn("w", F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)))
    return rows.select(
        "session_id", "turn", T.without_replacement_chars(F.translate(F.element_at("w", 1), "aeiou", "�" * 5)).alias("clean"),
        T.highlight("w", F.lit(1)).alias("underlined"), T.escape_arrow(F.replace(F.col("text"), F.lit(" a"), F.lit(" --> \ta"))).alias("escaped"),
    )


def stream_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the lags of a session at each event, from its number and value."""
    rows = adapters.read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 100).cast("double").alias("t"), F.round("value").alias("v"))
    lag = times.lags(F.col("t") + 7, F.lit(2.0), F.col("t") + 4, F.col("v") % 60, F.col("v") % 50, F.col("v") % 70)
    return rows.select("event_id", lag.alias("l")).select("event_id", "l.transcription", "l.processing", "l.policy", "l.speakers")


def response_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a response was made, the seconds of its audio and the seconds that are charged."""
    rows = adapters.read(spark, sf_dir, "events").withColumn("n_bytes", F.round(F.col("value") * 160).cast("bigint") * 100)
    seconds = times.pcm_seconds(F.col("n_bytes"))
    return rows.select("event_id", times.utc_created(F.col("ts").cast("timestamp")).alias("created"), seconds.alias("seconds"), times.half_even(seconds).cast("bigint").alias("charged"))


def likely_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """of each source the language with the largest share."""
    n = adapters.read(spark, sf_dir, "documents").where("lang IS NOT NULL").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    shares = n.groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "n")))).alias("m"))
    return shares.select("source", values.top_key(F.col("m")).alias("lang"), F.size("m").alias("n_langs"))


def words_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """each turn's words as JSON, in milliseconds."""
    toks = adapters.tokens(spark, sf_dir).groupBy("session_id", "turn").agg(F.array_sort(F.collect_list(F.struct("seq", "text", "start_cs", "end_cs"))).alias("t"))
    return toks.select("session_id", "turn", F.to_json(F.struct(values.words_payload(F.col("t")).alias("words"))).alias("content"))


def translated_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences as utterances: partial texts of three words more each, of which one in seven takes words back, and a final text for all but every fifth."""
    segs = lines.segments_at_marks(adapters.timeline(adapters.tokens(spark, sf_dir))).where("kind = 'token'")
    segs = segs.select("session_id", F.col("seg_no").alias("utt_no"), "start_cs", "end_cs", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w")).where(F.size("w") > 0)
    rows = segs.withColumn("seq", F.explode(F.sequence(F.lit(1), F.ceil(F.size("w") / 3).cast("int") + 1)))
    last = F.col("seq") > F.ceil(F.size("w") / 3)
    part = F.array_join(F.slice("w", F.when(F.col("seq") % 7 == 3, 2).otherwise(1), F.col("seq") * 3), " ")
    text = F.when(~last, part).when(F.col("utt_no") % 5 == 0, "").otherwise(F.concat(F.lit("="), F.array_join("w", " ")))
    return words.translation_utterances(rows.select("session_id", "utt_no", "seq", text.alias("text"), last.alias("is_final"), "start_cs", "end_cs"))


def caught_up_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that leave the buffer when speaker spans reach from a third to two thirds of a session."""
    toks = _tokens(spark, sf_dir)
    cover = toks.groupBy("session_id").agg(F.max("end_cs").alias("m"))
    before, after = (cover.select("session_id", F.expr(f"m * {k} div 3").alias("cover")) for k in (1, 2))
    return lines.caught_up(toks, before, after).select("session_id", "seq")


def history_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last eight pairs of source and translation of a session."""
    rows = _turns(spark, sf_dir).select("session_id", "turn", F.col("text").alias("source"), F.concat(F.lit("="), F.lower("text")).alias("translation"))
    return ranking.keep_last(rows, ["session_id"], "turn", 8)


def tokens_with_silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silence markers behind the words that they flush."""
    rows = adapters.timeline(_tokens(spark, sf_dir))
    return lines.with_silences(rows.where("kind = 'token'"), rows.where("kind = 'silence'")).select("session_id", "at", "kind", "start_cs", "end_cs")


def rounded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as a report writes them."""
    rows = _runs(spark, sf_dir).select("id", (F.col("audio_us") / 1e6).alias("duration_s"), "wer", (F.col("processing_us") / 1e6).alias("processing_time_s"), metrics.ratio(F.col("processing_us"), F.col("audio_us")).alias("rtf"), (F.col("latency_us") / 1000).alias("avg_latency_ms"))
    return metrics.rounded(rows)


def ordered_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by language, in order."""
    return metrics.grouped(_runs(spark, sf_dir), "language")


def joined_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long samples of conversations and the documents' texts as one set."""
    turns = adapters.turn_bounds(adapters.tokens(spark, sf_dir)).select("session_id", F.col("turn").alias("seq"), (F.col("b") - F.col("a")).alias("duration"), F.lit("t").alias("text"))
    long = ranking.long_samples(turns, 3000).select(F.concat(F.lit("c"), F.col("session_id").cast("string")).alias("name"), "duration")
    docs = adapters.read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), "lang")
    return ranking.all_samples(long, docs)


def sample_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a manifest on disk, read back for two languages."""
    turns = _turns(spark, sf_dir).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.min("role").alias("category"))
    lang = F.element_at(F.array(*map(F.lit, ("de", "en", "es", "fr"))), (F.col("session_id") % 4 + 1).cast("int"))
    sample = F.struct(F.col("session_id").cast("string").alias("name"), lang.alias("language"), "category", F.col("n").cast("double").alias("duration"))
    path = f"{shared_dir(spark)}/manifest-{uuid.uuid4().hex}"
    parts = turns.groupBy(F.pmod(F.xxhash64("session_id"), F.lit(64)).alias("part")).agg(F.to_json(F.sort_array(F.collect_list(sample))).alias("value"))
    parts.select("value").write.option("maxRecordsPerFile", 1).text(path)  # a file is one JSON array
    return files.read_manifest(spark, path, languages=["en", "fr"]).select("name", "language", "category", "duration")


def saved_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each backend's systems saved as a JSON report and read back."""
    report = _systems(spark, sf_dir).groupBy("backend").agg(F.sort_array(F.collect_list(F.struct("model", "language", "wer_pct", "rtf"))).alias("results"))
    path = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    exports.report_json(report, "backend").select(F.col("content").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return files.read_bench_results(spark, path).select("model", "language", F.col("wer_pct").cast("double").alias("wer_pct"), F.col("rtf").cast("double").alias("rtf"))


def scored_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's model over the calls: it is loaded once a task and maps batches to batches."""

    def load():
        return lambda pdf: pdf.assign(score=(pdf["dur_us"] // 1000) * 3 + 1)[["call_ix", "score"]]

    return files.score_partitions(adapters.calls(spark, sf_dir).select("call_ix", "dur_us"), load, "call_ix bigint, score bigint")


def streamed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a stream of files, every micro-batch handed to a callback that writes it once, under its number."""
    path = f"{shared_dir(spark)}/turns-{uuid.uuid4().hex}"
    _turns(spark, sf_dir).repartition(4, "session_id").write.parquet(f"{path}/in")
    rows = files.session_stream(spark, f"{path}/in", "session_id bigint, turn bigint, role string, text string", 2)
    write = lambda df, number: df.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
    sinks.snapshot_stream(rows, write, f"{path}/checkpoint").awaitTermination()
    found = spark.read.parquet(f"{path}/out")
    return found.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_turns"), F.max_by("text", "turn").alias("last_text"))


def verbose_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions whose lines have no segment yet get one over the whole duration where there is text."""
    rows = _turns(spark, sf_dir).groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.substring(x["text"], 1, 5)), " ").alias("text"), (F.count(F.lit(1)) * 2.5).alias("duration"))
    segment = F.struct(F.lit(0).alias("id"), F.lit(0.0).alias("start"), F.lit(1.5).alias("end"), F.substring("text", 1, 3).alias("text"))
    rows = rows.withColumns({"segments": F.when(F.col("session_id") % 3 == 0, F.array(segment)).otherwise(F.array().cast("array<struct<id:int,start:double,end:double,text:string>>")), "text": F.when(F.col("session_id") % 7 == 1, "").otherwise(F.col("text"))})
    found = exports.cli_verbose_json(rows)
    return found.select("session_id", F.size("segments").alias("n"), F.get("segments", F.lit(0))["end"].alias("end_s"), F.get("segments", F.lit(0))["text"].alias("text"))


QUERIES = {f.__name__: f for f in (
    mark_tokens, visible_lines, speech_and_silence, clipped_tokens, session_states, uncommitted_buffers, unified_tokens, joined_fragments, shared_prefixes, speaker_numbers, projected_words, shown_words, stream_lags,
    response_heads, likely_languages, words_json, translated_utterances, caught_up_tokens, history_pairs, tokens_with_silences, rounded_runs, ordered_groups, joined_samples, sample_manifest, saved_results, scored_calls,
    streamed_turns, verbose_sessions,
)}

_T = "t AS (SELECT conv_id AS session_id, turn, role, text FROM conversations WHERE text IS NOT NULL)"

ORACLES = {
    "mark_tokens": rf"WITH {TOKENS} SELECT session_id, seq, text FROM tokens WHERE regexp_matches(trim(text), '^\pP+$')",
    "visible_lines": f"""WITH {TOKENS}, {TIMELINE},
        n AS (SELECT *, sum(c) OVER (PARTITION BY session_id ORDER BY seq2 ROWS UNBOUNDED PRECEDING)::BIGINT AS line_no FROM (
            SELECT *, CASE WHEN coalesce(kind <> lag(kind) OVER (PARTITION BY session_id ORDER BY seq2), TRUE) THEN 1 ELSE 0 END AS c FROM timeline))
        SELECT session_id, line_no, min(kind) AS kind FROM n GROUP BY session_id, line_no HAVING min(kind) = 'silence' OR length(string_agg(text, '')) >= 150""",
    "speech_and_silence": f"""{FULL} SELECT session_id, bool_or(kind = 'silence') AS has_silence, count(*) FILTER (kind = 'line') AS n_speech, count(*) FILTER (kind = 'silence') AS n_silences
        FROM lines WHERE kind <> 'buffer' GROUP BY session_id""",
    "clipped_tokens": f"""WITH {TOKENS}, r AS (SELECT * FROM (VALUES (0, 200, 1000), (1, 2050, 3100), (2, 6000, NULL)) AS v(range_no, s, e))
        SELECT session_id, seq, range_no FROM tokens JOIN r ON end_cs >= s AND (e IS NULL OR start_cs <= e)""",
    "session_states": """SELECT user_id AS session_id, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN count(*) FILTER (event_type = 'purchase' AND value >= 30) = 0 AND count(*) FILTER (event_type = 'error') = 0
        THEN 'no_audio_detected' ELSE 'active_transcription' END AS status FROM events GROUP BY ALL""",
    "uncommitted_buffers": f"""WITH {_T}, n AS (SELECT *, CASE WHEN turn % 2 = 0 THEN text[1:20] ELSE text[3:22] END AS new FROM t)
        SELECT session_id, turn, CASE WHEN length(new) > 0 AND starts_with(text, new) THEN ltrim(substr(text, length(new) + 1)) ELSE text END AS buffer FROM n""",
    "unified_tokens": f"""WITH {TOKENS} SELECT session_id, seq, ' ' || trim(text) AS text, start_cs / 100 AS start_s, end_cs / 100 AS end_s, length(role)::INT AS speaker, NULL::VARCHAR AS lang FROM tokens WHERE seq % 50 <> 0""",
    "joined_fragments": rf"""WITH {_T}, p AS (SELECT session_id, turn, regexp_extract_all(text, '[^\x20\x09-\x0D.!?]+|[.!?]+') AS w FROM t)
        SELECT session_id, turn, CASE WHEN len(w) = 0 THEN '' ELSE list_reduce(w, lambda a, f : CASE WHEN regexp_matches(a, '[\pL\pN]$') AND regexp_matches(f, '^[\pL\pN]') THEN a || ' ' || f ELSE a || f END) END AS text FROM p""",
    "shared_prefixes": r"""WITH p AS (SELECT conv_id AS session_id, turn, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM conversations WHERE text IS NOT NULL)
        SELECT session_id, turn, CASE WHEN turn * 3 < len(w) AND w[turn * 3 + 1] <> 'other' THEN turn * 3 ELSE len(w) END::INT AS n FROM p""",
    "speaker_numbers": """WITH n AS (SELECT conv_id AS session_id, turn, greatest(coalesce(TRY_CAST(CASE WHEN turn % 5 = 0 THEN role WHEN turn % 7 <> 0 THEN (turn * 9 - 2)::VARCHAR END AS INT), 1) - 1, 0) AS n FROM conversations)
        SELECT session_id, turn, n, CASE WHEN n >= 702 THEN chr(((n - 702) // 676 + 65)::INT) ELSE '' END || CASE WHEN n >= 26 THEN chr(((n - 26) // 26 % 26 + 65)::INT) ELSE '' END || chr((n % 26 + 65)::INT) AS label FROM n""",
    "projected_words": r"""WITH p AS (SELECT conv_id AS session_id, turn, trim(text, ' ') AS c FROM conversations WHERE text IS NOT NULL),
        w AS (SELECT *, regexp_extract_all(c, '[\pL\pN]+') AS ws, turn % 11 = 10 AS lacks FROM p),
        g AS (SELECT *, regexp_extract_all(c, '[^\pL\pN]*[\pL\pN]+') AS gs, regexp_extract(c, '[^\pL\pN]*$') AS rest FROM w),
        b AS (SELECT *, CASE WHEN lacks AND len(ws) > 1 THEN 'projection' ELSE '' END AS error_code,
            [CASE WHEN i = 1 THEN gs[1] ELSE regexp_extract(gs[i], '\s*[\pL\pN]+$') END || CASE WHEN i = len(gs) THEN rest ELSE regexp_replace(gs[i + 1], '\s*[\pL\pN]+$', '') END FOR i IN range(1, len(gs) + 1)] AS tokens FROM g)
        SELECT session_id, turn, 'en' AS lang, CASE WHEN error_code = '' THEN array_to_string(tokens, '|') END AS tokens, error_code FROM b""",
    "shown_words": r"""WITH p AS (SELECT conv_id AS session_id, turn, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS w FROM conversations WHERE text IS NOT NULL)
        SELECT session_id, turn, nullif(regexp_replace(w[1], '[aeiou]', '', 'g'), '') AS clean,
            array_to_string([CASE WHEN i = 2 THEN regexp_replace(w[i], '^(\s*)(.*)$', '\1<u>\2</u>') ELSE w[i] END FOR i IN range(1, len(w) + 1)], '') AS underlined,
            replace(replace(trim(replace(text, ' a', ' --> ' || chr(9) || 'a')), '-->', '->'), chr(9), ' ') AS escaped FROM p""",
    "stream_lags": """WITH e AS (SELECT event_id, (event_id % 100)::DOUBLE AS t, round(value) AS v FROM events)
        SELECT event_id, greatest(t + 7 - 2 - v % 50, 0.0) AS transcription, greatest(t + 4 - v % 60, 0.0) AS processing, greatest(v % 60 - v % 50, 0.0) AS policy, greatest(t + 4 - v % 70, 0.0) AS speakers FROM e""",
    "response_heads": """WITH e AS (SELECT event_id, ts, round(value * 160)::BIGINT * 100 / 32000 AS seconds FROM events)
        SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS created, seconds, round_even(seconds, 0)::BIGINT AS charged FROM e""",
    "likely_languages": """WITH n AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS k, count(*) OVER (PARTITION BY source) AS c FROM n) SELECT source, lang, c AS n_langs FROM r WHERE k = 1""",
    "words_json": f"""WITH {TOKENS} SELECT session_id, turn, '{{"words":[' || string_agg('{{"word":' || to_json(trim(text)) || ',"start_ms":' || start_cs * 10 || ',"end_ms":' || end_cs * 10 || '}}', ',' ORDER BY seq) || ']}}' AS content
        FROM tokens GROUP BY session_id, turn""",
    "caught_up_tokens": f"""WITH {TOKENS}, c AS (SELECT *, max(end_cs) OVER (PARTITION BY session_id) AS m FROM tokens),
        w AS (SELECT *, bool_or(start_cs >= m // 3) OVER o AS a, bool_or(start_cs >= m * 2 // 3) OVER o AS b FROM c WINDOW o AS (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) SELECT session_id, seq FROM w WHERE a AND NOT b""",
    "history_pairs": f"""WITH {_T} SELECT session_id, turn, text AS source, '=' || lower(text) AS translation FROM t QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= 8""",
    "tokens_with_silences": f"""WITH {TOKENS}, {TIMELINE} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY start_cs, kind = 'token', end_cs, text) AS at, kind, start_cs, end_cs FROM timeline""",
    "rounded_runs": f"""WITH RECURSIVE {RUNS} SELECT id, format('{{:.2f}}', audio_us / 1e6)::DOUBLE AS duration_s, format('{{:.4f}}', wer::DOUBLE)::DOUBLE AS wer, format('{{:.2f}}', processing_us / 1e6)::DOUBLE AS processing_time_s,
        format('{{:.3f}}', CASE WHEN audio_us > 0 THEN processing_us / audio_us ELSE 0::DOUBLE END)::DOUBLE AS rtf, format('{{:.1f}}', latency_us / 1000)::DOUBLE AS avg_latency_ms FROM runs""",
    "ordered_groups": f"WITH RECURSIVE {RUNS} SELECT language, count(*) AS n, round(avg(wer), 6) AS avg_wer, sum(audio_us)::BIGINT AS audio_us, row_number() OVER (ORDER BY language) AS place FROM runs GROUP BY language",
    "joined_samples": f"""WITH {TOKENS}, {TURNS}, u AS (SELECT session_id, b - a AS d, coalesce(sum(b - a) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM turns)
        SELECT 'c' || session_id AS name, (sum(d) + (count(*) - 1) * 50)::BIGINT AS duration, NULL AS lang FROM u WHERE used < 3000 GROUP BY session_id UNION ALL SELECT 'd' || doc_id, NULL, lang FROM documents""",
    "sample_manifest": f"""WITH {_T} SELECT session_id::VARCHAR AS name, ['de', 'en', 'es', 'fr'][session_id % 4 + 1] AS language, min(role) AS category, count(*)::DOUBLE AS duration FROM t WHERE session_id % 4 IN (1, 3) GROUP BY session_id""",
    "saved_results": f"WITH RECURSIVE {RUNS} SELECT model, language, wer_pct, rtf FROM systems",
    "scored_calls": "SELECT event_id AS call_ix, CAST(round(value * 1000) AS BIGINT) // 1000 * 3 + 1 AS score FROM events",
    "streamed_turns": f"WITH {_T} SELECT session_id, count(*) AS n_turns, arg_max(text, turn) AS last_text FROM t GROUP BY session_id",
    "verbose_sessions": f"""WITH {_T}, s AS (SELECT session_id, CASE WHEN session_id % 7 = 1 THEN '' ELSE string_agg(text[1:5], ' ' ORDER BY turn) END AS said, string_agg(text[1:5], ' ' ORDER BY turn) AS text, count(*) * 2.5 AS d FROM t GROUP BY session_id)
        SELECT session_id, CASE WHEN session_id % 3 = 0 OR said <> '' THEN 1 ELSE 0 END AS n, CASE WHEN session_id % 3 = 0 THEN 1.5 WHEN said <> '' THEN d END AS end_s, CASE WHEN session_id % 3 = 0 THEN text[1:3] WHEN said <> '' THEN said END AS text FROM s""",
}

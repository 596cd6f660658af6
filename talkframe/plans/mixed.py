"""Queries over look-ups, segments with words, and checks of foreign results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.operators import audio, joins, ranking, words
from talkframe.plans.speech import BASE
from talkframe.plans.tables_sql import CALLS, TOKENS
from talkframe.sources import adapters
from talkframe.streaming import sinks, windows


def majority_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per translated span the speaker with the most overlap in sum, the lower number on ties."""
    toks = adapters.tokens(spark, sf_dir)
    met = joins.overlapping(adapters.translations(toks), adapters.speaker_spans(toks), "session_id", "start_cs", "end_cs", 6000)
    shared = met.groupBy("session_id", "tr_no", F.col("r_speaker").alias("speaker")).agg(F.sum(joins.overlap("start_cs", "end_cs", "r_start_cs", "r_end_cs")).alias("cs"))
    return shared.groupBy("session_id", "tr_no").agg(F.max(F.struct("cs", (-F.col("speaker")).alias("n"))).alias("m")).select("session_id", "tr_no", (-F.col("m.n")).alias("speaker"), F.col("m.cs").alias("cs"))


def session_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of conversations and users by number."""
    toks = adapters.tokens(spark, sf_dir)
    heard = toks.groupBy("session_id").agg((F.max("end_cs") / 100).alias("audio_s"))
    out = sinks.session_metrics(toks, adapters.calls(spark, sf_dir), heard)
    return out.select("session_id", "n_tokens", "n_calls", F.round("processing_s", 6).alias("processing_s"), F.round("audio_s", 2).alias("audio_s"), F.round("rtf", 6).alias("rtf"))


def compatible_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose source, as a backend, takes their language: sources of an even number take all, the others what they have most of."""
    docs = adapters.read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("backend"), F.col("lang").alias("language"))
    number = F.coalesce(F.regexp_extract("backend", "([0-9]+)", 1).try_cast("int"), F.lit(0))
    counts = docs.where("backend IS NOT NULL AND language IS NOT NULL").groupBy("backend", "language").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("backend").agg(F.max(F.struct("n", "language")).alias("m"))
    takes = best.select("backend", F.when(number % 2 == 1, F.col("m.language")).alias("language"))
    return ranking_only(joins.compatible(docs, takes))


def ranking_only(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "backend", "language")


def spelled_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens through a spelling table made of the corpus: words of benchmark items map to their upper case."""
    toks = adapters.tokens(spark, sf_dir).select("session_id", "seq", F.trim("text").alias("word"))
    items = adapters.read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return joins.lookup(toks, items.withColumn("as", F.upper("word")), "word", "as")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events of a day as words with spans in milliseconds, some of them malformed, checked."""
    events = adapters.read(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", "event_type", "value")
    span = F.when(F.col("event_id") % 97 == 0, F.array(F.col("value"))).when(F.col("event_id") % 89 == 0, F.array(F.col("value"), F.col("value") - 1)).otherwise(F.array(F.col("event_id").cast("double"), F.col("event_id") + F.col("value")))
    rows = events.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type", span.alias("span")))).alias("e"))
    checked = ranking.checked_spans(rows.select("user_id", "day", F.transform("e", lambda x: x["event_type"]).alias("words"), F.transform("e", lambda x: x["span"]).alias("spans")))
    return checked.select("user_id", "day", F.size("words").alias("n"), "error_code")


def checked_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results and the error of each."""
    return _results(spark, sf_dir)


def plausible_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as segments with words whose probability follows from their length; those that look invented go."""
    toks = adapters.tokens(spark, sf_dir)
    word = F.struct(F.col("text").alias("word"), (F.col("start_cs") / 100).alias("start_s"), (F.col("end_cs") / 100).alias("end_s"), F.when(F.length("text") > 14, 0.1).otherwise(0.8).alias("prob"))
    rows = toks.withColumn("w", word).groupBy("session_id", F.col("turn").alias("seq")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("seq").alias("o"), "w"))), lambda x: x["w"]).alias("words"))
    rows = rows.withColumns({"start_s": F.get("words", F.lit(0))["start_s"], "end_s": F.element_at("words", -1)["end_s"], "window_id": F.floor(F.col("seq") / 4)})
    return words.drop_hallucinations(rows).select("session_id", "seq", F.size("words").alias("n_words"), "start_s", "end_s")


def rated_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that bring no more tokens than their time allows, at a rate low enough to tell."""
    toks = adapters.tokens(spark, sf_dir)
    rows = toks.groupBy("session_id", "turn").agg(F.count(F.lit(1)).alias("n_tokens"), ((F.max("end_cs") - F.min("start_cs")) / 100).alias("audio_s"))
    return ranking.within_rate(rows, 2, 1.2, 5)


def newest_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a cumulative source, whose newest revision replaces the others: turns as revisions of three."""
    spans = adapters.speaker_spans(adapters.tokens(spark, sf_dir)).withColumn("rev", F.floor(F.col("span_no") / 3))
    return windows.newest_revision(spans, True).select("session_id", "span_no", "start_cs", "end_cs")


def last_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation the number of turns, the last that says something, and the distinct roles."""
    turns = adapters.read(spark, sf_dir, "conversations")
    said = F.col("text").isNotNull() & (F.trim("text") != "")
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_updates"), F.max_by(F.col("text"), F.when(said, F.col("turn"))).alias("last_text"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"))


def audio_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector numbers as samples, in chunks of 40; the remainder is the last."""
    vectors = adapters.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("session_id"), F.posexplode("embedding").alias("ix", "value"))
    chunks = audio.chunk_pcm(vectors, 40 / 16000)
    return chunks.select("session_id", F.col("chunk_ix").cast("bigint").alias("chunk_ix"), "n_samples", F.round(F.get("pcm", F.lit(0)), 6).alias("first"))


QUERIES = {f.__name__: f for f in (majority_speakers, session_metrics, compatible_runs, spelled_words, checked_results, plausible_segments, rated_batches, newest_spans, last_snapshots, audio_chunks)}

ORACLES = {
    "majority_speakers": f"""{BASE}, tr AS (SELECT session_id, turn // 2 AS tr_no, min(start_cs) AS start_cs, CASE WHEN (turn // 2) % 5 = 4 THEN min(start_cs) ELSE max(end_cs) END AS end_cs FROM tokens GROUP BY session_id, turn // 2),
        o AS (SELECT tr.session_id, tr_no, speaker, sum(least(tr.end_cs, s.end_cs) - greatest(tr.start_cs, s.start_cs))::BIGINT AS cs FROM tr JOIN spans s ON s.session_id = tr.session_id AND s.end_cs > tr.start_cs AND s.start_cs < tr.end_cs GROUP BY ALL)
        SELECT session_id, tr_no, arg_max(speaker, (cs, -speaker)) AS speaker, max(cs) AS cs FROM o GROUP BY session_id, tr_no""",
    "session_metrics": f"""WITH {TOKENS}, {CALLS}, t AS (SELECT session_id, count(*) AS n_tokens, round(max(end_cs) / 100, 2) AS audio_s FROM tokens GROUP BY session_id),
        c AS (SELECT session_id, count(*) AS n_calls, round(sum(dur_us) / 1e6, 6) AS processing_s FROM calls GROUP BY session_id)
        SELECT session_id, coalesce(n_tokens, 0) AS n_tokens, coalesce(n_calls, 0) AS n_calls, coalesce(processing_s, 0) AS processing_s, coalesce(audio_s, 0) AS audio_s,
            CASE WHEN coalesce(audio_s, 0) > 0 THEN round(coalesce(processing_s, 0) / audio_s, 6) ELSE 0 END AS rtf FROM t FULL JOIN c USING (session_id)""",
    "compatible_runs": """WITH m AS (SELECT source, lang, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY source, lang),
        b AS (SELECT source, CASE WHEN coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)', 1) AS INT), 0) % 2 = 1 THEN arg_max(lang, (n, lang)) END AS takes FROM m GROUP BY source)
        SELECT doc_id, source AS backend, lang AS language FROM documents JOIN b USING (source) WHERE takes IS NULL OR takes = lang""",
    "spelled_words": f"""WITH {TOKENS}, m AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark)
        SELECT session_id, seq, CASE WHEN w IS NULL THEN trim(text) ELSE upper(w) END AS word FROM tokens LEFT JOIN m ON trim(text) = w""",
    "rated_batches": f"""WITH {TOKENS} SELECT session_id, turn, count(*) AS n_tokens, (max(end_cs) - min(start_cs)) / 100 AS audio_s FROM tokens GROUP BY session_id, turn
        HAVING count(*) <= greatest(5, floor((max(end_cs) - min(start_cs)) / 100 * 2 * 1.2::DOUBLE))""",
    "newest_spans": f"{BASE} SELECT session_id, span_no, start_cs, end_cs FROM spans QUALIFY span_no // 3 = max(span_no // 3) OVER (PARTITION BY session_id)",
    "last_snapshots": """SELECT conv_id, count(*) AS n_updates, arg_max(text, turn) FILTER (text IS NOT NULL AND trim(text) <> '') AS last_text, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM conversations GROUP BY conv_id""",
    "audio_chunks": """WITH e AS (SELECT vec_id AS session_id, embedding AS v, unnest(range(0, len(embedding), 40)) AS x FROM embeddings)
        SELECT session_id, x // 40 AS chunk_ix, least(40, len(v) - x) AS n_samples, round(v[x + 1], 6) AS first FROM e""",
}

"""Queries of labels, bounds, checks, rounding, whole exports, audio files and functions for SQL users."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.functions import registered, times
from talkframe.operators import exports, joins, lines, metrics, ranking, words
from talkframe.plans.speech import FULL, _lines_of, _tokens
from talkframe.plans.tables_sql import TOKENS, TRANSLATIONS
from talkframe.sources import adapters, files
from talkframe.sources.scratch import kept, shared_dir


def named_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels of speakers named by number (up to AAA and on) or by word, the latter by first sight."""
    turns = adapters.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role")
    name = F.when(F.col("turn") % 3 == 0, F.col("role")).when(F.col("turn") % 3 == 1, F.concat(F.lit("guest"), (F.col("turn") % 4).cast("string"))).when(F.col("turn") % 5 > 0, (F.col("turn") * 131).cast("string"))
    return ranking.session_labels(turns.select("session_id", "turn", name.alias("name")), "name", "turn").select("session_id", "turn", "label")


def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as times of one to four parts, some of them no numbers."""
    part = lambda k: (F.col("event_id") % k).cast("string")
    text = F.when(F.col("event_id") % 6 == 0, F.concat(part(60), F.lit(".25"))).when(F.col("event_id") % 6 == 1, F.concat_ws(":", part(60), part(50))).when(F.col("event_id") % 6 == 2, F.concat_ws(":", part(9), part(60), F.lit("07.5")))
    text = text.when(F.col("event_id") % 6 == 3, F.concat_ws(":", part(2), part(3), part(4), part(5))).when(F.col("event_id") % 6 == 4, F.concat_ws(":", part(7), F.lit("x")))
    return adapters.read(spark, sf_dir, "events").select("event_id", times.parse_time(text).alias("seconds"))


def rounded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: values that lie on or near a half, to 0 to 3 decimals."""
    x = F.col("event_id") / 8 + 0.005
    y = (F.col("event_id") % 4000 * 10 + 5) / 1000
    return adapters.read(spark, sf_dir, "events").select("event_id", times.round_binary(x, 0).alias("n0"), times.round_binary(F.col("event_id") / 8, 2).alias("n2"), times.round_binary(y, 2).alias("h2"), times.round_binary(-x, 1).alias("m1"), times.round_binary(F.col("value"), 3).alias("n3"))


def spoken_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as segments; likely silence goes, instantaneous ones are blanked; where speech begins and ends in what is left."""
    toks = adapters.tokens(spark, sf_dir)
    word = F.struct("seq", F.struct("text", (F.col("start_cs") / 100).alias("start_s"), (F.col("end_cs") / 100).alias("end_s")).alias("w"))
    rows = toks.groupBy("session_id", F.col("turn").alias("seq")).agg(F.transform(F.array_sort(F.collect_list(word)), lambda x: x["w"]).alias("words"), (F.min("start_cs") / 100).alias("start_s"), (F.max("end_cs") / 100).alias("end_s"))
    rows = rows.withColumns({"text": F.array_join(F.transform("words", lambda w: w["text"]), ""), "no_speech_prob": (F.col("seq") * 3 % 10 + 1) / 10})
    # the first turn of every session is instantaneous, and so are all of every fifth session
    rows = rows.withColumn("end_s", F.when((F.col("seq") == 0) | (F.col("session_id") % 5 == 0), F.col("start_s")).otherwise(F.col("end_s")))
    return ranking.bounds(ranking.blank_empty(ranking.with_speech(rows)))


def kept_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: the words of turns that are likely speech."""
    toks = adapters.tokens(spark, sf_dir)
    rows = toks.groupBy("session_id", "turn").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]).alias("words"))
    return ranking.without_no_speech(rows.withColumn("no_speech_prob", (F.col("turn") * 3 % 10 + 1) / 10)).select("session_id", "turn", "word")


def sampled_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: of each conversation two turns behind the first."""
    rows = adapters.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role")
    return ranking.skip_take(rows, ["session_id"], "turn", 1, 2)


def range_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who speaks in each translated span."""
    toks = _tokens(spark, sf_dir)
    spoken = kept(_lines_of(toks).where("kind = 'line'").select("session_id", "speaker", "start_cs", "end_cs"))
    found = joins.speakers_in(adapters.translations(toks), spoken, "tr_no")
    return found.select("session_id", "tr_no", F.array_join(F.col("speakers").cast("array<string>"), ",").alias("speakers"))


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which some begin before the one before, some before 0, and some end before they begin."""
    found = _lines_of(_tokens(spark, sf_dir)).where("kind <> 'buffer'")
    begin = F.when(F.col("line_no") % 7 == 0, F.col("start_cs") - 5000).otherwise(F.col("start_cs"))
    end = F.when(F.col("line_no") % 5 == 0, begin - 10).otherwise(F.col("end_cs"))
    return found.withColumns({"start_cs": begin, "end_cs": end})


def timing_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faults of lines as messages."""
    return metrics.timing_messages(_faulty(spark, sf_dir))


def health_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of every conversation, one row each."""
    sessions = adapters.read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg((F.max("turn") % 9 / 3).alias("rtf"), F.count_if(F.col("text").isNull()).alias("n_anomalies"))
    return metrics.health_report(kept(_faulty(spark, sf_dir)), sessions)


def worded_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verbose response with the real times of all words, and with shares of each line's time."""
    toks = _tokens(spark, sf_dir)
    found = kept(_lines_of(toks))
    owned = joins.first_container(toks, found.where("kind = 'line'").select("session_id", "line_no", "start_cs", "end_cs"), "line_no")
    real = exports.openai_json(found, words=exports.line_words(found, owned)).select("session_id", F.lit("real").alias("times"), "content")
    return real.unionByName(exports.openai_json(found, words=exports.line_words(found)).select("session_id", F.lit("shares").alias("times"), "content"))


def all_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of each session's file in every form, and the table of one."""
    found = exports.writer("all")(kept(_lines_of(_tokens(spark, sf_dir))))
    return found.where("form IN ('tsv', 'txt', 'text')")


def sql_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function in a lateral join, by SQL text alone."""
    registered.register(spark)
    adapters.read(spark, sf_dir, "conversations").createOrReplaceTempView("spoken_turns")
    return spark.sql("SELECT t.conv_id, t.turn, w.i, regexp_replace(w.word, r'^\\s+', '') AS word, w.start_s, w.end_s FROM spoken_turns t, LATERAL words_of(t.text, t.turn * 10.0D, t.turn * 10.0D + 8.0D) w")


def comma_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with the sentences of a user's splitter, which cuts behind commas."""
    toks = adapters.tokens(spark, sf_dir).withColumn("session_id", F.col("session_id") * 10000 + F.col("turn"))
    toks = kept(toks.select("session_id", "seq", "text"))
    texts = toks.groupBy("session_id").agg(lines.joined("seq", "text").alias("text"))
    cut = lambda texts: [re.findall(r"[^,]*,+|[^,]+$", t) for t in texts]
    return words.words_to_sentences(toks, words.sentences_of(texts, cut)).select("session_id", "seq", "sent_no")


def mark_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the splitter at marks."""
    toks = kept(adapters.tokens(spark, sf_dir).select("session_id", "seq", "text"))
    texts = toks.groupBy("session_id").agg(lines.joined("seq", "text").alias("text"))
    return words.words_to_sentences(toks, words.sentences_of(texts)).select("session_id", "seq", "sent_no")


def audio_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as samples in WAV and raw files, read back in chunks of 100."""
    vectors = adapters.read(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    samples = F.transform("embedding", lambda x: F.floor(x.cast("double") * 10000).cast("smallint"))
    rows = vectors.groupBy(F.expr("vec_id div 20").alias("g")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", samples.alias("s")))), lambda x: x["s"])).alias("samples"))
    rows = rows.select(F.concat(F.lit("g"), F.col("g").cast("string")).alias("name"), "samples")
    folder, out = f"{shared_dir(spark)}/audio-{uuid.uuid4().hex}", []
    for form, reader in (("wav", files.read_wav), ("pcm", files.read_pcm)):
        files.write_audio(rows, f"{folder}/{form}", form).write.format("noop").mode("overwrite").save()
        found = reader(spark, f"{folder}/{form}", 100 / files.RATE)
        total = F.round(F.aggregate("pcm", F.lit(0.0), lambda a, x: a + x.cast("double") * 32768)).cast("bigint")
        out.append(found.select(F.regexp_extract("session_id", r"g(\d+)\.\w+$", 1).cast("bigint").alias("g"), F.lit(form).alias("form"), "chunk_ix", "n_samples", total.alias("total")))
    return out[0].unionByName(out[1])


def language_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages in mixed writing under one name."""
    written = F.when(F.col("doc_id") % 3 == 0, F.upper("lang")).when(F.col("doc_id") % 3 == 1, F.concat(F.initcap("lang"), F.lit("_XX"))).otherwise(F.col("lang"))
    rows = adapters.read(spark, sf_dir, "documents").where("lang IS NOT NULL").select("doc_id", written.alias("language"))
    known = rows.select(F.lower("language").alias("language")).where("length(language) = 2").distinct()
    mapping = known.select(F.concat("language", F.lit("-xx")).alias("language"), F.col("language").alias("name"))
    return joins.alias(rows, mapping, "language", "name")


QUERIES = {f.__name__: f for f in (
    named_speakers, parsed_times, rounded_values, spoken_bounds, kept_words, sampled_turns, range_speakers, timing_faults, health_checks, worded_json, all_forms, sql_words, comma_sentences, mark_sentences,
    audio_files, language_aliases,
)}

FAULTY = f"""{FULL},
    fb AS (SELECT *, CASE WHEN line_no % 7 = 0 THEN start_cs - 5000 ELSE start_cs END AS b FROM lines WHERE kind <> 'buffer'),
    faulty AS (SELECT session_id, line_no, n_tokens, b AS s, CASE WHEN line_no % 5 = 0 THEN b - 10 ELSE end_cs END AS e, lag(b) OVER (PARTITION BY session_id ORDER BY line_no) AS p,
        row_number() OVER (PARTITION BY session_id ORDER BY line_no) - 1 AS i FROM fb)"""

SPOKEN_LINES = f"""{FULL}, c AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS cue, max(end_cs) OVER (PARTITION BY session_id) / 100 AS d FROM lines WHERE kind = 'line' AND text <> '')"""
_TWO = lambda x: f"format('{{:.2f}}', {x})::DOUBLE"

ORACLES = {
    "named_speakers": """WITH n AS (SELECT conv_id AS session_id, turn, CASE WHEN turn % 3 = 0 THEN role WHEN turn % 3 = 1 THEN 'guest' || (turn % 4) WHEN turn % 5 > 0 THEN (turn * 131)::VARCHAR END AS name FROM conversations),
        q AS (SELECT *, CASE WHEN regexp_matches(name, '^[0-9]+$') AND name <> '0' THEN name::BIGINT - 1 END AS no FROM n),
        f AS (SELECT session_id, name, row_number() OVER (PARTITION BY session_id ORDER BY min(turn)) - 1 AS place FROM q WHERE no IS NULL GROUP BY session_id, name),
        i AS (SELECT q.session_id, q.turn, coalesce(q.no, f.place) AS n FROM q LEFT JOIN f ON f.session_id = q.session_id AND f.name IS NOT DISTINCT FROM q.name AND q.no IS NULL)
        SELECT session_id, turn, CASE WHEN n >= 18278 THEN chr(((n - 18278) // 17576 % 26 + 65)::INT) ELSE '' END || CASE WHEN n >= 702 THEN chr(((n - 702) // 676 % 26 + 65)::INT) ELSE '' END
            || CASE WHEN n >= 26 THEN chr(((n - 26) // 26 % 26 + 65)::INT) ELSE '' END || chr((n % 26 + 65)::INT) AS label FROM i""",
    "parsed_times": """SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_id % 60 + 0.25::DOUBLE WHEN 1 THEN (event_id % 60) * 60 + event_id % 50 WHEN 2 THEN (event_id % 9) * 3600 + (event_id % 60) * 60 + 7.5::DOUBLE END AS seconds FROM events""",
    "rounded_values": """SELECT event_id, format('{:.0f}', event_id / 8 + 0.005::DOUBLE)::DOUBLE AS n0, format('{:.2f}', event_id / 8)::DOUBLE AS n2, format('{:.2f}', (event_id % 4000 * 10 + 5) / 1000)::DOUBLE AS h2,
        format('{:.1f}', -(event_id / 8 + 0.005::DOUBLE))::DOUBLE AS m1, format('{:.3f}', value)::DOUBLE AS n3 FROM events""",
    "spoken_bounds": f"""WITH {TOKENS}, s AS (SELECT session_id, turn, min(start_cs) AS a, max(end_cs) AS b, arg_max(end_cs, seq) AS last, arg_min(start_cs, seq) AS first, count(*) AS n FROM tokens GROUP BY session_id, turn),
        k AS (SELECT *, turn = 0 OR session_id % 5 = 0 OR a = b AS blank FROM s WHERE (turn * 3 % 10 + 1) / 10 <= 0.9)
        SELECT session_id, coalesce(arg_min(first, turn) FILTER (NOT blank), arg_min(a, turn)) / 100 AS start_s, coalesce(arg_max(last, turn) FILTER (NOT blank), arg_max(CASE WHEN blank THEN a ELSE b END, turn)) / 100 AS end_s,
            coalesce(sum(n) FILTER (NOT blank), 0)::BIGINT AS n_words FROM k GROUP BY session_id""",
    "kept_words": f"WITH {TOKENS} SELECT session_id, turn, text AS word FROM tokens WHERE (turn * 3 % 10 + 1) / 10 <= 0.9",
    "sampled_turns": "SELECT conv_id AS session_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) IN (2, 3)",
    "range_speakers": f"""{FULL}, {TRANSLATIONS} SELECT tr.session_id, tr_no, coalesce(string_agg(DISTINCT speaker::VARCHAR, ',' ORDER BY speaker::VARCHAR), '') AS speakers FROM tr
        LEFT JOIN lines l ON l.session_id = tr.session_id AND l.kind = 'line' AND l.speaker > 0 AND l.end_cs >= tr.start_cs AND l.start_cs <= tr.end_cs GROUP BY tr.session_id, tr_no""",
    "timing_faults": f"""{FAULTY} SELECT session_id, unnest([x FOR x IN [CASE WHEN s < 0 THEN printf('Line %d: negative start %.2fs', i, s / 100) END, CASE WHEN e < 0 THEN printf('Line %d: negative end %.2fs', i, e / 100) END,
        CASE WHEN e < s THEN printf('Line %d: end (%.2fs) < start (%.2fs)', i, e / 100, s / 100) END, CASE WHEN s < p THEN printf('Line %d: start (%.2fs) < previous start (%.2fs)', i, s / 100, p / 100) END] IF x IS NOT NULL]) AS message FROM faulty""",
    "health_checks": f"""{FAULTY}, m AS (SELECT conv_id AS session_id, (max(turn) % 9) / 3 AS rtf, count(*) FILTER (text IS NULL) AS bad FROM conversations GROUP BY conv_id),
        t AS (SELECT session_id, count(*) AS n, sum(n_tokens) AS w, bool_and(s >= 0 AND e >= 0 AND e >= s) AS valid, bool_and(coalesce(s >= p, TRUE)) AS mono FROM faulty GROUP BY session_id),
        j AS (SELECT m.*, coalesce(n, 0) AS n, coalesce(w, 0) AS w, coalesce(valid, TRUE) AS valid, coalesce(mono, TRUE) AS mono FROM m LEFT JOIN t USING (session_id))
        SELECT session_id, 1 AS check_no, 'no_anomalies' AS name, bad = 0 AS ok FROM j UNION ALL SELECT session_id, 2, 'has_words', w > 0 FROM j UNION ALL SELECT session_id, 3, 'has_lines', n > 0 FROM j
        UNION ALL SELECT session_id, 4, 'timing_valid', valid FROM j UNION ALL SELECT session_id, 5, 'timing_monotonic', mono FROM j UNION ALL SELECT session_id, 6, 'fast_enough', rtf < 2 FROM j""",
    "worded_json": f"""{SPOKEN_LINES},
        tk AS (SELECT t.session_id, t.seq, min(c.line_no) AS line_no, any_value(t.text) AS text, any_value(t.start_cs) AS s, any_value(t.end_cs) AS e FROM tokens t
            JOIN lines c ON c.session_id = t.session_id AND c.kind = 'line' AND c.start_cs <= t.start_cs AND c.end_cs >= t.end_cs GROUP BY t.session_id, t.seq),
        r AS (SELECT c.session_id, string_agg(format('{{{{"word":{{}},"start":{{}},"end":{{}}}}}}', to_json(trim(tk.text)), to_json(s / 100), to_json(e / 100)), ',' ORDER BY cue, seq) AS w FROM c JOIN tk USING (session_id, line_no) GROUP BY c.session_id),
        v AS (SELECT *, regexp_extract_all(text, '\\S+') AS ws FROM c),
        x AS (SELECT *, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i, (end_cs - start_cs) / 100 / greatest(len(ws), 1) AS share FROM v),
        y AS (SELECT session_id, string_agg(format('{{{{"word":{{}},"start":{{}},"end":{{}}}}}}', to_json(word), to_json({_TWO("start_cs / 100 + i * share")}), to_json({_TWO("start_cs / 100 + (i + 1) * share")})), ',' ORDER BY cue, i) AS w FROM x GROUP BY session_id),
        g AS (SELECT session_id, d, string_agg(text, ' ' ORDER BY cue) AS said,
                string_agg(format('{{{{"id":{{}},"start":{{}},"end":{{}},"text":{{}}}}}}', cue - 1, to_json(start_cs / 100), to_json(end_cs / 100), to_json(text)), ',' ORDER BY cue) AS segs FROM c GROUP BY session_id, d),
        z AS (SELECT *, 'real' AS times FROM g JOIN r USING (session_id) UNION ALL SELECT *, 'shares' FROM g JOIN y USING (session_id))
        SELECT session_id, times, format('{{{{"task":"transcribe","language":"unknown","duration":{{}},"text":{{}},"words":[{{}}],"segments":[{{}}],"usage":{{{{"type":"duration","seconds":{{}}}}}}}}}}', to_json(d), to_json(trim(said)), w, segs, round_even(d, 0)::BIGINT) AS content FROM z""",
    "all_forms": f"""{SPOKEN_LINES}
        SELECT session_id, 'tsv' AS form, 'start' || chr(9) || 'end' || chr(9) || 'text' || chr(10) || string_agg((start_cs * 10) || chr(9) || (end_cs * 10) || chr(9) || replace(trim(text), chr(9), ' '), chr(10) ORDER BY cue) || chr(10) AS content FROM c GROUP BY session_id
        UNION ALL SELECT session_id, 'txt', string_agg(trim(text), chr(10) ORDER BY cue) FROM c GROUP BY session_id UNION ALL SELECT session_id, 'text', trim(string_agg(text, ' ' ORDER BY cue)) FROM c GROUP BY session_id""",
    "sql_words": r"""WITH w AS (SELECT conv_id, turn, regexp_extract_all(text, '\S+') AS w, turn * 10.0::DOUBLE AS s, turn * 10.0::DOUBLE + 8.0::DOUBLE AS e FROM conversations WHERE text IS NOT NULL),
        u AS (SELECT *, unnest(w) AS word, generate_subscripts(w, 1)::INT - 1 AS i, (e - s) / len(w) AS share FROM w)
        SELECT conv_id, turn, i, word, s + i * share AS start_s, CASE WHEN i = len(w) - 1 THEN e ELSE s + (i + 1) * share END AS end_s FROM u""",
    "comma_sentences": f"""WITH {TOKENS}, p AS (SELECT session_id * 10000 + turn AS session_id, seq, string_agg(regexp_replace(text, '\\s+', '', 'g'), '') OVER (PARTITION BY session_id, turn ORDER BY seq ROWS UNBOUNDED PRECEDING) AS p FROM tokens)
        SELECT session_id, seq, (len(regexp_extract_all(p, ',+[^,]')) + 1)::INT AS sent_no FROM p""",
    "mark_sentences": f"""WITH {TOKENS}, p AS (SELECT session_id, seq, string_agg(regexp_replace(text, '\\s+', '', 'g'), '') OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS p FROM tokens)
        SELECT session_id, seq, (len(regexp_extract_all(p, '[.!?]+[^.!?]')) + 1)::INT AS sent_no FROM p""",
    "audio_files": """WITH s AS (SELECT vec_id // 20 AS g, flatten(list(list_transform(embedding, lambda x: floor(x::DOUBLE * 10000)::BIGINT) ORDER BY vec_id)) AS s FROM embeddings WHERE embedding IS NOT NULL GROUP BY vec_id // 20),
        c AS (SELECT g, (a // 100)::INT AS chunk_ix, s[a + 1 : a + 100] AS part FROM (SELECT *, unnest(range(0, len(s), 100)) AS a FROM s))
        SELECT g, form, chunk_ix, len(part)::INT AS n_samples, list_sum(part)::BIGINT AS total FROM c, (VALUES ('wav'), ('pcm')) AS f(form)""",
    "language_aliases": "SELECT doc_id, lower(lang) AS language FROM documents WHERE lang IS NOT NULL",
}

"""Lines as subtitles, text, tables and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkframe.functions.text import escape_arrow
from talkframe.functions.times import half_even, round_binary, stamp
from talkframe.functions.values import speaker_label


def spoken(lines: DataFrame) -> DataFrame:
    """Lines with text, silence aside, numbered from 1 as `cue`."""
    rows = lines.where("kind = 'line' AND coalesce(text, '') <> ''")
    return rows.withColumn("cue", F.row_number().over(Window.partitionBy("session_id").orderBy("line_no")))


def _in_order(value: str, sep: str, order: str = "cue"):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda c: c[value]), sep)


def subtitles(lines: DataFrame, form: str = "srt") -> DataFrame:
    """session_id and the whole file: cues in order, numbered for srt, under a header for vtt."""
    mark = "," if form == "srt" else "."
    rows = spoken(lines)
    times = F.concat(stamp(F.col("start_cs") * 10, mark), F.lit(" --> "), stamp(F.col("end_cs") * 10, mark))
    head = [F.col("cue").cast("string")] if form == "srt" else []
    rows = rows.withColumn("part", F.concat_ws("\n", *head, times, escape_arrow("text"), F.lit("")))
    body = _in_order("part", "\n")
    return rows.groupBy("session_id").agg((body if form == "srt" else F.concat(F.lit("WEBVTT\n\n"), body)).alias("content"))


def plain_text(lines: DataFrame) -> DataFrame:
    """One line of text per line."""
    return spoken(lines).withColumn("part", F.trim("text")).groupBy("session_id").agg(_in_order("part", "\n").alias("content"))


def tab_separated(lines: DataFrame) -> DataFrame:
    """Start and end in whole milliseconds, text; rows for a tab-separated file."""
    return spoken(lines).select("session_id", "cue", (F.col("start_cs") * 10).alias("start"), (F.col("end_cs") * 10).alias("end"), F.replace(F.trim("text"), F.lit("\t"), F.lit(" ")).alias("text"))


def line_words(lines: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """session_id, cue, words (word, start, end in seconds): the `tokens` (session_id, line_no, seq, text, start_cs, end_cs) of each spoken line, or without them the line's words
    with equal shares of its time."""
    rows = spoken(lines)
    if tokens is None:
        said = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
        line = F.array(F.struct(said.alias("w"), ((F.col("end_cs") - F.col("start_cs")) / 100 / F.greatest(F.size(said), F.lit(1))).alias("share")))
        times = lambda s, shift: F.transform(F.transform(s["w"], lambda w, i: F.col("start_cs") / 100 + (i + shift) * s["share"]), lambda t: round_binary(t, 2))
        made = lambda s: F.transform(F.arrays_zip(s["w"].alias("word"), times(s, 0).alias("start"), times(s, 1).alias("end")), lambda z: F.struct(z["word"].alias("word"), z["start"].alias("start"), z["end"].alias("end")))
        return rows.select("session_id", "cue", F.get(F.transform(line, made), F.lit(0)).alias("words"))  # a line is cut once: `line` stands for it in what follows
    word = F.struct("seq", F.struct(F.trim("text").alias("word"), (F.col("start_cs") / 100).alias("start"), (F.col("end_cs") / 100).alias("end")).alias("w"))
    words = tokens.where(F.trim("text") != "").groupBy("session_id", "line_no").agg(F.transform(F.array_sort(F.collect_list(word)), lambda x: x["w"]).alias("words"))
    return rows.select("session_id", "cue", "line_no").join(words.hint("merge"), ["session_id", "line_no"]).drop("line_no")


def openai_json(lines: DataFrame, verbose: bool = True, language: str = "unknown", words: DataFrame | None = None) -> DataFrame:
    """session_id and the response: text, duration, usage, and segments with ids from 0 in the verbose form; with `words` (from line_words) also all words with
    their times."""
    rows = spoken(lines).withColumn("seg", F.struct((F.col("cue") - 1).alias("id"), (F.col("start_cs") / 100).alias("start"), (F.col("end_cs") / 100).alias("end"), F.col("text").alias("text")))
    out = rows.groupBy("session_id").agg(F.trim(_in_order("text", " ")).alias("text"), (F.max("end_cs") / 100).alias("duration"), F.transform(F.array_sort(F.collect_list(F.struct("cue", "seg"))), lambda s: s["seg"]).alias("segments"))
    if words is not None:
        every = words.groupBy("session_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("cue", "words"))), lambda c: c["words"])).alias("words"))
        out = out.join(every.hint("merge"), "session_id", "left")
    usage = F.struct(F.lit("duration").alias("type"), half_even(F.col("duration")).cast("bigint").alias("seconds"))
    body = F.struct(F.lit("transcribe").alias("task"), F.lit(language).alias("language"), "duration", "text", *(["words"] if words is not None else []), "segments", usage.alias("usage")) if verbose else F.struct("text", usage.alias("usage"))
    return out.select("session_id", F.to_json(body).alias("content"))


def openai_text(lines: DataFrame) -> DataFrame:
    """The text form: all lines in one."""
    return spoken(lines).groupBy("session_id").agg(F.trim(_in_order("text", " ")).alias("content"))


def diarized_json(lines: DataFrame) -> DataFrame:
    """Segments seg_001, ... with speakers A, B, ..., and "A: text" lines."""
    rows = spoken(lines).withColumn("who", speaker_label(F.greatest(F.col("speaker") - 1, F.lit(0))))
    seg = F.struct(F.lit("transcript.text.segment").alias("type"), F.format_string("seg_%03d", "cue").alias("id"), (F.col("start_cs") / 100).alias("start"), (F.col("end_cs") / 100).alias("end"), F.col("text").alias("text"), F.col("who").alias("speaker"))
    rows = rows.withColumns({"seg": seg, "said": F.concat("who", F.lit(": "), "text")})
    out = rows.groupBy("session_id").agg((F.max("end_cs") / 100).alias("duration"), F.trim(_in_order("said", "\n")).alias("text"), F.transform(F.array_sort(F.collect_list(F.struct("cue", "seg"))), lambda s: s["seg"]).alias("segments"))
    usage = F.struct(F.lit("duration").alias("type"), half_even(F.col("duration")).cast("bigint").alias("seconds"))
    return out.select("session_id", F.to_json(F.struct(F.lit("transcribe").alias("task"), "duration", "text", "segments", usage.alias("usage"))).alias("content"))


def cli_verbose_json(sessions: DataFrame) -> DataFrame:
    """Of (session_id, text, duration, segments): one segment over the whole duration where there is text but no segment."""
    kind = sessions.schema["segments"].dataType.elementType.simpleString()
    whole = F.array(F.struct(F.lit(0).alias("id"), F.lit(0.0).alias("start"), F.col("duration").alias("end"), F.col("text").alias("text")).cast(kind))
    return sessions.withColumn("segments", F.when((F.size("segments") <= 0) & (F.col("text") != ""), whole).otherwise(F.col("segments")))


def report_json(report: DataFrame, key: str) -> DataFrame:
    """Each row as one JSON text."""
    return report.select(key, F.to_json(F.struct(*report.columns)).alias("content"))


#: Exporters by name.
WRITERS = {
    "srt": subtitles, "vtt": lambda lines: subtitles(lines, "vtt"), "txt": plain_text, "tsv": tab_separated, "json": openai_json, "text": openai_text, "diarized_json": diarized_json,
    "short_json": lambda lines: openai_json(lines, False), "words_json": lambda lines: openai_json(lines, words=line_words(lines)),
}


def writer(name: str):
    """The exporter of a name; `all` gives one table with the whole files of all of them, told apart by `form`."""
    if name == "all":
        return every_form
    if name not in WRITERS:
        raise ValueError(f"no exporter {name}; there are all, {', '.join(WRITERS)}")
    return WRITERS[name]


def every_form(lines: DataFrame) -> DataFrame:
    """session_id, form, content: each session's file in every form, the table of tsv as text under its header. `lines` is read once for each form: keep it."""
    tsv = F.concat_ws("\t", F.col("start").cast("string"), F.col("end").cast("string"), "text")
    table = tab_separated(lines).withColumn("part", tsv).groupBy("session_id").agg(F.concat(F.lit("start\tend\ttext\n"), _in_order("part", "\n"), F.lit("\n")).alias("content"))
    out = table.select("session_id", F.lit("tsv").alias("form"), "content")
    for name, made in WRITERS.items():
        if name != "tsv":
            out = out.unionByName(made(lines).select("session_id", F.lit(name).alias("form"), "content"))
    return out

"""Lines from tokens: islands by speaker, by mark, by pause; all as windows, so one long session sorts but never loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkframe.functions.text import has_mark, only_marks
from talkframe.operators.joins import owner_among, owner_candidates
from talkframe.operators.scans import Along

SILENCE = -2


def joined(order: str, text: str, sep: str = "") -> Column:
    """A1: texts of a group in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda t: t[text]), sep)


def islands(change: Column, order: Window) -> Column:
    """The number of the run that a row belongs to, from 1: it rises where `change` holds, and at the first row."""
    return F.sum(F.coalesce(change.cast("int"), F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, 0))


def _with_cover(rows: DataFrame, cover: DataFrame, along: Along) -> DataFrame:
    """Rows with their session's `cover`; in two levels a row for each block meets it first, so no session's rows go to one task."""
    if not along.block:
        return rows.join(cover.hint("merge"), "session_id", "left")
    blocks = rows.groupBy("session_id", "_blk").agg(F.count(F.lit(1)).alias("_n")).join(cover.hint("merge"), "session_id", "left").drop("_n")
    return rows.join(blocks.hint("merge"), ["session_id", "_blk"])


def _owned(timeline: DataFrame, spans: DataFrame, along: Along) -> DataFrame:
    """`timeline` with the owner of each token and the cover of its session, for spans of any number."""
    cover = spans.groupBy("session_id").agg(F.max("end_cs").alias("cover"))
    speech = timeline.where("kind = 'token'").select("session_id", F.col("seq2").alias("seq"), "start_cs", "end_cs")
    owners = owner_candidates(speech, spans, "session_id", "seq", "span_no", "start_cs", "end_cs", 6000, "speaker").withColumnRenamed("seq", "seq2")
    # tokens and those who may own them are dealt once, as the windows need them, and meet there
    both = timeline.unionByName(owners, allowMissingColumns=True)
    both = along.start(both) if along.block else both.repartition("session_id")
    keys = ["session_id", *(["_blk"] if along.block else []), "seq2"]
    rows = both.groupBy(*keys).agg(*(F.max(c).alias(c) for c in both.columns if c not in keys)).withColumn("owner", F.col("candidate.v")).drop("candidate")
    return _with_cover(rows, cover, along)


def _owned_among_few(timeline: DataFrame, spans: DataFrame) -> DataFrame:
    """The same where every session has few spans: they come to its tokens as one row, so that no token is dealt by time."""
    span = F.struct(F.col("start_cs").alias("a"), F.col("end_cs").alias("e"), F.col("span_no").alias("n"), F.col("speaker").alias("v"))
    sessions = spans.groupBy("session_id").agg(F.max("end_cs").alias("cover"), F.collect_list(span).alias("_spans"))
    rows = timeline.repartition("session_id").join(sessions.hint("merge"), "session_id", "left")
    return rows.withColumn("owner", F.when(F.col("kind") == "token", owner_among(F.col("_spans"), "start_cs", "end_cs"))).drop("_spans")


def speaker_lines(timeline: DataFrame, spans: DataFrame, block: int | None = None, few: bool = False) -> DataFrame:
    """session_id, line_no, kind (line, silence, buffer), speaker, start_cs, end_cs, text, n_tokens.

    From the first token on that starts at or after the end of all spans, text waits in the buffer and silences are withheld. A token of
    marks only, unless it is the first since a silence, joins the line before it. A line ends where the speaker changes or a silence stands.
    Sessions without spans have speaker -1 throughout. With `block`, sessions are taken in blocks of so many values of seq2; without it,
    `few` says that no session has many spans (`joins.few`).
    """
    along = Along("seq2", block)
    rows = _owned_among_few(timeline, spans) if few and not block else _owned(timeline, spans, along)
    silent = F.col("kind") == "silence"
    rows = along.lags(rows, kind_before=F.col("kind"))
    rows = rows.withColumn("attached", ~silent & only_marks("text") & (F.col("kind_before") == "token"))
    rows = rows.withColumn("attached", F.coalesce("attached", F.lit(False)))
    late = ~silent & (F.col("start_cs") >= F.col("cover")) & ~F.col("attached")
    # a silence forgets who spoke; what waits stands behind all that is shown, so it need not be told apart here
    own = F.when(silent, SILENCE).when(~F.col("attached"), F.coalesce(F.col("owner") + 1, F.lit(1))).cast("int")
    rows = along.heard(rows, {"waits": late}, {"heard": own})
    rows = rows.withColumn("waits", F.coalesce("waits", F.lit(False)))
    who = lambda kind, heard: F.when(F.col(kind) == "silence", SILENCE).when(F.col("cover").isNull(), -1).when(F.col(heard) != SILENCE, F.col(heard))
    rows = rows.withColumns({"speaker": who("kind", "heard"), "speaker_before": F.when(F.col("kind_before").isNotNull(), who("kind_before", "heard_before"))})
    change = silent | (F.col("kind_before") == "silence") | (F.col("speaker") != F.col("speaker_before"))
    rows = along.sums(rows, line_no=F.coalesce(change.cast("int"), F.lit(1)))
    # what waits comes behind all that is shown, so the numbers of lines do not depend on it
    rows = rows.withColumn("line_no", F.when(F.col("waits"), F.lit(0)).otherwise(F.col("line_no"))).where(~(F.col("waits") & silent))
    lines = rows.groupBy("session_id", "line_no").agg(
        F.when(F.max("waits"), "buffer").when(F.min("kind") == "token", "line").otherwise("silence").alias("kind"), F.when(~F.max("waits"), F.min("speaker")).alias("speaker"),
        F.min("start_cs").alias("start_cs"), F.max("end_cs").alias("end_cs"), F.when(F.min("kind") == "token", joined("seq2", "text")).alias("text"), F.count_if(F.col("kind") == "token").alias("n_tokens"),
    )
    return lines


def segments_at_marks(timeline: DataFrame, block: int | None = None) -> DataFrame:
    """session_id, seg_no, kind, complete, start_cs, end_cs, text: a segment ends after a token with a mark, a silence stands alone;
    the last segment of a session is complete only if it ends with a mark or is a silence."""
    along = Along("seq2", block)
    silent = F.col("kind") == "silence"
    rows = along.start(timeline.withColumn("ends", F.coalesce(has_mark("text"), F.lit(False)) | silent))
    rows = along.lags(rows, ended=F.col("ends"))
    rows = along.sums(rows, seg_no=F.coalesce((silent | F.col("ended")).cast("int"), F.lit(1)))
    rows = along.greatest(rows, last_no=F.col("seg_no"))
    return rows.groupBy("session_id", "seg_no").agg(
        F.min("kind").alias("kind"), (F.max("ends") | (F.col("seg_no") < F.max("last_no"))).alias("complete"), F.min("start_cs").alias("start_cs"),
        F.max_by("end_cs", "seq2").alias("end_cs"), joined("seq2", "text").alias("text"),
    )


def lines_at_pauses(timeline: DataFrame, block: int | None = None) -> DataFrame:
    """One line per run of tokens between silences; neighbouring silences are one."""
    along = Along("seq2", block)
    rows = along.lags(along.start(timeline), kind_before=F.col("kind"))
    rows = along.sums(rows, line_no=F.coalesce((F.col("kind") != F.col("kind_before")).cast("int"), F.lit(1)))
    return rows.groupBy("session_id", "line_no").agg(F.min("kind").alias("kind"), F.min("start_cs").alias("start_cs"), F.max_by("end_cs", "seq2").alias("end_cs"), F.when(F.min("kind") == "token", joined("seq2", "text")).alias("text"))


def pause_boundary(duration: Column, threshold: float) -> Column:
    """Strictly longer than the threshold; a threshold of 0 or less disables, a null duration is no boundary."""
    if threshold != threshold or threshold in (float("inf"), float("-inf")):
        raise ValueError("the pause threshold must be finite")
    return F.coalesce(duration > threshold, F.lit(False)) if threshold > 0 else F.lit(False)


def merge_spans(spans: DataFrame, order: str = "span_no", block: int | None = None) -> DataFrame:
    """Neighbouring spans of one speaker as one; it takes the first start and the last end."""
    along = Along(order, block)
    runs = along.lags(along.start(spans), speaker_before=F.col("speaker"))
    runs = along.sums(runs, run_no=F.coalesce((F.col("speaker") != F.col("speaker_before")).cast("int"), F.lit(1)))
    return runs.groupBy("session_id", "run_no").agg(F.min("speaker").alias("speaker"), F.min_by("start_cs", order).alias("start_cs"), F.max_by("end_cs", order).alias("end_cs"), F.count(F.lit(1)).alias("n_spans"))


def conversation(words: DataFrame) -> DataFrame:
    """session_id, turn_no, speaker, text: the words (with speaker, in order of seq) as turns of one speaker each."""
    along = Along("seq")
    rows = along.lags(words, speaker_before=F.col("speaker"))
    rows = along.sums(rows, turn_no=F.coalesce((F.col("speaker") != F.col("speaker_before")).cast("int"), F.lit(1)))
    return rows.groupBy("session_id", "turn_no").agg(F.min("speaker").alias("speaker"), F.trim(joined("seq", "text")).alias("text"))


def concatenate_speakers(spans: DataFrame, label: str = "label", order: str = "span_no") -> DataFrame:
    """Labels become their number plus 1, neighbours of one speaker are merged, after a placeholder (speaker 1, from 0 to 0)."""
    numbered = spans.withColumn("speaker", F.coalesce(F.expr(f"try_cast(regexp_extract({label}, '([0-9]+)', 1) AS INT)"), F.lit(0)) + 1)
    first = spans.select("session_id").distinct().select("session_id", F.lit(-1).cast("int").alias(order), F.lit(0).cast("bigint").alias("start_cs"), F.lit(0).cast("bigint").alias("end_cs"), F.lit(1).alias("speaker"))
    return merge_spans(numbered.select("session_id", F.col(order).cast("int"), F.col("start_cs").cast("bigint"), F.col("end_cs").cast("bigint"), "speaker").unionByName(first), order)


def turned(lines: DataFrame) -> DataFrame:
    """The lines of speech with `turned`: has another speaker than the line before, silence aside."""
    by = Window.partitionBy("session_id").orderBy("line_no")
    return lines.where(F.col("kind") == "line").withColumn("turned", F.col("speaker") != F.lag("speaker").over(by))


def make_monotonic(spans: DataFrame, gap: int = 1, order: str = "span_no") -> DataFrame:
    """Start at least `gap` after the end before, end not before start, without a loop: ends less i * gap rise as a running maximum."""
    by = Window.partitionBy("session_id").orderBy(order)
    i = F.row_number().over(by)
    lifted = spans.withColumn("_i", i).withColumn("_e", F.greatest("start_cs", "end_cs") - F.col("_i") * gap)
    lifted = lifted.withColumn("_m", F.greatest(F.max("_e").over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) + F.col("_i") * gap)
    before = F.coalesce(F.lag("_m").over(by), F.lit(0))
    return lifted.withColumns({"start_cs": F.greatest(before + gap, F.col("start_cs")), "end_cs": F.col("_m")}).drop("_i", "_e", "_m")


def speech_lines(lines: DataFrame) -> DataFrame:
    """The lines that are no silence."""
    return lines.where(F.col("speaker") != SILENCE)


def silence_segments(lines: DataFrame) -> DataFrame:
    """The silences."""
    return lines.where(F.col("speaker") == SILENCE)


def has_silence() -> Column:
    """Does a group of lines hold a silence?"""
    return F.coalesce(F.bool_or(F.col("speaker") == SILENCE), F.lit(False))


def with_silences(tokens: DataFrame, silences: DataFrame) -> DataFrame:
    """Tokens and silence markers (session_id, start_cs, end_cs) in order of arrival, numbered as `at`: a marker is published after the words that its silence
    flushed, those that begin before it. A marker's text is null."""
    words = tokens.select("session_id", "start_cs", "end_cs", "text", F.lit("token").alias("kind"))
    marks = silences.select("session_id", "start_cs", "end_cs", F.lit(None).cast("string").alias("text"), F.lit("silence").alias("kind"))
    order = Window.partitionBy("session_id").orderBy("start_cs", F.col("kind") == "token", "end_cs", "text")
    return words.unionByName(marks).withColumn("at", F.row_number().over(order))


def waiting(tokens: DataFrame, cover: DataFrame, order: str = "seq", block: int | None = None) -> DataFrame:
    """Tokens with `waits`: from the first that begins at or after its session's `cover` (session_id, cover) on, they wait in the buffer."""
    along = Along(order, block)
    rows = _with_cover(along.start(tokens), cover, along)
    rows = along.end(along.maxima(rows, waits=F.col("start_cs") >= F.col("cover")))
    return rows.withColumn("waits", F.coalesce("waits", F.lit(False))).drop("cover")


def caught_up(tokens: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Tokens that leave the buffer when coverage moves from `before` to `after` (session_id, cover): each leaves exactly once."""
    waits = waiting(waiting(tokens, before).withColumnRenamed("waits", "_old"), after)
    return waits.where(F.col("_old") & ~F.col("waits")).drop("_old", "waits")

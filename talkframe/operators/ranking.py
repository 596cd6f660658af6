"""Filters, ranks and choices among candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkframe.functions.text import common_prefix_length
from talkframe.functions.values import speaker_label


def with_speech(segments: DataFrame, threshold: float = 0.9) -> DataFrame:
    """P5: segments whose no_speech_prob is not above the threshold."""
    return segments.where(F.col("no_speech_prob") <= threshold)


def without_no_speech(segments: DataFrame, threshold: float = 0.9) -> DataFrame:
    """P5: the same as one row per word."""
    return with_speech(segments, threshold).select(*(c for c in segments.columns if c != "words"), F.explode("words").alias("word"))


def needs_fallback(most_ratio: float = 2.4, least_logprob: float = -1.0, no_speech: float = 0.6) -> Column:
    """A candidate is rejected for too much repetition or too little probability, unless it is silence."""
    bad = (F.col("compression_ratio") > most_ratio) | (F.col("avg_logprob") < least_logprob)
    return bad & ~((F.col("no_speech_prob") > no_speech) & (F.col("avg_logprob") < least_logprob))


def skipped(no_speech: float = 0.6, logprob: float = -1.0) -> Column:
    """A segment is skipped if it is likely no speech, unless it is probable enough."""
    return (F.col("no_speech_prob") > no_speech) & ~(F.col("avg_logprob") > logprob)


def blank_empty(segments: DataFrame) -> DataFrame:
    """P10: instantaneous or blank segments lose text and words."""
    empty = (F.col("start_s") == F.col("end_s")) | (F.trim("text") == "")
    return segments.withColumns({"text": F.when(empty, "").otherwise(F.col("text")), "words": F.when(empty, F.array().cast(segments.schema["words"].dataType)).otherwise(F.col("words"))})


def visible_lines(lines: DataFrame) -> DataFrame:
    """Lines with text, and silences."""
    return lines.where((F.col("kind") == "silence") | (F.coalesce("text", F.lit("")) != ""))


def rank_score(length: Column, logprob: Column, penalty: float | None = None) -> Column:
    """Log probability over the length, or over ((5 + length) / 6) ** penalty."""
    return logprob / (length if penalty is None else ((5 + length) / 6) ** penalty)


def best_candidates(candidates: DataFrame, key: list[str], penalty: float | None = None) -> DataFrame:
    """The candidate of the best score per key, the first by seq on ties."""
    score = rank_score(F.col("length"), F.col("logprob"), penalty)
    rest = [c for c in candidates.columns if c not in key]
    return candidates.groupBy(*key).agg(F.max(F.struct(score.alias("s"), (-F.col("seq")).alias("n"), F.struct(*rest).alias("r"))).alias("m")).select(*key, "m.r.*")


def first_acceptable(candidates: DataFrame, key: list[str]) -> DataFrame:
    """By rising temperature the first candidate that P8 lets pass, else the one of the highest temperature."""
    bad = needs_fallback()
    rest = [c for c in candidates.columns if c not in key]
    order = F.struct(bad.alias("b"), F.when(bad, -F.col("temperature")).otherwise(F.col("temperature")).alias("t"), F.struct(*rest).alias("r"))
    return candidates.groupBy(*key).agg(F.min(order).alias("m")).select(*key, "m.r.*")


def skip_take(rows: DataFrame, key: list[str], order: str, skip: int, take: int) -> DataFrame:
    """T4: `take` rows per key behind the first `skip`."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return rows.withColumn("_n", n).where((F.col("_n") > skip) & (F.col("_n") <= skip + take)).drop("_n")


def keep_last(rows: DataFrame, key: list[str], order: str, n: int) -> DataFrame:
    """The last n rows per key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc()))).where(F.col("_n") <= n).drop("_n")


def first_group_until(rows: DataFrame, group: str, order: str, duration: str, limit: float) -> DataFrame:
    """Of the first group (by `order`) of each session the rows before the running duration exceeds the limit; the row that exceeds it is kept."""
    by = Window.partitionBy("session_id").orderBy(order)
    first = rows.withColumn("_g", F.first(group).over(by)).where(F.col(group) == F.col("_g")).drop("_g")
    used = F.coalesce(F.sum(duration).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return first.withColumn("_u", used).where(F.col("_u") <= limit).drop("_u")


def long_samples(utterances: DataFrame, target: int, pause: int = 50) -> DataFrame:
    """Per session the utterances, in order, until their durations reach the target (the one that crosses it is kept), joined by
    spaces: session_id, n, duration with pauses between, text."""
    by = Window.partitionBy("session_id").orderBy("seq")
    used = F.coalesce(F.sum("duration").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = utterances.withColumn("_u", used).where(F.col("_u") < target)
    return kept.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), (F.sum("duration") + (F.count(F.lit(1)) - 1) * pause).alias("duration"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda t: t["text"]), " ").alias("text"))


def session_labels(rows: DataFrame, name: str, order: str) -> DataFrame:
    """`rows` with `label`: of a positive whole number its own letter (1 is A); of any other name, null included, that of its place among such names of the session by
    first sight. Names are aggregated first, so the window sees a session's names, not its rows."""
    number = F.when(F.col(name).rlike("^[0-9]+$"), F.col(name).try_cast("bigint"))
    rows = rows.withColumn("_no", F.when(number > 0, number))
    first = rows.where("_no IS NULL").groupBy("session_id", F.col(name).alias("_name")).agg(F.min(order).alias("_at"))
    first = first.withColumn("_place", F.row_number().over(Window.partitionBy("session_id").orderBy("_at")) - 1).withColumnRenamed("session_id", "_session")
    same = (F.col("session_id") == F.col("_session")) & F.col(name).eqNullSafe(F.col("_name"))
    found = rows.join(first.hint("merge"), same, "left")
    index = F.when(F.col("_no").isNotNull(), F.col("_no") - 1).otherwise(F.col("_place"))
    return found.withColumn("label", speaker_label(index)).drop("_no", "_session", "_name", "_at", "_place")


def bounds(segments: DataFrame) -> DataFrame:
    """session_id, start_s, end_s: the first word's start and the last word's end over a session's segments (session_id, seq, start_s, end_s, words), else the first segment's start
    and the last one's end; null without segments."""
    said = F.when(F.size("words") > 0, F.col("seq"))
    return segments.groupBy("session_id").agg(
        F.coalesce(F.min_by(F.get("words", F.lit(0))["start_s"], said), F.min_by("start_s", "seq")).alias("start_s"),
        F.coalesce(F.max_by(F.try_element_at("words", F.lit(-1))["end_s"], said), F.max_by("end_s", "seq")).alias("end_s"), F.sum(F.greatest(F.size("words"), F.lit(0))).alias("n_words"),
    )


def changed_only(rows: DataFrame, order: str, signature: str) -> DataFrame:
    """Rows whose signature differs from the one before."""
    before = F.lag(signature).over(Window.partitionBy("session_id").orderBy(order))
    first = F.row_number().over(Window.partitionBy("session_id").orderBy(order)) == 1
    return rows.withColumns({"_b": before, "_f": first}).where(F.col("_f") | ~F.col(signature).eqNullSafe(F.col("_b"))).drop("_b", "_f")


def checked_spans(results: DataFrame) -> DataFrame:
    """Results (id, words, spans in ms) with error_code, null for good ones: lengths differ, a span is no pair, not finite, negative, inverted, or
    begins or ends before the one before. Bad rows are for a quarantine table."""
    s = F.col("spans")
    pairs = F.forall(s, lambda x: F.coalesce(F.size(x) == 2, F.lit(False)))
    finite = F.forall(s, lambda x: F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    order = F.forall(F.sequence(F.lit(2), F.greatest(F.size(s), F.lit(2))), lambda i: (F.size(s) < 2) | ((F.get(F.get(s, i - 1), F.lit(0)) >= F.get(F.get(s, i - 2), F.lit(0))) & (F.get(F.get(s, i - 1), F.lit(1)) >= F.get(F.get(s, i - 2), F.lit(1)))))
    code = (
        F.when(s.isNull() | F.col("words").isNull() | (F.size(s) != F.size("words")), "length").when(~pairs, "shape").when(~finite, "not_finite")
        .when(F.exists(s, lambda x: x[0] < 0), "negative").when(F.exists(s, lambda x: x[1] < x[0]), "inverted").when(~F.coalesce(order, F.lit(True)), "order")
    )
    return results.withColumn("error_code", code)


def clip_ranges(spec: str) -> list[tuple[float, float]]:
    """P18: "s,e,s,e" as ranges; an odd count leaves the last open."""
    numbers = [float(x) for x in spec.split(",") if x.strip()] or [0.0]
    numbers += [float("inf")] if len(numbers) % 2 else []
    return list(zip(numbers[::2], numbers[1::2], strict=True))


def unify_tokens(source: DataFrame, names: dict[str, str], lead_space: bool = False) -> DataFrame:
    """Foreign word records as tokens. `names` gives the source's column for start_s, end_s and text (needed) and for what else it has; words
    that are empty are dropped when `lead_space` asks for one space before each."""
    need = lambda c: F.col(names[c])
    other = lambda c, kind, default: (F.coalesce(F.col(names[c]).cast(kind), F.lit(default)) if c in names else F.lit(default).cast(kind)).alias(c)
    text = F.concat(F.lit(" "), F.trim(need("text"))) if lead_space else need("text")
    out = source.select(need("session_id").alias("session_id"), need("seq").alias("seq"), need("start_s").cast("double").alias("start_s"), need("end_s").cast("double").alias("end_s"), text.alias("text"), other("speaker", "int", -1), other("lang", "string", None), other("prob", "double", None))
    return out.where(F.trim("text") != "") if lead_space else out


def within_rate(batches: DataFrame, words_per_s: float = 15, slack: float = 1.5, least: int = 50) -> DataFrame:
    """Batches (n_tokens, audio_s) that bring no more tokens than speech can: max(least, int(seconds * rate * slack))."""
    return batches.where(F.col("n_tokens") <= F.greatest(F.lit(least), F.floor(F.col("audio_s") * words_per_s * slack)))


#: What a snapshot tells anew each time, whether lines changed or not.
VOLATILE = ("status", "buffer_transcription", "buffer_diarization", "buffer_translation", "lag_total", "lag_processing", "lag_policy", "lag_diarization", "error")


def snapshot_deltas(snapshots: DataFrame, order: str = "rev") -> DataFrame:
    """X7, S16 for whole tables: snapshots (session_id, rev, lines: array, and any of VOLATILE) as messages: seq, type (snapshot, then diff), n_lines, lines_pruned, new_lines and
    the volatile fields as they are.

    How many lines went in front is where the first line stood before (all, where it stood nowhere or no line is left); new lines are what follows the common prefix
    behind these. A window gives the lines before, arrays do the rest.
    """
    by = Window.partitionBy("session_id").orderBy(order)
    rows = snapshots.withColumns({"_b": F.lag("lines").over(by), "seq": F.row_number().over(by)})
    at = F.array_position("_b", F.get("lines", F.lit(0)))
    gone = F.when(F.col("_b").isNull(), 0).when((F.size("lines") > 0) & (at > 0), at - 1).otherwise(F.size("_b")).cast("int")
    rows = rows.withColumn("lines_pruned", gone)
    left = F.slice("_b", F.col("lines_pruned") + 1, F.greatest(F.size("_b"), F.lit(0)))
    same = F.when(F.col("_b").isNull(), 0).otherwise(common_prefix_length(left, F.col("lines")))
    new = F.slice("lines", same + 1, F.size("lines"))
    volatile = [c for c in VOLATILE if c in snapshots.columns]
    kind = F.when(F.col("_b").isNull(), "snapshot").otherwise("diff")
    return rows.select("session_id", order, "seq", kind.alias("type"), "lines_pruned", F.size("lines").alias("n_lines"), new.alias("new_lines"), *volatile)


def status_of(n_lines: Column, buffers: Column) -> Column:
    """P19."""
    return F.when((n_lines == 0) & (buffers == ""), "no_audio_detected").otherwise("active_transcription")


def all_samples(*sets: DataFrame) -> DataFrame:
    """The samples of several sets, one behind the other; a column that a set lacks is null."""
    first, *others = sets
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first

"""Words of a session in order: trim points, gaps, releases, locks, merging and smoothing. Tables hold session_id, seq, text, start_cs, end_cs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from talkframe.functions.text import has_mark
from talkframe.operators.lines import islands
from talkframe.operators.scans import Along


def by(*order: str) -> WindowSpec:
    """A session's words in order."""
    return Window.partitionBy("session_id").orderBy(*(order or ("seq",)))


def upto() -> WindowSpec:
    return by().rowsBetween(Window.unboundedPreceding, 0)


def after() -> WindowSpec:
    """The words behind a word."""
    return Window.partitionBy("session_id").orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, -1)


def context_suffix(words: DataFrame, budget: int = 200, block: int | None = None) -> DataFrame:
    """`words` with `prompt`: the last words until at least `budget` characters (length and one each) are reached; the word that crosses counts."""
    along = Along("seq", block)
    rows = along.sums(along.start(words), upto=F.length(F.trim("text")) + 1)
    rows = along.end(along.greatest(rows, whole=F.col("upto")))
    return rows.withColumn("prompt", F.col("whole") - F.col("upto") < budget).drop("whole", "upto")


def penultimate_end(sentences: DataFrame, order: str = "seg_no") -> DataFrame:
    """session_id, trim_cs: the end of the last sentence but one; null with fewer."""
    return sentences.groupBy("session_id").agg(F.get(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct(order, "end_cs")))), lambda s: s["end_cs"]), F.lit(1)).alias("trim_cs"))


def segment_trim(segments: DataFrame, committed: DataFrame, order: str = "seg_no") -> DataFrame:
    """session_id, trim_cs: the newest segment end, never the last segment's, that is not after the session's committed end; else that end."""
    last = F.max(order).over(Window.partitionBy("session_id"))
    rows = segments.withColumn("_last", last).join(committed.hint("merge"), "session_id")
    ok = (F.col(order) < F.col("_last")) & (F.col("end_cs") <= F.col("committed_cs"))
    return rows.groupBy("session_id").agg(F.coalesce(F.max(F.when(ok, F.col("end_cs"))), F.max("committed_cs")).alias("trim_cs"))


def word_gaps(words: DataFrame, threshold: int) -> DataFrame:
    """session_id, last_end_cs, next_start_cs of gaps of at least `threshold` between neighbouring words."""
    rows = words.select("session_id", F.col("end_cs").alias("last_end_cs"), F.lead("start_cs").over(by()).alias("next_start_cs"))
    return rows.where(F.col("next_start_cs") - F.col("last_end_cs") >= threshold)


def rolling_median(rows: DataFrame, value: str, width: int) -> DataFrame:
    """`rows` with `smooth`: the median over `width` (odd) neighbours; the ends are reflected; at most width // 2 rows stay as they are."""
    k = width // 2
    n = F.count(F.lit(1)).over(Window.partitionBy("session_id"))
    rows = rows.withColumns({"_i": F.row_number().over(by()), "_n": n})
    inner = F.struct(F.col("_i").alias("i"), F.col(value).alias("v"))
    mirror = F.concat(
        F.array(inner),
        F.when((F.col("_i") > 1) & (F.col("_i") <= k + 1), F.array(F.struct((2 - F.col("_i")).alias("i"), F.col(value).alias("v")))).otherwise(F.array().cast("array<struct<i:int,v:double>>")),
        F.when((F.col("_i") < F.col("_n")) & (F.col("_i") >= F.col("_n") - k), F.array(F.struct((2 * F.col("_n") - F.col("_i")).cast("int").alias("i"), F.col(value).alias("v")))).otherwise(F.array().cast("array<struct<i:int,v:double>>")),
    )
    padded = rows.select("session_id", "seq", F.col("_i").alias("own"), "_n", F.explode(mirror.cast("array<struct<i:int,v:double>>")).alias("p"))
    near = Window.partitionBy("session_id").orderBy("p.i").rowsBetween(-k, k)
    smooth = F.element_at(F.sort_array(F.collect_list("p.v").over(near)), k + 1)
    done = padded.withColumn("smooth", F.when(F.col("_n") > k, smooth).otherwise(F.col("p.v"))).where(F.col("p.i") == F.col("own")).select("session_id", "seq", "smooth")
    return rows.drop("_i", "_n").join(done.hint("merge"), ["session_id", "seq"])


def clip_long_words(words: DataFrame, marks: str = ".。!！?？", most: float = 70) -> DataFrame:
    """At sentence marks a word lasts at most twice the session's median length (itself at most `most`): a mark's end moves back, the start
    of a word behind a mark moves forward. The median is over words of some length."""
    length = F.col("end_cs") - F.col("start_cs")
    half = words.groupBy("session_id").agg((2 * F.least(F.lit(float(most)), F.coalesce(F.percentile(F.when(length != 0, length), F.lit(0.5)), F.lit(0.0)))).alias("_m"))
    rows = words.join(half.hint("merge"), "session_id")
    is_mark = lambda c: F.coalesce(F.length(F.trim(c)) == 1, F.lit(False)) & F.coalesce(F.locate(" ", F.trim(c)) == 0, F.lit(False)) & F.coalesce(F.trim(c).isin(*marks), F.lit(False))
    before = F.lag("text").over(by())
    long = (length > F.col("_m")) & before.isNotNull()
    return rows.withColumns({
        "_end": F.when(long & is_mark(F.col("text")), F.col("start_cs") + F.col("_m")).otherwise(F.col("end_cs")),
        "_start": F.when(long & ~is_mark(F.col("text")) & is_mark(before), F.col("end_cs") - F.col("_m")).otherwise(F.col("start_cs")),
    }).withColumns({"start_cs": F.col("_start").cast("double"), "end_cs": F.col("_end").cast("double")}).drop("_m", "_start", "_end")


def merge_marks(words: DataFrame, prepended: str = "\"'“¿([{-", appended: str = "\"'.。,，!！?？:：”)]}、", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Opening marks join the word behind them, closing marks the word before: session_id, word_no, text, start_cs, end_cs. Where words are sorted by other columns
    than seq, to the same effect, `order` names them and spares a sort."""
    opening = F.startswith(F.col("text"), F.lit(" ")) & F.trim("text").isin(*prepended)
    closing = F.col("text").isin(*appended)
    rows = words.withColumns({"_open": opening, "_close": closing})
    rows = rows.withColumn("word_no", islands(~F.lag("_open").over(by(*order)) & ~F.col("_close"), by(*order)))
    return rows.groupBy("session_id", "word_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda t: t["text"]), "").alias("text"), F.min("start_cs").alias("start_cs"), F.max("end_cs").alias("end_cs"))


def subwords_to_words(lists: DataFrame, order: str = "seq") -> DataFrame:
    """session_id, word_no, text, n_pieces. A word begins at a piece with a leading space, a punctuation mark or a special token; others continue it, those before
    a session's first beginning are word 0. `lists` hold session_id, `order` (unique in a session) and pieces: a list of text and special, of any length.

    Words are put together inside their list, and the lists are what is dealt and sorted: only pieces that continue the word of an earlier list meet it along the session.
    """
    def begins(p: Column) -> Column:
        return F.coalesce(p["special"] | F.startswith(p["text"], F.lit(" ")) | F.trim(p["text"]).rlike(r"^\p{Punct}$"), F.lit(True))

    def said(start: Column, n: Column) -> Column:
        return F.array_join(F.transform(F.slice("pieces", start + 1, n), lambda p: p["text"]), "")

    rows = lists.select("session_id", order, "pieces", F.array_compact(F.transform("pieces", lambda p, i: F.when(begins(p), i))).alias("heads"))
    rows = rows.withColumn("sizes", F.transform("heads", lambda h, k: F.coalesce(F.get("heads", k + 1), F.size("pieces")) - h))
    before = F.coalesce(F.get("heads", F.lit(0)), F.size("pieces"))  # pieces of a word that began in an earlier list
    rows = rows.select("session_id", order, "sizes", F.zip_with("heads", "sizes", said).alias("words"), before.alias("n_before"), said(F.lit(0), before).alias("before"), F.size("pieces").alias("_all"))

    along = Window.partitionBy("session_id").orderBy(order)
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_first": (F.col("n_before") > 0) & (F.sum("_all").over(so_far) == F.col("_all")), "_no": F.sum(F.size("words")).over(so_far) - F.size("words")})
    with_first = lambda own, many: F.when(F.col("_first"), F.concat(F.array(own), many)).otherwise(F.col(many))
    rows = rows.withColumns({"_no": F.col("_no") + F.when(F.col("_first"), 0).otherwise(1), "words": with_first("before", "words"), "sizes": with_first("n_before", "sizes")})
    rows = rows.withColumns({"_run": F.sum((F.size("words") > 0).cast("int")).over(so_far), "_rest": F.lead("before").over(along), "_n_rest": F.lead("n_before").over(along)})

    # a run: a list in which words begin, and lists behind it in which none does
    begun = lambda c: F.first(F.when(F.size("words") > 0, F.col(c)), True).alias(c)
    rest = F.array_sort(F.collect_list(F.when(F.col("_n_rest") > 0, F.struct(order, F.col("_rest").alias("text")))))
    runs = rows.groupBy("session_id", "_run").agg(begun("_no"), begun("words"), begun("sizes"), F.array_join(F.transform(rest, lambda t: t["text"]), "").alias("_rest"), F.coalesce(F.sum("_n_rest"), F.lit(0)).alias("_n_rest"))
    done = runs.select("session_id", "_no", "_rest", "_n_rest", F.size("words").alias("_n"), F.posexplode(F.arrays_zip("words", "sizes")).alias("_i", "w"))
    last = F.col("_i") == F.col("_n") - 1
    text, n = F.when(last, F.concat("w.words", "_rest")).otherwise(F.col("w.words")), F.col("w.sizes") + F.when(last, F.col("_n_rest")).otherwise(0)
    return done.select("session_id", (F.col("_no") + F.col("_i")).alias("word_no"), text.alias("text"), n.alias("n_pieces"))


def word_end_from_next(words: DataFrame, fallback: int = 10, least: int = 2) -> DataFrame:
    """A word ends where the next begins, at least `least` after its start; the last lasts `fallback`."""
    end = F.greatest(F.col("start_cs") + least, F.coalesce(F.lead("start_cs").over(by()), F.col("start_cs") + fallback))
    return words.withColumn("end_cs", end)


def interpolate_words(lines: DataFrame, key: list[str]) -> DataFrame:
    """The words of a line with equal shares of its time, the last ending at its end; leading space stays with the word."""
    pieces = lines.select(*key, "start_cs", "end_cs", F.regexp_extract_all("text", F.lit(r"\s*\S+"), F.lit(0)).alias("w"))
    rows = pieces.select(*key, "start_cs", "end_cs", F.size("w").alias("n"), F.posexplode("w").alias("i", "text"))
    share = (F.col("end_cs") - F.col("start_cs")) / F.col("n")
    end = F.when(F.col("i") == F.col("n") - 1, F.col("end_cs").cast("double")).otherwise(F.col("start_cs") + share * (F.col("i") + 1))
    return rows.select(*key, "i", "text", F.round(F.col("start_cs") + share * F.col("i"), 6).alias("start_cs"), F.round(end, 6).alias("end_cs"))


def char_offset_times(words: DataFrame, fragments: DataFrame) -> DataFrame:
    """Words (session_id, seq, offset) with t of the fragment (session_id, offset, t) that holds their first character: the last that begins at or before it."""
    f = fragments.select("session_id", "offset", F.lit(0).alias("_k"), F.lit(None).cast("bigint").alias("seq"), "t")
    w = words.select("session_id", "offset", F.lit(1).alias("_k"), "seq", F.lit(None).cast(dict(fragments.dtypes)["t"]).alias("t"))
    over = Window.partitionBy("session_id").orderBy("offset", "_k").rowsBetween(Window.unboundedPreceding, 0)
    return f.unionByName(w).withColumn("t", F.last("t", True).over(over)).where("_k = 1").drop("_k")


def released(timeline: DataFrame, block: int | None = None) -> DataFrame:
    """Tokens with `released`: up to the last mark of their stretch between silences, or all where a silence or the end follows. That is: up to the session's last
    mark or silence."""
    along = Along("seq2", block)
    rows = along.greatest(along.start(timeline), last=F.when((F.col("kind") == "silence") | has_mark("text"), F.col("seq2")))
    return rows.where("kind = 'token'").select("session_id", "seq2", F.coalesce(F.col("seq2") <= F.col("last"), F.lit(False)).alias("released"))


def language_lock(detections: DataFrame, default: str, supported: list[str], least_s: float = 2.0, least_conf: float = 0.5) -> DataFrame:
    """Rows with `locked`: the default until enough audio (audio_s) and a confident (conf), supported detection; that one from then on."""
    good = (F.col("audio_s") >= least_s) & (F.col("conf") >= least_conf) & F.col("lang").isin(*supported)
    return detections.withColumn("locked", F.coalesce(F.first(F.when(good, F.col("lang")), True).over(upto()), F.lit(default)))


def word_times_from_positions(words: DataFrame, cs_per_token: int = 8, delay_cs: int = 48, offset_cs: int = 0) -> DataFrame:
    """start = position less the delay, not below 0; end = the next word's start, or one token after the own start."""
    start = F.greatest(F.lit(0), F.col("pos") * cs_per_token - delay_cs + offset_cs)
    rows = words.withColumn("start_cs", start)
    return rows.withColumn("end_cs", F.coalesce(F.lead("start_cs").over(by()), F.col("start_cs") + cs_per_token))


def snap_to_marks(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """A span ends at the nearer of the mark tokens' ends before and after its end (ties go back); the next begins there: session_id, span_no, start_cs, end_cs."""
    from talkframe.operators.joins import nearest

    marks = tokens.where(F.trim("text").rlike("^[.!?]+$")).select("session_id", F.col("end_cs").alias("at"), F.col("end_cs").alias("no"))
    ends = spans.select("session_id", "span_no", "start_cs", F.col("end_cs").alias("t"))
    snapped = nearest(ends, marks, "session_id", "t", "at", "no").withColumn("end_cs", F.coalesce("no", "t"))
    before = F.lag("end_cs").over(Window.partitionBy("session_id").orderBy("span_no"))
    return snapped.select("session_id", "span_no", F.coalesce(before, F.col("start_cs")).alias("start_cs"), "end_cs")


def anomaly_score(words: Column) -> Column:
    """The anomaly of a segment's first eight words that are no marks: improbable, very short or very long ones. Words: word, start_s, end_s, prob."""
    spoken = F.slice(F.filter(words, lambda w: ~F.trim(w["word"]).rlike(r"^\p{P}+$")), 1, 8)

    def one(w: Column) -> Column:
        lasts = w["end_s"] - w["start_s"]
        return F.when(w["prob"] < 0.15, 1.0).otherwise(0.0) + F.when(lasts < 0.133, (0.133 - lasts) * 15).otherwise(0.0) + F.when(lasts > 2.0, lasts - 2.0).otherwise(0.0)

    total = F.aggregate(spoken, F.lit(0.0), lambda a, w: a + one(w))
    return F.struct(total.alias("score"), ((total >= 3) | (total + 0.01 >= F.size(spoken))).alias("flagged"))


def drop_hallucinations(segments: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Segments (session_id, window_id, seq, start_s, end_s, words) without a flagged one that has silence, or a flagged one, on both sides, and
    without what follows it in its window."""
    along = Window.partitionBy("session_id", "window_id").orderBy("seq")
    rows = segments.where(F.size("words") > 0).withColumn("_a", anomaly_score(F.col("words"))["flagged"])
    before = (F.col("start_s") - F.coalesce(F.lag("end_s").over(along), F.lit(0.0)) > threshold) | (F.col("start_s") < threshold)
    behind = F.lead("start_s").over(along).isNull() | (F.lead("start_s").over(along) - F.col("end_s") > threshold) | F.coalesce(F.lead("_a").over(along), F.lit(False))
    rows = rows.withColumn("_drop", F.col("_a") & before & behind)
    return rows.withColumn("_gone", F.max("_drop").over(along.rowsBetween(Window.unboundedPreceding, 0))).where("NOT _gone").drop("_a", "_drop", "_gone")


def words_to_sentences(words: DataFrame, sentences: DataFrame) -> DataFrame:
    """Words with sent_no: the first sentence (session_id, sent_no, text, in order) whose running length of text reaches the word's, white space aside."""
    size = lambda c: F.length(F.regexp_replace(c, r"\s+", ""))
    sent = sentences.select("session_id", "sent_no", F.sum(size("text")).over(Window.partitionBy("session_id").orderBy("sent_no").rowsBetween(Window.unboundedPreceding, 0)).alias("_c"), F.lit(1).alias("_k"))
    w = words.withColumns({"sent_no": F.lit(None).cast(dict(sentences.dtypes)["sent_no"]), "_c": F.sum(size("text")).over(upto()), "_k": F.lit(0)})
    later = Window.partitionBy("session_id").orderBy("_c", "_k", "sent_no").rowsBetween(0, Window.unboundedFollowing)
    found = w.unionByName(sent, allowMissingColumns=True).withColumn("sent_no", F.first("sent_no", True).over(later))
    return found.where("_k = 0").drop("_c", "_k")


def held_back(texts: DataFrame) -> DataFrame:
    """X22 for whole tables: session_id, ix, text of growing texts (session_id, rev, text): a word is final in the first revision in which it is not the last; it is
    told as that revision has it, behind a space but for the first. What each revision adds follows from a running maximum."""
    by_rev = Window.partitionBy("session_id").orderBy("rev")
    said = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    rows = texts.select("session_id", "rev", said.alias("w")).withColumn("_upto", F.greatest(F.size("w") - 1, F.lit(0)))
    rows = rows.withColumn("_done", F.coalesce(F.max("_upto").over(by_rev.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    new = F.slice("w", F.col("_done") + 1, F.greatest(F.col("_upto") - F.col("_done"), F.lit(0)))
    told = rows.select("session_id", "_done", F.posexplode(new).alias("i", "word"))
    ix = (F.col("_done") + F.col("i")).cast("int")
    return told.select("session_id", ix.alias("ix"), F.when(ix == 0, F.col("word")).otherwise(F.concat(F.lit(" "), F.col("word"))).alias("text"))


def sentences_of(texts: DataFrame, splitter: Callable[[list[str]], list[list[str]]] | None = None) -> DataFrame:
    """session_id, sent_no, text of (session_id, text): the text cut into sentences by `splitter`, a user's function from texts to lists of sentences that sees a batch of
    texts at a time; without one a sentence ends with its marks. Sentences together hold all that is no white space, in order."""
    if splitter is None:
        parts = F.regexp_extract_all("text", F.lit(r"[^.!?]*[.!?]+|[^.!?]+$"), F.lit(0))
    else:

        @F.pandas_udf(ArrayType(StringType()))
        def cut(texts: pd.Series) -> pd.Series:
            said = texts.fillna("").tolist()
            return pd.Series(splitter(said), index=texts.index, dtype=object)

        parts = cut("text")
    return texts.select("session_id", F.posexplode(parts).alias("sent_no", "text")).withColumn("sent_no", F.col("sent_no") + 1)


def translation_utterances(updates: DataFrame) -> DataFrame:
    """Of each utterance what was shown and what holds: session_id, utt_no, n_updates, shown, text, start_cs, end_cs, n_refused.

    Updates: session_id, utt_no, seq, text, is_final, start_cs, end_cs (of the source). A partial text must go on from the longest shown so far, else it is refused; the
    final text, if not blank, replaces what is shown; without one, what is shown stays (a boundary takes nothing back). An utterance that has text begins
    where the one before ended.
    """
    partial = ~F.col("is_final") & (F.trim("text") != "")
    none = F.lit("").alias("shown"), F.lit(0).alias("refused")
    seen = F.transform(F.array_sort(F.collect_list(F.when(partial, F.struct("seq", F.trim("text").alias("t"))))), lambda x: x["t"])
    step = lambda a, t: F.when(F.startswith(t, a["shown"]), F.struct(t.alias("shown"), a["refused"].alias("refused"))).otherwise(F.struct(a["shown"].alias("shown"), (a["refused"] + 1).alias("refused")))
    out = updates.groupBy("session_id", "utt_no").agg(
        F.count(F.lit(1)).alias("n_updates"), F.aggregate(seen, F.struct(*none), step).alias("p"), F.max_by(F.trim("text"), F.when(F.col("is_final"), F.col("seq"))).alias("final"),
        F.min("start_cs").alias("own_start"), F.max("end_cs").alias("end_cs"),
    )
    text = F.when(F.coalesce(F.col("final"), F.lit("")) != "", F.col("final")).otherwise(F.col("p.shown"))
    out = out.withColumns({"text": text, "shown": F.col("p.shown"), "n_refused": F.col("p.refused")})
    before = F.last(F.when(F.col("text") != "", F.col("end_cs")), True).over(Window.partitionBy("session_id").orderBy("utt_no").rowsBetween(Window.unboundedPreceding, -1))
    return out.select("session_id", "utt_no", "n_updates", "shown", "text", F.coalesce(before, F.col("own_start")).alias("start_cs"), "end_cs", "n_refused")

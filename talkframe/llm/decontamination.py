"""Benchmark decontamination with a distributed positional inverted index."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkframe.llm.tables import sized, written

#: Words are runs of ASCII letters and digits and of non-ASCII characters, in the lower case of A-Z; everything else separates.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a window; lists that are intersected before the others; words that a near match may stand off its place; it may lack one word in LACKS.
SIZE, LISTS, SLOP, LACKS = 10, 3, 3, 5


def words_of(text_col: str) -> Column:
    """The words of a text; none for null."""
    text = F.col(text_col)
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))
    return F.coalesce(F.array_remove(F.split(low, BREAK), ""), F.array().cast("array<string>"))


def n_words(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")


def windows(items: DataFrame, size: int = SIZE, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The windows of the items: text_no (of an item's words), at (the first word), phrase (the words), items (the ids of the items with these
    words, as strings). An item of fewer words is one window; of none, no window; a null id is the empty string."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(text_col).alias("w")).where(F.size("w") > 0)
    texts = rows.groupBy("w").agg(F.collect_set("item").alias("items")).withColumn("text_no", F.xxhash64("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    cut = F.transform(starts, lambda at: F.struct(at.alias("at"), F.slice("w", at + 1, size).alias("phrase")))  # a row for a window holds its own words alone
    return texts.select("text_no", "items", F.inline(cut)).select("text_no", "at", "phrase", "items")


def key_of(id_col: str, text_col: str) -> list[Column]:
    """What tells rows apart: the id and a hash of the text; rows alike in both have the same matches."""
    return [F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h")]


def anchors(tests: DataFrame, docs: DataFrame, lists: int = LISTS, text_col: str = "text") -> DataFrame:
    """The `lists` rarest terms of each window: text_no, at, term, place (of the term in the item), n (how many the window has).

    Frequencies are counted over the whole corpus, for the terms of the tests only and with map-side combining; a term that the corpus lacks comes last.
    """
    terms = tests.select("text_no", "at", F.posexplode("phrase").alias("offset", "term"))
    vocabulary = sized(written(terms.select("term").distinct(), "decon-terms"))
    seen = docs.select(F.explode(words_of(text_col)).alias("term")).join(vocabulary, "term")
    counts = written(seen.groupBy("term").agg(F.count(F.lit(1)).alias("n_seen")), "decon-counts")
    by_window = Window.partitionBy("text_no", "at")
    found = terms.join(sized(counts), "term", "left").withColumn("k", F.row_number().over(by_window.orderBy(F.col("n_seen").asc_nulls_last(), "offset")))
    found = found.withColumn("n", F.least(F.count(F.lit(1)).over(by_window), F.lit(lists)))
    return found.where(F.col("k") <= lists).select("text_no", "at", "term", (F.col("at") + F.col("offset")).alias("place"), "n")


def postings(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of `docs` for `terms`, stored in the shared folder: term, id, h, pos (from 0).

    `terms` comes from the tests; it does not grow with the corpus, and is broadcast only while its counted size is small.
    """
    rows = docs.select(*key_of(id_col, text_col), F.posexplode(words_of(text_col)).alias("pos", "term"))
    return written(rows.join(sized(terms), "term").select("term", "id", "h", "pos"), "decon-postings")


def candidates(index: DataFrame, chosen: DataFrame, slop: int = SLOP) -> DataFrame:
    """Intersects the lists of the rarest terms: text_no, at, id, h, start, met, n for each window of an item and each start at which
    at least one of its lists has a posting that agrees, while all but one of its lists agree within `slop` words.

    Lists are offset-adjusted at the level of items: a posting less the term's place in the item is a diagonal, so that the overlapping windows
    of an item share rows. A row without a neighbour of another place within `slop` diagonals leaves at once, before windows are looked at.
    """
    places = sized(written(chosen.select("term", "text_no", "place").distinct(), "decon-places"))
    rows = index.join(places, "term").select("text_no", "id", "h", (F.col("pos") - F.col("place")).alias("diagonal"), "place")
    near = Window.partitionBy("text_no", "id", "h").orderBy("diagonal").rangeBetween(-slop, slop)
    several = (F.min("place").over(near) != F.max("place").over(near))
    alone = chosen.where("n = 1").select("text_no").distinct().withColumn("alone", F.lit(True))
    rows = rows.withColumn("several", several).join(sized(written(alone, "decon-alone")), "text_no", "left").where(F.col("several") | F.col("alone"))
    rows = written(rows.select("text_no", "id", "h", "diagonal", "place").distinct(), "decon-diagonals")
    lists = rows.join(sized(chosen.select("text_no", "place", "at", "n")), ["text_no", "place"])
    starts = lists.groupBy("text_no", "at", "id", "h", (F.col("diagonal") + F.col("at")).alias("start"), "n").agg(F.count(F.lit(1)).alias("met"))
    around = Window.partitionBy("text_no", "at", "id", "h").orderBy("start").rangeBetween(-slop, slop)
    return written(starts.withColumn("close", F.sum("met").over(around)).where("met >= n OR close >= greatest(n - 1, least(n, 2))").drop("close"), "decon-candidates")


def phrase_matches(found: DataFrame, docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where windows occur word for word: text_no, at, id, h, start, size: the intersection, at equal starts, of the lists of all terms of a window.

    The rarest lists are intersected already (`found`); the others are read only in the documents that are left.
    """
    exact = found.where("met >= n AND start >= 0").select("text_no", "at", "id", "h", "start")
    left = sized(written(exact.select("id", "h").distinct(), "decon-left"))
    keyed = docs.select(*key_of(id_col, text_col), F.col(text_col).alias("text")).alias("d")
    some = keyed.join(left.alias("l"), F.col("d.id").eqNullSafe(F.col("l.id")) & (F.col("d.h") == F.col("l.h")), "left_semi")
    terms = written(tests.select(F.explode("phrase").alias("term")).distinct(), "decon-all-terms")
    lists = postings(some.dropDuplicates(["id", "h"]), terms, "id", "text")
    wanted = exact.join(sized(tests.select("text_no", "at", "phrase")), ["text_no", "at"])
    wanted = wanted.select("text_no", "at", "id", "h", "start", F.size("phrase").alias("size"), F.posexplode("phrase").alias("offset", "term"))
    wanted = wanted.withColumn("pos", F.col("start") + F.col("offset")).alias("w")
    on = F.col("w.id").eqNullSafe(F.col("p.id")) & (F.col("w.h") == F.col("p.h")) & (F.col("w.pos") == F.col("p.pos")) & (F.col("w.term") == F.col("p.term"))
    met = wanted.join(lists.alias("p").hint("merge"), on).groupBy("w.text_no", "w.at", "w.id", "w.h", "w.start", "w.size").agg(F.count(F.lit(1)).alias("met"))
    return met.where(F.col("met") == F.col("size")).select("text_no", "at", "id", "h", "start", "size")


def proximity_matches(found: DataFrame, docs: DataFrame, tests: DataFrame, slop: int = SLOP, lacks: int = LACKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where a window occurs, maybe altered: text_no, at, id, h. Seen from some start, its words stand within `slop` words of their places, in any order, but for
    one word in `lacks`, rounded down; among its rarest words at most one may be that."""
    near = found.join(sized(tests.select("text_no", "at", "phrase")), ["text_no", "at"])
    near = near.groupBy("id", "h").agg(F.collect_list(F.struct("text_no", "at", "start", "phrase")).alias("tries"))
    words = docs.select(*key_of(id_col, text_col), words_of(text_col).alias("w")).alias("d")
    rows = words.join(near.hint("merge").alias("n"), F.col("d.id").eqNullSafe(F.col("n.id")) & (F.col("d.h") == F.col("n.h")))

    def met(t: Column) -> Column:
        here = lambda i: t["start"] + i - slop
        part = lambda i: F.slice("w", F.greatest(here(i), F.lit(0)) + 1, F.greatest(F.lit(2 * slop + 1) + F.least(here(i), F.lit(0)), F.lit(0)))
        return F.size(F.filter(F.transform(t["phrase"], lambda term, i: F.array_contains(part(i), term)), lambda hit: hit))

    hits = F.filter("tries", lambda t: met(t) >= F.size(t["phrase"]) - F.floor(F.size(t["phrase"]) / lacks))
    return rows.select("d.id", "d.h", F.explode(hits).alias("t")).select("t.text_no", "t.at", "id", "h").distinct()


def named(matches: DataFrame, tests: DataFrame, count: str, name: str) -> DataFrame:
    """id, h, and of the items of the matched windows the number and the ids (sorted as strings, comma-joined)."""
    texts = sized(tests.select("text_no", "items").dropDuplicates(["text_no"]))
    listed = matches.select("id", "h", "text_no").distinct().join(texts, "text_no").select("id", "h", F.explode("items").alias("item"))
    listed = listed.groupBy("id", "h").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return listed.select("id", "h", F.size("items").cast("bigint").alias(count), F.array_join("items", ",").alias(name))


def covered(matches: DataFrame) -> DataFrame:
    """id, h, n_hit (distinct words inside a match)."""
    spans = matches.groupBy("id", "h", "start").agg(F.max("size").alias("size"))
    along = Window.partitionBy("id", "h").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    done = F.coalesce(F.max(end).over(along), F.lit(0))
    fresh = F.greatest(end - F.greatest(F.col("start"), done), F.lit(0))
    return spans.withColumn("fresh", fresh).groupBy("id", "h").agg(F.sum("fresh").alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", near: bool = False, keyed: bool = False) -> DataFrame:
    """Every document's id with n_words, n_hit, n_items, items (ids, sorted as strings, comma-joined), contaminated, with `near` n_near and
    near_items (items that a document holds altered and in no exact window), and if `keyed` h (xxhash64 of the text).

    A window is `size` consecutive words of an item, or a shorter item as a whole. A word of a document is hit when it lies
    inside an occurrence of a window. Null texts have no words, empty items no windows; rows that repeat id and text
    get the same result each; empty tables give an empty result, or no hits; other columns are ignored.
    """
    tests = written(windows(items, size, text_col="text"), "decon-windows")
    chosen = written(anchors(tests, docs, text_col=text_col), "decon-anchors")
    index = postings(docs, written(chosen.select("term").distinct(), "decon-index-terms"), id_col, text_col)
    found = candidates(index, chosen)
    exact = written(phrase_matches(found, docs, tests, id_col, text_col), "decon-matches")
    result = covered(exact).alias("a").join(named(exact, tests, "n_items", "items").hint("merge").alias("b"), F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.h") == F.col("b.h")))
    result = result.select("a.id", "a.h", "n_hit", "n_items", "items")
    if near:
        close = proximity_matches(found, docs, tests, id_col=id_col, text_col=text_col).alias("n")
        known = exact.select("text_no", "id", "h").distinct().alias("e")
        close = close.join(known.hint("merge"), F.col("n.id").eqNullSafe(F.col("e.id")) & (F.col("n.h") == F.col("e.h")) & (F.col("n.text_no") == F.col("e.text_no")), "left_anti")
        close = named(written(close, "decon-near"), tests, "n_near", "near_items").alias("n")
        result = result.alias("x").join(close.hint("merge"), F.col("x.id").eqNullSafe(F.col("n.id")) & (F.col("x.h") == F.col("n.h")), "full")
        result = result.select(F.coalesce("x.id", "n.id").alias("id"), F.coalesce("x.h", "n.h").alias("h"), "n_hit", "n_items", "items", "n_near", "near_items")
    result = written(result, "decon-result")
    rows = docs.select(*key_of(id_col, text_col), n_words(text_col).alias("n_words"))
    joined = rows.alias("d").join(result.hint("merge").alias("f"), F.col("d.id").eqNullSafe(F.col("f.id")) & (F.col("d.h") == F.col("f.h")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return joined.select(
        F.col("d.id").alias(id_col), "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items", F.lit("")).alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        *([zero("n_near"), F.coalesce("near_items", F.lit("")).alias("near_items")] if near else []), *([F.col("d.h").alias("h")] if keyed else []),
    )

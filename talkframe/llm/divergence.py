"""Source divergence audit: how far the word use of the sources of a language lies apart, priced over hash-consed segment trees."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkframe.llm.ranks import ranked
from talkframe.llm.tables import forget, written

#: Documents that a kept term needs, what p is scaled by, and terms that are listed for a group.
LEAST_DOCS, UNIT, TOP = 10, 1_000_000_000, 10
#: Terms of a segment (the leaves of its trees), and about how many groups of a language meet in a task on each side.
LEAVES, GROUPS = 4096, 64
#: (group, term) counts that a task holds before it sends them on.
HELD = 400_000
#: Bytes that are no letters (A-Z, a-z, or of a character beyond ASCII) as blanks, capitals as small letters.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 22


def words(text: str) -> Counter:
    """How often each word of a text occurs: runs of letters and of characters beyond ASCII, A-Z in lower case."""
    data = text.encode("utf-8", "surrogatepass").translate(LETTERS)
    found: Counter = Counter()
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)  # pieces end between words
        end = len(data) if end < 0 else end
        found.update(data[at:end].split())
        at = end
    return found


def counted(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n: occurrences, docs: documents), summed up inside tasks; each group also has a row with a null term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in groups.items():
                terms = [None, *(t.decode("utf-8", "replace") for t in n)]
                size = len(terms)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(terms, pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(df[t] for t in n)], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )
            groups.clear()

        for batch in batches:
            for text, lang, source in zip(*(batch.column(k) for k in range(3)), strict=True):
                n, df = groups.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                before = len(n)
                found = words(text.as_py())
                n.update(found), df.update(found.keys())
                held += len(n) - before + 1
                if held > HELD:
                    yield from out()
                    held = 0
        yield from out()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(text_col).alias("text"), text(lang_col).alias("lang"), text(source_col).alias("source"))
    return rows.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def scaled(n: Column, total: Column, kept: Column) -> Column:
    """p = 1 + floor(UNIT * (n + 2) / (total + 2 * kept)), exact."""
    whole = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", whole(n + 2) * F.lit(UNIT).cast("decimal(10,0)"), whole(total + 2 * kept)) + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


class Forest:
    """The segment trees of several groups over one segment of term ids. Equal subtrees, of one group or of several, are one node: nodes are interned level
    by level, leaves by their count and inner nodes by their two children."""

    def __init__(self, counts: np.ndarray) -> None:
        groups, size = counts.shape
        width = 1 << max(0, size - 1).bit_length()
        self.counts, leaf = np.unique(counts, return_inverse=True)
        nodes = np.full((groups, width), len(self.counts), np.int64)  # what fills a level up is a leaf of its own, and free
        nodes[:, :size] = leaf.reshape(groups, size)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        while nodes.shape[1] > 1:
            pairs, inner = np.unique(nodes[:, ::2] << 32 | nodes[:, 1::2], return_inverse=True)
            self.levels.append((pairs >> 32, pairs & 0xFFFFFFFF))
            nodes = inner.reshape(groups, -1)
        self.roots = nodes[:, 0]

    def prices(self, one: int, others: np.ndarray, p: np.ndarray) -> np.ndarray:
        """For each of `others` the sum of f over all leaves of its tree and of tree `one`, walked together; `p` has each group's value of each leaf.

        On each level a pair of nodes stands once for each other tree, however often it occurs, and is priced once from its children's prices.
        """
        other, a, b = np.arange(len(others)), np.full(len(others), self.roots[one]), self.roots[others]
        backs = []
        for left, right in reversed(self.levels):
            most = max(int(left.max()), int(right.max())) + 1
            pairs = np.concatenate([(other * most + left[a]) * most + left[b], (other * most + right[a]) * most + right[b]])
            pairs, back = np.unique(pairs, return_inverse=True)
            backs.append(back)
            other, a, b = pairs // (most * most), pairs // most % most, pairs % most
        x, y = p[one][a], p[others][other, b]
        value = (x - y) ** 2 // np.maximum(x + y, 1)
        for back in reversed(backs):
            value = value[back[: len(back) // 2]] + value[back[len(back) // 2 :]]
        return value


def values(counts: np.ndarray, totals: list[int], kept: int) -> np.ndarray:
    """p of each group (row) for each distinct count, in Python integers where 64 bits do not do; 0 for the leaf that fills up."""
    whole = counts.astype(object) if counts.max(initial=0) > 1 << 33 or max(totals, default=0) > 1 << 61 else counts
    out = np.zeros((len(totals), len(counts) + 1), np.int64)
    for g, total in enumerate(totals):
        out[g, :-1] = 1 + (np.minimum(whole, total) + 2) * UNIT // (total + 2 * kept)  # a count above its total is another group's
    return out


def priced(rows: pd.DataFrame) -> pd.DataFrame:
    """The pairs of groups (lang, source, item, value) that one task prices over one segment."""
    rows = rows.sort_values("source")
    lang, segment, kept = rows["lang"].iat[0], int(rows["segment"].iat[0]), int(rows["kept"].iat[0])
    one, two, block = int(rows["one"].iat[0]), int(rows["two"].iat[0]), rows["block"].to_numpy()
    names = rows["source"].tolist()
    size = min(LEAVES, kept - segment * LEAVES)
    counts = np.zeros((len(rows), max(size, 1)), np.int64)
    for g, (places, n) in enumerate(zip(rows["places"], rows["n"], strict=True)):
        if places is not None:
            counts[g, np.asarray(places)] = n
    forest = Forest(counts)
    p = values(forest.counts, [int(t) for t in rows["total"]], kept) if kept else np.zeros((len(rows), 2), np.int64)
    out = []
    for g in range(len(rows)):
        others = np.arange(g + 1, len(rows)) if one == two else np.flatnonzero(block == two) if block[g] == one else np.arange(0)
        if len(others):
            found = forest.prices(g, others, p)
            out += [(lang, names[g], names[h], int(v)) for h, v in zip(others, found, strict=True)]
    return pd.DataFrame(out, columns=["lang", "source", "item", "value"])


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: how far each other source of the language is; part `term`: the (up to TOP) kept terms that a source
    overuses most against its language.

    1. Tasks count terms for each (lang, source) as far as memory allows, Spark adds up. Terms in at least LEAST_DOCS documents of a language are kept and
       numbered from the most frequent on, with no task that sees a whole vocabulary, so rare terms, which most sources lack, lie side by side.
    2. Term ids are cut into segments of LEAVES. For each segment and pair of blocks of about GROUPS sources a task builds the segment trees of its sources
       with shared nodes, walks them in pairs and prices each pair of nodes once; values add up over segments.

    All arithmetic is in integers. Null text, language and source count as empty; a group without terms is a group of zeros; a language without kept
    terms has pairs of value 0 and no terms; repeated rows are documents each; an empty table gives an empty result; other columns are ignored.
    The pairs themselves are the result and grow with the square of a language's sources; a single source gives none.
    """
    groups_on, terms_on = ["lang", "source"], ["lang", "term"]
    counts = counted(docs, text_col, lang_col, source_col).groupBy(*groups_on, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = written(counts, "audit-counts")
    vocabulary = counts.where("term IS NOT NULL").groupBy(*terms_on).agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS)
    bits = F.length(F.bin("all"))
    vocabulary = written(vocabulary.withColumns({"_band": -bits, "_salt": F.pmod(F.xxhash64("term"), F.lit(256)).cast("int")}), "audit-vocabulary")
    terms = ranked(vocabulary, ["lang"], ["_band", "_salt"], [F.col("term")])
    terms = written(terms.select("lang", "term", "all", F.col("rank").alias("id")), "audit-terms")
    hits = written(counts.where("term IS NOT NULL").join(terms.hint("merge"), terms_on).select(*groups_on, "term", "id", "n", "all"), "audit-hits")

    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("all").alias("lang_total"))
    sources = counts.where("term IS NULL").select(*groups_on)
    wide = sources.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    totals = hits.groupBy(*groups_on).agg(F.sum("n").alias("total"))
    groups = sources.join(totals.hint("merge"), groups_on, "left").join(wide.hint("merge"), "lang").join(langs.hint("merge"), "lang", "left")
    groups = written(groups.fillna(0, ["total", "kept", "lang_total"]), "audit-groups")

    p, q = scaled(F.col("n"), F.col("total"), F.col("kept")), scaled(F.col("all"), F.col("lang_total"), F.col("kept"))
    over = hits.join(groups.hint("merge"), groups_on).select(*groups_on, "term", p.alias("p"), q.alias("q")).where("p > q")
    over = over.select(*groups_on, F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy(*groups_on).orderBy(F.col("value").desc(), "item")
    top = over.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP)

    cell = F.struct((F.col("id") % LEAVES).cast("int").alias("place"), "n")
    vectors = hits.groupBy(*groups_on, F.expr(f"id div {LEAVES}").cast("int").alias("segment")).agg(F.collect_list(cell).alias("cells"))
    vectors = vectors.select(*groups_on, "segment", F.col("cells.place").alias("places"), F.col("cells.n").alias("n"))
    blocks = F.ceil(F.col("sources") / GROUPS).cast("int")
    segments = F.greatest(F.ceil(F.col("kept") / LEAVES), F.lit(1)).cast("int")
    units = groups.where("sources > 1").select(*groups_on, "total", "kept", F.pmod(F.xxhash64("source"), blocks).cast("int").alias("block"), blocks.alias("blocks"), F.explode(F.sequence(F.lit(0), segments - 1)).alias("segment"))
    units = units.join(vectors.hint("merge"), [*groups_on, "segment"], "left").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select(*groups_on, "segment", "total", "kept", "block", "places", "n", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"))
    pairs = units.groupBy("lang", "segment", "one", "two").applyInPandas(priced, "lang string, source string, item string, value bigint")
    pairs = written(pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "audit-pairs")
    both = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    both = both.select(*groups_on, F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    forget(counts, vocabulary, terms)
    return both.unionByName(top)

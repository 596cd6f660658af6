"""MinHash near-duplicate detection with tensored banding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe.llm.components import components
from talkframe.llm.tables import forget, kept_in_worker, sized, written

#: Hashes of one half key, and half keys of each of the two collections: HALVES squared tables from 2 * ROWS * HALVES minhashes.
#: A pair of similarity 0.8 meets in a table with probability (1 - (1 - 0.8**3)**12)**2 = 0.9996, one of 0.85 with 0.99998.
ROWS, HALVES = 3, 12
#: Longs of an odd sketch of a small set, and shingles for each of them in a large one.
LONGS, PER_LONG = 16, 16
#: Shingles that are hashed at a time.
GROUP = 1 << 18


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, hashes: WordHashes, width: int) -> np.ndarray:
    """The distinct `width`-word shingles of a text as sorted 64-bit hashes; fewer words are one shingle, none give none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = mixed(out + h[k : len(words) - width + 1 + k])
    return np.unique(out)


def half_keys(sets: list[np.ndarray], rows: int, halves: int) -> np.ndarray:
    """For each non-empty set 2 * halves keys, each the hash of `rows` minhashes."""
    rng = np.random.default_rng(11)
    odd = rng.integers(0, 1 << 63, 2 * rows * halves, np.uint64) * np.uint64(2) + np.uint64(1)
    seed = rng.integers(0, 1 << 63, 2 * rows * halves, np.uint64)
    flat = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    out = np.zeros((len(sets), 2 * halves), np.uint64)
    for k in range(2 * rows * halves):
        v = (flat ^ seed[k]) * odd[k]
        v ^= v >> np.uint64(32)
        out[:, k // rows] = mixed(out[:, k // rows] + np.minimum.reduceat(v * odd[k - 1], starts))
    return out


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """A bit for each hash bucket of shingles: is their number odd? LONGS * 64 bits, doubled while a long stands for more than PER_LONG shingles.

    Two sketches differ in at most as many bits as the sets have shingles apart, so a pair of sets can be refuted and never lost.
    Folding the halves of a sketch onto each other gives the sketch of half the size.
    """
    longs = LONGS
    while longs * PER_LONG < len(s):
        longs *= 2
    bits = np.bincount((s & np.uint64(longs * 64 - 1)).astype(np.int64), minlength=longs * 64) & 1
    return np.packbits(bits.astype(bool), bitorder="little").view(np.int64)


def folded(sketch: np.ndarray) -> np.ndarray:
    """The sketch of LONGS longs."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, LONGS), axis=0)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, rows: int, halves: int, keyed: bool) -> DataFrame:
    """id, node (hash of the whole shingle set: equal for equal sets), n_shingles, a and b (the two collections of half keys), small (the folded odd
    sketch), large (the whole one, null where it is no larger) and, if `keyed`, h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = kept_in_worker("word hashes", WordHashes)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                sets, first, filled = [], at, 0
                while at < batch.num_rows and filled < GROUP:
                    sets.append(shingles(batch.column(1)[at].as_py(), hashes, width))
                    filled += len(sets[-1]) + 1
                    at += 1
                full = [s for s in sets if len(s)]
                keys = iter(half_keys(full, rows, halves).view(np.int64).tolist() if full else [])
                both = [next(keys) if len(s) else [] for s in sets]
                nodes = [xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets]
                odd = [odd_sketch(s) for s in sets]
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, at - first), pa.array(np.array(nodes, np.uint64).view(np.int64)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([k[:halves] for k in both], longs), pa.array([k[halves:] for k in both], longs),
                        pa.array([folded(s) for s in odd], longs), pa.array([s if len(s) > LONGS else None for s in odd], longs),
                        *(c.slice(first, at - first) for c in batch.columns[2:]),
                    ],
                    names=["id", "node", "n", "a", "b", "small", "large", *["h"] * keyed],
                )

    rows_in = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.xxhash64(text_col).alias("h")] * keyed)
    kind, longs = rows_in.schema["id"].dataType.simpleString(), "array<bigint>"
    return rows_in.mapInArrow(run, f"id {kind}, node bigint, n bigint, a {longs}, b {longs}, small {longs}, large {longs}" + ", h bigint" * keyed)


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """node and s (its sorted shingle hashes) for the documents whose id is in `wanted` (id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = kept_in_worker("word hashes", WordHashes)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                sets, filled = [], 0
                while at < batch.num_rows and filled < GROUP:
                    sets.append(shingles(batch.column(0)[at].as_py(), hashes, width))
                    filled += len(sets[-1]) + 1
                    at += 1
                nodes = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "s"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sized(wanted), "id").select("text")
    return texts.mapInArrow(run, "node bigint, s array<bigint>")


def possible(x: str, y: str, percent: int) -> Column:
    """Can the sets of two rows (n, small, large) be linked? By their sizes and by the bits in which their odd sketches differ: never false for a linked pair."""
    col = lambda row, name: F.col(f"{row}.{name}")
    most = (100 - percent) * (col(x, "n") + col(y, "n"))
    apart = lambda differ: differ * (100 + percent) <= most
    small = sum((F.bit_count(F.get(col(x, "small"), F.lit(i)).bitwiseXOR(F.get(col(y, "small"), F.lit(i)))) for i in range(LONGS)), F.lit(0))
    size = F.least(F.size(col(x, "large")), F.size(col(y, "large")))
    half = lambda row: F.when(F.size(col(row, "large")) <= size, col(row, "large")).otherwise(
        F.zip_with(F.slice(col(row, "large"), 1, size), F.slice(col(row, "large"), size + 1, size), lambda p, q: p.bitwiseXOR(q))
    )  # linked sets differ in size by less than a factor of two, so one fold is enough
    large = F.aggregate(F.zip_with(half(x), half(y), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, v: t + v)
    long = F.greatest(F.size(col(x, "large")), F.size(col(y, "large"))) <= 2 * size
    return apart(F.abs(col(x, "n") - col(y, "n"))) & apart(small) & (col(x, "large").isNull() | col(y, "large").isNull() | F.when(long, apart(large)).otherwise(True))


def linked(pairs: DataFrame, docs: DataFrame, ids: DataFrame, percent: int, id_col: str, text_col: str, width: int) -> DataFrame:
    """Of `pairs` (a, b), both nodes, those that are linked, counted on their whole sets. `ids` has a document's id for each node."""
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(ids.hint("merge"), "node").select("id").distinct(), "near-wanted")
    sets = written(shingle_sets(docs, wanted, id_col, text_col, width).dropDuplicates(["node"]), "near-sets")
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")).hint("merge"), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")).hint("merge"), "b")
    met = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("met"), (F.size("sa") + F.size("sb")).alias("sum"))
    found = written(met.where(100 * F.col("met") >= percent * (F.col("sum") - F.col("met"))).select("a", "b"), "near-links")
    forget(wanted, sets)
    return found


def once(halves: int) -> Column:
    """Is this the first table in which two rows (a, b: half keys) meet?"""
    first = lambda c: F.array_position(F.zip_with(f"x.{c}", f"y.{c}", lambda p, q: p == q), True) - 1
    return F.col("x.tab") == halves * first("a") + first("b")


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, rows: int = ROWS, halves: int = HALVES, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """Every document's id with n_shingles, component_id (smallest id reachable over links), kept (id = component_id) and, if `keyed`, h
    (xxhash64 of the text, which with the id tells rows apart).

    Two documents are linked when their sets of distinct `width`-word shingles (words between ASCII white space, A-Z in
    lower case) have 100 * intersection >= percent * union, counted on the whole sets. Candidates come from tensored
    banding: two collections of `halves` half keys each, and one table for every pair of half keys.

    1. Equal sets are one node, found by digest with map-side combining; only nodes go on.
    2. Half keys held by one node are dropped after a pre-aggregated count, then table keys, made of the half keys that are left: a table key can
       be shared only where both its halves are.
    3. In every bucket each node is a candidate of the bucket's least node (a star, not all pairs). Candidates that odd sketches do not
       refute are compared on their whole sets, and links are joined to components. Buckets that lie in one component are done.
    4. In the others every node outside the bucket's largest component is a candidate of all nodes of other components. Again only what odd
       sketches do not refute is compared.

    An odd sketch bounds the difference of two sets from below, so every pair that meets in a table is compared, refuted by that
    bound, or in one component already: no cap, nothing left to chance beyond the tables themselves. Sketches grow with the sets.
    Documents without words or with a null id are linked with nothing (component_id is their id); rows with equal ids and texts share
    the result, equal ids with unequal texts are documents of their own; an empty table gives an empty result; other columns are
    ignored. Nodes and shingles are 64-bit hashes.
    """
    all_rows = written(signatures(docs, id_col, text_col, width, rows, halves, keyed), "near-signatures")
    lone = F.col("id").isNull() | (F.col("n") == 0)
    marked = all_rows.where(~lone)
    same = ("n", "a", "b", "small", "large")  # alike in all rows of a node
    nodes = written(marked.groupBy("node").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in same)), "near-nodes")

    halfs = nodes.select("node", F.posexplode(F.concat("a", "b")).alias("slot", "half"))
    shared = halfs.groupBy("slot", "half").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("slot", "half")
    left = halfs.join(shared.hint("merge"), ["slot", "half"], "left_semi").groupBy("node").agg(F.collect_list(F.struct("slot", "half")).alias("halfs"))
    tab = lambda x, y: x["slot"] * halves + y["slot"] - halves
    pair = lambda x, y: F.struct(tab(x, y).alias("tab"), F.xxhash64(tab(x, y), x["half"], y["half"]).alias("key"))
    side = lambda first: F.filter("halfs", lambda x: (x["slot"] < halves) == first)
    table = F.flatten(F.transform(side(True), lambda x: F.transform("second", lambda y: pair(x, y))))
    keys = left.withColumn("second", side(False)).select("node", F.inline(table))
    keys = written(keys, "near-keys")
    crowd = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").drop("high")
    buckets = written(keys.join(crowd.hint("merge"), "key"), "near-buckets")
    short = lambda c: F.transform(c, lambda v: F.hash(v)).alias(c)
    fine = nodes.join(buckets.select("node").distinct().hint("merge"), "node").select("node", "n", "small", "large", short("a"), short("b"))
    fine = written(fine, "near-sketches")

    stars = buckets.select(F.greatest("node", "low").alias("a"), F.least("node", "low").alias("b")).where("a <> b").distinct()
    stars = stars.join(fine.select(F.col("node").alias("a"), F.struct("n", "small", "large").alias("x")).hint("merge"), "a")
    stars = stars.join(fine.select(F.col("node").alias("b"), F.struct("n", "small", "large").alias("y")).hint("merge"), "b")
    stars = written(stars.where(possible("x", "y", percent)).select("a", "b"), "near-stars")
    links = linked(stars, docs, nodes, percent, id_col, text_col, width)
    label = components(links)

    left = buckets.join(label.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node")).drop("low")
    sizes = left.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    open_keys = sizes.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("labels"), F.sum("n").alias("n"))
    open_keys = open_keys.where("labels > 1 AND n > 2").select("key", "main")
    left = left.join(open_keys.hint("merge"), "key").withColumn("is_main", F.col("label") == F.col("main")).drop("main")
    left = written(left.join(fine.hint("merge"), "node"), "near-open")
    x, y = left.where("NOT is_main").alias("x"), left.alias("y")
    apart = (F.col("x.label") != F.col("y.label")) & (F.col("y.is_main") | (F.col("x.node") < F.col("y.node")))
    rest = x.join(y.hint("merge"), (F.col("x.key") == F.col("y.key")) & apart & possible("x", "y", percent) & once(halves))
    rest = rest.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()
    rest = written(rest.join(stars.hint("merge"), ["a", "b"], "left_anti"), "near-rest")
    more = linked(rest, docs, nodes, percent, id_col, text_col, width)

    ids = nodes.select("node", F.struct("id", "node").alias("v"))  # a component is named by its smallest id, then node
    named = links.unionByName(more).join(ids.select(F.col("node").alias("a"), F.col("v").alias("va")).hint("merge"), "a")
    named = named.join(ids.select(F.col("node").alias("b"), F.col("v").alias("vb")).hint("merge"), "b").select(F.col("va").alias("a"), F.col("vb").alias("b"))
    found = components(named).select("node.node", F.col("label.id").alias("least"))
    found = nodes.join(found.hint("merge"), "node", "left").select("node", F.coalesce("least", "id").alias("component_id"))
    found = written(found, "near-components")
    forget(nodes, keys, buckets, fine, stars, links, left, rest, more)
    more = ["h"] if keyed else []
    rows_out = all_rows.select("id", "n", F.when(~lone, F.col("node")).alias("node"), *more).join(found.hint("merge"), "node", "left")
    component = F.coalesce("component_id", "id")
    return rows_out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), *more)

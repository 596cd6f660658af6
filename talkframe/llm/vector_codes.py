"""Vector code compression: product codes whose codebooks are fitted over Hilbert-sorted blocks with boxes and sums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe.llm.tables import sized, written

#: Parts of a vector, entries of a codebook, rounds of fitting, and the factor before components are floored.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components of the vectors that are sorted together, and points of a block.
CHUNK, BLOCK = 1 << 20, 16
#: Pairs of a point and an entry whose distances are counted at a time.
CELLS = 1 << 18


def largest(dims: int) -> int:
    """The largest integer component for which the squared distance of two vectors of `dims` components stays below 2**63."""
    return 1 << (30 - -(-(dims - 1).bit_length() // 2))


def hilbert(points: np.ndarray) -> np.ndarray:
    """The place of each row of non-negative integers along a Hilbert curve. At most the first 15 coordinates count, with the leading bits that fit in 60."""
    x = points[:, :15].T.astype(np.int64)
    n = len(x)
    bits = max(1, 60 // n)
    x = x >> max(0, int(x.max(initial=0)).bit_length() - bits)
    for level in range(bits - 1, 0, -1):  # undo the turns that the curve takes in each cell, from the largest cells down
        below = (1 << level) - 1
        for i in range(n):
            here = (x[i] >> level & 1).astype(bool)
            swap = np.where(here, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(here, below, swap)
            x[i] ^= swap
    for i in range(1, n):  # the cells of a level follow each other in Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[n - 1] >> level & 1, (1 << level) - 1, 0)
    x ^= turn
    place = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << 1 | (x[i] >> level & 1)
    return place


def narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the smallest signed type that holds them all."""
    for kind in (np.int8, np.int16, np.int32):
        if x.min(initial=0) >= np.iinfo(kind).min and x.max(initial=0) <= np.iinfo(kind).max:
            return x.astype(kind)
    return x


def blocks(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one part of a chunk's vectors: the order along the curve, and of each block of BLOCK points in that order lower corner, upper corner and sum."""
    order = np.argsort(hilbert(part - part.min(0)), kind="stable")
    starts = np.arange(0, len(part), BLOCK)
    rows = part[order]
    return order, np.minimum.reduceat(rows, starts), np.maximum.reduceat(rows, starts), np.add.reduceat(rows.astype(np.int64), starts)


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(block, entry) flags: can the entry be nearest to a point of the block's box? An entry whose least distance to the box is above
    another's greatest cannot; equal distances stay, so ties are decided point by point."""
    below, above = low[:, None] - book, book - high[:, None]
    gap = np.maximum(np.maximum(below, above), 0)
    reach = np.maximum(np.abs(below), np.abs(above))
    return (gap * gap).sum(2) <= (reach * reach).sum(2).min(1, keepdims=True)


def nearest(rows: np.ndarray, short: np.ndarray, book: np.ndarray) -> np.ndarray:
    """For each point (in curve order) the index of its nearest entry, the lowest of equals: one pass for each rank in the shortlists of the blocks
    that have more than one entry."""
    sizes = short.sum(1)
    lists = np.argsort(~short, axis=1, kind="stable")  # a block's entries first, lowest index first
    found = np.repeat(lists[:, 0], BLOCK)[: len(rows)]
    of_block = np.arange(len(rows)) // BLOCK
    at = np.flatnonzero(sizes[of_block] > 1)
    for first in range(0, len(at), CELLS):
        here = at[first : first + CELLS]
        best = ((rows[here] - book[found[here]]) ** 2).sum(1)
        for rank in range(1, int(sizes[of_block[here]].max())):
            left = np.flatnonzero(sizes[of_block[here]] > rank)
            entry = lists[of_block[here[left]], rank]
            away = ((rows[here[left]] - book[entry]) ** 2).sum(1)
            nearer = away < best[left]
            best[left[nearer]], found[here[left[nearer]]] = away[nearer], entry[nearer]
    return found


def totals(rows: np.ndarray, short: np.ndarray, sums: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(entry, 1 + length): how many points are nearest to each entry, and their sums. A block with one entry in its shortlist adds its stored sum."""
    out = np.zeros((len(book), 1 + rows.shape[1]), np.int64)
    alone = short.sum(1) == 1
    entry = short.argmax(1)[alone]
    counts = np.full(len(short), BLOCK)
    counts[-1] = len(rows) - BLOCK * (len(short) - 1)
    np.add.at(out, entry, np.column_stack([counts, sums])[alone])
    rest = ~np.repeat(alone, BLOCK)[: len(rows)]
    if rest.any():
        points = rows[rest]  # only the last block can be short, and it stays last
        np.add.at(out, nearest(points, short[~alone], book), np.column_stack([np.ones(len(points), np.int64), points]))
    return out


def kept_vectors(table: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, v) of the rows whose vector is neither null nor holds a null or non-finite component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = table.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.where(F.col("v").isNotNull() & ~F.exists("v", bad))


def integers(rows: DataFrame, dims: int) -> Column:
    """The vector's components as integers, floor(SCALE * x), filled up with zeros to `dims` of them."""
    most = float(largest(dims))
    part = F.transform("v", lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(most)), F.lit(-most))).cast("bigint"))
    return F.concat(part, F.array_repeat(F.lit(0).cast("bigint"), F.lit(dims) - F.size("v")))


def chunks(rows: DataFrame, dims: int) -> DataFrame:
    """The vectors (id, label, v: integers) as chunks of about CHUNK components: id, label (arrays), kind (the integers' type), points (part by part in curve order),
    places (the curve orders), low, high and sums (of blocks)."""
    width, size = dims // PARTS, min(max(256, CHUNK // dims), 1 << 16)
    id_kind, label_kind = rows.schema["id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()

    def chunk(ids: list[pa.Array], labels: list[pa.Array], vectors: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(vectors)
        found = [blocks(x[:, p * width : (p + 1) * width]) for p in range(PARTS)]
        points = narrow(np.concatenate([x[f[0], p * width : (p + 1) * width] for p, f in enumerate(found)]))
        places = np.concatenate([f[0] for f in found]).astype(np.uint16)
        low, high = (np.concatenate([f[k] for f in found]).astype(points.dtype) for k in (1, 2))
        sums = np.concatenate([f[3] for f in found]).astype(np.int64)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.concat_arrays(a)) for a in (ids, labels)]
        raw = [pa.array([a.tobytes()], pa.binary()) for a in (points, places, low, high, sums)]
        return pa.RecordBatch.from_arrays([*lists, pa.array([points.dtype.name]), *raw], names=["id", "label", "kind", "points", "places", "low", "high", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors, n = [], [], [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, size - n)
                ids.append(some.column(0)), labels.append(some.column(1))
                vectors.append(some.column(2).flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, dims))
                at, n = at + some.num_rows, n + some.num_rows
                if n == size:
                    yield chunk(ids, labels, vectors)
                    ids, labels, vectors, n = [], [], [], 0
        if n:
            yield chunk(ids, labels, vectors)

    shape = f"id array<{id_kind}>, label array<{label_kind}>, kind string, points binary, places binary, low binary, high binary, sums binary"
    return rows.select("id", "label", integers(rows, dims).alias("v")).mapInArrow(run, shape)


class Chunk:
    """One row of `chunks`, part by part."""

    def __init__(self, batch: pa.RecordBatch, i: int, width: int) -> None:
        raw = lambda name, kind: np.frombuffer(batch.column(name)[i].as_py(), kind)
        kind = np.dtype(batch.column("kind")[i].as_py())
        self.n = len(batch.column("id")[i])
        self.points = raw("points", kind).reshape(PARTS, self.n, width)
        self.places = raw("places", np.uint16).reshape(PARTS, self.n)
        self.low, self.high = (raw(name, kind).reshape(PARTS, -1, width) for name in ("low", "high"))
        self.sums = raw("sums", np.int64).reshape(PARTS, -1, width)

    def part(self, p: int, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The points of a part, and the shortlists of its blocks."""
        return self.points[p].astype(np.int64), shortlists(self.low[p].astype(np.int64), self.high[p].astype(np.int64), book)


def fitted(table: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks (part, entry, component) after `rounds` rounds over `chunks`. Tasks send a count and a sum for each entry, Spark adds them up."""
    width = books.shape[2]
    for _ in range(rounds):
        now = books.copy()

        def run(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            out = np.zeros((PARTS, now.shape[1], 1 + width), np.int64)
            for batch in batches:
                for i in range(batch.num_rows):
                    c = Chunk(batch, i, width)
                    for p in range(PARTS):
                        rows, short = c.part(p, now[p])
                        out[p] += totals(rows, short, c.sums[p], now[p])
            part, entry = np.nonzero(out[:, :, 0])
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(list(out[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "t"])

        sums = [F.sum(F.get("t", F.lit(i)).cast("decimal(38,0)")).alias(f"t{i}") for i in range(1 + width)]
        for part, entry, n, *total in table.mapInArrow(run, "part bigint, entry bigint, t array<bigint>").groupBy("part", "entry").agg(*sums).collect():
            books[part, entry] = [int(t) // int(n) for t in total]
    return books


def coded(table: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error) of every vector of `chunks`."""
    width = books.shape[2]
    id_kind, label_kind = (table.schema[c].dataType.elementType.simpleString() for c in ("id", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = Chunk(batch, i, width)
                codes, error = np.zeros((c.n, PARTS), np.uint8), np.zeros(c.n, np.int64)
                for p in range(PARTS):
                    rows, short = c.part(p, books[p])
                    found = nearest(rows, short, books[p])
                    codes[c.places[p], p] = found
                    error[c.places[p]] += ((rows - books[p][found]) ** 2).sum(1)
                text = codes.tobytes().hex()
                texts = [text[k : k + 2 * PARTS] for k in range(0, len(text), 2 * PARTS)]
                yield pa.RecordBatch.from_arrays([batch.column("id")[i].values, batch.column("label")[i].values, pa.array(texts), pa.array(error)], names=["id", "label", "code", "error"])

    return table.mapInArrow(run, f"id {id_kind}, label {label_kind}, code string, error bigint")


def compress(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors (id, code, error, label_error) and the codebooks (part, entry, component).

    Components become floor(256 * x), vectors 16 equal consecutive parts; each part position's codebook starts as that part of the 64 first vectors
    by id (of equal ids, by components; nulls last) and takes two rounds of nearest entries and floored means.

    1. Tasks cut their vectors into chunks, sort each part along a Hilbert curve and cut it into flat blocks with a box and a sum: no shuffle, and what
       is written is hardly larger than the vectors.
    2. In each round a block's box and the entries give a shortlist: entries nearer at their furthest than others at their nearest. A block with one
       is added to that entry by its sum; points of other blocks are compared with the shortlist alone, in 64-bit integers.
    3. Tasks send at most 1,024 counts and sums, whatever they hold; the codebooks (at most 1,024 entries) go through the driver.

    Rows with a null vector, or a null, NaN or infinite component, are dropped. Shorter vectors, and vectors whose length is no multiple of 16, are filled
    up with zeros to the longest; components so large that an error could leave the 64-bit range (2**19 and more at 64 components) count as that bound.
    With fewer than 64 vectors the codebooks have as many entries; without any the result is empty. Repeated rows count each; a null id
    is an id like others; null labels are one label; other columns are ignored.
    """
    rows = kept_vectors(table, id_col, vec_col, label_col)
    dims = -(-(rows.agg(F.max(F.size("v"))).first()[0] or 1) // PARTS) * PARTS
    first = rows.select("id", integers(rows, dims).alias("v")).orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    books = np.array([r.v for r in first], np.int64).reshape(len(first), PARTS, dims // PARTS).transpose(1, 0, 2).copy()
    table = written(chunks(rows, dims), "vector-chunks")
    if len(first):
        books = fitted(table, books, ROUNDS)
    codes = written(coded(table, books), "vector-codes")
    by_label = written(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "vector-labels").alias("l")
    found = codes.alias("c").join(sized(by_label), F.col("c.label").eqNullSafe(F.col("l.label")))
    return found.select(F.col("c.id").alias(id_col), "code", "error", "label_error"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimals joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

"""Removal of repeated byte strings with a distributed suffix array."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe.llm.near_dedup import mixed
from talkframe.llm.tables import kept_in_worker, sized, written

#: Bytes of a repeated string, and of the leading token by which suffixes are told apart.
LENGTH, LEAD = 100, 24
#: Bytes that are hashed at a time, unless one text is longer; and the largest that positions are packed for.
GROUP, MOST = 1 << 21, 1 << 24
#: A lead with more contexts than this is compared in Spark, spread over all tasks; others are sorted whole, each in one task.
MANY, SALTS = 5_000, 16
#: Ranges of leads that the sample shows to fill more than one range are cut by context, and numbered from here on.
HOT, SLICES = 1 << 20, 64
#: Stands for a null id in the order of documents: after all others.
LAST = (1 << 63) - 1
U = np.uint64


def powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, of its inverse, and a random number for each byte."""
    base = 0xD6E8FEB86659FD93
    inverse = pow(base, -1, 1 << 64)

    def up(b: int) -> np.ndarray:
        out = np.full(n + 1, b, U)
        out[0] = 1
        return np.multiply.accumulate(out)

    return up(base), up(inverse), np.random.default_rng(5).integers(1, 1 << 63, 256, U)


def tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = 1 << max(22, n.bit_length())
    return kept_in_worker(f"powers {size}", lambda: powers(size))


def characters(data: np.ndarray) -> np.ndarray:
    """At each position the next 8 bytes as a number, ordered as the bytes are; beyond the end there are zeros."""
    v = np.concatenate([data, np.zeros(7, np.uint8)]).astype(U)
    v = v[:-1] << U(8) | v[1:]
    v = v[:-2] << U(16) | v[2:]
    return v[:-4] << U(32) | v[4:]


def anchored(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The anchors of texts that lie end to end in `data`: for every run of windows (strings of `length` bytes inside one text)
    with the same anchor, the anchor's place, the first and the last window, the lead's bytes as three numbers, and the context's hash.

    A window's anchor is its leftmost position of least lead hash. It depends on the window's bytes alone, so equal windows
    have their anchors at the same place: repeats need looking for only among suffixes that begin at anchors.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(7))
    ends = np.append(starts[1:], len(data))
    if len(data) < length or not np.any(ends - starts >= length):
        return none
    v, n = characters(data), len(data) - LEAD + 1
    lead = mixed(mixed(mixed(v[:n]) + v[8 : n + 8]) + v[16 : n + 16])
    least = (lead >> U(24) << U(24)) | np.arange(len(lead), dtype=U)
    span, width = length - LEAD + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: -(span - width)], least[span - width :])
    inside = np.zeros(len(data) + 1, np.int32)
    long = ends - starts >= length
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1])[: len(least)])
    anchor = (least[at] & U((1 << 24) - 1)).astype(np.int64)
    cut = np.flatnonzero(np.diff(anchor, prepend=-1))
    p1, p2 = at[cut], at[np.append(cut[1:], len(at)) - 1]
    anchor = anchor[cut]
    up, down, letters = tables(len(data))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(letters[data] * up[: len(data)], out=sums[1:])
    context = (sums[p2 + length] - sums[p1]) * down[p1]
    context = mixed(context + (anchor - p1).astype(U) * U(1 << 20) + (anchor - p2).astype(U))
    return anchor, p1, p2, v[anchor], v[anchor + 8], v[anchor + 16], context


def grouped(texts: Iterator[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in groups of about GROUP bytes, with the number of the first."""
    first, group, size = 0, [], 0
    for n, text in enumerate(texts):
        if group and size + len(text) > GROUP:
            yield first, group
            first, group, size = n, [], 0
        group.append(text)
        size += len(text)
    if group:
        yield first, group


def pieces(text: bytes, length: int, most: int = MOST) -> Iterator[tuple[int, bytes]]:
    """A text beyond what positions are packed for (`most`) goes in pieces that share length - 1 bytes."""
    step = most - length
    for at in range(0, max(1, len(text) - length + 1), step):
        yield at, text[at : at + step + length - 1]


def ordered(v: np.ndarray) -> np.ndarray:
    """Unsigned numbers as signed ones in the same order."""
    return (v ^ U(1 << 63)).view(np.int64)


def repeated_here(context: np.ndarray, key: np.ndarray, h: np.ndarray, p1: np.ndarray) -> np.ndarray:
    """Rows that certainly repeat: their context stands in an earlier document, or earlier in this one, among these very rows."""
    order = np.argsort(context, kind="stable")
    same = context[order[1:]] == context[order[:-1]]
    tied = np.zeros(len(order), bool)
    tied[1:], tied[:-1] = same, tied[:-1] | same
    out = np.zeros(len(context), bool)
    some = order[tied]
    if len(some):
        some = some[np.lexsort((p1[some], h[some], key[some], context[some]))]
        new = np.append(True, context[some[1:]] != context[some[:-1]])
        first = some[new][np.cumsum(new) - 1]
        out[some] = (key[some] != key[first]) | (h[some] != h[first]) | (p1[some] != p1[first])
    return out


COLUMNS = ("lead", "mid", "tail", "context", "key", "h", "a", "p1", "p2", "part")


def suffixes(rows: DataFrame, length: int, cuts: list[int] | None = None, hot: list[int] | None = None, most: int = MOST) -> DataFrame:
    """(key, h, text) as anchored suffixes: lead, mid and tail (the first 24 bytes as three ordered numbers), context (hash), key, h, a, p1, p2, part and sure.

    `part` is the number of the range between `cuts` that the lead falls into; leads in `hot` are cut by context besides. A row that repeats an
    earlier one of the same stretch of text is `sure` and goes to any range: so a string in a third of all documents sends few rows to its range.
    """
    splits, heavy = np.array(cuts or [], np.int64), np.array(sorted(hot or []), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [(i, off, part) for i, t in enumerate(batch.column(2)) for off, part in pieces(t.as_py().encode("utf-8", "surrogatepass"), length, most)]
            of, offs = np.array([c[0] for c in cut], np.int64), np.array([c[1] for c in cut], np.int64)
            keys, hs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, group in grouped(c[2] for c in cut):
                sizes = np.array([len(t) for t in group])
                starts = np.cumsum(sizes) - sizes
                a, p1, p2, *lead, context = anchored(np.frombuffer(b"".join(group), np.uint8), starts, length)
                doc = np.searchsorted(starts, a, "right") - 1
                shift = offs[first + doc] - starts[doc]
                doc = of[first + doc]
                lead = [ordered(x.astype(U)) for x in lead]
                part = np.searchsorted(splits, lead[0], "right")
                if len(heavy):
                    at = np.minimum(np.searchsorted(heavy, lead[0]), len(heavy) - 1)
                    part = np.where(heavy[at] == lead[0], HOT + at * SLICES + (context.astype(U) % U(SLICES)).astype(np.int64), part)
                key, h, p1, p2 = keys[doc], hs[doc], p1 + shift, p2 + shift
                sure = repeated_here(context, key, h, p1)
                part = np.where(sure, (mixed(h.view(U)) % U(len(splits) + 1)).astype(np.int64), part)
                cols = [*lead, context.view(np.int64), key, h, a + shift, p1, p2, part, sure]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[*COLUMNS, "sure"])

    return rows.mapInArrow(run, ", ".join(f"{c} bigint" for c in COLUMNS) + ", sure boolean")


def changes(batch: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    """Where a row differs from the one before in the named columns; the first does."""
    out = np.ones(batch.num_rows, bool)
    cols = [batch.column(n).to_numpy() for n in names]
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols]) if batch.num_rows else out[1:]
    return out


LEADS = ("lead", "mid", "tail")


def without_twins(batch: pa.RecordBatch, before: tuple | None) -> tuple[pa.RecordBatch, tuple]:
    """A sorted batch without rows that repeat the row before (`before`: of the last batch) in lead, key, h and p1: a document that
    is in the table twice is no repeat of itself."""
    names = (*LEADS, "key", "h", "p1")
    fresh = changes(batch, names)
    fresh[0] = tuple(batch.column(n)[0].as_py() for n in names) != before
    return batch.filter(pa.array(fresh)), tuple(batch.column(n)[-1].as_py() for n in names)


def whole_repeats(sorted_rows: DataFrame) -> DataFrame:
    """Over rows sorted by sure, lead, context and document: kind 0, a run whose whole context stands earlier; kind 1, the first of
    each context where a lead has several, or may have some in another range. One pass with one remembered row; other rows are done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # lead and context of the row before
        first: pa.RecordBatch | None = None  # the first row of the open lead, until it is known whether another context follows
        before = None

        def out(rows: pa.RecordBatch, kinds: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*rows.select([*COLUMNS]).columns, pa.array(kinds.astype(np.int32), pa.int32())], names=[*COLUMNS, "kind"])

        for batch in batches:
            sure = batch.column("sure")
            if sure.true_count:
                rows = batch.filter(sure)
                yield out(rows, np.zeros(rows.num_rows))
                batch = batch.filter(pa.array(~sure.to_numpy(zero_copy_only=False)))
            if batch.num_rows:
                batch, before = without_twins(batch, before)
            if not batch.num_rows:
                continue
            values = [batch.column(c).to_numpy() for c in (*LEADS, "context")]
            new = changes(batch, LEADS)
            head = new | changes(batch, ("context",))
            if last is not None and tuple(v[0] for v in values[:3]) == last[:3]:
                new[0] = False
                head[0] = values[3][0] != last[3]
            group = np.cumsum(new)
            heads = np.bincount(group, head, minlength=group[-1] + 1)
            if not new[0]:
                heads[0] += 1  # the remembered context
            hot = batch.column("part").to_numpy() >= HOT
            several = head & ((heads[group] > 1) | hot)
            shown = ~head | several
            yield out(batch.filter(pa.array(shown)), np.where(head, 1, 0)[shown])
            if first is not None and not new[0] and heads[0] > 1:
                yield out(first, np.ones(1))
                first = None
            if new.any():
                start = int(np.flatnonzero(new)[-1])
                first = batch.slice(start, 1) if heads[group[-1]] <= 1 and not hot[start] else None
            last = tuple(v[-1] for v in values)

    return sorted_rows.mapInArrow(run, ", ".join(f"{c} bigint" for c in COLUMNS) + ", kind int")


CONTEXTS = (*LEADS, "key", "h", "a", "p1", "p2", "part")


def surroundings(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """From documents with their list of runs: the bytes around each anchor that the run's windows cover."""
    lists = batch.column(3)
    flat = lists.flatten()
    sizes = np.diff(lists.offsets.to_numpy())
    doc = np.repeat(np.arange(batch.num_rows), sizes)
    p1, p2 = flat.field("p1").to_numpy(), flat.field("p2").to_numpy()
    texts = {}
    parts = []
    for d, x, y in zip(doc.tolist(), p1.tolist(), p2.tolist(), strict=True):
        if d not in texts:
            texts = {d: batch.column(2)[d].as_py().encode("utf-8", "surrogatepass")}
        parts.append(texts[d][x : y + length])
    of_doc = {"key": batch.column(0), "h": batch.column(1)}
    cols = [of_doc[c].take(pa.array(doc)) if c in of_doc else flat.field(c) for c in CONTEXTS]
    return pa.RecordBatch.from_arrays([*cols, pa.array(parts, pa.binary())], names=[*CONTEXTS, "bytes"])


def contexts(rows: DataFrame, length: int) -> DataFrame:
    """`surroundings` of a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (surroundings(batch, length) for batch in batches)

    return rows.mapInArrow(run, ", ".join(f"{c} bigint" for c in CONTEXTS) + ", bytes binary")


def windows(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, ...]:
    """Every window of a batch of contexts: the bytes end to end, where it begins in them, its row and its number in the row."""
    data = np.frombuffer(b"".join(v.as_py() for v in batch.column("bytes")), np.uint8)
    n = batch.column("p2").to_numpy() - batch.column("p1").to_numpy() + 1
    size = n + length - 1
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return data, (np.cumsum(size) - size)[row] + step, row, step


def multikey_sorted(data: np.ndarray, where: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the suffixes that begin at `where`, by their first `length` bytes, in characters of 8 bytes.

    A range of suffixes that agree up to its depth is cut in three around the character of its middle one: less, equal, greater; the equal part goes on with the next
    character. All open ranges are cut at once. Returns the order, and whether a suffix's longest common prefix with its neighbour before reaches `length`.
    Ties keep the order of `where`.
    """
    v, n = characters(data), len(where)
    small = np.int32 if n < 1 << 29 else np.int64  # numbers of places and of parts: memory is what bounds a batch
    order, depth, first = np.arange(n, dtype=small), np.zeros(n, np.int16), np.zeros(n, bool)
    first[:1] = True
    while True:
        alone = first & np.append(first[1:], True)
        at = np.flatnonzero(~alone & (depth < length)).astype(small)  # the places of open ranges
        if not len(at):
            break
        char = v[where[order[at]] + depth[at]]
        beyond = np.flatnonzero(depth[at] > length - 8)
        char[beyond] >>= (8 * (depth[at[beyond]].astype(np.int64) + 8 - length)).astype(U)
        begins = np.flatnonzero(first[at])
        sizes = np.diff(begins, append=len(at))
        part = np.repeat(np.arange(0, 3 * len(begins), 3, dtype=small), sizes)
        pivot = np.repeat(char[begins + sizes // 2], sizes)
        part += char >= pivot
        part += char > pivot
        del char, pivot
        cut = np.argsort(part, kind="stable").astype(small)
        part = part[cut]
        order[at] = order[at[cut]]
        first[at[1:]] |= part[1:] != part[:-1]
        depth[at[part % 3 == 1]] += 8
    return order, ~first


def window_codes(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every window of a batch of contexts: its row, its number in the row, and a hash of its bytes."""
    data, where, row, step = windows(batch, length)
    up, down, letters = tables(len(data))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(letters[data] * up[: len(data)], out=sums[1:])
    return row, step, mixed((sums[where + length] - sums[where]) * down[where])


def crowded_repeats(rows: DataFrame, length: int) -> DataFrame:
    """As `partial_repeats`, from documents with their list of runs, for leads of any number of contexts: every window is a row, the first of equal ones is a minimum
    with map-side combining, and the way back to the windows is salted, so that neither a lead nor a window is one task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = (batch.slice(at, 500) for batch in batches for at in range(0, batch.num_rows, 500))
        for whole in (surroundings(batch, length) for batch in small):
            for at in range(0, whole.num_rows, 2_000):
                batch = whole.slice(at, 2_000)
                row, step, code = window_codes(batch, length)
                tail, key, h, p1 = (batch.column(n).to_numpy()[row] for n in ("tail", "key", "h", "p1"))
                cols = [tail, code.view(np.int64), key, h, p1 + step]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["tail", "code", "key", "h", "p"])

    windows = written(rows.mapInArrow(run, "tail bigint, code bigint, key bigint, h bigint, p bigint"), "suffix-windows")
    where = F.struct("key", "h", "p")
    first = windows.groupBy("tail", "code").agg(F.min(where).alias("first"), F.max(where).alias("last")).where("first <> last").drop("last")
    first = written(first, "suffix-firsts").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = windows.withColumn("salt", F.pmod(F.xxhash64("key", "h", "p"), F.lit(SALTS)).cast("int"))
    again = salted.join(sized(first), ["tail", "code", "salt"]).where(F.struct("key", "h", "p") != F.col("first"))
    return again.select("key", "h", F.col("p").alias("p1"), F.col("p").alias("p2"))


def partial_repeats(sorted_rows: DataFrame, length: int) -> DataFrame:
    """Over contexts sorted by lead and document: key, h, p1, p2 of runs of windows that stand in an earlier context.

    All windows of a lead are suffixes of their contexts; they are sorted by their bytes, and neighbours whose common prefix reaches
    `length` are equal strings, of which the first in document order is the original. Equal strings have the same anchor, hence the same lead; leads are
    taken whole, many at a time, and one that a batch ends in goes on to the next, so no neighbours are missed. A lead comes here with at most MANY contexts.
    """

    def repeats(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, where, row, step = windows(batch, length)
        order, tied = multikey_sorted(data, where, length)
        again = np.zeros(len(where), bool)
        again[order[tied]] = True
        edge = np.diff(np.concatenate([[0], again.astype(np.int8), [0]]))
        broken = np.flatnonzero(again[1:] & again[:-1] & (row[1:] != row[:-1])) + 1
        s = np.sort(np.concatenate([np.flatnonzero(edge == 1), broken]))
        e = np.sort(np.concatenate([np.flatnonzero(edge == -1) - 1, broken - 1]))
        key, h, p1 = (batch.column(c).to_numpy()[row[s]] for c in ("key", "h", "p1"))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (key, h, p1 + step[s], p1 + step[e])], names=["key", "h", "p1", "p2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, waiting, n = None, [], 0
        for batch in batches:
            if batch.num_rows:
                batch, before = without_twins(batch, before)
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, 5_000)
                at += some.num_rows
                waiting.append(some)
                n += some.num_rows
                if n < 5_000:
                    continue
                whole = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                cut = int(np.flatnonzero(changes(whole, LEADS))[-1])
                if cut:
                    yield repeats(whole.slice(0, cut))
                waiting, n = [whole.slice(cut)], whole.num_rows - cut
        if n:
            yield repeats(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])

    return sorted_rows.mapInArrow(run, "key bigint, h bigint, p1 bigint, p2 bigint")


def cleaned(rows: DataFrame, length: int, keep_text: bool) -> DataFrame:
    """From (key, h, text, runs): n_bytes, n_removed, n_spans, kept_sha256 and the kept text where asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, runs in zip(batch.column(2), batch.column(3), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                kept, removed, spans = data, 0, 0
                if runs.is_valid and len(runs):
                    p1, p2 = runs.values.field("p1").to_numpy(), runs.values.field("p2").to_numpy()
                    cover = np.zeros(len(data) + 1, np.int32)
                    np.add.at(cover, p1, 1)
                    np.add.at(cover, p2 + length, -1)
                    gone = np.cumsum(cover)[:-1] > 0
                    removed, spans = int(gone.sum()), int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                for column, value in zip(out, (len(data), removed, spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            cols = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.mapInArrow(run, "key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def splitters(docs: DataFrame, length: int, parts: int, share: float, seed: int = 17, most: int = MOST) -> tuple[list[int], list[int]]:
    """`parts` - 1 quantiles of the leads in a sample of the documents, and the leads that fill more than one range: both bounded by the number of parts."""
    sample = suffixes(docs.sample(share, seed), length, most=most).select("lead")
    found = sample.agg(F.percentile_approx("lead", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []
    return sorted(set(found)), sorted({x for x, y in zip(found, found[1:], strict=False) if x == y})


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", sample: float = 0.01, keep_text: bool = False, most: int = MOST) -> DataFrame:
    """Every document's id with n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and `kept` (binary) where asked for.

    A byte goes when a `length`-byte string that covers it also starts earlier: in a document of smaller id, or earlier in the same
    document. Strings are judged on the input. Texts are UTF-8 bytes, null is empty; ids are integers of any width (others are an error), null ids come
    last; rows that share an id are ordered by a hash of their text, rows alike in both are one document; texts beyond `most` bytes are read in pieces
    that overlap; an empty table gives an empty result.

    1. Suffixes enter the array at anchors first (a window's leftmost least lead hash): about one byte in forty. What repeats inside a stretch of one
       map task is settled there.
    2. Sampled splitters range-partition them by their leading bytes; every range sorts by lead, context and document. Ranges are cut between leads,
       so equal strings never lie on two sides; a lead that fills more than one range is cut by context, and its contexts meet again in step 4.
    3. One pass over the sorted range finds runs whose whole context stands earlier, and leads that have several contexts.
    4. Those contexts' bytes are fetched and dealt by the same splitters. Every window in them is a suffix: a multikey quicksort orders a lead's
       suffixes by their bytes, and neighbours are compared by their longest common prefix. Suffixes of a lead with more than MANY contexts become
       a row each, of which Spark finds the first by hash, so no task holds a lead that grows with the corpus.
    5. The runs go back to their documents. Texts are shuffled once: both joins use the same exchange.
    """
    if docs.schema[id_col].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"{id_col} must be an integer")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("key"), F.xxhash64(text).alias("h"), text.alias("text"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts, hot = splitters(rows, length, min(16 * tasks, 4096), sample, most=most)
    order = ["sure", *LEADS, "context", "key", "h", "p1"]
    dealt = suffixes(rows, length, cuts, hot, most).repartition(tasks, "part").sortWithinPartitions(*order)
    found = written(whole_repeats(dealt).drop("context"), "suffix-repeats")
    heads = found.where("kind = 1").drop("kind")
    on, lead = ["key", "h"], [*LEADS]
    crowded = written(heads.groupBy(*lead).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MANY).select(*lead), "suffix-crowded")
    runs = found.where("kind = 0").select("key", "h", "p1", "p2")

    def holding(some: DataFrame) -> DataFrame:
        part = F.when(F.col("part") >= HOT, F.xxhash64(*lead)).otherwise(F.col("part")).alias("part")
        lists = some.withColumn("part", part).groupBy(*on).agg(F.collect_list(F.struct(*lead, "a", "p1", "p2", "part")).alias("runs"))
        return rows.join(lists.hint("merge"), on).select("key", "h", "text", "runs")

    if not crowded.isEmpty():
        runs = runs.unionByName(crowded_repeats(holding(heads.join(sized(crowded), lead, "left_semi")), length))
        heads = heads.join(sized(crowded), lead, "left_anti")
    dealt = contexts(holding(heads), length).repartition(tasks, "part").sortWithinPartitions(*lead, "key", "h", "p1")
    runs = runs.unionByName(partial_repeats(dealt, length))
    runs = runs.distinct().groupBy("key", "h").agg(F.collect_list(F.struct("p1", "p2")).alias("runs"))
    done = cleaned(rows.join(runs.hint("merge"), on, "left").select("key", "h", "text", "runs"), length, keep_text)
    return done.select(F.nullif(F.col("key"), F.lit(LAST)).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else []))

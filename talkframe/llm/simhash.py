"""SimHash near-duplicate detection with a binary trie joined with itself."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe.llm.components import components
from talkframe.llm.tables import forget, sized, written

BITS, WIDTH, BUDGET, SEED = 64, 4, 4, 42
#: Shingles that are hashed at a time.
GROUP = 1 << 16
#: Fingerprints of a branch that one task joins; larger branches are dealt into slices.
BRANCH = 8192
#: Rows of branches that a task takes together, and pairs of trie nodes that it holds or compares at a time.
ROWS, PAIRS = 1 << 17, 1 << 18
#: Two nodes that hold at most so many pairs of fingerprints are compared without going further down.
LEAF = 256


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """A bit is 1 if it is set in over half the XXH64 hashes (seed 42) of all shingles of `width` words, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = memoryview(b" ".join(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    width = min(width, len(words))
    starts, ends = (ends - sizes + 1)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), GROUP):
        some = zip(starts[at : at + GROUP], ends[at : at + GROUP], strict=True)
        h = np.fromiter((xxhash.xxh64_intdigest(line[s:e], SEED) for s, e in some), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (the 64 bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def trie_join(keys: np.ndarray, bits: int, left: np.ndarray, right: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """For each of the sorted `keys` the index of the first key that it is linked with over links found here.

    The trie of the keys' last `bits` bits is implicit: a node is a range of keys. `left` and `right` hold the (first, end) ranges of the pairs of nodes to begin
    with, above the last `bits` bits; a node paired with itself stands for all pairs inside it. Pairs go down one bit at a time: children on the same
    side keep their count of differing bits, those on different sides add one, and a pair over `budget`, or with an empty node, ends. Pairs of
    nodes wait on a stack in groups, so memory is bounded whatever the number of pairs; links are merged as they are found.
    """
    label = np.arange(len(keys))
    low = np.uint64((1 << bits) - 1)
    stack = [(left[:, 0], left[:, 1], right[:, 0], right[:, 1], np.zeros(len(left), np.int64), bits)]
    while stack:
        al, ah, bl, bh, used, bit = stack.pop()
        if len(al) > PAIRS:
            half = len(al) // 2
            stack += [(al[:half], ah[:half], bl[:half], bh[:half], used[:half], bit), (al[half:], ah[half:], bl[half:], bh[half:], used[half:], bit)]
            continue
        cells = (ah - al) * (bh - bl)
        leaf = (cells <= LEAF) | (bit == 0)
        if leaf.any():
            _compare(keys, low, label, al[leaf], ah[leaf], bl[leaf], bh[leaf], budget)
        al, ah, bl, bh, used = (v[~leaf] for v in (al, ah, bl, bh, used))
        if not len(al):
            continue
        bit -= 1
        one = np.uint64(1 << bit)
        split = lambda first: np.searchsorted(keys, (keys[first] & ~(one | (one - np.uint64(1)))) | one)
        am, bm = split(al), split(bl)
        unlike = al != bl
        down = [(al, am, bl, bm, used), (am, ah, bm, bh, used), (al, am, bm, bh, used + 1), *([tuple(v[unlike] for v in (am, ah, bl, bm, used + 1))] if unlike.any() else [])]
        al, ah, bl, bh, used = (np.concatenate(v) for v in zip(*down, strict=True))
        live = (used <= budget) & (al < ah) & (bl < bh)
        stack.append((*(v[live] for v in (al, ah, bl, bh, used)), bit))
    return label


def _compare(keys: np.ndarray, low: np.uint64, label: np.ndarray, al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray, budget: int) -> None:
    """All fingerprints of one node with all of the other; what is linked takes the lesser label."""
    width, cells = bh - bl, (ah - al) * (bh - bl)
    ends = np.cumsum(cells)
    at = 0
    while at < len(cells):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] - cells[at] + PAIRS)))
        some, n = slice(at, end), cells[at:end]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        w = np.repeat(width[some], n)
        i, j = np.repeat(al[some], n) + k // w, np.repeat(bl[some], n) + k % w
        near = (i < j) & (label[i] != label[j]) & (np.bitwise_count((keys[i] ^ keys[j]) & low) <= budget)
        merge(label, i[near], j[near])
        at = end


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i and j in `label`, where every index points to the least index of its set."""
    while len(i):
        a, b = label[i], label[j]
        high, least = np.maximum(a, b), np.minimum(a, b)
        np.minimum.at(label, high, least)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]


def layouts(blocks: int, budget: int = BUDGET) -> list[tuple[Column, Column, int]]:
    """The bit orders in which tries are built: for every choice of blocks - budget of the fingerprint's blocks, (these blocks' bits, the other bits, their number).

    Two fingerprints of at most `budget` differing bits agree on all of some choice.
    """
    cuts = [round(BITS * k / blocks) for k in range(blocks + 1)]
    found = []

    def packed(chosen: list[int]) -> tuple[Column, int]:
        out, total = F.lit(0).cast("bigint"), 0
        for b in chosen:
            n = cuts[b + 1] - cuts[b]
            out = F.shiftleft(out, n).bitwiseOR(F.shiftrightunsigned("fp", cuts[b]).bitwiseAND(F.lit((1 << n) - 1)))
            total += n
        return out, total

    for chosen in combinations(range(blocks), blocks - budget):
        rest, bits = packed([b for b in range(blocks) if b not in chosen])
        found.append((packed(list(chosen))[0], rest, bits))
    return found


def branches(nodes: DataFrame, blocks: int, most: int) -> DataFrame:
    """layout, branch (the bits that a branch of the trie shares), one and two (which slices meet), side, rest (the other bits) and fp of every fingerprint in
    every branch. A branch of more than `most` fingerprints is dealt by hash into slices of about `most`, each of which meets each."""
    rows = [F.struct(F.lit(k).alias("layout"), branch.alias("branch"), rest.alias("rest")) for k, (branch, rest, _) in enumerate(layouts(blocks))]
    rows = nodes.select("fp", F.inline(F.array(*rows)))
    sizes = rows.groupBy("layout", "branch").agg(F.count(F.lit(1)).alias("n"))
    crowded = written(sizes.where(F.col("n") > most).select("layout", "branch", F.ceil(F.col("n") / most).cast("int").alias("m")), "simhash-crowded")
    rows = rows.join(sized(crowded), ["layout", "branch"], "left").withColumn("m", F.coalesce("m", F.lit(1)))
    rows = rows.withColumn("s", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    rows = rows.select("layout", "branch", "rest", "fp", "s", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("t"))
    return rows.select("layout", "branch", F.least("s", "t").alias("one"), F.greatest("s", "t").alias("two"), (F.col("s") > F.col("t")).cast("int").alias("side"), "rest", "fp")


def joined(rows: DataFrame, blocks: int) -> DataFrame:
    """Links (a, b) that connect what the trie joins of `branches` connect: each fingerprint with the first of its set in the branch."""
    bits = [b for *_, b in layouts(blocks)]
    heads = 1 << (BITS - max(bits))

    def links(cols: list[np.ndarray]) -> pa.RecordBatch:
        layout, branch, one, two, side, rest, fp = cols
        new = np.ones(len(fp), bool)
        new[1:] = reduce(np.logical_or, (c[1:] != c[:-1] for c in (layout, branch, one, two)))
        head = new.copy()
        head[1:] |= side[1:] != side[:-1]
        starts = np.flatnonzero(head)
        width = max(bits)
        keys = (np.cumsum(head).astype(np.uint64) - np.uint64(1) << np.uint64(width)) | rest.view(np.uint64)
        ranges = np.column_stack([starts, np.append(starts[1:], len(fp))])
        second = ~new[starts]  # the other side of a branch whose slices meet
        pairs = np.flatnonzero(second)
        same = np.flatnonzero((one == two)[starts])
        left, right = np.concatenate([ranges[same], ranges[pairs - 1]]), np.concatenate([ranges[same], ranges[pairs]])
        label = trie_join(keys, width, left, right)
        far = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(fp[far]), pa.array(fp[label[far]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in whole_branches(batches, heads // 2):
            yield links(cols)

    order = ["layout", "branch", "one", "two", "side", "rest"]
    dealt = rows.repartition("layout", "branch", "one", "two").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "a bigint, b bigint")


def whole_branches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[np.ndarray]]:
    """The sorted rows as columns, about ROWS at a time and at most `most` branches (told apart by the first four columns), none of them cut."""
    ends = lambda cols: np.flatnonzero(reduce(np.logical_or, (c[1:] != c[:-1] for c in cols[:4]))) + 1

    def pieces(cols: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        cuts = [0, *ends(cols)[most - 1 :: most].tolist(), len(cols[0])]
        for first, end in zip(cuts, cuts[1:]):
            yield [c[first:end] for c in cols]

    held: list[list[np.ndarray]] = []
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        if sum(len(cols[0]) for cols in held) >= ROWS:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            found = ends(cols)
            last = int(found[-1]) if len(found) else 0
            if last:
                yield from pieces([c[:last] for c in cols])
            held = [[c[last:] for c in cols]]
    cols = [np.concatenate(c) for c in zip(*held, strict=True)] if held else []
    if cols and len(cols[0]):
        yield from pieces(cols)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id with fp (its fingerprint as a long) and component_id, the smallest id reachable over links of at most BUDGET differing bits.

    1. Fingerprints in one scan; equal ones are one node, with map-side combining, so copies cost nothing further on.
    2. The fingerprint is cut into blocks, one or more of which two linked fingerprints share whole. For each choice of these blocks a binary trie is built with
       their bits on top; no difference is allowed there, so the trie falls into branches, and Spark deals them to tasks. The number of
       blocks follows the number of fingerprints, so that branches stay small at any size; every choice is complete.
    3. Each branch is joined with itself: pairs of nodes go down the trie together, adding up differing bits, and end beyond the budget. A branch of
       more than BRANCH fingerprints is dealt into slices that meet in pairs, each pair a task of its own.
    4. A task reports each fingerprint with the first of its set, not all links; components joins what tasks found.

    Words are runs without ASCII white space, A-Z in lower case. Null and empty texts have fingerprint zero, which links like any other; repeated rows and
    ids are rows each; rows with a null id take part, and are named by the smallest id of their component (null if there is none); an empty
    table gives an empty result; other columns are ignored.
    """
    rows = written(fingerprints(docs, id_col, text_col), "simhash-fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    count = nodes.count()
    blocks = BUDGET + 1 + (count > 1 << 25) + (count > 1 << 33)
    links = written(joined(branches(nodes, blocks, BRANCH), blocks).distinct(), "simhash-links")
    label = written(components(links), "simhash-labels").withColumnRenamed("node", "fp")
    linked = written(nodes.join(label.hint("merge"), "fp").select("fp", "label", "least"), "simhash-linked")
    names = linked.groupBy("label").agg(F.min("least").alias("name"))
    named = linked.join(names.hint("merge"), "label").select("fp", F.col("name").alias("least"))
    alone = nodes.join(label.hint("merge"), "fp", "left_anti").select("fp", "least")
    found = written(named.unionByName(alone).withColumnRenamed("least", "component_id"), "simhash-components")
    forget(nodes, links, label, linked)
    return rows.join(found.hint("merge"), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), BITS // 4, "0")

"""Sharding along a Hilbert curve through the documents' metadata."""

from __future__ import annotations

from os.path import commonprefix

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe.llm.ranks import ranked
from talkframe.llm.tables import sized, slices, written

BITS, DIMS = 4, 3


def hilbert_index(point: tuple[int, ...], bits: int = BITS) -> int:
    """Place of an integer point on the Hilbert curve of its dimensions (undo excess work from the top bit down, then Gray code)."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    place = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            place = place << 1 | (v >> b & 1)
    return place


def curve_table(bits: int = BITS) -> list[int]:
    """The curve index of every cell, at the cell's row-major number."""
    side = range(1 << bits)
    return [hilbert_index((a, b, c), bits) for a in side for b in side for c in side]


def leading_number(name: str, skip: int = 0) -> Column:
    """Seven UTF-8 bytes of a string, after the first `skip`, as a number in the same order; null comes before all."""
    head = F.substring(F.encode(F.col(name).cast("string"), "UTF-8"), skip + 1, 7)
    return F.coalesce(F.conv(F.hex(F.rpad(head, 7, F.lit(b"\x00"))), 16, 10).cast("bigint"), F.lit(-1).cast("bigint"))


def common_bytes(docs: DataFrame, names: tuple[str, ...], most: int = 1000) -> list[int]:
    """How many bytes all values of each string column begin with (up to `most` characters), from the least and the greatest."""
    text = lambda c: F.substring(F.col(c).cast("string"), 1, most)
    ends = docs.agg(*(f(text(c)) for c in names for f in (F.min, F.max))).first()
    return [len(commonprefix([(ends[2 * i] or "").encode(), (ends[2 * i + 1] or "").encode()])) for i in range(len(names))]


def metadata(docs: DataFrame, text_col: str = "text") -> list[Column]:
    """size: UTF-8 bytes and 16 for the row; text_crc32: of the UTF-8 text. A null text counts as none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [(F.octet_length(text).cast("bigint") + 16).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")]


def shard(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, str] = ("source", "lang"), carry: bool = False, most: int = 1_000_000) -> DataFrame:
    """Every row with shard (0 to n_shards - 1) and slot (gapless from 0 within its shard): id, size, text_crc32, shard, slot, curve, and,
    with `carry`, row (all columns of `docs`).

    Three dimensions - two strings and the size - are each quantised into 16 bins at their quantiles; the bins give a cell,
    the cell its place on a Hilbert curve. Rows sorted along the curve are cut into runs of equal counts (at most one
    apart), so a shard covers a compact box of metadata and readers can skip files by the ranges of any dimension.
    Of a string the seven bytes count that follow what all values begin with. Equal texts take the metadata of their smallest id, so they have one
    cell, and lie side by side in it: a group is in one shard unless a run's end cuts it or it is larger than a run.

    No task sees a whole cell: it is cut by checksum into stretches of at most about `most` rows, and a text that many rows share is cut by id
    besides. Null metadata sorts first, null text counts as empty, repeated rows take neighbouring slots, an empty table gives an empty result.
    Without `carry` only a narrow table is shuffled.
    """
    skip = common_bytes(docs, by)
    meta = docs.select(
        F.col(id_col).alias("_id"), *metadata(docs, text_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h"),
        leading_number(by[0], skip[0]).alias("_a"), leading_number(by[1], skip[1]).alias("_b"),
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []),
    )
    if not carry:
        meta = written(meta, "shard-meta")
    total = meta.count()
    light = max(1000, min(total >> 12, most))  # a text of more rows is cut by id
    alike, place = ["_h", "text_crc32", "size"], F.struct("_a", "_b")
    first = F.min(F.struct(F.col("_id").isNull().alias("no"), F.col("_id").alias("id"), place.alias("p")))["p"]
    groups = meta.groupBy(*alike).agg(F.count(F.lit(1)).alias("_n"), first.alias("_p"), F.min(place).alias("_low"), F.max(place).alias("_high"))
    groups = groups.where((F.col("_n") > light) | (F.col("_low") != F.col("_high"))).select(*alike, "_p", (F.col("_n") > light).alias("_hot"))
    meta = meta.join(sized(written(groups, "shard-groups")), alike, "left")
    meta = meta.withColumns({"_a": F.coalesce("_p._a", "_a"), "_b": F.coalesce("_p._b", "_b"), "_hot": F.coalesce("_hot", F.lit(False))}).drop("_p", "_h")
    steps = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    dims = ("_a", "_b", "size")
    cuts = meta.agg(*(F.percentile_approx(d, steps, 100_000).alias(d) for d in dims)).first()  # 3 x 15 numbers
    bin_of = lambda d: sum(((F.col(d) > F.lit(v)).cast("int") for v in cuts[d] or []), F.lit(0))
    cell = (bin_of("_a") * (1 << BITS) + bin_of("_b")) * (1 << BITS) + bin_of("size")
    stretch = (1 << 32) // max(32, total // most)
    placed = meta.withColumns({
        "curve": F.get(F.lit(curve_table()), cell),
        "_run": F.when(F.col("_hot"), F.col("text_crc32")).otherwise(F.expr(f"{1 << 32}L + text_crc32 div {stretch}L")),
        "_salt": F.when(F.col("_hot"), F.pmod(F.xxhash64("_id"), F.lit(slices(docs.sparkSession))).cast("int")).otherwise(0),
    }).drop("_a", "_b", "_hot")
    narrow = placed.select("curve", "_run", "_salt")
    rows = ranked(placed, [], ["curve", "_run", "_salt"], [F.col("text_crc32"), F.col("size"), F.col("_id")], counted=narrow)
    number = F.expr(f"rank * {n_shards} div {max(total, 1)}")
    rows = rows.withColumn("shard", number.cast("int"))
    return rows.select(
        F.col("_id").alias(id_col), "size", "text_crc32", "shard",
        (F.col("rank") - F.expr(f"(shard * {total}L + {n_shards - 1}) div {n_shards}")).alias("slot"),
        "curve", *(["row"] if carry else []),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

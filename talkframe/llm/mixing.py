"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkframe.llm.ranks import ranked
from talkframe.llm.tables import sized, written

WEIGHTS = (5, 2, 1)


def word_count(text_col: str = "text") -> Column:
    """Number of runs without white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """From (source, size) rows: source, source_size, target.

    The sources, ordered by code point with null last, take the weights in turn and share `share` times all
    sizes; what exceeds `most` times a source's size is shared again by weight among the rest. In the order of
    cap / weight the capped sources come first, so one pass over running sums finds the final level.
    The windows see one row per source, never documents.
    """
    one = F.lit(0)
    by_name = Window.partitionBy(one).orderBy(F.col("source").asc_nulls_last())
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_no", F.row_number().over(by_name))
    sources = sources.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_no") - 1) % len(weights) + 1))
    sources = sources.withColumn("_cap", F.lit(most) * F.col("source_size"))
    by_level = Window.partitionBy(one).orderBy(F.col("_cap") / F.col("_w"), "_no")
    whole = Window.partitionBy(one)
    sources = sources.withColumns({
        "_budget": F.lit(share) * F.sum("source_size").over(whole),
        "_used": F.coalesce(F.sum("_cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_left": F.sum("_w").over(by_level.rowsBetween(0, Window.unboundedFollowing)),
        "_rank": F.row_number().over(by_level),
    })
    sources = sources.withColumn("_level", (F.col("_budget") - F.col("_used")) / F.col("_left"))
    sources = sources.withColumn("_full", F.col("_cap") <= F.col("_level") * F.col("_w"))
    level = F.min(F.when(~F.col("_full"), F.struct("_rank", "_level"))).over(whole)
    return sources.withColumn("_final", level["_level"]).select(
        "source", "source_size", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_final") * F.col("_w")).alias("target")
    )


def hashed(key: Column) -> Column:
    """32 bits of the MD5 of a string."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def offset(seed: str) -> Column:
    """The random offset of a source, in [0, 1): the same at every run."""
    return hashed(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))) / F.lit(2.0**32)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix", salts: int = 64, carry: bool = False) -> DataFrame:
    """How often the mix takes every row: id, size (words), source_size, target, copies, taken, and, with
    `carry`, row (all columns of `docs`).

    Every document of a source expects target / source_size copies. Expected copies are summed up along the source, a
    random offset is added once, and a row is taken once for each integer boundary its step crosses: so copies differ from the
    expectation by less than one, and words of a source miss its target by little more than one document. The
    order within a source is by size, largest first, in blocks of nearly equal size; this keeps the miss small.

    Blocks are cut by source, size and a hash of the id modulo `salts`, so a source that holds a third of the rows spreads over many tasks, whatever
    its ids are like. Ids may be of any type that a string shows; null ids are alike. Null text has size 0, null source is a source of its own, after all others; sources without words get
    target 0; repeated rows count each; an empty table gives an empty result.
    """
    size = F.col("size")
    bits = F.length(F.bin(size))
    top = F.when(bits > 3, F.expr("bigint(shiftright(size, length(bin(size)) - 3))")).otherwise(size)
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"),
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []),
    )
    if not carry:
        rows = written(rows, "mix-sizes")
    plan = sized(written(targets(rows.select("source", "size"), weights, share, most), "mix-targets"))
    rows = rows.withColumns({"_band": (-(bits * 8 + top)).cast("int"), "_salt": (hashed(F.coalesce(F.concat(F.lit("="), F.col("_id").cast("string")), F.lit(""))) % salts).cast("int")})
    order = [F.col("size").desc(), F.col("_id").asc_nulls_first()]
    placed = ranked(rows, ["source"], ["_band", "_salt"], order, counted=rows.select("source", "_band", "_salt")).alias("d")
    joined = placed.join(plan.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    step = lambda k: F.floor(k * F.col("_rate") + F.col("_u"))
    joined = joined.select("d.*", "source_size", "target", rate.alias("_rate")).withColumn("_u", offset(seed))
    joined = joined.withColumn("copies", step(F.col("rank") + 1) - step(F.col("rank")))
    return joined.select(
        F.col("_id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * size).alias("taken"),
        *(["row"] if carry else []),
    )


def emitted(mixed: DataFrame) -> DataFrame:
    """The rows of a carried mix, one per copy that the mix takes."""
    return mixed.where("copies > 0").select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")

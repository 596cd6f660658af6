"""Ranks over a whole table without one task that sees it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, within: list[str], blocks: list[str], order: list[Column], counted: DataFrame | None = None) -> DataFrame:
    """`df` with `rank`: its place from 0 in the order of (blocks, order), within each value of `within`.

    Blocks must cut the table finely. Rows are numbered inside their block, blocks are counted with map-side combining, and
    the counts are summed up in two steps, first inside the leading block column, then over it; only the last
    step has one task per value of `within`, and it sees one row per value of the leading block column. `counted` is a
    narrow version of `df` to count from. Nulls in `within` count as one value; blocks hold none.
    """
    keys, head = [*within, *blocks], [*within, blocks[0]]
    counts = (df if counted is None else counted).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    inner = Window.partitionBy(*head).orderBy(*blocks[1:]).rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.select(*keys, F.coalesce(F.sum("_n").over(inner), F.lit(0)).alias("_in"))
    outer = (Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))).orderBy(blocks[0]).rowsBetween(Window.unboundedPreceding, -1)
    tops = counts.groupBy(*head).agg(F.sum("_n").alias("_n")).select(*head, F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_out"))
    parts, tops = parts.alias("p"), tops.alias("t")
    starts = parts.join(tops.hint("merge"), reduce(Column.__and__, (F.col(f"p.{k}").eqNullSafe(F.col(f"t.{k}")) for k in head)))
    starts = starts.select(*(F.col(f"p.{k}").alias(f"_k_{k}") for k in keys), (F.col("_in") + F.col("_out")).alias("_start"))
    placed = df.withColumn("_row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    joined = placed.join(starts.hint("merge"), reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys)))
    return joined.withColumn("rank", F.col("_row") - 1 + F.col("_start")).drop("_row", "_start", *(f"_k_{k}" for k in keys))

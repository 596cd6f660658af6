"""Running values along a session, in one window over the session or in two levels over blocks of it.

A window over a session is one task. In two levels a session is cut into blocks by its order column: each block is a window of its own and a task of its own; a
summary row for each block (its sum, maximum, last value, last row) is scanned along the session, and what the blocks before amount to is carried into each block.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from talkframe.sources.scratch import dealt

#: Values of the order column that make up a block of a long session.
BLOCK = 1 << 18


@dataclass(frozen=True)
class Along:
    """Sessions in the order of a column of whole numbers; with `block`, in two levels over blocks of so many of its values."""

    order: str = "seq"
    block: int | None = None
    key: str = "session_id"

    def start(self, rows: DataFrame) -> DataFrame:
        """`rows` ready for running values: in two levels with the number of each row's block, dealt by it."""
        if not self.block:
            return rows
        rows = rows.withColumn("_blk", F.floor(F.col(self.order) / self.block).cast("bigint"))
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(parts, self.key, "_blk").sortWithinPartitions(self.key, "_blk", self.order)

    def end(self, rows: DataFrame) -> DataFrame:
        return rows.drop("_blk")

    def _by(self) -> WindowSpec:
        return Window.partitionBy(*([self.key, "_blk"] if self.block else [self.key])).orderBy(self.order)

    def _carried(self, rows: DataFrame, summary: dict[str, Column], over: Callable[[str, WindowSpec], Column], rest: bool = False) -> DataFrame:
        """`rows` with a column for each of `summary`: what the blocks before (with `rest`: all blocks of the session) amount to. Rows are read twice, for the
        summary and for the way back, so they are written first: else each running value would double the work before it."""
        rows = dealt(rows)
        blocks = rows.groupBy(self.key, "_blk").agg(*(c.alias(name) for name, c in summary.items()))
        w = Window.partitionBy(self.key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing if rest else -1)
        blocks = blocks.select(self.key, "_blk", *(over(name, w).alias(name) for name in summary))
        return rows.join(blocks.hint("merge"), [self.key, "_blk"])

    def sums(self, rows: DataFrame, **values: Column) -> DataFrame:
        """Running sums up to and with each row (nulls count as 0)."""
        w = self._by().rowsBetween(Window.unboundedPreceding, 0)
        clean = {n: F.coalesce(v.cast("bigint"), F.lit(0).cast("bigint")) for n, v in values.items()}
        if not self.block:
            return rows.withColumns({n: F.sum(v).over(w) for n, v in clean.items()})
        rows = rows.withColumns({f"_v_{n}": v for n, v in clean.items()})
        rows = self._carried(rows, {f"_c_{n}": F.sum(f"_v_{n}") for n in values}, lambda name, along: F.sum(name).over(along))
        return rows.withColumns({n: F.sum(f"_v_{n}").over(w) + F.coalesce(f"_c_{n}", F.lit(0)) for n in values}).drop(*(f"_{k}_{n}" for n in values for k in "vc"))

    def maxima(self, rows: DataFrame, **values: Column) -> DataFrame:
        """Running maxima up to and with each row; null before the first value."""
        w = self._by().rowsBetween(Window.unboundedPreceding, 0)
        if not self.block:
            return rows.withColumns({n: F.max(v).over(w) for n, v in values.items()})
        rows = rows.withColumns({f"_v_{n}": v for n, v in values.items()})
        rows = self._carried(rows, {f"_c_{n}": F.max(f"_v_{n}") for n in values}, lambda name, along: F.max(name).over(along))
        return rows.withColumns({n: F.greatest(F.max(f"_v_{n}").over(w), F.col(f"_c_{n}")) for n in values}).drop(*(f"_{k}_{n}" for n in values for k in "vc"))

    def lasts(self, rows: DataFrame, **values: Column) -> DataFrame:
        """The last value that is not null, up to and with each row."""
        w = self._by().rowsBetween(Window.unboundedPreceding, 0)
        if not self.block:
            return rows.withColumns({n: F.last(v, True).over(w) for n, v in values.items()})
        rows = rows.withColumns({f"_v_{n}": v for n, v in values.items()})
        newest = lambda n: F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(self.order)))
        rows = self._carried(rows, {f"_c_{n}": newest(n) for n in values}, lambda name, along: F.last(name, True).over(along))
        return rows.withColumns({n: F.coalesce(F.last(f"_v_{n}", True).over(w), F.col(f"_c_{n}")) for n in values}).drop(*(f"_{k}_{n}" for n in values for k in "vc"))

    def heard(self, rows: DataFrame, highest: dict[str, Column], newest: dict[str, Column]) -> DataFrame:
        """`maxima` and `lasts` in one step, and of each last value also what it was at the row before, as `<name>_before`."""
        by = self._by()
        w, past = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
        if not self.block:
            ends = {n: F.last(v, True).over(w) for n, v in newest.items()} | {f"{n}_before": F.last(v, True).over(past) for n, v in newest.items()}
            return rows.withColumns({n: F.max(v).over(w) for n, v in highest.items()} | ends)
        rows = rows.withColumns({f"_v_{n}": v for n, v in (highest | newest).items()})
        last = lambda n: F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(self.order)))
        summary = {f"_c_{n}": F.max(f"_v_{n}") for n in highest} | {f"_c_{n}": last(n) for n in newest}
        rows = self._carried(rows, summary, lambda name, along: (F.max(name) if name[3:] in highest else F.last(name, True)).over(along))
        found = {n: F.greatest(F.max(f"_v_{n}").over(w), F.col(f"_c_{n}")) for n in highest}
        found |= {n: F.coalesce(F.last(f"_v_{n}", True).over(w), F.col(f"_c_{n}")) for n in newest} | {f"{n}_before": F.coalesce(F.last(f"_v_{n}", True).over(past), F.col(f"_c_{n}")) for n in newest}
        return rows.withColumns(found).drop(*(f"_{k}_{n}" for n in (*highest, *newest) for k in "vc"))

    def lags(self, rows: DataFrame, **values: Column) -> DataFrame:
        """The value of the row before; null at a session's first row."""
        by = self._by()
        if not self.block:
            return rows.withColumns({n: F.lag(v).over(by) for n, v in values.items()})
        rows = rows.withColumns({f"_v_{n}": v for n, v in values.items()})
        edge = lambda n: F.max_by(F.struct(F.col(f"_v_{n}").alias("v")), self.order)  # noqa: E731 (a struct, so that a null value is carried too)
        rows = self._carried(rows, {f"_c_{n}": edge(n) for n in values}, lambda name, along: F.last(name, True).over(along))
        first = F.row_number().over(by) == 1
        return rows.withColumns({n: F.when(first, F.col(f"_c_{n}.v")).otherwise(F.lag(f"_v_{n}").over(by)) for n in values}).drop(*(f"_{k}_{n}" for n in values for k in "vc"))

    def greatest(self, rows: DataFrame, **values: Column) -> DataFrame:
        """The greatest value of the whole session."""
        if not self.block:
            return rows.withColumns({n: F.max(v).over(Window.partitionBy(self.key)) for n, v in values.items()})
        rows = rows.withColumns({f"_v_{n}": v for n, v in values.items()})
        rows = self._carried(rows, {n: F.max(f"_v_{n}") for n in values}, lambda name, along: F.max(name).over(along), rest=True)
        return rows.drop(*(f"_v_{n}" for n in values))


def block_for(rows: DataFrame, order: str, key: str = "session_id", most: int = BLOCK) -> int | None:
    """None where every session of `rows` (a table that is cheap to read) spans at most `most` values of `order`, so that one window a session will do; else `most`."""
    far = rows.groupBy(key).agg((F.max(order) - F.min(order)).alias("n")).agg(F.max("n")).first()[0]
    return most if far is not None and far > most else None

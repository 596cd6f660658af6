"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe.llm.tables import forget, written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of the undirected `links` (a, b); label is the smallest node of its component.

    Alternates large-star and small-star steps until the links no longer change. Each step is a minimum per node with
    map-side combining and a join back of two written tables, so a hub's rows can be split over tasks; each round is written to the
    shared folder, and the one before deleted. Only a row count and a checksum come to the driver. An empty table gives an empty result.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "components")
    last = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "components-least")
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "components-large")
        lower = written(large.groupBy("u").agg(F.min("v").alias("m")), "components-lower")
        small = large.join(lower.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(lower.select("u", F.col("m").alias("v")))
        before, edges = edges, written(small.where("u <> v").distinct(), "components")
        forget(before, least, large, lower)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    found = edges.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
    return found.unionByName(found.select(F.col("label").alias("node"), "label").distinct())

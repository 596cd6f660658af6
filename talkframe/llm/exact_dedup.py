"""Exact de-duplication by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe.llm.tables import slices

#: The characters that equality ignores.
WHITE = " \t\n\x0b\x0c\r"


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """Which row stays for every row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters of WHITE. The longest original text (code points) stays, then
    the smallest id; a null id comes after all others, a null text is the empty text, and empty texts are one group.
    Rows that repeat id and text are both kept or both dropped. An empty table gives an empty result; other columns are ignored.

    Equal texts meet in three stages, each grouping by digest *and* whole text: within the input partition (the map side
    of the first aggregation), within one of `salts` slices of a digest, and over the slices. So a text that fills a
    third of the table reaches any one task as one row per partition, then as `salts` rows. The way back to the rows
    joins on digest and slice, which spreads the same text over `salts` keys; by default as many as shuffles have partitions.
    """
    salts = salts or slices(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = F.translate(text, WHITE, "")
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(norm, 256)).alias("digest"),
        F.xxhash64(norm).alias("second"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int").alias("salt"),
        norm.alias("content"),
        F.struct((-F.char_length(text)).alias("short"), F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id")).alias("rank"),
    )
    parts = rows.groupBy("digest", "second", "salt", "content").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("rank"))
    groups = parts.groupBy("digest", "second", "content").agg(
        F.sum("n").alias("group_size"), F.min("rank").alias("rank"), F.collect_set("salt").alias("in_salts")
    )
    found = groups.select("digest", "second", F.explode("in_salts").alias("salt"), F.col("rank.id").alias("keep_id"), "group_size")
    return (
        rows.select("id", "digest", "second", "salt")
        .join(found.hint("merge"), ["digest", "second", "salt"])
        .select(
            F.col("id").alias(id_col), "keep_id", "group_size",
            F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )

"""A corpus pipeline of five stages over `documents`: quality, near duplicates, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.llm import decontamination, language_id, mixing, near_dedup, quality, sharding
from talkframe.llm.tables import documents, sized, written

SHARDS = 40
#: Some stages cannot be said in SQL (a trained classifier, MinHash tables): tests hold the stages against brute force.
ORACLE_SQL = None


def matched(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The rows of `docs` with (left_semi) or without (left_anti) an id and a text hash (doc_id, h) in `rows`; null ids are equal to each other. Rows travel as
    one struct, so no column of theirs can clash with a key, whatever its name. The join follows the counted size."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    keys = sized(rows.select(F.struct("doc_id", "h").alias("key")))
    same = F.col("row.doc_id").eqNullSafe(F.col("key.doc_id")) & (F.xxhash64(F.col("row.text")) == F.col("key.h"))
    return packed.join(keys, same, how).select("row.*")


def without(docs: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    return matched(docs, written(rows.select("doc_id", "h").distinct(), name), "left_anti")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score 0.3 or more).

    Null and empty texts are scored as an empty passage; repeated rows are scored each, and all stay or all go; without a labelled row every
    document stays; an empty table stays empty; other columns are carried along, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, language_id.fold(5) != 0)
    return quality.score(docs, model, threshold=0.3, carry=True).where("predicted = 1").select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more; the smallest doc_id stays.

    Documents without words (null, empty) or with a null id are in no group and stay; of rows alike in id and text one stays, whose other columns are
    any of theirs; rows that share an id but not a text are judged each; an empty table stays empty; other columns are carried along, whatever their names.
    """
    found = near_dedup.near_groups(docs, width=5, percent=80, keyed=True)
    found = written(found.select("doc_id", "h", "kept", (F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).alias("grouped")), "pipeline-near")
    left = without(docs, found.where("NOT kept"), "pipeline-near-gone")
    twins = found.where("kept AND grouped").groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twins = written(twins.select("doc_id", "h"), "pipeline-near-twins")
    if twins.isEmpty():
        return left
    again = matched(left, twins, "left_semi")
    return without(left, twins, "pipeline-near-twins-gone").unionByName(again.dropDuplicates(["doc_id", "text"]))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark.

    Null and empty texts stay; a null id is an id like others; rows that repeat an id are judged by their own text; an empty table stays empty;
    other columns are carried along, whatever their names.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(docs, decontamination.contamination(docs, items, keyed=True).where("contaminated"), "pipeline-leaks")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a document comes as often as the sampling takes it.

    Texts without words (null, empty) have size 0 and take part like others; a null source is a source of its own; repeated rows are sampled each;
    an empty table stays empty; other columns are carried along, whatever their names.
    """
    return mixing.emitted(mixing.mix(docs, carry=True))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot.

    Null texts count as empty, null metadata comes first; repeated rows take slots each; an empty table stays empty; other columns are carried
    along, but for a column called shard or slot, which the stage's own replaces.
    """
    found = sharding.shard(docs, SHARDS, carry=True)
    old = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    return found.select(*(found["row"][c].alias(c) for c in old), found["shard"].alias("shard"), found["slot"].alias("slot"))


STAGES = [
    ("quality", good_quality),
    ("near_dedup", one_of_each_group),
    ("decontamination", uncontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read back by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Small helpers around tables: shared scratch tables and joins whose strategy follows a counted size."""

from __future__ import annotations

import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset and Spark runs in one process (tests), a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="talkframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: cuts the lineage, survives lost executors and gives the planner true sizes."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by `written` that no later plan reads."""
    for table in tables:
        for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
            jvm_path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(jvm_path, True)


def sized(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """`df` with a join hint by its counted rows: broadcast up to `most_rows`, else sort-merge. Count cheap (written) tables only."""
    return df.hint("broadcast" if df.limit(most_rows + 1).count() <= most_rows else "merge")


def slices(spark: SparkSession) -> int:
    """Into how many slices a hot group is cut: as many as shuffles have partitions, 16 at least."""
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def kept_in_worker(key: str, make: Callable[[], Any]) -> Any:
    """An object that a Python worker process makes once and keeps for its later tasks."""
    kept = sys.modules.setdefault("_talkframe_worker", types.ModuleType("_talkframe_worker")).__dict__
    return kept[key] if key in kept else kept.setdefault(key, make())

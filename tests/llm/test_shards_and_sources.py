"""Shards on disk can be pruned by several dimensions; mixing of very many sources."""

import collections
import random

import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from talkframe.llm import mixing, sharding


def test_written_shards_can_be_pruned(spark, tmp_path):
    random.seed(3)
    rows = [(i, f"t{i} " + "w " * random.randint(1, 400), random.choice(["de", "en", "es", "fr"]), f"s{random.randint(0, 19):02}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    placed = sharding.shard(docs, 20, carry=True).select("row.*", "size", "shard", "slot")
    sharding.write_shards(placed, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(r.doc_id for r in back.select("doc_id").collect()) == list(range(4000))
    spans = {}
    for k in range(20):
        table = ds.dataset(str(tmp_path / "shards" / f"shard={k}")).to_table().to_pandas()
        assert table["slot"].tolist() == list(range(200))
        spans[k] = {c: (table[c].min(), table[c].max()) for c in ("source", "lang", "size")}
    read = lambda **wanted: sum(all(spans[k][c][0] <= v <= spans[k][c][1] for c, v in wanted.items()) for k in spans)
    some = random.sample(rows, 200)
    share = [sum(f(r) for r in some) / 200 / 20 for f in (lambda r: read(source=r[3]), lambda r: read(lang=r[2]), lambda r: read(source=r[3], lang=r[2]), lambda r: read(source=r[3], lang=r[2], size=len(r[1]) + 16))]
    assert share[0] < 0.75 and share[1] < 0.75 and share[2] < 0.4 and share[3] < 0.3  # files that a filter has to open


def test_mixing_of_very_many_sources(spark):
    rows = [(i, "word " * (i % 7 + 1), f"https://host-{i % 1500}.example/") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(docs).collect()
    sizes, target = collections.Counter(), {}
    for r, (_, _, source) in zip(sorted(got, key=lambda r: r.doc_id), rows, strict=True):
        sizes[source] += r["size"]
        target[source] = r.target
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values())) and all(target[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    plan = mixing.targets(docs.select("source", F.lit(2).cast("bigint").alias("size"))).collect()
    assert len(plan) == 1500

"""Running values in blocks against one window a session; lines of long sessions; dyadic buckets; labels, rounding, bounds."""

import random

import pytest
from pyspark.sql import functions as F

from talkframe.functions import times, values
from talkframe.operators import exports, lines, metrics, ranking, words
from talkframe.operators.scans import Along, block_for
from talkframe.sources import adapters, scratch


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_blocks_equal_windows(spark, block):
    random.seed(block)
    rows = [(s, seq, random.choice([None, *range(5)]), random.choice([None, "x", "y"])) for s in ("a", "b", None) for seq in random.sample(range(-50, 400), 90)]
    df = spark.createDataFrame(rows, "session_id string, seq bigint, n bigint, t string").where("session_id IS NOT NULL")

    def all_of(along):
        out = along.start(df)
        out = along.sums(out, total=F.col("n"), many=(F.col("n") > 2).cast("int"))
        out = along.maxima(out, top=F.col("n"))
        out = along.lasts(out, last=F.col("t"))
        out = along.lags(out, before=F.col("t"), other=F.col("n"))
        out = along.greatest(out, whole=F.col("n"))
        return sorted(map(tuple, along.end(out).select("session_id", "seq", "total", "many", "top", "last", "before", "other", "whole").collect()), key=str)

    assert all_of(Along("seq", block)) == all_of(Along("seq"))
    assert block_for(df, "seq", most=100) == 100 and block_for(df, "seq", most=1000) is None and block_for(df.where("false"), "seq") is None


def test_a_long_session_uses_all_tasks(spark):
    n = 12_000
    ids = spark.range(n).withColumnRenamed("id", "seq")
    toks = scratch.kept(ids.select(F.lit(1).cast("bigint").alias("session_id"), "seq", F.when(F.col("seq") % 13 == 12, F.lit(".")).otherwise(F.lit(" w")).alias("text"), (F.col("seq") * 50).alias("start_cs"), (F.col("seq") * 50 + 40).alias("end_cs")))
    spans = scratch.kept(spark.range(n // 100).select(F.lit(1).cast("bigint").alias("session_id"), F.col("id").cast("int").alias("span_no"), (F.col("id") * 5000).alias("start_cs"), (F.col("id") * 5000 + 4990).alias("end_cs"), (F.col("id") % 3).cast("int").alias("speaker")))
    timeline = adapters.timeline(toks, 1_000)
    want = sorted(map(tuple, lines.speaker_lines(timeline, spans).collect()))
    found = lines.speaker_lines(timeline, spans, 2048)
    assert sorted(map(tuple, found.collect())) == want and len(want) >= n // 100 - 1
    along = Along("seq2", 2048)
    dealt = along.sums(along.start(timeline), k=F.lit(1)).withColumn("task", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert dealt.select("task").distinct().count() == 4  # as many as shuffles have partitions
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for op in (lines.segments_at_marks, lines.lines_at_pauses, words.released):
        assert sorted(map(tuple, op(timeline, 999).collect())) == sorted(map(tuple, op(timeline).collect()))
    prompt = lambda block: words.context_suffix(toks, 200, block).where("prompt").count()
    assert prompt(777) == prompt(None) == 100 and lines.merge_spans(spans, block=50).count() == lines.merge_spans(spans).count()
    assert scratch.forget_stored(spark) > 2 and scratch.forget_stored(spark) == 0


def test_labels_of_any_length(spark):
    def plain(i):
        out, i = "", i + 1
        while i:
            i, r = divmod(i - 1, 26)
            out = chr(65 + r) + out
        return out

    some = [0, 25, 26, 51, 52, 701, 702, 703, 18277, 18278, 10**6, 2**31, 2**62]
    df = spark.createDataFrame([(i,) for i in [*some, -1]], "i bigint")
    assert {r.i: r.l for r in df.select("i", values.speaker_label(F.col("i")).alias("l")).collect()} == {i: plain(i) for i in some} | {-1: None}
    rows = [("s", 1, "bob"), ("s", 2, "3"), ("s", 3, "ann"), ("s", 4, "bob"), ("s", 5, None), ("s", 6, "703"), ("s", 7, "0"), ("s", 8, None), ("t", 1, "ann")]
    found = ranking.session_labels(spark.createDataFrame(rows, "session_id string, seq int, name string"), "name", "seq")
    assert [(r.session_id, r.label) for r in found.orderBy("session_id", "seq").collect()] == [("s", x) for x in ("A", "C", "B", "A", "C", "AAA", "D", "C")] + [("t", "A")]


def test_rounding_is_pythons(spark):
    random.seed(5)
    some = [2.675, 0.125, 0.375, 1.005, 2.5, 3.5, -2.675, -0.125, 1e15 + 0.5, 123456.785, 0.0, 5e-324, 1e300, 0.285, 1.115] + [random.uniform(-1000, 1000) for _ in range(400)] + [random.randrange(10**6) / 1000 + 0.0005 for _ in range(400)]
    df = spark.createDataFrame([(x,) for x in some], "x double")
    rows = df.select("x", *(times.round_binary(F.col("x"), n).alias(f"r{n}") for n in range(5))).collect()
    assert all(r[n + 1] == round(r.x, n) for r in rows for n in range(5))
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "x double").select(times.round_binary(F.col("x"), 2).alias("r")).collect()
    assert [str(r.r) for r in odd] == ["nan", "inf", "None"]


def test_times_of_too_many_parts(spark):
    df = spark.createDataFrame([(t,) for t in ("1:2:3:4", "1:02:03.5", "2:03", "7", "x:1", "", None)], "t string")
    assert [r.s for r in df.select(times.parse_time(F.col("t")).alias("s")).collect()] == [None, 3723.5, 123.0, 7.0, None, None, None]


def test_distances_without_python(spark):
    random.seed(6)
    pairs = [(i, random.choices("a b c d é 日本 x1".split(), k=random.randint(0, 9)), random.choices("a b c d é 日本 x1".split(), k=random.randint(0, 9))) for i in range(80)]
    pairs.append((99, [f"w{i}" for i in range(60_000)], [f"w{i}" for i in range(60_000, 60_003)]))  # words beyond the surrogates
    df = spark.createDataFrame(pairs, "id int, ref array<string>, hyp array<string>")
    got = {r.id: r.distance for r in metrics.edit_distances(df).collect()}
    want = {r.id: r.s + r.i + r.d for r in metrics.wer_rows(df.where("id < 99")).collect()}
    assert got == want | {99: 60_000} and "Python" not in metrics.edit_distances(df)._jdf.queryExecution().executedPlan().toString()


def test_bounds_fall_back_to_segments(spark):
    word = "array<struct<start_s:double,end_s:double>>"
    rows = [("a", 1, 0.0, 5.0, []), ("a", 2, 5.0, 9.0, [(5.5, 6.0), (6.0, 7.0)]), ("a", 3, 9.0, 12.0, []), ("b", 1, 1.0, 2.0, []), ("b", 2, 3.0, 4.0, [])]
    got = ranking.bounds(spark.createDataFrame(rows, f"session_id string, seq int, start_s double, end_s double, words {word}"))
    assert sorted(map(tuple, got.collect())) == [("a", 5.5, 7.0, 2), ("b", 1.0, 4.0, 0)]


def test_writers_by_name(spark):
    df = spark.createDataFrame([("s", 1, "line", 1, 0, 100, " Hi there"), ("s", 2, "silence", -2, 100, 300, None), ("s", 3, "line", 2, 300, 400, " you\tall")], "session_id string, line_no int, kind string, speaker int, start_cs bigint, end_cs bigint, text string")
    found = {r.form: r.content for r in exports.writer("all")(df).collect()}
    assert set(found) == set(exports.WRITERS) and found["tsv"] == "start\tend\ttext\n0\t1000\tHi there\n3000\t4000\tyou all\n" and found["text"] == "Hi there  you\tall"
    assert '"words":[{"word":"Hi","start":0.0,"end":0.5},{"word":"there","start":0.5,"end":1.0}' in found["words_json"]
    with pytest.raises(ValueError):
        exports.writer("docx")


def test_lines_in_blocks_write_rows_thrice(spark, sf, monkeypatch):
    """Each step along blocks writes the rows, so there are few of them."""
    from talkframe.operators import scans
    from talkframe.plans import speech

    written = []
    dealt = scans.dealt
    monkeypatch.setattr(scans, "dealt", lambda df: written.append(dealt(df)) or written[-1])
    toks = speech._tokens(spark, sf)
    got = speech._lines_of(toks, 128)
    assert len(written) == 3
    assert sorted(map(str, got.collect())) == sorted(map(str, speech._lines_of(toks).collect()))


def test_heard_is_maxima_and_lasts(spark):
    from pyspark.sql import functions as F

    from talkframe.operators.scans import Along

    rows = spark.createDataFrame([("a", i, (i * 7) % 5 if i % 3 else None, i % 4 == 2 or None) for i in range(40)] + [("b", 3, None, None)], "session_id string, seq int, v int, late boolean")
    told = lambda block: sorted(map(str, (along := Along("seq", block)).end(along.heard(along.start(rows), {"m": F.col("late")}, {"h": F.col("v")})).collect()))
    assert told(None) == told(4) == told(1)
    along = Along("seq")
    want = along.lags(along.lasts(along.maxima(rows, m=F.col("late")), h=F.col("v")), h_before=F.col("h"))
    assert sorted(map(str, want.collect())) == told(None)

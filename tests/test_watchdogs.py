"""Operators with event-time state: batch against stream, replays, and cases of the trimmed buffer one by one."""

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from talkframe.streaming import watchdogs

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def stream_of(spark, folder, parts, schema, watermark=None):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return rows.withWatermark("event_ts", watermark) if watermark else rows


def run(df, folder):
    query = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    query.awaitTermination(300)
    return query


PROBES = "session_id string, event_ts timestamp, audio_s double, updated boolean"


def test_one_stalled_and_one_silent_session():
    dog = watchdogs.Dog(10_000_000, 20.0, None)
    told = [e for t in range(60) for e in dog.probe(t * 1_000_000, float(t), t in (3, 5, 30))]
    assert told == [("stalled", 15_000_000), ("stalled", 40_000_000)]
    dog = watchdogs.Dog(10_000_000, 20.0, None)
    assert [e for t in range(60) for e in dog.probe(t * 1_000_000, float(t), False)] == [("stalled", 10_000_000), ("silent", 20_000_000)]
    dog = watchdogs.Dog(10_000_000, 20.0, None)  # no audio, no stall
    assert [e for t in range(60) for e in dog.probe(t * 1_000_000, 0.0, False)] == []
    dog = watchdogs.Dog(10_000_000, 20.0, None)  # an update at the limit itself is in time
    assert [e for t in range(11) for e in dog.probe(t * 1_000_000, float(t), t in (0, 10))] == [] and dog.elapsed(19_999_999) == []


def test_alarms_batch_equals_stream(spark, tmp_path):
    random.seed(1)
    rows = []
    for s in range(6):
        t = random.random() * 5
        for _ in range(60):
            t += random.choice([0.5, 1.0, 3.0, 12.0] if s != 3 else [1.0])
            rows.append((f"s{s}", at(t), round(t, 3), s not in (3, 4) and random.random() < 0.2))
    rows.append(("end", at(3000), 0.0, True))  # moves the watermark on
    rows.sort(key=lambda r: r[1])
    for i in range(0, len(rows) - 9, 7):  # out of order within the watermark's delay
        rows[i], rows[i + 3] = rows[i + 3], rows[i]
    df = spark.createDataFrame(rows, PROBES)
    want = collections.Counter(map(tuple, watchdogs.alarms(df, 10.0, 20.0, delay_s=60.0).collect()))
    parts = [rows[k : k + 30] for k in range(0, len(rows), 30)]
    out = watchdogs.alarms(stream_of(spark, str(tmp_path), parts, PROBES, "60 seconds"), 10.0, 20.0)
    query = run(out, str(tmp_path))
    assert collections.Counter(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == want
    assert {k for _, k, _ in want} == {"stalled", "silent"} and sum(k == "silent" for _, k, _ in want) >= 2
    assert query.exception() is None and watchdogs.alarms(df.where("false")).collect() == []


def test_retention_on_a_stream_keeps_its_state_flat(spark, tmp_path):
    random.seed(2)
    schema, rows, ends = "session_id string, seq bigint, end_cs bigint", [], collections.Counter()
    for i in range(600):
        s = f"s{i % 3}"
        ends[s] += random.randint(1, 60)
        rows.append((s, i, ends[s] - random.choice([0, 0, 0, 40])))
    parts = [rows[k : k + 60] for k in range(0, 600, 60)]
    query = run(watchdogs.dropped(stream_of(spark, str(tmp_path), parts, schema), 500), str(tmp_path))
    gone = collections.Counter(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    df = spark.createDataFrame(rows, schema)
    assert gone == collections.Counter(map(tuple, watchdogs.dropped(df, 500).collect())) and len(gone) > 400
    from talkframe.streaming.windows import retained

    assert sorted((r.session_id, r.seq) for r in retained(df, 500, "end_cs").collect()) == sorted(set((r[0], r[1]) for r in rows) - set(gone))
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(sizes[5:]) <= max(sizes[:5]) * 1.5


def test_silences_with_words_as_two_streams(spark, tmp_path):
    random.seed(3)
    words = [("s%d" % random.randint(0, 2), at(random.random() * 100), f"w{i}") for i in range(200)]
    marks = [("s%d" % random.randint(0, 3), at(k * 9.7)) for k in range(11)]
    w_schema, m_schema = "session_id string, event_ts timestamp, text string", "session_id string, event_ts timestamp"
    want = collections.Counter(map(tuple, watchdogs.flushed_words(spark.createDataFrame(words, w_schema), spark.createDataFrame(marks, m_schema)).collect()))
    inner = [(s, m, t, x) for s, m in marks for v, t, x in words if v == s and dt.timedelta(0) < m - t <= dt.timedelta(seconds=5)]
    assert want == collections.Counter(inner + [(s, m, None, None) for s, m in marks if not any(i[:2] == (s, m) for i in inner)])
    last = [("end", at(1000), "z")], [("end", at(1000))]
    words.sort(key=lambda r: r[1] + dt.timedelta(seconds=random.random() * 8))  # late rows on both sides
    marks.sort(key=lambda r: r[1] + dt.timedelta(seconds=random.random() * 8))
    w = stream_of(spark, f"{tmp_path}/w", [words[:80], words[80:150], words[150:], last[0], [("end", at(1001), "z")]], w_schema, "30 seconds")
    m = stream_of(spark, f"{tmp_path}/m", [marks[:4], marks[4:8], marks[8:], last[1], [("end", at(1001))]], m_schema, "30 seconds")
    run(watchdogs.flushed_words(w, m), str(tmp_path))
    got = collections.Counter(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.session_id != "end")
    assert got == want


def test_boundaries_in_are_those_kept_repeated_and_late(spark, tmp_path):
    schema = "session_id string, seq int, kind string, count bigint, start_s double, end_s double, event_ts timestamp"
    rows = [("a", 1, "final", 5, 0.0, 0.0, at(1)), ("a", 2, "boundary", 5, 1.0, 1.5, at(2)), ("a", 3, "boundary", 9, 1.0004, 1.5, at(2)), ("a", 4, "boundary", 4, 0.5, 0.6, at(3)), ("a", 5, "final", 8, 0.0, 0.0, at(4)), ("a", 6, "boundary", 7, 3.0, 3.1, at(5)), ("b", 1, "boundary", 0, 1.0, 1.5, at(5))]
    df = spark.createDataFrame(rows, schema)
    fates = watchdogs.boundary_fates(df)
    assert {(r.session_id, r.seq): r.fate for r in fates.collect()} == {("a", 2): "kept", ("a", 3): "repeated", ("a", 4): "late", ("a", 6): "late", ("b", 1): "kept"}
    folder = f"{tmp_path}/fates"
    for number in (0, 1, 1):  # the second batch is replayed
        watchdogs.dealt(fates.where(F.col("seq") % 2 == number), number, "fate", folder)
    tables = {f: spark.read.parquet(f"{folder}/fate={f}").count() for f in ("kept", "repeated", "late")}
    assert tables == {"kept": 2, "repeated": 1, "late": 2} and sum(tables.values()) == df.where("kind = 'boundary'").count()
    only = watchdogs.distinct_boundaries(stream_of(spark, f"{tmp_path}/d", [rows[:3], rows[3:]], schema, "10 seconds").where("kind = 'boundary'"))
    run(only, f"{tmp_path}/d")
    assert spark.read.parquet(f"{tmp_path}/d/out").count() == watchdogs.distinct_boundaries(df.where("kind = 'boundary'")).count() == 4


def test_a_dealing_sink_survives_a_replay(spark, tmp_path):
    schema = "id int, error_code string"
    parts = [[(i, None if i % 3 else "shape") for i in range(k, k + 10)] for k in (0, 10, 20)]
    rows = stream_of(spark, str(tmp_path), parts, schema).withColumn("fate", F.when(F.col("error_code").isNull(), "good").otherwise("quarantined"))
    for checkpoint in ("ck1", "ck2"):  # a lost checkpoint sends every batch again under its number
        watchdogs.dealing_sink(rows, "fate", f"{tmp_path}/tables", f"{tmp_path}/{checkpoint}").awaitTermination(300)
    counts = [spark.read.parquet(f"{tmp_path}/tables/fate={f}").count() for f in ("good", "quarantined")]
    assert counts == [20, 10]


def words_of(n, begin=0):
    return [[f"w{i}", i * 1.0, i * 1.0 + 0.9, 0.5] for i in range(begin, n)]


def feed(buffer, *rows):
    state, out = {}, []
    for row in rows:
        out.append([(e["kind"], e["at_s"]) for e in buffer(state, {"ends": [], "sentence_ends": [], **row})])
    return out, state


def test_trimmed_buffer_cases():
    cut = lambda rows: [e for row in rows for e in row if e[0] != "word"]
    seg = watchdogs.TrimmedBuffer(5.0, "segment")
    two = lambda n, **more: [{"audio_s": 3.0, "words": words_of(n)}, {"audio_s": float(n), "words": words_of(n), **more}]
    assert cut(feed(seg, *two(4, ends=[2.0, 4.0]))[0]) == []  # within the limit
    assert cut(feed(seg, *two(8, ends=[2.9, 4.9, 8.0]))[0][-1:]) == [("cut", 4.9)]  # the newest end, not the last
    # a new speaker has nothing committed yet: half the buffer
    new = [*two(4), {"kind": "change_speaker", "offset_s": 3.0}, {"audio_s": 8.5, "words": words_of(8, 3), "ends": [5.9, 8.5]}]
    assert cut(feed(seg, *new)[0]) == [("cut", 5.75)]
    assert cut(feed(seg, *two(8, ends=[8.0]))[0][-1:]) == [("cut", 7.9)]  # no such end: the last committed word
    assert cut(feed(seg, {"audio_s": 4.0, "words": words_of(4)}, {"audio_s": 9.0, "words": words_of(4) + [["x", 8.0, 8.9, 0.1]], "ends": [6.0, 9.0]})[0]) == [("cut", 3.9)]  # an end behind the committed words does not count
    sen = watchdogs.TrimmedBuffer(5.0, "sentence")
    assert cut(feed(sen, *two(8, sentence_ends=[1.9, 3.9, 5.9]))[0]) == [("cut", 3.9)]
    assert cut(feed(sen, *two(8, sentence_ends=[3.9]))[0]) == [("cut", 7.9)]
    assert cut(feed(sen, *two(4, sentence_ends=[0.9, 1.9]))[0]) == []
    # without output for longer than the limit the buffer is emptied
    silent, state = feed(watchdogs.TrimmedBuffer(5.0, "sentence"), {"audio_s": 3.0, "words": []}, {"audio_s": 6.0, "words": []}, {"audio_s": 9.0, "words": []})
    assert silent == [[], [("reset", 6.0)], []] and state["begin"] == 6.0
    # what was cut away is not heard again, and state holds no more than it needs
    out, state = feed(seg, *[{"audio_s": n + 1.0, "words": words_of(n + 1), "ends": [float(k) + 0.9 for k in range(n + 1)]} for n in range(40)])
    assert [e for row in out for e in row if e[0] == "word"] == [("word", k + 0.9) for k in range(39)] and len(state["committed"]) <= 3 and state["begin"] > 30


@pytest.mark.parametrize("length", [1, 1000, 2**40])
def test_spans_of_any_length_cost_few_rows(spark, length):
    from talkframe.operators import joins

    spans = spark.createDataFrame([("s", 0, 5, 5 + length), ("s", 1, 7, 8), ("s", 2, 2**39, 2**41)], "session_id string, span_no int, start_cs bigint, end_cs bigint")
    points = spark.createDataFrame([("s", i, t, t + 1) for i, t in enumerate((0, 6, 900, 2**20, 2**40 - 1, 2**40 + 9, 2**41))], "session_id string, seq int, start_cs bigint, end_cs bigint")
    met = joins.overlapping(points, spans, "session_id", "start_cs", "end_cs", 10)
    want = sorted((p.seq, s.span_no) for p in points.collect() for s in spans.collect() if s.end_cs > p.start_cs and s.start_cs < p.end_cs)
    assert sorted((r.seq, r.r_span_no) for r in met.collect()) == want
    swapped = joins.overlapping(spans, points, "session_id", "start_cs", "end_cs", 10)
    assert sorted((r.r_seq, r.span_no) for r in swapped.collect()) == want

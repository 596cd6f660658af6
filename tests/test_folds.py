"""Folds: literal cases, and batch against stream."""

import datetime as dt
import random

import pytest

from talkframe.operators import words
from talkframe.operators.ranking import snapshot_deltas
from talkframe.streaming import folds
from talkframe.streaming.events import EventStream


def test_stable_words():
    state = {"end": 10.30, "recent": []}
    got = folds.stable_words(state, {"words": [["stale", 9.5, 9.6], ["again", 10.35, 10.45], ["stale2", 10.25, 10.35], ["now", 10.5, 10.6]]})
    assert [w["text"] for w in got] == ["again", "now"] and state["end"] == 10.6
    assert folds.stable_words({"end": 191.2, "recent": ["x"]}, {"words": [["a", 187.0, 187.1]]})[0]["kind"] == "reset"


def test_local_agreement():
    state = {}
    hyp = lambda *ws: {"kind": "hypothesis", "words": [[w, i * 0.5, i * 0.5 + 0.4, 0.5] for i, w in enumerate(ws)]}
    assert folds.local_agreement(state, hyp("a", "b", "c")) == []
    assert [w["text"] for w in folds.local_agreement(state, hyp("a", "b", "x"))] == ["a", "b"]
    assert [w["text"] for w in folds.local_agreement(state, {"kind": "eof"})] == ["x"]


def test_endpoint_and_finals():
    run = EventStream(0.3, None, interims=False)
    state, out = {}, []
    snap = lambda *ws: {"kind": "snapshot", "words": [list(w) for w in ws]}
    clock = lambda kind, t: {"kind": kind, "ts_s": t}
    rows = [snap(("hello", 0.1, 0.5)), snap(("hello", 0.1, 0.5), ("world", 0.6, 0.9)), clock("silence_started", 0.9), clock("silence_transcription_ready", 0.9), clock("audio_advanced", 1.199)]
    for r in rows:
        out += run(state, r)
    assert [(e["text"], e["speech_final"]) for e in out] == [("hello", False)]
    assert [(e["text"], e["speech_final"]) for e in run(state, clock("audio_advanced", 1.2))] == [("world", True)]


def test_finals_are_never_taken_back():
    run, state, out = EventStream(None, None, interims=False), {}, []
    for ws in ([("hello", 0, 1), ("world", 1, 2)], [("hello", 0, 1), ("there", 1, 2)]):
        out += run(state, {"kind": "snapshot", "words": [list(w) for w in ws]})
    out += run(state, {"kind": "finish", "ts_s": 3.0})
    assert [e["text"] for e in out] == ["hello", "there"]


def test_utterance_end_once():
    run, state, out = EventStream(None, 1.0, interims=False), {}, []
    out += run(state, {"kind": "snapshot", "words": [["hello", 0.1, 0.5]]})
    out += run(state, {"kind": "snapshot", "words": [["hello", 0.1, 0.5], ["later", 2.0, 2.5]]})
    for t in (1.499, 1.5, 2.5):
        out += run(state, {"kind": "audio_advanced", "ts_s": t})
    assert [e["at_s"] for e in out if e["kind"] == "utterance_end"] == [0.5]


def test_deltas_rebuild_edited_snapshots():
    random.seed(2)
    for _ in range(300):
        lines, forward, back = [], {}, {}
        for rev in range(8):
            lines = lines[random.randint(0, 1) :] + [random.choice("abc") for _ in range(random.randint(0, 2))]
            if lines and random.random() < 0.4:
                lines[random.randrange(len(lines))] = random.choice("abcd")
            message = folds.to_delta(forward, {"rev": rev, "lines": list(lines)})[0]
            assert folds.from_delta(back, message)[0]["lines"] == lines


def test_deltas_of_a_table_and_of_a_fold(spark):
    random.seed(3)
    rows = []
    for s in range(5):
        lines = []
        for rev in range(1, 9):
            lines = lines[random.randint(0, 2) :] + [random.choice("abc") for _ in range(random.randint(0, 2))]
            if lines and random.random() < 0.5:
                lines[random.randrange(len(lines))] = random.choice("abcd")
            rows.append((f"s{s}", rev, list(lines), "active", f"b{rev}", rev / 10, None if rev % 3 else "gone"))
    df = spark.createDataFrame(rows, "session_id string, rev int, lines array<string>, status string, buffer_transcription string, lag_total double, error string")
    out = "rev int, seq int, type string, lines_pruned int, n_lines int, new_lines array<string>, status string, buffer_transcription string, lag_total double, error string"
    fold = folds.run_batch(df, folds.to_delta, out, ["rev"]).drop("out_no")
    table = snapshot_deltas(df)
    assert sorted(map(str, table.select(fold.columns).collect())) == sorted(map(str, fold.collect())) and table.where("type = 'diff' AND error = 'gone'").count() > 5


def test_coalescing():
    state, out = {}, []
    for s in (0.4, 0.4, 0.4):
        out += folds.coalesce_chunks(state, {"seconds": s, "kind": "audio"}, 1.0)
    out += folds.coalesce_chunks(state, {"seconds": 0.3, "kind": "audio"}, 1.0)
    out += folds.coalesce_chunks(state, {"seconds": 0.0, "kind": "silence"}, 1.0)
    assert [(e["seconds"], e["n"]) for e in out] == [(1.2, 3), (0.3, 1)]


def test_batch_equals_stream(spark, tmp_path):
    rows = [(f"s{i % 3}", i, " ".join(f"w{j}" for j in range(i // 3 + 1))) for i in range(30)]
    schema = "session_id string, rev int, text string"
    df = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, folds.run_batch(df, folds.hold_back_last, "ix int, text string", ["rev"]).collect()))
    assert sorted((r.session_id, r.ix, r.text) for r in words.held_back(df).collect()) == sorted((s, ix, t) for s, _, ix, t in want)
    for part in range(5):
        spark.createDataFrame(rows[part * 6 : part * 6 + 6], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    out = folds.run_stream(stream, folds.hold_back_last, "ix int, text string", ["rev"])
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("session_id", "out_no", "ix", "text").collect())) == want


def streamed(spark, folder, df, step, out, order, **more):
    """Runs a fold over the rows of `df`, two files a micro-batch in the order of `order`, as a stream."""
    rows = df.orderBy(*order).collect()
    size = max(1, -(-len(rows) // 6))
    for at in range(0, len(rows), size):
        spark.createDataFrame(rows[at : at + size], df.schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    stream = stream.withWatermark("event_ts", "0 seconds") if "event_ts" in df.columns else stream
    found = folds.run_stream(stream, step, out, order, **more)
    query = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    query.awaitTermination(300)
    return spark.read.parquet(f"{folder}/out")


WORDS = "array<struct<text:string,start_s:double,end_s:double,prob:double>>"


def hypotheses(spark):
    random.seed(3)
    rows = []
    for s in range(4):
        words = [random.choice("ka lo mi nu te re so".split()) for _ in range(24)]
        for rev in range(1, 8):
            shown = words[: rev * 4]
            shown = [*shown[:-1], shown[-1] + "~"] if rev < 6 else shown
            rows.append((f"s{s}", rev, [(w, i * 0.5, i * 0.5 + 0.4, 0.5) for i, w in enumerate(shown)]))
    return spark.createDataFrame(rows, f"session_id string, rev int, words {WORDS}")


def lists(step, n=4):
    return lambda state, row: step(state, row | {"words": [list(w.values())[:n] for w in row["words"]]})


@pytest.mark.parametrize("case", ["agreement", "stable", "coalesced", "delta", "events"])
def test_streams_equal_batches(spark, tmp_path, case):
    """The same rows, in one table and in micro-batches, give the same output."""
    hyps = hypotheses(spark)
    word = "text string, start_s double, end_s double"
    if case == "agreement":
        args = (hyps, lists(folds.local_agreement), word, ["rev"])
    elif case == "stable":
        args = (hyps, lists(folds.stable_words, 3), "kind string, " + word, ["rev"])
    elif case == "coalesced":
        rows = [(f"s{i % 3}", i, random.Random(i).random(), "silence" if i % 11 == 0 else "audio") for i in range(60)]
        args = (spark.createDataFrame(rows, "session_id string, rev int, seconds double, kind string"), folds.coalesce_chunks, "seconds double, n int", ["rev"])
    elif case == "delta":
        rows = [(f"s{i % 3}", i, [f"{k}" for k in range(i // 9, i // 3 + 1)] + ([f"edited {i}"] if i % 4 else [])) for i in range(40)]
        args = (spark.createDataFrame(rows, "session_id string, rev int, lines array<string>"), folds.to_delta, "rev int, seq int, type string, lines_pruned int, n_lines int, new_lines array<string>", ["rev"])
    else:
        rows = [(r.session_id, r.rev * 3 + k, kind, r.rev * 2.0 + t, [w.asDict() for w in r.words] if kind == "snapshot" else []) for r in hyps.collect() for k, (kind, t) in enumerate((("snapshot", 0), ("audio_advanced", 0.1), ("finish" if r.rev == 7 else "audio_advanced", 0.2)))]
        args = (spark.createDataFrame(rows, f"session_id string, seq int, kind string, ts_s double, words {WORDS}"), lists(EventStream(), 3), "kind string, text string, at_s double, speech_final boolean", ["seq"])
    want = sorted(map(str, folds.run_batch(*args).collect()))
    assert len(want) > 8 and sorted(map(str, streamed(spark, str(tmp_path), *args).collect())) == want


def test_idle_sessions_end(spark, tmp_path):
    """A session that falls silent without an end gets one by event time, and its state goes: a later row begins anew."""
    at = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)
    rows = [("a", "one two three", 0), ("b", "x y", 1), ("b", "x y z", 40), ("b", "x y z w", 80), ("b", "x y z w", 100), ("b", "x y z w", 101), ("a", "new day", 120), ("b", "x y z w v", 160), ("b", "x y z w v u", 200), ("b", "x y z w v u", 201)]
    rows = [(s, i, text, at(t)) for i, (s, text, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "session_id string, rev int, text string, event_ts timestamp")
    out = streamed(spark, str(tmp_path), df, folds.hold_back_last, "ix int, text string", ["rev"], idle_s=60)
    got = {s: [(r.out_no, r.text.strip()) for r in sorted(out.where(f"session_id = '{s}'").collect(), key=lambda r: r.out_no)] for s in "ab"}
    assert sorted(got["a"]) == sorted([(1, "one"), (2, "two"), (3, "three"), (1, "new"), (2, "day")])
    assert [t for _, t in got["b"]] == ["x", "y", "z", "w", "v"]

"""Files as sources, SQL functions, sinks."""

import json
import struct
import wave

from talkframe.functions import registered
from talkframe.sources import files


def test_pcm_and_wav(spark, tmp_path):
    samples = [i % 100 * 300 - 15000 for i in range(20000)]
    data = struct.pack(f"<{len(samples)}h", *samples)
    (tmp_path / "a.pcm").write_bytes(data + b"\0")
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000), w.writeframes(data)
    for found in (files.read_pcm(spark, str(tmp_path / "a.pcm")), files.read_wav(spark, str(tmp_path / "a.wav"))):
        rows = found.orderBy("chunk_ix").collect()
        assert [r.n_samples for r in rows] == [16000, 4000] and abs(rows[0].pcm[0] - samples[0] / 32768) < 1e-6


def test_manifest_and_results(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"name": "a", "language": "en", "category": "clean"}, {"name": "b", "language": "fr", "category": "clean"}]))
    assert [r.name for r in files.read_manifest(spark, str(tmp_path / "m.json"), languages=["fr"]).collect()] == ["b"]
    (tmp_path / "r.json").write_text(json.dumps({"results": [{"wer": 1.5}, {"wer": 2.5}]}))
    assert sorted(r.wer for r in files.read_bench_results(spark, str(tmp_path / "r.json")).collect()) == [1.5, 2.5]


def test_scoring(spark):
    df = spark.range(10)
    out = files.score_partitions(df, lambda: lambda pdf: pdf.assign(id=pdf["id"] * 2), "id bigint")
    assert sorted(r.id for r in out.collect()) == [2 * i for i in range(10)]


def test_words_of(spark):
    registered.register(spark)
    got = spark.sql("SELECT * FROM words_of('one two  three', 0D, 3D)").collect()
    assert [(r.word, r.start_s, r.end_s) for r in got] == [("one", 0.0, 1.0), (" two", 1.0, 2.0), ("  three", 2.0, 3.0)]


def test_tagged_tokens(spark):
    df = spark.createDataFrame([("<|en|><|NEUTRAL|> Hello, World!", ["Hello", "World"]), ("plain", ["gone"]), ("a b c", ["a", "c"]), ("¿Qué\u00a0- “tal”?", ["Qué", "tal"])], "text string, words array<string>")
    rows = registered.tagged_tokens(df).collect()
    assert (rows[0].lang, rows[0].tokens, rows[0].error_code) == ("en", ["Hello,", " World!"], None)
    assert [r.error_code for r in rows] == [None, "projection", "projection", None]  # text that no word stands for is an error
    assert rows[3].tokens == ["¿Qué\u00a0- “", "tal”?"]
    assert registered.project_words(["ab", "c"], "abc") == ["ab", "c"] and registered.project_words([], "!?") == []


def test_writers():
    from talkframe.operators import exports

    assert exports.writer("srt") is exports.WRITERS["srt"]
    try:
        exports.writer("doc")
    except ValueError as e:
        assert "doc" in str(e)
    else:
        raise AssertionError


def test_options():
    import pytest

    from talkframe.operators.options import Options, stream_options

    assert stream_options({}) == Options(None, False, False, 10, None) and stream_options({"endpointing": "false"}).endpointing_ms is None
    got = stream_options({"language": "de", "interim_results": " TRUE", "utterance_end_ms": "1000", "endpointing": "300", "encoding": "linear16", "sample_rate": "16000", "channels": "1"})
    assert (got.language, got.interim_results, got.endpointing_ms, got.utterance_end_ms, got.pcm_input) == ("de", True, 300, 1000, True)
    for bad in (
        {"interim_results": "yes"}, {"endpointing": "0"}, {"endpointing": "1.5"}, {"endpointing": "١"}, {"utterance_end_ms": "999", "interim_results": "true"}, {"utterance_end_ms": "5001", "interim_results": "true"},
        {"utterance_end_ms": "2000"}, {"encoding": "opus"}, {"encoding": "linear16"}, {"sample_rate": "8000"}, {"channels": "2"}, {"channels": "x"},
    ):
        with pytest.raises(ValueError):
            stream_options(bad)
    for bad in ({}, {"vad_events": "true", "endpointing": "false"}):
        with pytest.raises(ValueError):
            stream_options(bad, vad=False)

"""Sessions with few spans: tokens meet their session's spans in one row, with the results of the join by time."""

import random

from pyspark.sql import functions as F

from talkframe.operators import joins, lines, words
from talkframe.plans import QUERIES, speech
from talkframe.sources import adapters
from talkframe.sources.scratch import kept


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def made(spark, seed=3):
    r = random.Random(seed)
    rows, spans = [], []
    for s in range(6):
        t = 0
        for seq in range(1, 60):
            start = t + r.choice([0, 0, 3, 700])
            if start - t > 500:
                rows.append((s, 2 * seq - 1, "silence", None, t, start))
            t = start + r.choice([0, 10, 40, 9000])
            rows.append((s, 2 * seq, "token", r.choice([" a", ".", " b", "!"]), start, t))
        for n in range(r.choice([0, 3, 12])):
            a = r.randrange(t)
            spans.append((s, n, a, a + r.choice([-20, 0, 50, 4000, 60000]), r.randrange(3)))
    timeline = spark.createDataFrame(rows, "session_id long, seq2 long, kind string, text string, start_cs long, end_cs long")
    return timeline, spark.createDataFrame(spans, "session_id long, span_no int, start_cs long, end_cs long, speaker int")


def test_lines_of_sessions_with_few_spans(spark):
    """The same lines; which tokens have an owner and which do not, ties and items of no length among them."""
    timeline, spans = made(spark)
    want = sorted(map(str, lines.speaker_lines(timeline, spans).collect()))
    assert sorted(map(str, lines.speaker_lines(timeline, spans, few=True).collect())) == want


def test_lines_deal_no_token_by_time(spark, sf):
    """The step that these queries share has no explode over buckets of time, unless a session has many spans."""
    toks = speech._tokens(spark, sf)
    assert "explode" not in plan(speech._lines_of(toks))
    spans = kept(adapters.speaker_spans(toks))
    assert joins.few(spans, "session_id") and not joins.few(spans, "session_id", 1)


def test_first_container(spark, sf, monkeypatch):
    """the first line that holds a token, with and without the join by time."""
    timeline, spans = made(spark, 5)
    toks = timeline.where("kind = 'token'").withColumnRenamed("seq2", "seq")
    found = spans.withColumnRenamed("span_no", "line_no")
    near = joins.first_container(toks, found, "line_no")
    assert "explode" not in plan(near)
    monkeypatch.setattr(joins, "few", lambda *_: False)
    far = joins.first_container(toks, found, "line_no")
    key = ["session_id", "seq", "line_no"]
    assert "explode" in plan(far) and sorted(near.select(key).collect()) == sorted(far.select(key).collect()) != []


def test_sentences_carry_their_words(spark, sf):
    """words keep their columns through the one window; they are not joined again, and their tokens are computed once."""
    rows = [(1, k, t, k * 7) for k, t in enumerate([" a", ".", " bc", " d", "!", " e"], 1)]
    toks = spark.createDataFrame(rows, "session_id long, seq long, text string, x int")
    sents = spark.createDataFrame([(1, 1, " a."), (1, 2, " bc d!"), (1, 3, " e")], "session_id long, sent_no long, text string")
    found = words.words_to_sentences(toks, sents)
    assert "Join" not in plan(found)
    assert [(r.seq, r.text, r.x, r.sent_no) for r in found.orderBy("seq").collect()] == [(k, t, x, n) for (_, k, t, x), n in zip(rows, [1, 1, 2, 2, 2, 3], strict=True)]
    out = QUERIES["sentence_words"](spark, sf)
    assert "Generate" not in plan(out) and out.agg(F.count_if(F.col("sent_no").isNull())).first()[0] == 0

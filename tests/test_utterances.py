"""X16 and J13 case by case, and X16 against a plain loop over the query's own updates."""

import random

from pyspark.sql import functions as F

from talkframe.operators import lines, words

SCHEMA = "session_id string, utt_no int, seq int, text string, is_final boolean, start_cs bigint, end_cs bigint"


def plain(rows):
    """One session's utterances in order, one update after the other."""
    out, last_end = [], None
    for no in sorted({r[1] for r in rows}):
        mine = sorted((r for r in rows if r[1] == no), key=lambda r: r[2])
        shown, final, refused = "", "", 0
        for r in mine:
            text = r[3].strip()
            if r[4]:
                final = text
            elif text:
                if text.startswith(shown):
                    shown = text
                else:
                    refused += 1
        text, end = final or shown, max(r[6] for r in mine)
        out.append((no, len(mine), shown, text, min(r[5] for r in mine) if last_end is None else last_end, end, refused))
        last_end = end if text else last_end
    return out


def test_translation_utterances(spark):
    rng = random.Random(6)
    rows = []
    for s in range(6):
        for no in range(8):
            said = "ab cd ef gh".split()
            for seq in range(rng.randrange(1, 6)):
                text = " ".join(rng.choice(("ab", "xx")) if rng.random() < 0.2 else w for w in said[: rng.randrange(5)])
                rows.append((f"s{s}", no, seq, rng.choice((text, f" {text} ")), False, no * 10, no * 10 + 8))
            if rng.random() < 0.6:
                rows.append((f"s{s}", no, 9, rng.choice(("", "FINAL")), True, no * 10, no * 10 + 9))
    got = words.translation_utterances(spark.createDataFrame(rows, SCHEMA)).collect()
    for s in {r[0] for r in rows}:
        mine = sorted(tuple(r)[1:] for r in got if r.session_id == s)
        assert mine == plain([r for r in rows if r[0] == s])


def test_markers_follow_the_words_they_flush(spark):
    tokens = spark.createDataFrame([("s", 0, 5, "a"), ("s", 5, 9, "b"), ("s", 30, 33, "c"), ("t", 1, 2, "d")], "session_id string, start_cs bigint, end_cs bigint, text string")
    marks = spark.createDataFrame([("s", 9, 30), ("t", 2, 9)], "session_id string, start_cs bigint, end_cs bigint")
    got = lines.with_silences(tokens, marks).orderBy("session_id", "at").select("session_id", "kind", F.coalesce("text", F.lit("-"))).collect()
    assert [tuple(r) for r in got] == [("s", "token", "a"), ("s", "token", "b"), ("s", "silence", "-"), ("s", "token", "c"), ("t", "token", "d"), ("t", "silence", "-")]


def test_each_token_leaves_the_buffer_once(spark):
    tokens = spark.createDataFrame([("s", i, i * 10, i * 10 + 9, "w") for i in range(10)], "session_id string, seq int, start_cs bigint, end_cs bigint, text string")
    cover = lambda c: spark.createDataFrame([("s", c)], "session_id string, cover bigint")
    moved = [{r.seq for r in lines.caught_up(tokens, cover(a), cover(b)).collect()} for a, b in ((0, 35), (35, 35), (35, 60), (60, 200))]
    assert moved == [{0, 1, 2, 3}, set(), {4, 5}, {6, 7, 8, 9}]

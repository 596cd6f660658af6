"""Words from their pieces (W22) in lists of any length against plain Python, and the query over turns that the given tables lack against its SQL."""

import random
import string

import duckdb
import pytest

from talkframe import plans
from talkframe.operators import words

KIND = "session_id bigint, seq bigint, pieces array<struct<text:string,special:boolean>>"


def plain(pieces):
    """word_no, text, n_pieces of one session."""
    out, no = {}, 0
    for text, special in pieces:
        if text is None or special or text.startswith(" ") or (len(text.strip(" ")) == 1 and text.strip(" ") in string.punctuation):
            no += 1
        said, n = out.get(no, ("", 0))
        out[no] = (said + (text or ""), n + 1)
    return [(no, *w) for no, w in sorted(out.items())]


def test_lists_of_any_length(spark):
    """what a word's pieces are does not depend on where lists end; words go on over several lists, empty lists and null ones."""
    random.seed(13)
    given = {s: [(random.choice([" a", " b", "cd", "e", "f!", ".", " ,", "!!", "", None]), random.random() < 0.05) for _ in range(random.choice([1, 2, 9, 60]))] for s in range(40)}
    given[40] = [("x", False)] * 30  # begins nowhere
    given[41] = [("x", False)] * 5 + [(" y", False)] + [("z", False)] * 30
    rows = []
    for s, pieces in given.items():
        seq, at = 0, 0
        while at < len(pieces):
            n = random.choice([0, 1, 1, 2, 3, 20])
            rows.append((s, seq, None if n == 0 and seq % 2 else pieces[at : at + n]))
            seq, at = seq + 1, at + n
    rows += [(50, 0, None), (51, 0, []), (52, 0, []), (52, 1, None), (52, 2, [("late", False)])]
    random.shuffle(rows)
    got = words.subwords_to_words(spark.createDataFrame(rows, KIND)).collect()
    want = given | {52: [("late", False)]}
    assert sorted((r.session_id, r.word_no, r.text, r.n_pieces) for r in got) == [(s, *w) for s in sorted(want) for w in plain(want[s])]


@pytest.fixture(scope="module")
def odd_turns(spark, tmp_path_factory):
    """Tokens of over 30,000 characters, several rows of one turn, and turns that begin with marks or hold nothing else."""
    long = "ab-" * 13_000
    texts = [(1, 0, f"{long} then more. {long}! end"), (2, 0, None), (2, 1, "..."), (2, 2, ""), (2, 3, "!!!!? so."), (2, 4, "???"), (2, 5, ".... on"), (3, 0, "one two. three"), (3, 0, "un deux trois? quatre"), (3, 0, None), (3, 1, "!? x"), (4, 0, None), (5, 0, "")]
    folder = str(tmp_path_factory.mktemp("spark-pieces"))
    spark.createDataFrame([(*t, "user") for t in texts], "conv_id bigint, turn bigint, text string, role string").write.parquet(f"{folder}/conversations.parquet")
    return folder


def test_odd_turns(spark, odd_turns):
    """pieces were numbered 10,000 to a token, so those of a longer one came among the next token's."""
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{odd_turns}/conversations.parquet/*.parquet'")
    want = c.sql(plans.ORACLES["subwords_to_words"]).fetchall()
    got = [tuple(r) for r in plans.QUERIES["subwords_to_words"](spark, odd_turns).select("session_id", "word_no", "text", "n_pieces").collect()]
    assert sorted(got) == sorted(want)


def test_pieces_are_never_sorted(spark, sf):
    """a task's memory holds turns; tokens and pieces are made before or behind what sorts, never as rows between."""
    plan = plans.QUERIES["subwords_to_words"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate ") == 1 and plan.index("Generate ") < min(plan.index(x) for x in ("Sort ", "Window ", "Exchange "))


def test_marks_need_one_sort(spark, sf, odd_turns):
    """windows in the order in which tokens are sorted anyway; several rows of one turn give what the SQL gives."""
    query = plans.QUERIES["merged_marks"]
    assert query(spark, sf)._jdf.queryExecution().executedPlan().toString().count("Sort ") == 1
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{odd_turns}/conversations.parquet/*.parquet'")
    got = [tuple(r) for r in query(spark, odd_turns).select("session_id", "word_no", "text", "start_cs", "end_cs").collect()]
    assert sorted(got) == sorted(c.sql(plans.ORACLES["merged_marks"]).fetchall())

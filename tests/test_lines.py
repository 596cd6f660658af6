"""Lines, spans, joins: literal cases."""

from talkframe.operators import audio, joins, lines

SPANS = "session_id string, span_no int, start_cs bigint, end_cs bigint, speaker int"
TIME = "session_id string, seq2 bigint, kind string, text string, start_cs bigint, end_cs bigint"


def built(spark, tokens, spans):
    t = spark.createDataFrame([("a", i, k, x, s, e) for i, (k, x, s, e) in enumerate(tokens)], TIME)
    s = spark.createDataFrame([("a", i, b, e, who) for i, (b, e, who) in enumerate(spans)], SPANS)
    out = lines.speaker_lines(t, s).orderBy("line_no").collect()
    return [(r.speaker, r.start_cs, r.end_cs, r.text) for r in out if r.kind != "buffer"], next((r.text for r in out if r.kind == "buffer"), "")


def token(text, start, end):
    return ("token", text, start, end)


def test_largest_overlap_owns_a_token(spark):
    found, rest = built(spark, [token("Hello ", 0, 80), token("there ", 80, 180), token("Goodbye ", 210, 280), token("now", 280, 380)], [(0, 100, 0), (100, 200, 0), (200, 400, 1)])
    assert found == [(1, 0, 180, "Hello there "), (2, 210, 380, "Goodbye now")] and rest == ""


def test_text_behind_the_spans_waits(spark):
    words = [token("first ", 10, 90), token("second", 160, 240)]
    assert built(spark, words, [(0, 150, 0)]) == ([(1, 10, 90, "first ")], "second")
    assert built(spark, words, [(0, 150, 0), (150, 300, 1)]) == ([(1, 10, 90, "first "), (2, 160, 240, "second")], "")
    assert built(spark, [token("late ", 150, 200), token("rewound", 20, 80)], [(0, 100, 0)]) == ([], "late rewound")


def test_marks_join_the_line_before(spark):
    words = [token("Hello", 0, 100), token(" there", 100, 200), token(".", 200, 200), token(" Next", 200, 300)]
    assert built(spark, words, [(0, 200, 0), (200, 400, 1)])[0] == [(1, 0, 200, "Hello there."), (2, 200, 300, " Next")]


def test_silence_and_no_spans(spark):
    words = [token("before ", 0, 80), ("silence", None, 100, 600), token("after", 610, 700)]
    assert built(spark, words, [(0, 100, 0), (600, 800, 1)])[0] == [(1, 0, 80, "before "), (-2, 100, 600, None), (2, 610, 700, "after")]
    assert built(spark, [token("One. ", 0, 50), token("Two", 50, 100)], [])[0] == [(-1, 0, 100, "One. Two")]


def test_token_of_no_length(spark):
    assert built(spark, [token("x", 200, 200)], [(0, 100, 0), (100, 300, 1)])[0] == [(2, 200, 200, "x")]


def test_translation_owner_or_nearest(spark):
    own = spark.createDataFrame([("a", 1, 0, 200), ("a", 2, 200, 400), ("a", 3, 900, 950)], "session_id string, line_no bigint, start_cs bigint, end_cs bigint")
    items = spark.createDataFrame([("a", 1, 0, 400), ("a", 2, 400, 400), ("a", 3, 700, 720), ("a", 4, 100, 100)], "session_id string, tr_no bigint, start_cs bigint, end_cs bigint")
    found = {r.tr_no: r.owner for r in joins.owner_or_nearest(items, own, "session_id", "tr_no", "line_no", "start_cs", "end_cs", 100).collect()}
    assert found == {1: 1, 2: 2, 3: 3, 4: 1}


def test_pause_is_strictly_longer(spark):
    d = spark.createDataFrame([(1.99,), (2.0,), (2.01,), (None,)], "d double")
    assert [r[0] for r in d.select(lines.pause_boundary(d.d, 2.0)).collect()] == [False, False, True, False]
    assert [r[0] for r in d.select(lines.pause_boundary(d.d, 0)).collect()] == [False] * 4


def test_frames_to_spans(spark):
    scores = [[0.9, 0.1, 0.2, 0.05], [0.1, 0.8, 0.99, 0.05], [0.85, 0.1, 0.99, 0.05], [0.8, 0.1, 0.95, 0.05]]
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate(scores)], "session_id string, frame_ix int, scores array<float>")
    spans = lambda n: [(r.speaker, r.start_cs, r.end_cs) for r in audio.frame_spans(df, n, 4, 25).orderBy("span_ix").collect()]
    assert spans(2) == [(0, 0, 25), (1, 25, 50), (0, 50, 100)]
    assert spans(4) == [(0, 0, 25), (2, 25, 100)]

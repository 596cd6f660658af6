"""Scalar functions and evaluation: literal cases and plain Python twins."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from talkframe.functions import numbers, text, times, values
from talkframe.operators import metrics, ranking, words
from talkframe.streaming import folds, windows


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_times(spark):
    assert one(spark, times.format_time(F.lit(366105).cast("bigint"))) == "1:01:01.05"
    assert one(spark, times.stamp(F.lit(1999600 // 1000 + 0).cast("bigint") * 0 + 2000)) == "00:00:02,000"
    assert one(spark, times.parse_time(F.lit("1:01:01.05"))) == pytest.approx(3661.05)
    assert one(spark, times.parse_time(F.lit("x"))) is None


def test_labels_and_arrays(spark):
    assert [one(spark, values.speaker_label(F.lit(i))) for i in (0, 25, 26, 27)] == ["A", "Z", "AA", "AB"]
    assert one(spark, values.argmax(F.array(F.lit(1), F.lit(3), F.lit(3)))) == 1
    assert one(spark, text.extract_number(F.lit("speaker_12"))) == 12
    assert one(spark, text.common_prefix_length(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"), F.lit("c")))) == 1
    assert one(spark, text.join_fragments(F.array(F.lit("ab"), F.lit("cd"), F.lit("!"), F.lit("日"), F.lit("x")))) == "ab cd!日x"


@pytest.mark.parametrize("said, digits", [("twenty one", "21"), ("one hundred and five", "105"), ("two thousand nineteen", "2019"), ("three point one four", "3.14"), ("twenty first", "21st"), ("nineteen ninety nine", "1999"), ("fifty percent", "50%"), ("ten dollars", "$10"), ("one oh one", "101"), ("two and a half", "2.5"), ("double seven", "77"), ("plain words", "plain words")])
def test_spoken_numbers(said, digits):
    assert numbers.digits(said) == digits


def test_normal_forms(spark):
    assert one(spark, text.normalize_text(F.lit("  Don’t  STOP-it, Café! "))) == "don t stop-it café"
    assert one(spark, text.remove_symbols_and_diacritics(F.lit("Ærø café $5"), keep="$")) == "AErO".replace("O", "o") + " cafe $5"
    assert one(spark, text.english_normalize(F.lit("Mr. Smith won't pay $1,200 [noise]"))).split() == ["mister", "smith", "will", "not", "pay", "$1200"]
    decomposed = unicodedata.normalize("NFD", "é")
    assert one(spark, text.normalize_text(F.lit(decomposed))) == "é"


def levenshtein(ref, hyp):
    table = [[(j, 0, j, 0) for j in range(len(hyp) + 1)]]
    for i, r in enumerate(ref, 1):
        line = [(i, 0, 0, i)]
        for j, h in enumerate(hyp, 1):
            if r == h:
                line.append(table[-1][j - 1])
                continue
            a, b, c = table[-1][j - 1], table[-1][j], line[-1]
            options = [(a[0] + 1, a[1] + 1, a[2], a[3]), (b[0] + 1, b[1], b[2], b[3] + 1), (c[0] + 1, c[1], c[2] + 1, c[3])]
            line.append(min(options, key=lambda x: x[0]))
        table.append(line)
    return table[-1][-1]


def test_word_errors(spark):
    random.seed(4)
    cases = [(["the", "cat"], []), ([], ["a", "b"]), (list("abcd"), list("axcde"))] + [([random.choice("abc") for _ in range(random.randint(0, 7))], [random.choice("abc") for _ in range(random.randint(0, 7))]) for _ in range(60)]
    df = spark.createDataFrame([(i, r, h) for i, (r, h) in enumerate(cases)], "id int, ref array<string>, hyp array<string>")
    got = {r.id: r for r in metrics.wer_rows(df).collect()}
    fast = {r.id: r.distance for r in metrics.edit_distances(df).collect()}
    for i, (ref, hyp) in enumerate(cases):
        d, s, ins, dele = levenshtein(ref, hyp)
        assert (got[i].s, got[i].i, got[i].d) == (s, ins, dele) and fast[i] == d
        assert got[i].wer == (d / len(ref) if ref else float(len(hyp)))


def test_timestamp_accuracy(spark):
    table = lambda ws: spark.createDataFrame([("a", i, w, t) for i, (w, t) in enumerate(ws)], "id string, ix int, word string, start_cs int")
    got = metrics.timestamp_accuracy(table([("x", 10), ("b", 25), ("z", 40), ("d", 70)]), table([("a", 0), ("b", 20), ("c", 40), ("d", 60)])).first()
    assert (got.n_matched, got.mae_cs, got.max_cs, got.median_cs) == (2, 7.5, 10, 7.5)


def test_nearest_rank(spark):
    for n, want in ((1, 1), (19, 19), (20, 20), (21, 20)):
        df = spark.createDataFrame([("a", i, i + 1) for i in range(n)], "session_id string, call_ix int, dur_us bigint")
        assert metrics.session_calls(df).first().p95_us == want


def test_repetition(spark):
    phrase = "one two three four five six".split()
    for ws in (phrase, phrase * 2, phrase * 3, ["a"] * 12, [str(i) for i in range(30)], ["x"] * 8 + list("abcd")):
        assert one(spark, text.repetition_loop(F.array(*map(F.lit, ws)))) == folds.loops(ws)
    assert folds.loops(phrase * 3) and not folds.loops(phrase * 2)


def test_checked_spans(spark):
    cases = [(["a", "b"], [[0.0, 1.0], [1.0, 2.0]], None), (["a"], [], "length"), (["a"], [[1.0]], "shape"), (["a"], [[0.0, float("inf")]], "not_finite"), (["a"], [[-1.0, 1.0]], "negative"), (["a"], [[2.0, 1.0]], "inverted"), (["a", "b"], [[5.0, 6.0], [1.0, 7.0]], "order")]
    df = spark.createDataFrame([(str(i), w, s) for i, (w, s, _) in enumerate(cases)], "id string, words array<string>, spans array<array<double>>")
    got = {r.id: r.error_code for r in ranking.checked_spans(df).collect()}
    assert [got[str(i)] for i in range(len(cases))] == [c[2] for c in cases]


def test_monotonic_words_and_interpolation(spark):
    line = spark.createDataFrame([("a", "Concord  returned to its place amidst the tents", 55, 305)], "session_id string, text string, start_cs bigint, end_cs bigint")
    got = words.interpolate_words(line, ["session_id"]).orderBy("i").collect()
    assert len(got) == 8 and "".join(r.text for r in got) == "Concord  returned to its place amidst the tents" and got[-1].end_cs == 305


def test_retention():
    assert [windows.retention_seconds(r, m) for r, m in ((None, "full"), (None, "diff"), (60, "diff"), (0, "diff"), (-1, "full"))] == [float("inf"), 300.0, 60.0, float("inf"), float("inf")]

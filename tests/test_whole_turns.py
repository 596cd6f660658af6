"""Error rates over whole turns against brute force."""

import random
from collections import Counter

import pytest

from talkframe.operators import metrics
from talkframe.plans import QUERIES


def brute(ref, hyp):
    """(s, i, d): on ties a match or substitution comes before a deletion, before an insertion."""
    above = [(j, 0, j, 0) for j in range(len(hyp) + 1)]
    for w in ref:
        row = [(above[0][0] + 1, above[0][1], above[0][2], above[0][3] + 1)]
        for j, h in enumerate(hyp, 1):
            diag, up, left = above[j - 1], above[j], row[-1]
            if h == w:
                row.append(diag)
            elif diag[0] <= min(up[0], left[0]):
                row.append((diag[0] + 1, diag[1] + 1, diag[2], diag[3]))
            elif up[0] <= left[0]:
                row.append((up[0] + 1, up[1], up[2], up[3] + 1))
            else:
                row.append((left[0] + 1, left[1], left[2] + 1, left[3]))
        above = row
    return above[-1][1:]


@pytest.fixture(scope="module")
def long_turns(spark, tmp_path_factory):
    """Turns of 0 to 130 words, one of them null."""
    random.seed(4)
    texts = [None, "", "..."] + [" ".join(random.choice("ka lo mi nu te".split()) for _ in range(n)) for n in (1, 7, 39, 40, 41, 85, 130)]
    folder = str(tmp_path_factory.mktemp("spark-turns"))
    spark.createDataFrame([(i // 3, i % 3, t, "user") for i, t in enumerate(texts)], "conv_id bigint, turn bigint, text string, role string").write.parquet(f"{folder}/conversations.parquet")
    refs = {f"{i // 3}-{i % 3}": [w for w in t.replace(".", "").split()] for i, t in enumerate(texts) if t is not None}


    def hyp(key, ref):
        lacks, swaps = 7 + 11 * (int(key.split("-")[0]) % 3), 11 + 20 * (int(key.split("-")[1]) % 2)
        return [w + "x" if k % swaps == 0 else w for k, w in enumerate(ref, 1) if k % lacks]

    return folder, {k: (r, hyp(k, r)) for k, r in refs.items()}


def test_error_counts(spark):
    random.seed(2)
    word = lambda: random.choice("abcd")
    rows = [(str(i), [word() for _ in range(random.randrange(30))], [word() for _ in range(random.randrange(30))]) for i in range(300)]
    rows += [("r", ["a"] * 70, []), ("h", [], ["a"] * 70), ("e", [], [])]
    df = spark.createDataFrame(rows, "id string, ref array<string>, hyp array<string>")
    got = {r.id: (r.s, r.i, r.d, r.ref_words, r.hyp_words) for r in metrics.wer_rows(df).collect()}
    assert got == {k: (*brute(r, h), len(r), len(h)) for k, r, h in rows}


def test_whole_error_rates(spark, long_turns):
    folder, turns = long_turns
    got = {r.id: (r.s, r.i, r.d, r.ref_words, r.hyp_words) for r in QUERIES["word_error_rates"](spark, folder).collect()}
    assert got == {k: (*brute(r, h), len(r), len(h)) for k, (r, h) in turns.items()}
    found = {r.id: r.distance for r in QUERIES["edit_distances"](spark, folder).collect()}
    assert found == {k: sum(brute(r, h)) for k, (r, h) in turns.items()}


def test_whole_reports(spark, long_turns):
    folder, turns = long_turns
    n, errors = sum(len(r) for r, _ in turns.values()), sum(sum(brute(r, h)) for r, h in turns.values())
    (whole,) = QUERIES["bench_report"](spark, folder).where("level = 'all'").collect()
    assert (whole.audio_us, whole.weighted_wer) == (n * 400000, round(errors / n, 6))
    systems = QUERIES["compare_systems"](spark, folder).collect()
    assert sum(r.n for r in systems) == len(turns)
    per = Counter()
    for k, (r, h) in turns.items():
        c, t = map(int, k.split("-"))
        key = (("la", "ss")[t % 2], ("base", "small", "turbo")[c % 3], ("de", "en", "es", "fr")[c % 4])
        per[key, "n"] += len(r)
        per[key, "e"] += sum(brute(r, h))
    assert {(r.backend, r.model, r.language): r.wer_pct for r in systems} == {k: round(100 * per[k, "e"] / max(per[k, "n"], 1), 6) for k, x in per if x == "n"}
    most = [max(r[c] for r in systems) for c in ("rtf", "wer_pct")]
    want = sorted((r.backend, r.model, r.language) for r in systems if r.rtf < min(1, 0.85 * most[0]) and r.wer_pct < min(12, 0.45 * most[1]))
    assert sorted((r.backend, r.model, r.language) for r in QUERIES["sweet_spot"](spark, folder).collect()) == want


def test_whole_timestamps(spark, long_turns):
    folder, turns = long_turns
    got = {r.id: r.n_matched for r in QUERIES["timestamp_accuracy"](spark, folder).collect()}
    want = {}
    for k, (ref, hyp) in turns.items():
        at = n = 0
        for w in hyp:
            near = ref[at : at + 3]
            if w in near:
                at, n = at + near.index(w) + 1, n + 1
        want[k] = n
    assert got == {k: n for k, n in want.items() if turns[k][0] or turns[k][1]}

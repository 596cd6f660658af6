"""Hypotheses that reach folds as changes: the same hypotheses, the same results, and no row that carries a whole turn."""

import random

from pyspark.sql import functions as F

from talkframe.sources import adapters
from talkframe.streaming import folds, watchdogs
from talkframe.streaming.events import EventStream


def test_changes_are_the_hypotheses(spark, sf):
    said, got = {}, {}
    for r in adapters.hypothesis_changes(spark, sf).orderBy("session_id", "rev").collect():
        words = said.setdefault(r.session_id, [])
        words[r.kept :] = r.words
        got[r.session_id, r.rev] = list(words)
        assert len(r.words) <= 6 and r.n_revs >= r.rev
    assert got == {(r.session_id, r.rev): r.words for r in adapters.hypotheses(spark, sf).collect()}


def test_folds_get_no_whole_turns(spark, sf, monkeypatch):
    """What the registered queries send to their folds grows with the words of a turn, not with their square."""
    from talkframe.plans import QUERIES

    sent = []
    run = folds.run_batch
    monkeypatch.setattr(folds, "run_batch", lambda df, *a, **k: (sent.append(df), run(df, *a, **k))[1])
    n = adapters.read(spark, sf, "conversations").agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))).first()[0]
    for name in ("agreed_words", "steady_words", "final_events", "interim_events", "buffer_cuts"):
        QUERIES[name](spark, sf)
        assert sent.pop().agg(F.sum(F.size("_text"))).first()[0] <= 1.5 * n, name


def test_known_leading_words_change_nothing():
    rng = random.Random(5)
    for _ in range(300):
        words, before = [], []
        steps = {"agree": folds.local_agreement, "steady": folds.stable_words, "trim": watchdogs.TrimmedBuffer(2.0), "events": EventStream()}
        plain, told = {k: {} for k in steps}, {k: {} for k in steps}
        for rev in range(12):
            words = words[: rng.randrange(len(words) // 2, len(words) + 1)]
            while rng.random() < 0.8:
                s = max(len(words) * 0.3 + rng.choice([0, 0, 0, -1, 1.5]), 0)
                words.append([rng.choice("abc"), s, s + rng.choice([0.2, 0.2, -0.1, 1.0]), 0.9])
            same = next((i for i, (a, b) in enumerate(zip(words, before)) if a != b), min(len(words), len(before)))
            before = [*words]
            for k, step in steps.items():
                row = {"kind": "snapshot" if k == "events" else "hypothesis", "ts_s": rev * 1.0, "audio_s": rev * 1.0, "offset_s": 0.1 * (rev // 6) if k == "agree" else 0.0, "words": [w[: 4 if k in ("agree", "trim") else 3] for w in words]}
                assert step(plain[k], row) == step(told[k], row | {"same": same}), k


def test_loops_by_pairs():
    """Lists that cannot loop, as no two words follow each other often enough, are told without counting longer runs."""
    def plain(ws):
        n = len(ws)
        if n < 12:
            return False
        if any(len(set(ws[i : i + 8])) == 1 for i in range(n - 7)):
            return True
        for k in range(2, 9):
            need = max(3, -(-12 // k))
            if n >= k * need and all(ws[n - k * (r + 1) : n - k * r] == ws[n - k :] for r in range(1, need)):
                return True
            grams = [tuple(ws[i : i + k]) for i in range(n - k + 1)]
            top = max(map(grams.count, grams))
            if top >= max(4, -(-12 // k)) and top * k >= 0.55 * n:
                return True
        return False

    rng = random.Random(7)
    for _ in range(1500):
        part = [rng.choice("abcdefghijkl") for _ in range(rng.randrange(1, 9))]
        ws = [rng.choice("abcdefghijkl") for _ in range(rng.randrange(0, 40))] + part * rng.randrange(0, 6) + [rng.choice("abcdefghijkl") for _ in range(rng.randrange(0, 3))]
        assert folds.loops(ws) == plain(ws), ws

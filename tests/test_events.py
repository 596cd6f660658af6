"""Event rules: literal cases, state that stays flat, and the loop detector against its definition."""

import collections
import json
import random

from talkframe.streaming import folds
from talkframe.streaming.events import REMEMBERED, EventStream


def run(rows, **options):
    step, facts = EventStream(**({"endpoint_s": 0.3, "utterance_s": 1.0, "interims": False} | options)), {}
    return [(e["kind"], e["text"], e["at_s"], e["speech_final"]) for r in rows for e in step(facts, r)], facts


def snap(*words, lag=0.0, buffer=""):
    return {"kind": "snapshot", "words": [[w, i * 0.5, i * 0.5 + 0.4] for i, w in enumerate(words)], "lag_s": lag, "buffer": buffer}


def clock(kind, t):
    return {"kind": kind, "ts_s": t}


def boundary(t, count, lasts=0.1):
    return {"kind": "boundary", "ts_s": t, "duration_s": lasts, "count": count}


def test_a_boundary_waits_for_the_lag():
    rows = [snap("a", "b", lag=1.0), boundary(1.0, 2), snap("a", "b", lag=1.0)]
    assert run(rows)[0] == []
    assert run([*rows, snap("a", "b")])[0] == [("final", "a b", 0.9, False)]


def test_late_and_repeated_boundaries():
    rows = [snap("a", "b", "c"), boundary(1.0, 2, 0.4), boundary(1.0, 2, 0.4), boundary(1.0004, 2, 0.4), boundary(0.5, 1), boundary(0.5, 1), boundary(1.0, 2, 0.6)]
    assert run(rows)[0] == [("final", "a b", 0.9, True), ("late", "", 0.5, False)]


def test_a_pause_waits_for_words_buffer_and_lag():
    pause = [clock("silence_started", 1.0), clock("audio_advanced", 1.5)]
    ready = clock("silence_transcription_ready", 1.0)
    assert run([snap("a", "b"), *pause])[0] == []
    assert run([snap("a", "b", buffer="c"), *pause, ready])[0] == []
    assert run([snap("a", "b", lag=2.0), *pause, ready])[0] == []
    done = [("final", "a b", 0.9, True)]
    assert run([snap("a", "b", buffer="c"), *pause, ready, snap("a", "b")])[0] == done
    assert run([snap("a", "b", "later"), *pause, ready, ready])[0] == done  # the third word begins with the pause
    out, _ = run([snap("a", "b"), *pause, ready, clock("audio_advanced", 3.0), clock("speech_started", 3.2), clock("speech_started", 3.2)])
    assert out == [*done, ("utterance_end", "", 0.9, False), ("speech_started", "", 3.2, False)]


def test_short_pauses_and_speech_starts_in_order():
    rows = [clock("speech_started", 0.1), snap("a"), clock("silence_started", 0.5), clock("speech_started", 0.6), clock("silence_started", 1.0), clock("speech_started", 2.0), clock("silence_started", 3.0)]
    out, facts = run(rows)
    assert out == [("speech_started", "", 0.1, False), ("speech_started", "", 0.6, False)]  # the second pause lasts and waits for its words
    assert run([*rows, clock("silence_transcription_ready", 1.0)])[0][2:] == [("final", "a", 0.4, True), ("utterance_end", "", 0.4, False), ("speech_started", "", 2.0, False)]
    assert len(facts["pauses"]) == 2


def test_marks_added_to_finals_and_other_revisions():
    rows = [snap("a", "b"), snap("a", "b", "c"), snap("a", "b.", "c"), snap("x", "b.", "c"), snap("a", "b.", "c", "d")]
    assert [e[1] for e in run(rows)[0]] == ["a b", ".", "c"]


def test_a_word_far_behind_ends_the_utterance_before():
    far = {"kind": "snapshot", "words": [["a", 0.0, 0.4], ["b", 5.0, 5.4]], "lag_s": 0.0}
    out, _ = run([snap("a"), {**snap("a"), "words": [["a", 0.0, 0.4]]}, far, {**far, "words": far["words"] + [["c", 5.5, 5.9]]}])
    assert [e[:2] for e in out] == [("final", "a"), ("utterance_end", ""), ("final", "b")]
    assert run([snap("a", "b"), clock("finish", 9.0)])[0] == [("final", "a b", 0.9, False)]
    assert run([snap("a", buffer=" tail "), clock("finish", 9.0)])[0] == [("final", "a", 0.4, False), ("final", "tail", 0.4, False)][:1] + [("final", "tail", None, False)]


def test_state_stays_flat():
    sizes, step, facts = [], EventStream(), {}
    for i in range(2000):
        rows = [{"kind": "snapshot", "words": [[f"w{k}", k * 0.5, k * 0.5 + 0.4] for k in range(i + 1)]}, boundary(i * 0.5, i), clock("silence_started", i * 0.5), clock("silence_transcription_ready", i * 0.5), clock("audio_advanced", i * 0.5 + 0.4), clock("speech_started", i * 0.5 + 0.45)]
        for r in rows:
            step(facts, r)
        sizes.append(len(json.dumps(facts)))
    assert max(sizes[1000:]) <= max(sizes[200:1000]) * 1.2 and facts["finals"] > 1990 and len(facts["tail"]) == REMEMBERED


def plain_loop(words):
    n = len(words)
    if n < 12:
        return False
    if any(len(set(words[i : i + 8])) == 1 for i in range(n - 7)):
        return True
    for k in range(2, 9):
        times = 1
        while k * (times + 1) <= n and words[n - k * (times + 1) : n - k * times] == words[n - k :]:
            times += 1
        most = max(collections.Counter(tuple(words[i : i + k]) for i in range(n - k + 1)).values(), default=0)
        if times >= 3 and times * k >= 12 or most >= 4 and most * k >= 12 and most * k >= 0.55 * n:
            return True
    return False


def test_loops_by_their_definition():
    random.seed(4)
    seen = collections.Counter()
    for _ in range(3000):
        phrase = [random.choice("abcdefgh") for _ in range(random.randint(1, 9))]
        words = [random.choice("abcdefgh") for _ in range(random.randint(0, 30))] + phrase * random.randint(0, 5) + [random.choice("ab") for _ in range(random.randint(0, 6))]
        seen[plain_loop(words)] += 1
        assert folds.loops(words) == plain_loop(words), words
    assert min(seen.values()) > 300

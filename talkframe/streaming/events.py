"""Final words, interims, endpoints, utterance ends and speech starts from snapshots and sample-clock events.

What is known of a session is a small record of facts; a row changes facts, and then rules run until none has anything to say. Each rule looks at the facts alone,
so held boundaries, lags and pauses need no memory of the row that brought them.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import takewhile
from typing import Any

Row = dict[str, Any]

#: Finals whose later revisions are still looked at, and boundaries that are remembered to tell repeated ones.
REMEMBERED = 64
#: Slack of comparisons on the sample clock.
EPS = 1e-9


def fresh_facts() -> Row:
    """finals (their number), tail (the last of them), pending (words behind them), agreed (how many of these two snapshots share), buffer, lag, clock,
    pauses ([start, end, ready, settled], oldest first), held and seen (boundaries), last_end (of the finals), quiet (its utterance end is out, or there is
    none), marked (finals up to the last speech_final), spoke (the last speech start), speaking, shown (the last interim)."""
    return {
        "finals": 0, "tail": [], "pending": [], "agreed": 0, "buffer": "", "lag": 0.0, "clock": 0.0, "pauses": [], "held": [], "seen": [], "last_end": None,
        "quiet": True, "marked": 0, "spoke": None, "speaking": False, "shown": "",
    }


def event(kind: str, text: str = "", at: float | None = None, final: bool = False) -> Row:
    return {"kind": kind, "text": text, "at_s": at, "speech_final": final}


def shared(a: list, b: list) -> int:
    """How many leading words of two word lists have the same text."""
    return sum(1 for _ in takewhile(lambda p: p[0][0] == p[1][0], zip(a, b, strict=False)))


class EventStream:
    """The step of a fold. Rows: kind (snapshot, boundary, silence_started, silence_transcription_ready, speech_started, audio_advanced, finish), ts_s, words
    ([text, start_s, end_s], the whole list), buffer, lag_s, count (words before a boundary) and duration_s. Emits kind (final, interim, utterance_end, speech_started,
    late), text, at_s, speech_final.

    - Words become final once two snapshots agree on them, at a boundary, at a pause of `endpoint_s` or more, or at the end; finals never change. A later
      revision that only adds marks to the last finals is emitted as those marks; others are ignored.
    - While a pause of that length waits for its transcription, an empty buffer or an end of the lag, nothing becomes final; then the words that
      begin before it do, marked speech_final.
    - Boundaries wait while speaker labels lag. One behind the finals is reported as late; repeated ones, by start and end, are dropped.
    - An utterance ends when neither the clock nor the next word is within `utterance_s` of the last final word: once for each such word.
    - Speech starts rise in time and follow the pause that they end.

    State holds the words that are not final, the last REMEMBERED finals and boundaries, and pauses not yet done: it does not grow with the session.
    """

    def __init__(self, endpoint_s: float | None = 0.3, utterance_s: float | None = 1.0, interims: bool = True) -> None:
        self.endpoint_s, self.utterance_s, self.interims = endpoint_s, utterance_s, interims
        self.rules: tuple[Callable[[Row], list[Row] | None], ...] = (self.by_quiet, self.by_pause, self.by_boundary, self.by_agreement)

    def __call__(self, facts: Row, row: Row) -> list[Row]:
        for name, value in fresh_facts().items():
            facts.setdefault(name, value)
        out = getattr(self, "on_" + row["kind"])(facts, row)
        if row["kind"] == "finish":
            return out
        while True:
            found = next((f for f in (rule(facts) for rule in self.rules) if f is not None), None)
            if found is None:
                break
            out += found
        if row["kind"] == "snapshot" and self.interims:
            text = " ".join([*(w[0] for w in facts["pending"]), *filter(None, [facts["buffer"]])])
            if text != facts["shown"]:
                facts["shown"] = text
                out.append(event("interim", text))
        return out

    # what rows tell

    def on_snapshot(self, f: Row, row: Row) -> list[Row]:
        words, n = row["words"], f["finals"]
        again = words[n - len(f["tail"]) : n]
        marks = [] if [w[0] for w in again] == f["tail"] else self.added_marks(f["tail"], again)
        if marks:
            f["tail"] = [w[0] for w in again]
        now = [list(w) for w in words[n:]]
        if [w[0] for w in again] != f["tail"] or marks:
            f["agreed"] = 0
        elif [w[0] for w in now] != [w[0] for w in f["pending"]]:
            f["agreed"] = shared(f["pending"], now)
        f.update(pending=now, buffer=(row.get("buffer") or "").strip(), lag=row.get("lag_s") or 0.0)
        return [event("final", m) for m in marks]

    @staticmethod
    def added_marks(tail: list[str], again: list[list]) -> list[str]:
        """The marks that a snapshot adds to finals, if that is all in which it differs from them."""
        if len(again) < len(tail):
            return []
        added = [new[0][len(old) :] if new[0].startswith(old) else "?x" for old, new in zip(tail, again, strict=True)]
        return [] if any(c.isalnum() for c in "".join(added)) else [a.strip() for a in added if a.strip()]

    def on_boundary(self, f: Row, row: Row) -> list[Row]:
        lasts = row.get("duration_s") or 0.0
        key = [round(row["ts_s"], 3), round(row["ts_s"] + lasts, 3)]
        if key not in f["seen"]:
            f["seen"] = [*f["seen"], key][-REMEMBERED:]
            f["held"].append([row["ts_s"], lasts, row["count"]])
        return []

    def on_audio_advanced(self, f: Row, row: Row) -> list[Row]:
        f["clock"] = max(f["clock"], row["ts_s"])
        return []

    def on_silence_started(self, f: Row, row: Row) -> list[Row]:
        f["speaking"] = False
        if not any(end is None for _, end, *_ in f["pauses"]):
            f["pauses"].append([row["ts_s"], None, False, False])
        return self.on_audio_advanced(f, row)

    def on_silence_transcription_ready(self, f: Row, row: Row) -> list[Row]:
        for p in f["pauses"]:
            p[2] = p[2] or abs(p[0] - row["ts_s"]) < 1e-6
        return self.on_audio_advanced(f, row)

    def on_speech_started(self, f: Row, row: Row) -> list[Row]:
        f["clock"] = max(f["clock"], row["ts_s"])
        was, f["speaking"] = f["speaking"], True
        for p in f["pauses"]:
            if p[1] is None:
                p[1] = row["ts_s"]  # told when the pause is done
                return []
        return [] if was else self.speech(f, row["ts_s"])

    def on_finish(self, f: Row, row: Row) -> list[Row]:
        f["clock"] = max(f["clock"], row["ts_s"])
        rest = [event("final", f["buffer"])] if f["buffer"] else []
        f["buffer"] = ""
        return self.release(f, f["finals"] + len(f["pending"]), False) + rest

    # what follows from the facts

    def lasting(self, f: Row, pause: list) -> bool:
        return self.endpoint_s is not None and (f["clock"] if pause[1] is None else pause[1]) - pause[0] >= self.endpoint_s - EPS

    def blocked(self, f: Row) -> bool:
        """No word may become final: speaker labels lag, or the oldest pause lasts and is not settled."""
        return f["lag"] > 0 or bool(f["pauses"]) and not f["pauses"][0][3] and self.lasting(f, f["pauses"][0])

    def by_pause(self, f: Row) -> list[Row] | None:
        if not f["pauses"]:
            return None
        start, end, ready, settled = pause = f["pauses"][0]
        if self.lasting(f, pause) and not settled:
            if not ready or f["buffer"] or f["lag"] > 0:
                return None
            pause[3] = True
            return self.release(f, f["finals"] + sum(1 for _ in takewhile(lambda w: w[1] < start, f["pending"])), True)
        if end is None:
            return None
        f["pauses"].pop(0)
        return self.speech(f, end)

    def by_boundary(self, f: Row) -> list[Row] | None:
        if not f["held"] or self.blocked(f):
            return None
        start, lasts, count = f["held"].pop(0)
        if count < f["finals"]:
            return [event("late", "", start)]
        return self.release(f, count, self.endpoint_s is not None and lasts >= self.endpoint_s - EPS)

    def by_agreement(self, f: Row) -> list[Row] | None:
        return self.release(f, f["finals"] + f["agreed"], False) if f["agreed"] and not self.blocked(f) else None

    def by_quiet(self, f: Row) -> list[Row] | None:
        if f["quiet"] or self.utterance_s is None or f["buffer"] or f["clock"] - f["last_end"] < self.utterance_s - EPS:
            return None
        return self.utterance_end(f, f["pending"][0][1] if f["pending"] else None)

    def utterance_end(self, f: Row, following: float | None) -> list[Row] | None:
        """The end of the last final word's utterance, unless the word that follows is near."""
        if f["quiet"] or self.utterance_s is None or following is not None and following - f["last_end"] < self.utterance_s - EPS:
            return None
        f["quiet"] = True
        return [event("utterance_end", "", f["last_end"])]

    def speech(self, f: Row, t: float) -> list[Row]:
        if f["spoke"] is not None and t <= f["spoke"] + 1e-6:
            return []
        f["spoke"] = t
        return [event("speech_started", "", t)]

    def release(self, f: Row, count: int, final: bool) -> list[Row]:
        """Pending words up to the `count`-th word of all become final; without one, a speech_final still marks the finals since the last."""
        n = min(max(count - f["finals"], 0), len(f["pending"]))
        said, f["pending"] = f["pending"][:n], f["pending"][n:]
        if not said and not (final and f["finals"] > f["marked"]):
            return []
        out = (self.utterance_end(f, said[0][1]) or []) if said else []
        if said:
            f.update(finals=f["finals"] + n, agreed=max(f["agreed"] - n, 0), tail=[*f["tail"], *(w[0] for w in said)][-REMEMBERED:], last_end=said[-1][2], quiet=False)
        f["shown"] = ""
        f["marked"] = f["finals"] if final else f["marked"]
        return [*out, event("final", " ".join(w[0] for w in said), f["last_end"], final)]

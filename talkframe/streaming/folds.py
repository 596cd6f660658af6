"""Ordered per-session state machines. A fold is a state (plain JSON data) and a step; the batch and the streaming wrapper run the same step.

Folds are for what windows cannot say: whose next state depends on what the step itself has emitted. A session is one group, so
its rows go through one task in order; many sessions run in parallel.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StringType, StructField, StructType

from talkframe.operators.ranking import VOLATILE

Row = dict[str, Any]
Step = Callable[[Row, Row], list[Row]]


def leading(state: Row, row: Row, since: list[float], gone: Callable[[list], bool]) -> int:
    """How many leading words of a hypothesis are `gone`. Of a row with `same` (so many leading words are those of the hypothesis before) only words that were not found gone
    before are looked at; `gone` goes on to hold while none of `since` falls and its other numbers stay, so all are looked at again where one falls or another changes."""
    n, old = state.get("gone", (0, since))
    n = min(n, row["same"]) if old[0] <= since[0] and old[1:] == since[1:] else 0
    words = row["words"]
    while n < len(words) and gone(words[n]):
        n += 1
    state["gone"] = n, since
    return n


def local_agreement(state: Row, row: Row, sure: float | None = None) -> list[Row]:
    """Commits what two hypotheses in a row agree on. Rows: kind (hypothesis, silence, change_speaker, eof), offset_s, duration_s and
    words ([text, start_s, end_s, prob]). Emits text, start_s, end_s.

    A hypothesis' words count from 0.1 s before the last commit on; a leading 1 to 5 words that repeat the committed tail, when it starts within a
    second of it, go first (the shortest such match). `same` may tell how many leading words are those of the hypothesis before. Then the common prefix with the open words is committed, and with `sure` any
    word more probable than that. A silence of 5 s or more and a change of speaker start afresh at their time; the end of the stream flushes.
    """
    state.setdefault("last", 0.0), state.setdefault("tail", []), state.setdefault("open", [])
    kind = row.get("kind") or "hypothesis"
    out: list[list] = []
    if kind == "hypothesis":
        offset = row.get("offset_s") or 0.0
        words = row["words"]
        if "same" in row:
            words = words[leading(state, row, [state["last"], offset], lambda w: not w[1] + offset > state["last"] - 0.1) :]
        fresh = [[t, s + offset, e + offset, p] for t, s, e, p in words if s + offset > state["last"] - 0.1]
        if fresh and abs(fresh[0][1] - state["last"]) < 1:
            for n in range(1, min(5, len(state["tail"]), len(fresh)) + 1):
                if " ".join(state["tail"][-n:]) == " ".join(w[0] for w in fresh[:n]):
                    fresh = fresh[n:]
                    break
        agreed = 0
        for i, word in enumerate(fresh):
            certain = sure is not None and word[3] is not None and word[3] > sure
            if not certain and (i >= len(state["open"]) or state["open"][i][0] != word[0]):
                break
            agreed = i + 1
        out, state["open"] = fresh[:agreed], fresh[agreed:]
    elif kind == "eof":
        out, state["open"] = state["open"], []
    elif kind == "change_speaker" or kind == "silence" and (row.get("duration_s") or 0) >= 5:
        state.update(last=(row.get("offset_s") or 0.0) + (row.get("duration_s") or 0.0), tail=[], open=[])
    if out:
        state["last"] = out[-1][2]
        state["tail"] = (state["tail"] + [w[0] for w in out])[-5:]
    return [{"text": t, "start_s": s, "end_s": e} for t, s, e, _ in out]


def loops(words: list[str]) -> bool:
    """F30 for a Python list, by run lengths: words become numbers, a tail repeats itself after k words as far back as each number equals the one k before it, and
    k words are one number in the base of the vocabulary."""
    n = len(words)
    if n < 12:
        return False
    pairs = max(Counter(zip(words, words[1:], strict=False)).values())
    # a loop's first two words come as often as it does: 7 times in a run, else 3 times at the tail, where its last turn stands twice, or 4 times and often enough
    if pairs < 3 or pairs < 7 and (pairs < 4 or pairs * 8 < 0.55 * n) and not any(words[-k:] == words[-2 * k : -k] for k in range(2, 9)):
        return False
    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x = np.array([code[w] for w in words], np.int64)
    turns = np.flatnonzero(np.diff(x, prepend=-1, append=-1))
    if np.diff(turns).max() >= 8:
        return True
    gram = x
    for k in range(2, 9):
        gram = np.unique(gram[:-1] * len(code) + x[k - 1 :], return_inverse=True)[1]  # numbered anew, so numbers stay small
        unlike = np.flatnonzero(x[k:] != x[:-k])
        tail = n - (unlike[-1] + 1 if len(unlike) else 0)
        times = int(np.bincount(gram).max())
        if tail >= max(3 * k, k * -(-12 // k)) or times >= max(4, -(-12 // k)) and times * k >= 0.55 * n:
            return True
    return False


def stable_words(state: Row, row: Row) -> list[Row]:
    """Of a batch of words ([text, start_s, end_s]) those that move forward. Dropped: inverted spans, ends at or before the committed end + 0.05 s,
    ends over 0.75 s behind the batch's. If all end over a second behind the committed end, or the recent 80 words and these loop, the
    batch is withheld and a reset is reported. Emits kind (word, reset), text, start_s, end_s."""
    end, recent = state.setdefault("end", 0.0), state.setdefault("recent", [])
    kept, front = [], end
    words = row["words"]
    if "same" in row:
        words = words[leading(state, row, [end], lambda w: (w[2] or w[1]) < w[1] or (w[2] or w[1]) <= end + 0.05) :]
    for text, s, e in words:
        e = e or s
        if e < s or e <= end + 0.05 or (kept and front - e > 0.75):
            continue
        kept.append((text, s, e))
        front = max(front, e)
    if not kept:
        behind = row["words"] and end - max(e for *_, e in row["words"]) > 1.0
        state["recent"] = [] if behind else recent
        return [{"kind": "reset", "text": "rewound", "start_s": end, "end_s": end}] if behind else []
    said = [w for text, *_ in kept for w in "".join(c if c.isalnum() or c == "'" else " " for c in text.casefold()).split()]
    if loops(recent + said):
        state["recent"] = []
        return [{"kind": "reset", "text": "repetition", "start_s": end, "end_s": end}]
    state["end"], state["recent"] = front, (recent + said)[-80:]
    return [{"kind": "word", "text": t, "start_s": s, "end_s": e} for t, s, e in kept]


def coalesce_chunks(state: Row, row: Row, least_s: float = 1.0) -> list[Row]:
    """Chunks (seconds, kind) are held until they make up `least_s`; a silence, a change of speaker and the end drain them. Emits seconds, n."""
    state.setdefault("held", 0.0), state.setdefault("n", 0)
    if (row.get("kind") or "audio") == "audio":
        state["held"], state["n"] = state["held"] + row["seconds"], state["n"] + 1
        if least_s > 0 and state["held"] < least_s:
            return []
    if not state["n"]:
        return []
    out = [{"seconds": round(state["held"], 6), "n": state["n"]}]
    state.update(held=0.0, n=0)
    return out


def hold_back_last(state: Row, row: Row) -> list[Row]:
    """Of a growing text every word but the last is final; `eof` releases all. Emits ix, text (a leading space but for the first)."""
    done = state.setdefault("done", 0)
    words = (row["text"] or "").split()
    upto = len(words) if row.get("kind") == "eof" else max(len(words) - 1, 0)
    state["done"] = max(done, upto)
    return [{"ix": i, "text": ("" if i == 0 else " ") + words[i]} for i in range(done, upto)]


def to_delta(state: Row, row: Row) -> list[Row]:
    """X7, S16 for streams: a snapshot's lines as a change: the first as a whole, then how many to drop in front, the new lines and how many there are, with whatever of
    VOLATILE the snapshot has. The state is the lines shown last."""
    now, before = list(row["lines"]), state.get("lines")
    state["lines"], state["seq"] = now, state.get("seq", 0) + 1
    message = {"rev": row["rev"], "seq": state["seq"], "type": "snapshot", "lines_pruned": 0, "n_lines": len(now), "new_lines": now, **{c: row[c] for c in VOLATILE if c in row}}
    if before is None:
        return [message]
    gone = (before.index(now[0]) if now[0] in before else len(before)) if now else len(before)
    unlike = (i for i, (old, new) in enumerate(zip(before[gone:], now, strict=False)) if old != new)
    return [message | {"type": "diff", "lines_pruned": gone, "new_lines": now[next(unlike, min(len(before) - gone, len(now))) :]}]


def from_delta(state: Row, row: Row) -> list[Row]:
    """The snapshot again: drop in front, cut to what the new lines leave of n_lines, append."""
    new = list(row["new_lines"])
    before = [] if row["type"] == "snapshot" else state.get("lines", [])[row["lines_pruned"] :]
    state["lines"] = before[: row["n_lines"] - len(new)] + new
    return [{"rev": row["rev"], "lines": state["lines"]}]


def pack_subtitles(words: list[Row], width: int = 42, lines: int = 2, most_words: int | None = None, pause_s: float = 3.0, highlight: bool = False) -> list[Row]:
    """Words ({text, start_s, end_s}) packed into cues of at most `lines` lines of `width` characters; a gap of over `pause_s` since the last
    word's start begins a new cue. Emits start_s, end_s, text; with `highlight` a cue for each word, in which it is underlined, and one for each gap between words."""
    cues: list[list[tuple[str, Row]]] = []
    used, row, last, in_line = 0, 1, None, 0
    for w in words:
        late = last is not None and w["start_s"] - last > pause_s
        full = used + len(w["text"]) > width or (most_words is not None and in_line >= most_words)
        if cues and used and not late and not full:
            cues[-1].append((w["text"], w))
            used, in_line = used + len(w["text"]), in_line + 1
        else:
            text = w["text"].strip()
            if not cues or late or row >= lines:
                cues.append([(text, w)])
                row = 1
            else:
                cues[-1].append(("\n" + text, w))
                row += 1
            used, in_line = len(text), 1
        last = w["start_s"]
    if highlight:
        return [shown for cue in cues for shown in underlined(cue)]
    return [{"start_s": c[0][1]["start_s"], "end_s": c[-1][1]["end_s"], "text": "".join(t for t, _ in c)} for c in cues]


def underlined(cue: list[tuple[str, Row]]) -> Iterator[Row]:
    """A cue word by word, and as it stands in the gaps between words that last a millisecond or more."""
    pieces, until = [t for t, _ in cue], cue[0][1]["start_s"]
    for i, (piece, w) in enumerate(cue):
        if round(until * 1000) != round(w["start_s"] * 1000):
            yield {"start_s": until, "end_s": w["start_s"], "text": "".join(pieces)}
        bare = piece.lstrip()
        marked = piece[: len(piece) - len(bare)] + f"<u>{bare}</u>"
        yield {"start_s": w["start_s"], "end_s": w["end_s"], "text": "".join([*pieces[:i], marked, *pieces[i + 1 :]])}
        until = w["end_s"]


def plain(value: Any) -> Any:
    """Rows, arrays and numpy numbers as plain Python data."""
    if hasattr(value, "asDict"):
        value = value.asDict(recursive=True)
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return None if isinstance(value, float) and value != value else value


def as_lists(words: list[Row]) -> list[list]:
    return [list(w.values()) if isinstance(w, dict) else w for w in words]


def run_batch(df: DataFrame, step: Step, out: str, order: list[str], key: str = "session_id") -> DataFrame:
    """The fold over every session's rows in order; `out` is the schema of what it emits, behind the key. Spark deals sessions to partitions and sorts; rows reach
    the step batch by batch, so no session is held whole and small sessions cost no call each."""
    shape = StructType.fromDDL(f"{key} {df.schema[key].dataType.simpleString()}, out_no int, {out}")
    arrow = to_arrow_schema(shape)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Any = None
        state: Row | None = None
        n = 0
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                if state is None or r[key] != now:
                    now, state, n = r[key], {}, 0
                for e in step(state, r):
                    n += 1
                    made.append({key: now, "out_no": n, **e})
            yield pa.RecordBatch.from_pylist(made, schema=arrow)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(fold, shape)


def run_stream(df: DataFrame, step: Step, out: str, order: list[str], key: str = "session_id", idle_s: float | None = None, on_idle: Callable[[Row], Row] = lambda last: last | {"kind": "eof"}) -> DataFrame:
    """The same fold over a stream: one value of state per session, in the RocksDB state store; rows of a micro-batch are put in order first.

    With `idle_s` the stream has event_ts and a watermark: a session from which nothing has come for so long, by event time, gets a last row, made
    by `on_idle` of the one before (the same as its end, if not given), and its state is dropped; so neither states nor pauses wait for a sign that never comes.
    """
    names = [f.split()[0] for f in out.split(", ")]

    class Processor(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("fold", StructType([StructField("json", StringType())]))

        def fold(self, who: Any, rows: list[Row]) -> pd.DataFrame:
            state, n, _ = json.loads(self.state.get()[0]) if self.state.exists() else ({}, 0, None)
            frame = pd.DataFrame([e for r in rows for e in step(state, r)], columns=names, dtype=object)
            frame.insert(0, key, who)
            frame.insert(1, "out_no", range(n + 1, n + len(frame) + 1))
            self.state.update((json.dumps([state, n + len(frame), None if idle_s is None else rows[-1]]),))
            return frame

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            pdf = pd.concat(list(rows)).sort_values(order, kind="stable")
            if idle_s is not None:
                old = [t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()]
                for t in old:
                    self.handle.deleteTimer(t)
                seen = pd.to_datetime(pdf["event_ts"], utc=True).max().timestamp()
                self.handle.registerTimer(max([int((seen + idle_s) * 1000), *old]))
                pdf = pdf.drop(columns="event_ts")
            yield self.fold(key[0], [plain(r) for r in pdf.to_dict("records")])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            yield self.fold(key[0], [on_idle(json.loads(self.state.get()[0])[2])])
            self.state.clear()

        def close(self) -> None:
            pass

    shape = f"{key} {df.schema[key].dataType.simpleString()}, out_no int, {out}"
    return df.groupBy(key).transformWithStateInPandas(Processor(), shape, "append", "none" if idle_s is None else "EventTime")

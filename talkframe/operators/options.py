"""Options of a stream, checked on the driver before a query is built."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

#: The endpointing that holds if none is asked for, the range of utterance_end_ms, and the only audio form.
ENDPOINTING_MS, UTTERANCE_MS, RATE, CHANNELS = 10, (1000, 5000), 16000, 1


@dataclass(frozen=True)
class Options:
    language: str | None
    interim_results: bool
    vad_events: bool
    endpointing_ms: int | None
    utterance_end_ms: int | None
    pcm_input: bool | None = None


def stream_options(given: Mapping[str, str], vad: bool = True) -> Options:
    """The options named in `given`, all as text. Anything malformed, out of range or without what it needs (`vad`: voice activity is there) is a ValueError."""
    plain = {k: str(v).strip().lower() for k, v in given.items() if v is not None}

    def flag(name: str) -> bool:
        if plain.get(name, "false") not in ("true", "false"):
            raise ValueError(f"{name} must be true or false")
        return plain.get(name) == "true"

    def whole(name: str) -> int | None:
        text = plain.get(name)
        if text is not None and not (text.isascii() and text.isdecimal() and int(text)):
            raise ValueError(f"{name} must be a whole number above 0")
        return None if text is None else int(text)

    interim, events = flag("interim_results"), flag("vad_events")
    endpointing = {"true": ENDPOINTING_MS, "false": None}.get(plain.get("endpointing", "true"), 0)
    endpointing = whole("endpointing") if endpointing == 0 else endpointing
    if not vad and (endpointing is not None or events):
        raise ValueError("endpointing and vad_events need voice activity")
    utterance = whole("utterance_end_ms")
    if utterance is not None and not (UTTERANCE_MS[0] <= utterance <= UTTERANCE_MS[1] and interim):
        raise ValueError(f"utterance_end_ms must lie between {UTTERANCE_MS[0]} and {UTTERANCE_MS[1]}, with interim_results")
    pcm = plain.get("encoding") or None
    if pcm not in (None, "linear16"):
        raise ValueError("encoding must be linear16")
    if whole("sample_rate") not in ((RATE,) if pcm else (None, RATE)) or whole("channels") not in (None, CHANNELS):
        raise ValueError(f"audio must be mono at {RATE} Hz, and linear16 needs its sample_rate")
    return Options(given.get("language"), interim, events, endpointing, utterance, True if pcm else None)

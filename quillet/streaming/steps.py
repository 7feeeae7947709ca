"""Step functions and state classes shared by batch folds and stateful streaming.

Each class holds what a session needs between events, turns into a JSON string and back,
and takes one event at a time; time is event time in milliseconds, so replays agree.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from dataclasses import asdict, dataclass, field

from quillet.functions.chunking import join_parts, stable_chunks

SENTENCE_CLOSED_JAVA = "[.!?。！？][\\\"'”’》〉』】）)]*\\z"
_CLOSED = re.compile(SENTENCE_CLOSED_JAVA.replace("\\z", "$"))


class RevisionError(ValueError):
    """A hypothesis revised text that was committed."""


class _State:
    def dump(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @classmethod
    def load(cls, raw: str | None):
        return cls(**json.loads(raw)) if raw else cls()


@dataclass
class ChunkerState(_State):
    """Chunks of a cumulative hypothesis; indexes go on across voice boundaries."""

    text: str = ""
    committed: int = 0
    next_index: int = 0

    def update(self, hypothesis: str, boundary: bool = False, limit: int = 80) -> list[tuple[int, str]]:
        text = hypothesis.strip()
        if text[: self.committed] != self.text[: self.committed]:
            raise RevisionError("the recogniser revised committed text")
        self.text = text
        parts, self.committed = stable_chunks(text, limit, boundary, self.committed)
        out = [(self.next_index + i, p) for i, p in enumerate(parts)]
        self.next_index += len(parts)
        if boundary:
            self.text, self.committed = "", 0
        return out


@dataclass
class SlidingState(_State):
    """The last ``size`` chunks are refined together, older ones once and alone."""

    size: int = 3
    raw: list[str] = field(default_factory=list)
    committed: list[str] = field(default_factory=list)

    def add(self, chunk: str, refine) -> dict:
        self.raw.append(chunk)
        while len(self.raw) > self.size:
            self.committed.append(refine(self.raw.pop(0)))
        active = refine(join_parts(self.raw))
        return {"active": active, "committed": len(self.committed), "transcript": join_parts([*self.committed, active])}


@dataclass
class WindowCache(_State):
    """Cumulative text with cached refinements: chunks before the window are refined once,
    a revision drops what follows the first chunk that differs, and an unchanged active
    window is not refined again."""

    size: int = 3
    limit: int = 80
    sources: list[str] = field(default_factory=list)
    results: list[str] = field(default_factory=list)
    active_source: str | None = None
    active_result: str = ""
    calls: int = 0

    def _refine(self, text: str, refine) -> str:
        self.calls += 1
        return refine(text)

    def update(self, text: str, refine) -> str:
        chunks = stable_chunks(text.strip(), self.limit, flush=True)[0]
        older, active = chunks[: -self.size] if self.size else chunks, join_parts(chunks[-self.size :])
        same = 0
        for a, b in zip(self.sources, older):
            if a != b:
                break
            same += 1
        self.sources, self.results = self.sources[:same], self.results[:same]
        for chunk in older[same:]:
            self.results.append(self._refine(chunk, refine))
            self.sources.append(chunk)
        if self.active_source != active:
            self.active_source, self.active_result = active, self._refine(active, refine)
        return join_parts([*self.results, self.active_result])


@dataclass
class RotationState(_State):
    """Closes a recogniser segment by length, and keeps the text of closed ones."""

    held: float = 0.0
    closed: list[str] = field(default_factory=list)
    current: str = ""
    count: int = 0

    def add(self, seconds: float, text: str, soft: float = 30.0, hard: float = 45.0) -> str:
        self.held += seconds
        self.current = text
        if self.held >= hard or (self.held >= soft and _CLOSED.search(text)):
            self.closed.append(text)
            self.current, self.held, self.count = "", 0.0, self.count + 1
        return join_parts([*self.closed, self.current])


@dataclass
class VoiceState(_State):
    """Energy voice activity with a pre-roll ring: audio before speech starts belongs to
    the utterance. Yields finished utterances as (first window, last window)."""

    threshold: float = 0.02
    min_silence: float = 0.5
    min_speech: float = 0.2
    preroll: float = 0.7
    speech: float = 0.0
    silence: float = 0.0
    on: bool = False
    ring: list[list[float]] = field(default_factory=list)
    first: int = 0

    def add(self, index: int, rms: float, seconds: float) -> tuple[int, int] | None:
        self.ring.append([index, seconds])
        while sum(s for _, s in self.ring) - self.ring[0][1] >= self.preroll:
            self.ring.pop(0)
        if rms > self.threshold:
            self.speech, self.silence = self.speech + seconds, 0.0
            if not self.on and self.speech >= self.min_speech:
                self.on, self.first = True, int(self.ring[0][0])
        else:
            self.silence, self.speech = self.silence + seconds, 0.0
            if self.on and self.silence >= self.min_silence:
                self.on = False
                return self.first, index
        return None

    def finish(self, index: int) -> tuple[int, int] | None:
        """What speech is open at the end of the stream."""
        out = (self.first, index) if self.on else None
        self.on = False
        return out


@dataclass
class TriggerState(_State):
    new: float = 0.0

    def add(self, seconds: float, interval: float = 1.5, final: bool = False) -> bool:
        self.new += seconds
        fire = self.new >= interval or (final and self.new > 0)
        if fire:
            self.new = 0.0
        return fire


VERIFIED, ACCEPTED, OBSERVED, PROVISIONAL = "VERIFIED", "ACCEPTED", "OBSERVED", "PROVISIONAL"


def idle(entry: dict, now: float, ttl_ms: float) -> bool:
    """Whether an entry has expired: unused for longer than ``ttl_ms`` and not verified."""
    return entry["trust_level"] != VERIFIED and entry["last_seen_ms"] + ttl_ms < now


def worth(entry: dict) -> tuple:
    """By what entries stay where there is no room: verified ones, then accepted ones, then
    by when and how often they were seen."""
    return {VERIFIED: 2, ACCEPTED: 1}.get(entry["trust_level"], 0), entry["last_seen_ms"], entry["occurrence_count"]


def new_entry(now: float, entity_type: str = "TERM", source: str = "asr") -> dict:
    return dict(entity_type=entity_type, aliases=[], first_seen_ms=now, last_seen_ms=now, occurrence_count=0, confidence_sum=0.0, confidence_count=0, trust_level=PROVISIONAL, source=source)


def billionths(x: float) -> int:
    return math.floor(x * 1e9 + 0.5)


def observed(entry: dict, name: str, now: float, aliases=(), confidence: float | None = None, fresh: bool = False, verified: bool = False, promote_after: int = 2, min_confidence: float = 0.8) -> dict:
    """The entry after one more sight of it. Every sight counts, a confidence only if its
    observation is new to the entry (``fresh``); verified entries keep their trust.

    Confidences count in billionths, so that sums are exact (up to four million of them)
    and a mean that equals ``min_confidence`` reaches it in any order of observations."""
    if not name or not 0 <= (confidence or 0) <= 1:
        raise ValueError("an observation needs a canonical text and a confidence between 0 and 1, if any")
    given = [confidence] if fresh and confidence is not None else []
    e = entry | {
        "last_seen_ms": now, "occurrence_count": entry["occurrence_count"] + 1, "aliases": sorted(set(entry["aliases"]).union(filter(None, map(str.strip, aliases)))),
        "confidence_sum": sum(map(billionths, [entry["confidence_sum"], *given])) / 1e9, "confidence_count": entry["confidence_count"] + len(given),
    }
    confirmed = billionths(e["confidence_sum"]) >= billionths(min_confidence) * e["confidence_count"] > 0 and min(e["occurrence_count"], e["confidence_count"]) >= promote_after
    levels = {VERIFIED: verified or entry["trust_level"] == VERIFIED, ACCEPTED: confirmed, OBSERVED: e["occurrence_count"] > 1}
    return e | {"trust_level": next((level for level, reached in levels.items() if reached), entry["trust_level"])}


@dataclass
class MemoryState(_State):
    """Entities that a session has met, with trust that only independent, confident
    observations raise. Entries expire after ``ttl_ms`` without use (verified ones do
    not), and beyond ``capacity`` the least trusted and oldest go first."""

    capacity: int = 128
    ttl_ms: float = 1_200_000
    promote_after: int = 2
    min_confidence: float = 0.8
    entries: dict[str, dict] = field(default_factory=dict)

    def _alive(self, now: float) -> dict[str, dict]:
        self.entries = {k: e for k, e in self.entries.items() if not idle(e, now, self.ttl_ms)}
        return self.entries

    def observe(self, canonical: str, now: float, entity_type: str = "TERM", aliases=(), confidence: float | None = None,
                observation_id: str | None = None, verified: bool = False, source: str = "asr") -> dict:
        """Count one more sight of an entity; type and source stay as first seen."""
        name = canonical.strip()
        entry = self._alive(now).get(name) or {"canonical_text": name, "observation_ids": [], **new_entry(now, entity_type, source)}
        fresh = observation_id is not None and observation_id not in entry["observation_ids"]
        e = observed(entry, name, now, aliases, confidence, fresh, verified, self.promote_after, self.min_confidence)
        self.entries[name] = e | {"observation_ids": entry["observation_ids"] + [observation_id] * fresh}
        for k in heapq.nsmallest(len(self.entries) - self.capacity, self.entries, key=lambda k: worth(self.entries[k])):
            del self.entries[k]
        return e

    def trusted(self, now: float) -> list[dict]:
        return [e for e in self.snapshot(now) if e["trust_level"] in (ACCEPTED, VERIFIED)]

    def snapshot(self, now: float) -> list[dict]:
        return list(self._alive(now).values())


def final_deadline(segments: int) -> int:
    """Seconds that a final refinement may take."""
    return min(300, max(30, 15 + 8 * segments))

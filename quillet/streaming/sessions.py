"""Stateful session operators for Structured Streaming, one JSON state per session.

Each takes a streaming (or, through ``replay``, a batch) DataFrame of session events and
yields update rows. Events of a micro-batch are taken in order of ``seq``. State of idle
sessions expires by event-time timeout once a watermark passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillet.operators.masking import Entity, Protector
from quillet.operators.matching import Matcher
from quillet.operators.segments import Refiner, refine_text
from quillet.streaming import steps

IDLE_MS = 20 * 60 * 1000


def stateful(events: DataFrame, schema: str, load: Callable[[str | None], object], handle: Callable[[object, list[dict]], Iterable[dict]], mode: str = "append") -> DataFrame:
    """Groups events by ``session`` and runs ``handle(state, rows in order)`` on each
    micro-batch's rows; ``load`` makes the state from its JSON, ``dump`` writes it. With
    a column ``ts``, which must have a watermark, idle sessions expire."""
    timed = "ts" in events.columns
    columns = [part.split(" ")[0].strip() for part in schema.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            group.remove()
            return
        state = load(group.get[0] if group.exists else None)
        rows = pd.concat(batches).sort_values("seq", kind="stable").to_dict("records")
        out = [{"session": key[0], **r} for r in handle(state, rows)]
        group.update((state.dump(),))
        if timed and (watermark := group.getCurrentWatermarkMs()) > 0:
            group.setTimeoutTimestamp(watermark + IDLE_MS)
        yield pd.DataFrame(out, columns=columns)

    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return events.groupBy("session").applyInPandasWithState(run, schema, "state string", mode, timeout)


def replay(events: DataFrame, schema: str, load, handle) -> DataFrame:
    """The batch twin of ``stateful``: all events of a session in one call."""
    columns = [part.split(" ")[0].strip() for part in schema.split(", ")]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = handle(load(None), rows.sort_values("seq", kind="stable").to_dict("records"))
        return pd.DataFrame([{"session": key[0], **r} for r in out], columns=columns)

    return events.groupBy("session").applyInPandas(run, schema)


CHUNKS = "session string, index int, text string"


def chunk_events(state: steps.ChunkerState, rows: list[dict]) -> Iterator[dict]:
    """Stable chunks of cumulative hypotheses; event ``boundary`` closes the segment."""
    for row in rows:
        for index, text in state.update(row["text"] or "", row["event"] == "boundary"):
            yield {"index": index, "text": text}


SLIDING = "session string, seq long, active string, committed int, transcript string"


def sliding_events(state: steps.SlidingState, rows: list[dict], refine=lambda t: t) -> Iterator[dict]:
    for row in rows:
        yield {"seq": row["seq"], **state.add(row["text"] or "", refine)}


ROTATIONS = "session string, seq long, rotations int, transcript string"


def rotation_events(state: steps.RotationState, rows: list[dict]) -> Iterator[dict]:
    for row in rows:
        text = state.add(row["seconds"], row["text"] or "")
        yield {"seq": row["seq"], "rotations": state.count, "transcript": text}


UTTERANCES = "session string, first int, last int"


def voice_events(state: steps.VoiceState, rows: list[dict]) -> Iterator[dict]:
    for row in rows:
        span = state.add(int(row["seq"]), row["rms"], row["seconds"])
        if span:
            yield {"first": span[0], "last": span[1]}
        if row.get("event") == "finish" and (span := state.finish(int(row["seq"]))):
            yield {"first": span[0], "last": span[1]}


TRIGGERS = "session string, seq long"


def trigger_events(state: steps.TriggerState, rows: list[dict]) -> Iterator[dict]:
    for row in rows:
        if state.add(row["seconds"], final=row.get("event") == "finish"):
            yield {"seq": row["seq"]}


MEMORY = "session string, seq long, canonical_text string, trust_level string, occurrence_count int, confidence_count int, entries int"


def memory_events(state: steps.MemoryState, rows: list[dict]) -> Iterator[dict]:
    for row in rows:
        confidence = row.get("confidence")
        e = state.observe(
            row["canonical_text"], row["now_ms"], row.get("entity_type") or "TERM", row["aliases"] if row.get("aliases") is not None else (),
            None if confidence is None or confidence != confidence else confidence, row.get("observation_id"), bool(row.get("verified")),
        )
        yield {"seq": row["seq"], **{k: e[k] for k in ("canonical_text", "trust_level", "occurrence_count", "confidence_count")}, "entries": len(state.entries)}


@dataclass
class RefinementState(steps._State):
    """A session's window cache and memory; nothing is taken after ``finish``."""

    cache: dict = field(default_factory=dict)
    finished: bool = False
    last_text: str = ""
    updates: int = 0


UPDATES = "session string, seq long, event string, raw_text string, clean_text string, calls int, accepted boolean"


def refinement_events(entities: list[Entity], make_refiner: Callable[[], Refiner], domain: str = "general", mode: str = "shadow"):
    """Handler of the refinement service: hypotheses in, updates and one final out.

    Of the hypotheses that wait in a micro-batch only the newest is refined, unchanged
    text is not refined again, committed windows come from the cache, and rows after a
    ``finish`` are stale and dropped. A cancelled session yields nothing more.
    """

    def handle(state: RefinementState, rows: list[dict]) -> Iterator[dict]:
        protector = Protector(entities)
        matcher = Matcher(entities, domain, mode=mode) if entities and mode != "off" else None
        refiner = make_refiner()
        good = [True]

        def refine(text: str, auto: bool = False) -> str:
            out = refine_text(text, refiner, protector, matcher, allow_auto=auto)
            good[0] = good[0] and out.accepted
            return out.clean_text

        waiting = None
        for row in rows:
            if state.finished:
                break
            if row["event"] == "cancel":
                state.finished, waiting = True, None
            elif row["event"] == "finish":
                cache = steps.WindowCache(**state.cache)
                text = row["text"] or (waiting or {}).get("text") or state.last_text
                clean = cache.update(text, refine)
                state.cache, state.finished, waiting = cache.__dict__, True, None
                yield {"seq": row["seq"], "event": "final", "raw_text": text, "clean_text": clean, "calls": cache.calls, "accepted": good[0]}
            elif row["text"] and row["text"] != state.last_text:
                waiting = row
        if waiting is not None:
            cache = steps.WindowCache(**state.cache)
            clean = cache.update(waiting["text"], refine)
            state.cache, state.last_text = cache.__dict__, waiting["text"]
            state.updates += 1
            yield {"seq": waiting["seq"], "event": "update", "raw_text": waiting["text"], "clean_text": clean, "calls": cache.calls, "accepted": good[0]}

    return handle


def refinement_stream(events: DataFrame, entities: list[Entity], make_refiner: Callable[[], Refiner], **options) -> DataFrame:
    """events: session, seq, event (chunk, finish, cancel), text[, ts with a watermark]."""
    return stateful(events, UPDATES, RefinementState.load, refinement_events(entities, make_refiner, **options))

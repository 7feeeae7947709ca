"""Session memory, chunk order and deadlines as stateful processors with typed state.

Entries and the ids of their observations are map states, so an event reads and writes
what it touches and not the whole session. Time is event time: entries that no event has
used for the time to live go by a timer when the watermark passes, and count as gone for
any later event in any case. Deadlines are timers of processing time, and what waits for
one has a native time to live.

These need the RocksDB state store (``with_rocksdb``).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillet.streaming import sessions as ss
from quillet.streaming import steps

ENTRY = (
    "entity_type string, aliases array<string>, first_seen_ms double, last_seen_ms double, occurrence_count int, "
    "confidence_sum double, confidence_count int, trust_level string, source string"
)
_FIELDS = [part.split(" ")[0] for part in ENTRY.split(", ")]


def with_rocksdb(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def _in_order(rows: Iterator[pd.DataFrame]) -> list[dict]:
    frames = list(rows)
    return pd.concat(frames).sort_values("seq", kind="stable").to_dict("records") if frames else []


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[part.split(" ")[0] for part in schema.split(", ")])


@dataclass
class EntityMemory(StatefulProcessor):
    """What a session has met; rules and limits are those of ``steps.MemoryState``."""

    capacity: int = 128
    ttl_ms: float = 1_200_000
    promote_after: int = 2
    min_confidence: float = 0.8

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "canonical_text string", ENTRY)
        self.seen = handle.getMapState("observations", "canonical_text string, observation_id string", "at_ms double")

    def _all(self) -> dict[str, dict]:
        return {k[0]: dict(zip(_FIELDS, v)) for k, v in self.entries.iterator()}

    def _forget(self, names: list[str]) -> None:
        gone = set(names)
        for name in gone:
            self.entries.removeKey((name,))
        for key in [k for k in self.seen.keys() if k[0] in gone] if gone else []:
            self.seen.removeKey(tuple(key))

    def _evict(self, now: float) -> dict[str, dict]:
        """The entries that are alive; what is idle or beyond the capacity goes."""
        entries = self._all()
        idle = [k for k, e in entries.items() if steps.idle(e, now, self.ttl_ms)]
        alive = {k: e for k, e in entries.items() if k not in idle}
        extra = heapq.nsmallest(len(alive) - self.capacity, alive, key=lambda k: steps.worth(alive[k]))
        self._forget([*idle, *extra])
        return {k: e for k, e in alive.items() if k not in extra}

    def _observe(self, row: dict) -> dict:
        name, now, confidence = row["canonical_text"].strip(), row["now_ms"], row.get("confidence")
        confidence = None if confidence is None or confidence != confidence else confidence
        known = self.entries.getValue((name,))
        e = dict(zip(_FIELDS, known)) if known else None
        if e and steps.idle(e, now, self.ttl_ms):
            self._forget([name])
            e = None
        ident = row.get("observation_id")
        fresh = ident is not None and not self.seen.containsKey((name, ident))
        if fresh:
            self.seen.updateValue((name, ident), (now,))
        aliases = row["aliases"] if row.get("aliases") is not None else ()
        e = steps.observed(e or steps.new_entry(now, row.get("entity_type") or "TERM"), name, now, aliases, confidence, fresh, bool(row.get("verified")), self.promote_after, self.min_confidence)
        self.entries.updateValue((name,), tuple(e[f] for f in _FIELDS))
        alive = self._evict(now)
        return {"seq": row["seq"], "canonical_text": name, **{k: e[k] for k in ("trust_level", "occurrence_count", "confidence_count")}, "entries": len(alive)}

    def _wake(self) -> None:
        """One timer a session: when the first of its entries may be idle."""
        if not any(True for _ in self.handle.listTimers()):
            due = [e["last_seen_ms"] + self.ttl_ms for e in self._all().values() if e["trust_level"] != steps.VERIFIED]
            if due:
                self.handle.registerTimer(int(min(due)) + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = [{"session": key[0], **self._observe(r)} for r in _in_order(rows)]
        self._wake()
        yield _frame(out, ss.MEMORY)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._evict(timerValues.getCurrentWatermarkInMs())
        self._wake()
        yield _frame([], ss.MEMORY)

    def close(self) -> None:
        pass


def memory_stream(observations: DataFrame, **limits) -> DataFrame:
    """``observations`` (session, seq, canonical_text, now_ms, ts with a watermark[, entity_type,
    aliases, confidence, observation_id, verified]) to a row of ss.MEMORY for each of them."""
    return observations.groupBy("session").transformWithStateInPandas(EntityMemory(**limits), ss.MEMORY, "Append", "EventTime")


ORDERED = "session string, seq long, pcm binary, error string, missing long"


class ChunkOrder(StatefulProcessor):
    """Chunks of each session once each: repeats are dropped, and a chunk tells how many
    before it are missing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        expected = self.next.get()[0] if self.next.exists() else 0
        out = []
        for row in _in_order(rows):
            if row["seq"] >= expected:
                out.append({"session": key[0], **{k: row[k] for k in ("seq", "pcm", "error")}, "missing": row["seq"] - expected})
                expected = row["seq"] + 1
        self.next.update((int(expected),))
        yield _frame(out, ORDERED)

    def close(self) -> None:
        pass


def ordered_chunks(chunks: DataFrame) -> DataFrame:
    """A chunk source's rows (session, seq, pcm, error) with ``missing``, without repeats."""
    return chunks.groupBy("session").transformWithStateInPandas(ChunkOrder(), ORDERED, "Append", "None")


FINALS = "session string, seq long, clean_text string, accepted boolean, reason string"


@dataclass
class FinalDeadline(StatefulProcessor):
    """Final refinements against their deadlines. A ``request`` (its text is the baseline)
    waits for its ``result``; whichever comes first, the result or the deadline, gives the
    session's one final row. Results that come later are dropped.

    ``scale_ms``: milliseconds of a second of the deadline.
    """

    scale_ms: int = 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # what is left of a request that neither ended nor timed out goes after a day
        self.waiting = handle.getValueState("waiting", "seq long, baseline string, due_ms long", ttlDurationMs=86_400_000)

    def _final(self, key, text: str, reason: str | None) -> dict:
        seq, _, due = self.waiting.get()
        self.handle.deleteTimer(due)
        self.waiting.clear()
        return {"session": key[0], "seq": seq, "clean_text": text, "accepted": reason is None, "reason": reason}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for row in _in_order(rows):
            if row["event"] == "request" and not self.waiting.exists():
                due = timerValues.getCurrentProcessingTimeInMs() + steps.final_deadline(int(row["segments"])) * self.scale_ms
                self.waiting.update((int(row["seq"]), row["text"], due))
                self.handle.registerTimer(due)
            elif row["event"] == "result" and self.waiting.exists():
                out.append(self._final(key, row["text"], None))
        yield _frame(out, FINALS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.waiting.exists() and self.waiting.get()[2] <= timerValues.getCurrentProcessingTimeInMs():
            _, baseline, due = self.waiting.get()
            out.append(self._final(key, baseline, "refiner_timeout"))
        yield _frame(out, FINALS)

    def close(self) -> None:
        pass


def final_stream(events: DataFrame, scale_ms: int = 1000) -> DataFrame:
    """``events`` (session, seq, event request or result, text, segments) to FINALS."""
    return events.groupBy("session").transformWithStateInPandas(FinalDeadline(scale_ms), FINALS, "Append", "ProcessingTime")

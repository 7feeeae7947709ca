"""Ordered-sequence operators over chunk streams: sliding refinement, rotation, voice
activity, rolling triggers. Batch forms of the streaming operators; both share the
step functions of ``quillet.streaming.steps``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.functions.chunking import chunks_column
from quillet.functions.text import join_chunks
from quillet.streaming import steps


def sliding_refinement(chunks: DataFrame, size: int = 3) -> DataFrame:
    """For each chunk (session, pos, text): the active source (the last ``size`` chunks
    joined), the number of committed chunks, and the transcript of both with an identity
    refiner."""
    by = Window.partitionBy("session").orderBy("pos")
    active = F.collect_list("text").over(by.rowsBetween(-(size - 1), 0))
    every = F.collect_list("text").over(by.rowsBetween(Window.unboundedPreceding, 0))
    older = F.slice(every, F.lit(1), F.greatest(F.size(every) - size, F.lit(0)))
    return chunks.select(
        "session", "pos", join_chunks(active).alias("active"), F.size(older).alias("committed"),
        join_chunks(F.concat(older, F.array(join_chunks(active)))).alias("transcript"),
    )


def changed_text(rows: DataFrame) -> DataFrame:
    """Rows (session, pos, text) whose text differs from the one before; null and empty
    texts never count as a change."""
    before = F.lag("text").over(Window.partitionBy("session").orderBy("pos"))
    return rows.withColumn("_b", F.coalesce(before, F.lit(""))).where("coalesce(text, '') <> '' and text <> _b").drop("_b")


def after_offset(rows: DataFrame, processed: Column) -> DataFrame:
    """Rows of each session beyond the number that was processed."""
    n = F.row_number().over(Window.partitionBy("session").orderBy("pos"))
    return rows.withColumn("_n", n).where(F.col("_n") > processed).drop("_n")


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, False).cast("int")
    return F.when(first > 0, first - 1).otherwise(F.least(F.size(a), F.size(b)))


def chunked_segments(segments: DataFrame, limit: int = 80) -> DataFrame:
    """Chunks (session, index, text) of the closed voice segments (session, seq, text) of a
    session: each segment is chunked by itself, indexes go on through the session."""
    parts = segments.select("session", "seq", F.posexplode(chunks_column(F.col("text"), limit)).alias("k", "text"))
    index = F.row_number().over(Window.partitionBy("session").orderBy("seq", "k")) - 1
    return parts.select("session", index.alias("index"), "text")


def cached_windows(updates: DataFrame, size: int = 3, limit: int = 80) -> DataFrame:
    """What a window cache does with the cumulative texts (session, seq, text) of a session:
    session, seq, committed (chunks before the window), reused (of these, known from the
    update before), revised (known ones that this text has changed), active (the window's
    text) and calls (refiner calls so far).

    Each update is compared with the one before by the keys of its chunks, so a session is
    read once, in order; no update meets all others.
    """
    by = Window.partitionBy("session").orderBy("seq")
    chunked = updates.select("session", "seq", chunks_column(F.coalesce("text", F.lit("")), limit).alias("chunks"))
    older = F.greatest(F.size("chunks") - size, F.lit(0))
    keyed = chunked.select(
        "session", "seq", F.transform(F.slice("chunks", F.lit(1), older), lambda c: F.xxhash64(c)).alias("keys"),
        join_chunks(F.slice("chunks", older + 1, F.lit(size))).alias("active"),
    )
    met = keyed.withColumn("before", F.lag("keys").over(by)).withColumn("other", ~F.col("active").eqNullSafe(F.lag("active").over(by)))
    met = met.withColumn("committed", F.size("keys")).withColumn(
        "reused", F.when(F.col("before").isNull(), 0).otherwise(shared_prefix(F.col("before"), F.col("keys")))
    )
    fresh = F.col("committed") - F.col("reused") + F.col("other").cast("int")
    return met.select(
        "session", "seq", "committed", "reused", (F.coalesce(F.size("before"), F.lit(0)) - F.col("reused")).alias("revised"), "active",
        F.sum(fresh).over(by).cast("int").alias("calls"),
    )


def utterances(windows: DataFrame, threshold: float = 0.02, min_silence: float = 0.5, min_speech: float = 0.2, preroll: float = 0.7) -> DataFrame:
    """Utterances (session, first, last) of energy windows (session, pos, rms, seconds).

    Speech of ``min_speech`` seconds opens an utterance and silence of ``min_silence``
    closes it at its last window; what is open at the end is closed there. It begins with
    the window that reaches back ``preroll`` seconds from where it was opened: an ordered
    range over the time that has gone by.
    """
    by = Window.partitionBy("session").orderBy("pos")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    ms = lambda c: F.round(c * 1000).cast("long")
    timed = windows.select("session", "pos", (F.col("rms") > threshold).alias("loud"), ms(F.col("seconds")).alias("ms"))
    timed = timed.withColumn("at", F.sum("ms").over(so_far)).withColumn("turned", (~F.col("loud").eqNullSafe(F.lag("loud").over(by))).cast("int"))
    timed = timed.withColumn("run", F.sum("turned").over(so_far))
    back = Window.partitionBy("session").orderBy("at").rangeBetween(1 - round(preroll * 1000), 0)
    timed = timed.withColumn("first", F.first("pos").over(back)).withColumn("end", F.last("pos").over(by.rowsBetween(0, Window.unboundedFollowing)))
    held = F.sum("ms").over(Window.partitionBy("session", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    needed = F.when(F.col("loud"), round(min_speech * 1000)).otherwise(round(min_silence * 1000))
    # where a run of one kind has lasted long enough
    turns = timed.withColumn("held", held).where((F.col("held") >= needed) & (F.col("held") - F.col("ms") < needed))
    turns = turns.withColumn("was", F.coalesce(F.lag("loud").over(by), F.lit(False))).where("loud <> was")
    return turns.withColumn("last", F.coalesce(F.lead("pos").over(by), F.col("end"))).where("loud").select("session", "first", "last")


def ranked_margin(scores: DataFrame) -> DataFrame:
    """Best entity of each span with runner-up score and margin (1.0 when alone).

    ``scores``: span, entity_id, score, priority.
    """
    by = Window.partitionBy("span").orderBy(F.desc("score"), F.desc("priority"), "entity_id")
    out = scores.withColumn("n", F.row_number().over(by)).withColumn("runner_up", F.lead("score").over(by)).where("n = 1")
    return out.select("span", "entity_id", "score", "runner_up", F.coalesce(F.col("score") - F.col("runner_up"), F.lit(1.0)).alias("margin"))


def _fold(rows: DataFrame, fields: list[str], state: Column, step, out: Column) -> DataFrame:
    """Folds the ordered rows of each session natively: one array, one aggregate."""
    listed = rows.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("pos", *fields))).alias("_r"))
    return listed.select("session", F.aggregate("_r", state, step, out).alias("_o"))


def rotations(rows: DataFrame, soft: float = 30.0, hard: float = 45.0) -> DataFrame:
    """(session, rotations): how often a segment is closed. Rows have seconds and text; a
    segment closes at the hard limit, or at the soft one if the text ends a sentence."""
    ends = lambda t: t.rlike(steps.SENTENCE_CLOSED_JAVA)

    def step(s, r):
        total = s["held"] + r["seconds"]
        close = (total >= hard) | ((total >= soft) & F.coalesce(ends(r["text"]), F.lit(False)))
        return F.struct(F.when(close, 0.0).otherwise(total).alias("held"), (s["n"] + close.cast("int")).alias("n"))

    start = F.struct(F.lit(0.0).alias("held"), F.lit(0).alias("n"))
    folded = _fold(rows, ["seconds", "text"], start, step, lambda s: s["n"])
    return folded.withColumnRenamed("_o", "rotations")


def energy_segments(windows: DataFrame, threshold: float = 0.02, min_silence: float = 0.5, min_speech: float = 0.2) -> DataFrame:
    """(session, utterances): utterances that energy detection closes, from windows of
    rms and seconds."""

    def step(s, r):
        loud = r["rms"] > threshold
        speech = F.when(loud, s["speech"] + r["seconds"]).otherwise(0.0)
        silence = F.when(loud, 0.0).otherwise(s["silence"] + r["seconds"])
        on = s["on"] | (loud & (speech >= min_speech))
        off = s["on"] & ~loud & (silence >= min_silence)
        return F.struct(speech.alias("speech"), silence.alias("silence"), (on & ~off).alias("on"), (s["n"] + off.cast("int")).alias("n"))

    start = F.struct(F.lit(0.0).alias("speech"), F.lit(0.0).alias("silence"), F.lit(False).alias("on"), F.lit(0).alias("n"))
    return _fold(windows, ["rms", "seconds"], start, step, lambda s: s["n"]).withColumnRenamed("_o", "utterances")


def rolling_triggers(rows: DataFrame, interval: float = 1.5) -> DataFrame:
    """(session, triggers): re-transcriptions, each once at least ``interval`` seconds are
    new, and one at the end if anything is left."""

    def step(s, r):
        total = s["new"] + r["seconds"]
        fire = total >= interval
        return F.struct(F.when(fire, 0.0).otherwise(total).alias("new"), (s["n"] + fire.cast("int")).alias("n"))

    start = F.struct(F.lit(0.0).alias("new"), F.lit(0).alias("n"))
    return _fold(rows, ["seconds"], start, step, lambda s: s["n"] + (s["new"] > 0).cast("int")).withColumnRenamed("_o", "triggers")


def latest_only(rows: DataFrame) -> DataFrame:
    """The newest row of each session in a batch: what a one-place queue would hold."""
    rest = [c for c in rows.columns if c not in ("session",)]
    return rows.groupBy("session").agg(F.max_by(F.struct(*rest), "pos").alias("_l")).select("session", "_l.*")


def outside_blocked(spans: DataFrame, blocked: DataFrame, key: str) -> DataFrame:
    """Spans (key, start, end) that overlap no blocked span of the same key."""
    b = blocked.select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    hit = (F.col(key) == F.col("_k")) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end"))
    return spans.join(b, hit, "left_anti")


def greedy_spans(ranked: Column) -> Column:
    """Spans (start, end, ...) of an array in order of rank, each kept unless it overlaps
    a kept one: the array form of greedy non-overlap selection."""
    return F.aggregate(
        ranked, F.slice(ranked, 1, 0),
        lambda kept, s: F.when(
            F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])), kept
        ).otherwise(F.concat(kept, F.array(s))),
    )


def top_per_group(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("_n", n).where(F.col("_n") <= k).drop("_n")

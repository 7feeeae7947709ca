"""Session operators of the streaming service over whole tables, through their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillet.functions import text as tx
from quillet.operators import windows as wn
from quillet.operators.segments import identity
from quillet.plans.base import SQL_SPACE, sql_strip, table
from quillet.plans.text_queries import SQL_ORDERED, sql_glue
from quillet.registry import query
from quillet.streaming import sessions as ss
from quillet.streaming import steps


def turns(spark, sf_dir):
    """conversations as events: one session each, turns in order."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("seq"), "text", (F.length("text") / 20.0).alias("seconds"),
        F.lit("boundary").alias("event"),
    )


@query("g05_sliding_session", f"""WITH t AS (SELECT conv_id::VARCHAR AS session, turn AS seq, {sql_strip('text')} AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
l AS (SELECT *, lag(c) OVER w AS b, lag(c, 2) OVER w AS a FROM t WINDOW w AS (PARTITION BY session ORDER BY seq)), g AS (SELECT *, {sql_glue('a', 'b')} AS ab FROM l)
SELECT session, seq, md5({sql_glue('ab', 'c')}) AS active_md5, greatest(k - 3, 0)::INT AS committed FROM g""")
def g05(spark, sf_dir):
    out = ss.replay(turns(spark, sf_dir), ss.SLIDING, steps.SlidingState.load, ss.sliding_events)
    return out.select("session", "seq", F.md5("active").alias("active_md5"), "committed")


@query("g04_chunk_session", rf"""
WITH RECURSIVE t AS (SELECT conv_id::VARCHAR AS session, turn AS seq, {sql_strip('text')} AS t FROM conversations WHERE text IS NOT NULL),
c(session, seq, k, b, chunk) AS (
  SELECT session, seq, 0, 0, NULL::VARCHAR FROM t
  UNION ALL
  SELECT session, seq, k + 1, b + n, substr(w, 1, n) FROM (
    SELECT session, seq, k, b, w, CASE WHEN sentence <> '' AND length(sentence) <= 80 THEN length(sentence)
      WHEN length(w) <= 80 THEN length(w) WHEN soft <> '' THEN length(soft) ELSE 80 END AS n
    FROM (
      SELECT session, seq, k, b, w, regexp_extract(w, '^[^{tx.SENTENCE_END}]*[{tx.SENTENCE_END}]{SQL_SPACE}*') AS sentence,
        regexp_extract(substr(w, 1, 80), '^(?s:.*)[{tx.SOFT_BREAK}]{SQL_SPACE}*') AS soft
      FROM (SELECT c.session, c.seq, k, b, substr(t, b + 1, 81) AS w FROM c JOIN t USING (session, seq) WHERE b < length(t))
    )
  )
), p AS (SELECT session, seq, k, {sql_strip('chunk')} AS text FROM c WHERE k > 0)
SELECT session, (row_number() OVER (PARTITION BY session ORDER BY seq, k) - 1)::INT AS index, text FROM p WHERE text <> ''
""")
def g04(spark, sf_dir):
    """Each turn is a voice segment of its own; chunk indexes go on through the session."""
    return wn.chunked_segments(turns(spark, sf_dir))


@query("g11_rotation_session", f"""WITH RECURSIVE {SQL_ORDERED}, f AS (SELECT session, 0::BIGINT AS k, 0.0::DOUBLE AS held, 0 AS n FROM (SELECT DISTINCT session FROM o)
  UNION ALL SELECT o.session, o.k, CASE WHEN c THEN 0.0 ELSE total END, n + c::INT FROM (SELECT f.session, o.k, f.n, f.held + o.seconds AS total, (f.held + o.seconds >= 45 OR (f.held + o.seconds >= 30 AND regexp_matches(o.text, '[.!?。！？]["''”’》〉』】）)]*$'))) AS c FROM f JOIN o ON o.session = f.session AND o.k = f.k + 1) o)
SELECT session::VARCHAR AS session, max(n)::INT AS rotations FROM f GROUP BY session""")
def g11(spark, sf_dir):
    out = ss.replay(turns(spark, sf_dir), ss.ROTATIONS, steps.RotationState.load, ss.rotation_events)
    return out.groupBy("session").agg(F.max("rotations").alias("rotations"))


# confidences are summed in billionths: sums of doubles depend on their order where a mean is 0.3 exactly
SQL_TRUSTED = "count(c) >= 2 AND sum(floor(c * 1e9 + 0.5)::BIGINT) >= 300000000 * count(c)"
SQL_SEEN = "o AS (SELECT user_id::VARCHAR AS session, event_type AS canonical_text, event_id, CASE WHEN event_id % 3 > 0 THEN least(1.0, value / 100) END AS c FROM events)"


@query("g07_session_memory", f"""WITH {SQL_SEEN} SELECT session, canonical_text, count(*)::INT AS occurrence_count, count(c)::INT AS confidence_count,
  CASE WHEN {SQL_TRUSTED} THEN 'ACCEPTED' WHEN count(*) > 1 THEN 'OBSERVED' ELSE 'PROVISIONAL' END AS trust_level FROM o GROUP BY ALL""")
def g07(spark, sf_dir):
    """Trust in each user's event types after all observations, none of them expired."""
    confidence = F.when(F.col("event_id") % 3 > 0, F.least(F.lit(1.0), F.col("value") / 100))
    seen = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("canonical_text"),
        confidence.alias("confidence"), F.col("event_id").cast("string").alias("observation_id"), F.lit(0.0).alias("now_ms"),
    )
    load = lambda raw: steps.MemoryState.load(raw) if raw else steps.MemoryState(min_confidence=0.3)
    out = ss.replay(seen, ss.MEMORY, load, ss.memory_events)
    last = out.groupBy("session", "canonical_text").agg(F.max_by(F.struct("occurrence_count", "confidence_count", "trust_level"), "seq").alias("l"))
    return last.select("session", "canonical_text", "l.*")


@query("g10_trusted_entities", f"WITH {SQL_SEEN} SELECT session, count(*) AS trusted FROM (SELECT session, canonical_text FROM o GROUP BY ALL HAVING {SQL_TRUSTED}) GROUP BY session")
def g10(spark, sf_dir):
    return g07(spark, sf_dir).where("trust_level in ('ACCEPTED', 'VERIFIED')").groupBy("session").agg(F.count("*").alias("trusted"))


@query("g14_refinement_service", f"SELECT conv_id::VARCHAR AS session, max(turn) + 1 AS seq, 'final' AS event, md5({sql_strip('max_by(text, turn)')}) AS raw_md5, true AS accepted FROM conversations GROUP BY conv_id")
def g14(spark, sf_dir):
    """Each session's hypotheses, then a finish: one final with the newest text."""
    t = turns(spark, sf_dir).select("session", "seq", F.lit("chunk").alias("event"), F.btrim("text").alias("text"))
    ends = t.groupBy("session").agg((F.max("seq") + 1).alias("seq")).select("session", "seq", F.lit("finish").alias("event"), F.lit(None).cast("string").alias("text"))
    out = ss.replay(t.unionByName(ends), ss.UPDATES, ss.RefinementState.load, ss.refinement_events([], lambda: identity, mode="off"))
    return out.select("session", "seq", "event", F.md5("raw_text").alias("raw_md5"), "accepted")


@query("g15_stale_events", "SELECT conv_id::VARCHAR AS session, count(*) FILTER (WHERE turn > 2) AS stale FROM conversations GROUP BY conv_id")
def g15(spark, sf_dir):
    """Events after a session's finish, here its third turn, yield nothing."""
    t = turns(spark, sf_dir).select("session", "seq", F.when(F.col("seq") == 2, "finish").otherwise("chunk").alias("event"), "text")
    out = ss.replay(t, ss.UPDATES, ss.RefinementState.load, ss.refinement_events([], lambda: identity, mode="off"))
    last = out.groupBy("session").agg(F.max("seq").alias("last"), F.max(F.col("event") == "final").alias("finished"))
    joined = t.join(last, "session", "left")
    return joined.groupBy("session").agg(F.count_if((F.col("seq") > F.col("last")) & F.col("finished")).alias("stale"))

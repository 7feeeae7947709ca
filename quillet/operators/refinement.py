"""The batch refinement flow as stages over a table of segments.

Texts are cut into segments; exact spans, fuzzy matches and masks are relations and
columns (``spans``, ``fuzzy``); only the external refiner is called per row, with the
masked text and its hints. What it returns is restored and checked in columns, what may
be tried again goes through one strict call, and segments are put together by id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.functions.chunking import guard_column, windows_column
from quillet.functions.text import join_chunks
from quillet.operators import spans as sp
from quillet.operators.fuzzy import fuzzy_matches
from quillet.operators.matching import MatchConfig
from quillet.operators.segments import PLACEHOLDER_FAILURES, RETRYABLE, Refiner
from quillet.sources.store import discard, shared_table

NONE = "array<string>"
OUTCOME = [
    "clean_text", "accepted", "reasons", "audit_issues", "hints", "retries", "placeholder_retries", "retry_reasons", "masked_outputs", "normalizations", "error",
]


def _no_names() -> Column:
    return F.array().cast(NONE)


def marks_failed(reasons: Column) -> Column:
    return F.exists(reasons, lambda r: reduce(lambda a, b: a | b, [F.startswith(r, F.lit(p)) for p in PLACEHOLDER_FAILURES]))


def retryable(reasons: Column) -> Column:
    """Whether a rejected segment is worth a strict call."""
    return marks_failed(reasons) | F.exists(reasons, lambda r: r.isin(*RETRYABLE))


def times(text: Column, part: Column) -> Column:
    """How often ``part`` stands in ``text``, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def introduced(restored: Column, baseline: Column, hints: Column, matches: Column) -> Column:
    """Reasons for hints that the text has more often than it has used up what was heard."""

    def more(name):
        heard = F.filter(matches, lambda m: (m["canonical"] == name) & (times(baseline, m["observed"]) > times(restored, m["observed"])))
        added = times(restored, name) - times(baseline, name)
        return (added > 0) & (added > F.size(heard))

    return F.transform(F.filter(hints, more), lambda name: F.concat(F.lit("introduced_entity_from_hint:"), name))


def prepared(segments: DataFrame, dictionary: DataFrame | None, domain: str, mode: str, allow_auto: bool, sounds: DataFrame | None, config: MatchConfig) -> DataFrame:
    """Stored ``segments`` (id, text; each id once) with masked_text, spans, baseline (the text with all
    replacements), hints and matches (canonical, observed)."""
    exact = sp.protect_unique(segments, dictionary)
    ready, found = exact, None
    if dictionary is not None and mode != "off":
        exact = shared_table(exact, "exact")
        blocked = exact.select("id", F.inline("spans")).select("id", "start", "end")
        found = shared_table(fuzzy_matches(segments, dictionary, domain, config, mode, allow_auto, blocked, sounds), "matches")
        ready = sp.protect_unique(segments, dictionary, fuzzy=found) if mode == "auto" and allow_auto else exact
    kind = "array<struct<start:int,canonical:string,observed:string,decision:string>>"
    if found is None:
        ready = ready.withColumn("matches", F.array().cast(kind))
    else:
        listed = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "canonical", "observed", "decision"))).alias("matches"))
        ready = ready.join(listed, "id", "left").withColumn("matches", F.coalesce("matches", F.array().cast(kind)))
    suggested = F.transform(F.filter("matches", lambda m: m["decision"] == "HINT_ONLY"), lambda m: m["canonical"])
    spans, text, masked = F.col("spans"), F.col("text"), F.col("masked_text")
    # what is as the text is not stored again
    baseline, plain = sp.restored(masked, text, masked, spans)["text"], F.size(spans) == 0
    done = shared_table(ready.select(
        "id", "text", F.when(~plain, masked).alias("masked_text"), "spans", "matches", baseline.alias("baseline"),
        F.slice(F.array_distinct(F.concat(sp.hints(spans), suggested)), 1, config.max_refiner_hints).alias("hints"),
    ).withColumn("baseline", F.when(F.col("baseline") != text, F.col("baseline"))), "prepared")
    for table in (exact, found) if found is not None else ():
        discard(table)
    return done.withColumns({c: F.coalesce(c, "text") for c in ("masked_text", "baseline")})


def called(ready: DataFrame, make_refiner: Callable[[], Refiner], strict: bool) -> DataFrame:
    """``ready`` with output and error: one call for each masked text with its hints. The
    refiner is made once per task; where it fails, the output is null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refine = make_refiner()
        for batch in batches:
            out = []
            for masked, hints in zip(batch["masked_text"], batch["hints"]):
                try:
                    out.append((refine(masked, list(hints), strict), None))
                except Exception as error:  # an external model may fail in any way
                    out.append((None, f"refiner_error: {error}"))
            yield pd.DataFrame({"output": [o for o, _ in out], "error": [e for _, e in out]}, dtype=object)

    # an outer model: Spark may not work it out twice
    call = F.pandas_udf(run, "output string, error string").asNondeterministic()
    return ready.withColumn("o", call(F.struct("masked_text", "hints"))).select("*", "o.output", "o.error").drop("o")


def checked(met: DataFrame, strict: bool) -> DataFrame:
    """``met`` (prepared segments with output and error) with clean_text and reasons: the
    restored output, or the baseline and why; audit_issues and normalizations. Only what
    is tried again keeps what was prepared for it, so a text is stored as few times as it
    can be."""
    baseline = F.col("baseline")
    met = met.withColumn("r", sp.restored(F.col("output"), F.col("text"), F.col("masked_text"), F.col("spans")))
    guard = guard_column(baseline, F.col("r.text"))
    wrong = F.concat(introduced(F.col("r.text"), baseline, F.col("hints"), F.col("matches")), guard)
    reasons = F.when(F.col("error").isNotNull(), F.array(F.lit("refiner_error"))).when(F.size("r.reasons") > 0, F.col("r.reasons")).otherwise(wrong)
    # what can be tried again is looked up again: the call is not repeated for it
    done = met.withColumn("reasons", reasons).withColumn("clean_text", F.when(F.size("reasons") > 0, baseline).otherwise(F.col("r.text"))).drop("r")
    changed = F.filter("spans", lambda s: s["original"] != s["replacement"])
    done = done.withColumns({
        "audit_issues": sp.audit(F.col("clean_text"), F.col("spans")),
        "normalizations": F.transform(changed, lambda s: F.concat(s["original"], F.lit("->"), s["replacement"])),
    })
    again = F.lit(False) if strict else tried_again()
    return shared_table(done.withColumns({c: F.when(again, F.col(c)) for c in ("text", "masked_text", "spans", "baseline", "matches")}), "checked")


def tried_again() -> Column:
    return retryable(F.col("reasons")) & F.col("error").isNull()


def refine_batch(rows: DataFrame, dictionary: DataFrame | None, make_refiner: Callable[[], Refiner], domain: str = "general", mode: str = "shadow", allow_auto: bool = True,
                 limit: int | None = None, sounds: DataFrame | None = None, config: MatchConfig = MatchConfig()) -> DataFrame:
    """``rows`` (id, text) refined: id and OUTCOME.

    ``dictionary`` is an entity view. With ``limit`` texts are refined in windows of that
    many characters, else whole. A null or blank text gives an input error. An id stands
    for one text.
    """
    rows = rows.select("id", "text").distinct()
    blank = F.coalesce(sp.stripped(F.col("text")) == "", F.lit(True))
    cut = windows_column(F.col("text"), limit) if limit else F.array("text")
    parts = rows.where(~blank).select("id", F.posexplode(cut).alias("seg", "text"))
    segments = shared_table(parts.select(F.struct("id", "seg").alias("id"), "text"), "segments")
    ready = prepared(segments, dictionary, domain, mode, allow_auto, sounds, config)

    first = checked(called(ready, make_refiner, strict=False), strict=False)
    for table in (segments, ready):
        discard(table)
    again = tried_again()
    retried = first.where(again).select(*ready.columns, F.col("output").alias("o1"), F.col("reasons").alias("r1"))
    second = checked(called(retried, make_refiner, strict=True), strict=True)
    names = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(_no_names())
    once = first.where(~again).select("*", F.lit(0).alias("retries"), F.lit(0).alias("placeholder_retries"), _no_names().alias("retry_reasons"), names("output").alias("masked_outputs"))
    twice = second.select(
        "*", F.lit(1).alias("retries"), marks_failed(F.col("r1")).cast("int").alias("placeholder_retries"), F.col("r1").alias("retry_reasons"), F.concat(F.array("o1"), names("output")).alias("masked_outputs"),
    ).drop("o1", "r1")
    done = once.unionByName(twice).select(
        F.col("id.id").alias("id"), F.struct(
            F.col("id.seg").alias("seg"), "clean_text", "reasons", "audit_issues", "hints", "retries", "placeholder_retries", "retry_reasons",
            "masked_outputs", "normalizations", "error",
        ).alias("s"),
    )
    return _merged(done).unionByName(_input_errors(rows.where(blank)))


def _merged(segments: DataFrame) -> DataFrame:
    """Segments of a text as one: texts joined, counts summed, lists in order; reasons are
    numbered if there are several."""
    listed = segments.groupBy("id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    several = F.size("s") > 1
    tagged = lambda f: F.flatten(F.transform("s", lambda s, i: F.transform(s[f], lambda r: F.when(several, F.concat(F.lit("segment_"), i.cast("string"), F.lit(":"), r)).otherwise(r))))
    flat = lambda f: F.flatten(F.transform("s", lambda s: s[f]))
    total = lambda f: F.aggregate("s", F.lit(0), lambda n, s: n + s[f])
    values = {
        "clean_text": join_chunks(F.transform("s", lambda s: s["clean_text"])), "accepted": F.forall("s", lambda s: F.size(s["reasons"]) == 0), "reasons": tagged("reasons"),
        "audit_issues": flat("audit_issues"), "hints": flat("hints"), "retries": total("retries"), "placeholder_retries": total("placeholder_retries"), "retry_reasons": tagged("retry_reasons"),
        "masked_outputs": flat("masked_outputs"), "normalizations": flat("normalizations"), "error": F.get(F.filter(F.transform("s", lambda s: s["error"]), lambda e: e.isNotNull()), F.lit(0)),
    }
    return listed.select("id", *[v.alias(k) for k, v in values.items()])


def _input_errors(rows: DataFrame) -> DataFrame:
    values = dict.fromkeys(OUTCOME, _no_names()) | {
        "clean_text": F.lit(""), "accepted": F.lit(False), "retries": F.lit(0), "placeholder_retries": F.lit(0), "error": F.lit("input_error: missing text"),
    }
    return rows.select("id", *[values[k].alias(k) for k in OUTCOME])

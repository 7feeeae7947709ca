"""Benchmark evaluation: reading records, matching, judging, resumable logs, summaries.

Records arrive as JSON strings; wrong shapes raise where the benchmark must be complete,
and give null where a missing value has a meaning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.functions.metrics import text_metrics
from quillet.functions.text import blank_to_null, strip
from quillet.sources.store import shared_table

CATEGORIES = ("content", "format", "filter", "rephrase")
NO_OUTPUT = "ASR output is empty or unsuccessful"
OPTION = r"\A\s*(.+?)\s*[（(]\s*(-?\d+)\s*[）)]\s*\z"
JOINED = r"(?:\A|[，,])\s*(.+?)\s*[（(]\s*(-?\d+)\s*[）)](?=\s*[，,]|\s*\z)"
OPTIONS = "array<struct<text:string,score:int>>"


class DataError(ValueError):
    """A table breaks a rule that the evaluation depends on."""


def require_unique(df: DataFrame, key: str, what: str) -> DataFrame:
    """``df``, or DataError if a key is null, blank or repeated."""
    bad = df.groupBy(key).count().where(F.col("count").__gt__(1) | F.col(key).isNull() | (strip(F.col(key).cast("string")) == "")).limit(1).collect()
    if bad:
        raise DataError(f"{what}: key {bad[0][0]!r} is missing or repeated")
    return df


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def text_at(record: Column, path: str) -> Column:
    """Stripped non-blank string at a dotted path of a JSON record, else null."""
    parts = F.try_parse_json(record)
    value = F.try_variant_get(parts, F.lit("$." + path), "string")
    is_text = F.schema_of_variant(F.try_variant_get(parts, F.lit("$." + path), "variant")) == "STRING"
    return F.when(is_text, blank_to_null(strip(value)))


def number_at(record: Column, path: str) -> Column:
    """Finite number of at least 0 at a path (booleans and strings are none), else null."""
    variant = F.try_variant_get(F.try_parse_json(record), F.lit("$." + path), "variant")
    numeric = F.schema_of_variant(variant).rlike(r"\A(BIGINT|DOUBLE|FLOAT|INT|SMALLINT|TINYINT|DECIMAL.*)\z")
    value = F.try_variant_get(variant, F.lit("$"), "double")
    return F.when(numeric & (value >= 0) & (value < float("inf")), value)


def flag_at(record: Column, path: str) -> Column:
    """True only for a JSON true."""
    variant = F.try_variant_get(F.try_parse_json(record), F.lit("$." + path), "variant")
    return F.coalesce((F.schema_of_variant(variant) == "BOOLEAN") & F.try_variant_get(variant, F.lit("$"), "boolean"), F.lit(False))


def asr_text(record: Column, path: str | None = None) -> Column:
    if path:
        return text_at(record, path)
    formal = F.when(text_at(record, "formalasr_status") == "ok", text_at(record, "formalasr_text"))
    return F.coalesce(F.when(flag_at(record, "output.ok"), text_at(record, "output.clean_text")), formal)


def asr_latency(record: Column) -> Column:
    at = lambda p: number_at(record, p)
    return F.coalesce(
        at("output.total_latency_ms"), at("total_latency_ms"), at("formalasr_latency_ms"),
        at("output.stt_latency_ms") + at("output.llm_latency_ms"), at("latency_ms"),
    )


def asr_error(record: Column) -> Column:
    return F.coalesce(text_at(record, "output.error"), text_at(record, "formalasr_error_message"), F.lit(NO_OUTPUT))


def parse_options(raw: Column) -> Column:
    """Options from a JSON value: a list of objects, a list of "text (n)" strings, or one
    string of such options joined by commas. Null where any part fits none of these."""
    variant = F.try_parse_json(raw)
    kind = F.schema_of_variant(variant)
    objects = F.from_json(raw, OPTIONS)
    good = F.filter(objects, lambda o: o["text"].isNull() | (strip(o["text"]) == "") | o["score"].isNull())
    strings = F.from_json(raw, "array<string>")
    one = lambda s: F.struct(F.regexp_extract(s, OPTION, 1).alias("text"), F.regexp_extract(s, OPTION, 2).cast("int").alias("score"))
    joined = F.try_variant_get(variant, F.lit("$"), "string")
    pieces = F.arrays_zip(F.regexp_extract_all(joined, F.lit(JOINED), F.lit(1)), F.regexp_extract_all(joined, F.lit(JOINED), F.lit(2)))
    parsed = F.transform(pieces, lambda p: F.struct(p["0"].alias("text"), p["1"].cast("int").alias("score")))
    left = F.regexp_replace(F.regexp_replace(joined, JOINED, ""), r"[ ，,]", "")
    out = (
        F.when((kind == "STRING") & (left == "") & (F.size(parsed) > 0), parsed.cast(OPTIONS))
        .when(kind.startswith("ARRAY<OBJECT") & (F.size(good) == 0) & (F.size(objects) > 0), objects)
        .when((kind == "ARRAY<STRING>") & ~F.exists(strings, lambda s: ~s.rlike(OPTION)), F.transform(strings, one).cast(OPTIONS))
    )
    return out


def rubric_questions(rubric: DataFrame) -> DataFrame:
    """(sample_id, question_id, category, question, evidence, options, n) of usable rows.

    ``rubric``: sample_id, status, qa (JSON array). Rows without success or questions are
    left out. A missing string, an unknown category, bad options or a repeated question
    id raise DataError.
    """
    items = rubric.where("status = 'success'").select("sample_id", F.posexplode(F.from_json("qa", "array<string>")).alias("n", "item"))
    field = lambda p: text_at(F.col("item"), p)
    options = F.to_json(F.try_variant_get(F.try_parse_json("item"), F.lit("$.options"), "variant"))
    out = items.select(
        "sample_id", "n", field("id").alias("question_id"), field("category").alias("category"),
        field("question").alias("question"), field("evidence").alias("evidence"), parse_options(options).alias("options"),
    )
    out = shared_table(out, "questions")  # the replies are read once, not for each check
    checks = F.col("question_id").isNull() | ~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)) | F.col("question").isNull()
    bad = out.where(checks | F.col("evidence").isNull() | F.col("options").isNull()).limit(1).collect()
    if bad:
        raise DataError(f"invalid question {bad[0]['question_id']!r} in {bad[0]['sample_id']!r}")
    twice = duplicate_keys(out, "sample_id", "question_id").limit(1).collect()
    if twice:
        raise DataError(f"repeated question id in {twice[0]['sample_id']!r}")
    return out


def match_records(rubric: DataFrame, asr: DataFrame, path: str | None = None) -> DataFrame:
    """Inner join on sample_id: rubric columns with output, latency_ms and asr_error.

    ``asr``: sample_id, record (JSON). Repeated keys raise. A failed recognition stays
    with an empty output, so it counts in the denominator.
    """
    require_unique(asr, "sample_id", "ASR record")
    require_unique(rubric, "sample_id", "rubric item")
    usable = rubric.where("status = 'success' and coalesce(qa, '') not in ('', '[]', 'null')")
    output = asr_text(F.col("record"), path)
    read = asr.select(
        "sample_id", F.coalesce(output, F.lit("")).alias("output"), asr_latency(F.col("record")).alias("latency_ms"),
        F.when(output.isNull(), asr_error(F.col("record"))).alias("asr_error"),
    )
    return usable.join(read, "sample_id")


def content_signature(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def score_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Scored rows: the option at the answer's index with its score and the best score.

    An answer for an unknown question, a missing answer and an index out of range raise.
    """
    joined = shared_table(questions.join(answers, ["sample_id", "question_id"], "full"), "answered")
    picked = F.get("options", F.col("option_index"))
    bad = joined.where(F.col("options").isNull() | F.col("option_index").isNull() | (F.col("option_index") < 0) | picked.isNull()).limit(1).collect()
    if bad:
        raise DataError(f"no valid answer for {bad[0]['question_id']!r} in {bad[0]['sample_id']!r}")
    return joined.select(
        "*", picked["text"].alias("selected_option"), picked["score"].alias("score"),
        F.array_max(F.transform("options", lambda o: o["score"])).alias("max_score"), F.lit("success").alias("status"),
    )


def latest_rows(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in log order; one aggregate, no sort of whole groups."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return last.select(*keys, "_last.*")


def current_rows(expected: DataFrame, latest: DataFrame) -> DataFrame:
    """Expected questions with their latest row where its signature is the expected one."""
    row = latest.select("sample_id", "question_id", F.col("evaluation_signature").alias("_s"), F.struct("*").alias("row"))
    same = (F.col("evaluation_signature") == F.col("_s"))
    return expected.join(row, ["sample_id", "question_id"], "left").withColumn("row", F.when(same, F.col("row"))).drop("_s")


def completed_samples(current: DataFrame) -> DataFrame:
    """Samples all of whose questions have a current row that succeeded."""
    done = F.coalesce(F.col("row.status") == "success", F.lit(False))
    return current.groupBy("sample_id").agg(F.every(done).alias("done")).where("done").select("sample_id")


def completed_records(log: DataFrame) -> DataFrame:
    """Records whose latest row is ok or failed with an input error. Log: id, pos, ok, error."""
    latest = log.groupBy("id").agg(F.max_by(F.struct("ok", "error"), "pos").alias("last"))
    done = F.coalesce(F.col("last.ok"), F.lit(False)) | F.coalesce(F.col("last.error").startswith("input_error:"), F.lit(False))
    return latest.where(done).select("id")


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done, key, "left_anti")


def summarize(rows: DataFrame) -> DataFrame:
    """Overall, by category and by scene in one pass: questions, scores, normalised score.

    Rows that did not succeed, or lack a score, category or scene, are not scored; a
    missing best score is 2 for filter and rephrase, else 1.
    """
    scored = rows.where("status = 'success' and score is not null and category is not null and scene is not null")
    best = F.coalesce(F.col("max_score"), F.when(F.col("category").isin("filter", "rephrase"), 2).otherwise(1))
    sums = scored.withColumn("_best", best).groupingSets([[], ["category"], ["scene"]], "category", "scene").agg(
        F.count("*").alias("question_count"), F.coalesce(F.sum("score"), F.lit(0)).alias("total_score"),
        F.coalesce(F.sum("_best"), F.lit(0)).alias("max_possible_score"), F.grouping_id().alias("gid"),
    )
    share = F.when(F.col("max_possible_score") != 0, F.col("total_score") / F.col("max_possible_score")).otherwise(0.0)
    return sums.select(
        F.when(F.col("gid") == 3, "overall").when(F.col("gid") == 1, "category").otherwise("scene").alias("dimension"),
        F.coalesce("category", "scene", F.lit("")).alias("value"), "question_count", "total_score", "max_possible_score",
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)).alias("normalized_score"),
    )


def run_counters(rows: DataFrame) -> DataFrame:
    spent = F.coalesce(F.col("asr_retry_exhausted"), F.lit(False))
    return rows.agg(
        F.count_if(~F.col("status").eqNullSafe("success")).alias("failed_question_count"),
        F.count_if(spent).alias("asr_retry_exhausted_question_count"),
        F.count_distinct(F.when(spent, F.col("sample_id"))).alias("asr_retry_exhausted_sample_count"),
    )


def summarize_asr(samples: DataFrame) -> DataFrame:
    """Corpus error rates and mean latency. ``samples``: sample_id, clean, output,
    latency_ms, pos; the last row of a repeated sample counts."""
    one = latest_rows(samples, ["sample_id"], ["pos"])
    m = one.withColumn("m", text_metrics(F.col("clean"), F.col("output")))
    sums = [F.coalesce(F.sum(f"m.{k}_{x}"), F.lit(0)).alias(f"{k}_{x}") for k in ("wer", "cer", "mer") for x in ("errors", "units")]
    total = m.agg(
        F.count("*").alias("sample_count"), F.count("latency_ms").alias("latency_sample_count"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("average_latency_ms"), *sums,
    )
    rates = [F.when(F.col(f"{k}_units") > 0, F.col(f"{k}_errors") / F.col(f"{k}_units")).otherwise(0.0).alias(k) for k in ("wer", "cer", "mer")]
    return total.select("*", (F.col("sample_count") - F.col("latency_sample_count")).alias("missing_latency_sample_count"), *rates)


def result_record(source: DataFrame) -> DataFrame:
    """``source`` with the output struct of a refinement: raw_text, clean_text, error and
    latencies; ok if there is no error, total only where the recogniser's is valid."""
    raw = F.col("output.raw_text")
    stt = F.when((F.col("output.stt_latency_ms") >= 0) & (F.col("output.stt_latency_ms") < float("inf")), F.col("output.stt_latency_ms"))
    made = F.struct(
        F.coalesce("clean_text", F.lit("")).alias("clean_text"), F.col("error"), F.col("llm_latency_ms"),
        F.col("error").isNull().alias("ok"), F.coalesce(raw, F.lit("")).alias("raw_text"),
        stt.alias("stt_latency_ms"), (stt + F.col("llm_latency_ms")).alias("total_latency_ms"),
    )
    return source.withColumn("output", made).drop("clean_text", "error", "llm_latency_ms")


def input_error(record: Column) -> Column:
    """``input_error:`` and what a batch input lacks, or null."""
    missing = F.when(text_at(record, "source_record_id").isNull(), "source_record_id").when(
        text_at(record, "output.raw_text").isNull(), "output.raw_text"
    )
    return F.concat(F.lit("input_error: missing "), missing)


def first_in_order(df: DataFrame, n: int | None, order: str = "pos") -> DataFrame:
    return df if n is None else df.orderBy(order).limit(n)


def validate_answers(reply: Column, ids: Column, sizes: Column) -> Column:
    """Error of a judge's reply ``{"answers": [{"id", "option_index"}]}``, or null if it
    answers exactly the asked questions with indexes in range. Booleans are no numbers."""
    body = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    answers = F.from_json(F.get_json_object(body, "$.answers"), "array<struct<id:string,option_index:string>>")
    given = F.transform(answers, lambda a: a["id"])
    index = lambda a: F.when(a["option_index"].rlike(r"\A-?\d+\z"), a["option_index"].cast("int"))
    limit = F.map_from_arrays(ids, sizes)
    wrong = F.exists(answers, lambda a: index(a).isNull() | (index(a) < 0) | (index(a) >= F.try_element_at(limit, a["id"])))
    return (
        F.when(F.coalesce(F.size(answers), F.lit(-1)) < 0, "no_answers")
        .when(F.size(F.array_distinct(given)) < F.size(given), "repeated_id")
        .when(F.size(F.array_except(given, ids)) > 0, "unknown_id")
        .when(F.size(F.array_except(ids, given)) > 0, "missing_id")
        .when(wrong, "index_out_of_range")
    )

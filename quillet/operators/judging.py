"""Running a judge over matched samples: prompts, answers, checked scores.

A judge is a callable over a batch of prompts (see ``plans.transcripts.Generator``). Any
reply that does not answer exactly the asked questions fails the job, so a summary never
leaves failed questions out; finished samples are in the log and are not asked again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.functions.replies import parse_reply
from quillet.operators.evaluation import DataError


def judge_prompts(questions: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample_id, asked, prompt): one JSON payload a sample with all its questions."""
    asked = questions.groupBy("sample_id").agg(
        F.sort_array(F.collect_list(F.struct("n", "question_id", "question", "evidence", "options"))).alias("q")
    )
    shaped = F.transform("q", lambda q: F.struct(q["question_id"].alias("id"), q["question"].alias("question"), q["evidence"].alias("evidence"), F.transform(q["options"], lambda o: o["text"]).alias("options")))
    payload = F.to_json(F.struct(F.col("clean").alias("reference"), F.col("output"), shaped.alias("questions")))
    sizes = F.transform("q", lambda q: F.struct(q["question_id"].alias("id"), F.size(q["options"]).alias("n")))
    return samples.join(asked, "sample_id").select("sample_id", F.to_json(sizes).alias("asked"), payload.alias("prompt"))


def read_answers(reply: str, asked: list[dict]) -> list[tuple[str, int]]:
    """(question id, option index) of a reply; anything but exactly the asked questions
    with an index in range raises DataError. Booleans are no numbers."""
    try:
        answers = parse_reply(reply)["answers"]
        got = [(a["id"], a["option_index"]) for a in answers]
    except (ValueError, KeyError, TypeError) as error:
        raise DataError(f"unreadable judge reply: {error}") from error
    limit = {a["id"]: a["n"] for a in asked}
    if sorted(i for i, _ in got) != sorted(limit):
        raise DataError("a judge must answer each question once")
    if any(isinstance(k, bool) or not isinstance(k, int) or not 0 <= k < limit[i] for i, k in got):
        raise DataError("a judge chose an option that does not exist")
    return got


def judge(prompts: DataFrame, make: Callable[[], Callable[[list[str]], list[str | None]]]) -> DataFrame:
    """(sample_id, question_id, option_index) of all samples; a failed call raises."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            rows = []
            for sample, asked, reply in zip(batch["sample_id"], batch["asked"], model(list(batch["prompt"]))):
                if reply is None:
                    raise DataError(f"the judge gave no reply for {sample!r}")
                rows += [(sample, q, k) for q, k in read_answers(reply, json.loads(asked))]
            yield pd.DataFrame(rows, columns=["sample_id", "question_id", "option_index"])

    return prompts.mapInPandas(run, "sample_id string, question_id string, option_index int")


def first_option(prompts: list[str]) -> list[str | None]:
    """Stand-in: always the first option."""
    return [json.dumps({"answers": [{"id": q["id"], "option_index": 0} for q in json.loads(p)["questions"]]}) for p in prompts]

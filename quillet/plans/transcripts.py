"""The transcript pipeline: seeds to oral, clean and simulated text, assembly, QC, dedup
and export, each step a function of DataFrames.

Text models are callables over a batch of prompts; the stand-ins are repeatable.
"""

from __future__ import annotations

import asyncio
from collections.abc import Awaitable, Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.functions.text import casefold, collapse, simulate_asr
from quillet.operators import dedup, records as rc
from quillet.settings import SETTINGS, Settings

Generator = Callable[[list[str]], list[str | None]]


def echo(prompts: list[str]) -> list[str | None]:
    """Stand-in: the last line of each prompt."""
    return [p.rsplit("\n", 1)[-1] for p in prompts]


def concurrent(call: Callable[[str], Awaitable[str]], limit: int = SETTINGS.concurrency, attempts: int = 3, pause: float = 1.0) -> Generator:
    """A generator from an asynchronous call: bounded concurrency, retries with doubled
    pauses; what still fails is null."""

    async def one(gate: asyncio.Semaphore, prompt: str) -> str | None:
        for k in range(attempts):
            try:
                async with gate:
                    return await call(prompt)
            except Exception:  # an external model may fail in any way
                if k + 1 < attempts:
                    await asyncio.sleep(pause * 2**k)
        return None

    async def all_(prompts: list[str]) -> list[str | None]:
        gate = asyncio.Semaphore(limit)
        return list(await asyncio.gather(*(one(gate, p) for p in prompts)))

    return lambda prompts: asyncio.run(all_(prompts))


def generate(rows: DataFrame, prompt: str, out: str, make: Callable[[], Generator]) -> DataFrame:
    """``rows`` with the generator's text for the column ``prompt``; null prompts are not
    asked. The generator is made once per task."""

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for prompts in batches:
            asked = prompts.dropna()
            answers = pd.Series(model(list(asked)), index=asked.index, dtype=object)
            yield answers.reindex(prompts.index).where(lambda x: x.notna(), None)

    return rows.withColumn(out, ask(prompt))


def cached_generate(rows: DataFrame, cache: DataFrame, prompt: str, out: str, make: Callable[[], Generator]) -> tuple[DataFrame, DataFrame]:
    """Answers by content: (rows with answers, new cache entries). ``cache``: key, answer.
    Each distinct prompt that the cache lacks is asked once."""
    keyed = rows.withColumn("_key", F.sha2(F.col(prompt), 256))
    missing = keyed.where(F.col(prompt).isNotNull()).join(cache, keyed["_key"] == cache["key"], "left_anti")
    asked = missing.groupBy("_key").agg(F.min(prompt).alias("_p"))
    fresh = generate(asked, "_p", "answer", make).select(F.col("_key").alias("key"), "answer")
    known = cache.select("key", "answer").unionByName(fresh)
    return keyed.join(known, keyed["_key"] == known["key"], "left").drop("_key", "key").withColumnRenamed("answer", out), fresh


@dataclass
class TranscriptPipeline:
    spark: SparkSession
    settings: Settings = field(default_factory=lambda: SETTINGS)
    make: Callable[[], Generator] = field(default=lambda: echo)
    seed: int = 42

    def oral(self, seeds: DataFrame) -> DataFrame:
        """seeds: id, pos, scene, language, seed. Adds controls and the oral text."""
        drawn = rc.controls(seeds, self.seed, self.settings.passthrough_ratio)
        ask = F.concat(F.lit("Speak about: "), F.coalesce("oral", F.lit("plain")), F.lit("\n"), collapse(F.col("seed")))
        return generate(drawn.withColumn("_ask", ask), "_ask", "oral_text", self.make).drop("_ask", "seed")

    def clean(self, oral: DataFrame) -> DataFrame:
        """Clean text of the oral text; passthrough rows keep it as it is."""
        ask = F.when(~F.col("passthrough"), F.concat(F.lit("Clean:\n"), F.col("oral_text")))
        out = generate(oral.withColumn("_ask", ask), "_ask", "_clean", self.make)
        return out.withColumn("clean_text", F.when(F.col("passthrough"), F.col("oral_text")).otherwise(F.col("_clean"))).drop("_ask", "_clean")

    def asr(self, clean: DataFrame) -> DataFrame:
        """Recogniser-like input: passthrough, simulated for the drawn share, else oral."""
        drawn = rc.select_for_asr(clean, self.seed, "text_sim", self.settings.asr_ratio)
        return drawn.withColumn("input", F.when(F.col("asr_mode") == "text_sim", simulate_asr(F.col("oral_text"))).otherwise(F.col("oral_text")))

    def simulate(self, seeds: DataFrame) -> DataFrame:
        return self.asr(self.clean(self.oral(seeds)))

    def assemble(self, rows: DataFrame) -> DataFrame:
        shaped = rows.withColumn("refined_text", F.lit(None).cast("string")).withColumn("meta", F.create_map(F.lit("asr_mode"), F.col("asr_mode")))
        return rc.assemble(shaped).where("fate = 'kept'").drop("fate").join(rows.select("id", "pos"), "id")

    def finalize(self, records: DataFrame, total: int | None = None) -> DataFrame:
        """Rule QC until each scene's target, then greedy near-dup removal on the refined
        text, in order of scene and position."""
        total = total or self.settings.total
        judged = records.withColumn("passed", rc.rule_reason(F.col("input"), F.col("refined_text")).isNull())
        kept = rc.qc_until_target(rc.targets(judged, total)).where("outcome = 'passed'")
        ordered = kept.withColumn("_o", F.concat("scene", F.lit("\0"), F.lpad(F.col("pos").cast("string"), 20, "0")))
        unique = dedup.deduplicate(ordered.select(F.col("_o").alias("pos"), casefold(F.col("refined_text")).alias("text")), self.settings.dedup_threshold)
        return ordered.join(unique.select(F.col("pos").alias("_o")), "_o", "left_semi").drop("_o")

    def run(self, seeds: DataFrame, total: int | None = None) -> DataFrame:
        return self.finalize(self.assemble(self.simulate(seeds)), total)

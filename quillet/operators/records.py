"""Record assembly, rule QC, sampling and distribution of training records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.functions.text import blank_to_null, hash_rank, hash_unit, length_bucket, strip
from quillet.settings import DEFAULT_RATIO, SCENES, SHORT_SCENES, SETTINGS

#: Ranges that the rows of a key are numbered in.
PIECES = 64


def min_length(scene: Column) -> Column:
    return F.when(scene.startswith("english_"), 6).when(scene.isin(*SHORT_SCENES), 8).otherwise(10)


def language_of(scene: Column, *declared: Column) -> Column:
    """First declared language that is not empty, else by the scene's prefix."""
    by_scene = F.when(scene.startswith("english_"), "en").otherwise("zh")
    return F.coalesce(*[blank_to_null(c) for c in declared], by_scene)


def with_defaults(meta: Column, defaults: dict[str, Column]) -> Column:
    """A map with defaults for the keys that it lacks; a null value counts as present."""
    have = F.coalesce(meta, F.create_map().cast("map<string,string>"))
    extra = F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), v)])
    return F.map_concat(have, F.map_filter(extra, lambda k, _: ~F.map_contains_key(have, k)))


def overwritten(meta: Column, values: dict[str, Column]) -> Column:
    """A map in which the given keys have the given values."""
    new = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
    have = F.coalesce(meta, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(have, lambda k, _: ~k.isin(list(values))), new)


def assembly_fate(source: Column, clean: Column, scene: Column) -> Column:
    """``kept``, ``skipped_empty`` or ``skipped_short``, in the order of the checks."""
    empty = F.coalesce(source, F.lit("")).eqNullSafe("") | F.coalesce(clean, F.lit("")).eqNullSafe("")
    short = (F.length(strip(source)) < 2) | (F.length(strip(clean)) < min_length(scene))
    return F.when(empty, "skipped_empty").when(short, "skipped_short").otherwise("kept")


def assemble(rows: DataFrame, fallback: bool = False) -> DataFrame:
    """Records from recogniser rows, or from clean rows with ``fallback``.

    ``rows`` has id, scene, input, oral_text, refined_text, clean_text, language, meta
    (map). With ``fallback`` the input is the oral text, and meta is overwritten rather
    than completed. All rows are returned with their ``fate``; kept ones are the records.
    """
    language = language_of(F.col("scene"), F.col("language"), F.element_at(F.col("meta"), "language"))
    facts = {"scene": F.col("scene"), "language": language}
    if fallback:
        source, clean = F.col("oral_text"), F.col("clean_text")
        facts["asr_mode"] = F.coalesce(blank_to_null(F.element_at(F.col("meta"), "asr_mode")), F.lit("clean_fallback"))
        meta = overwritten(F.col("meta"), facts)
    else:
        source, clean = F.col("input"), F.coalesce(blank_to_null(F.col("refined_text")), F.col("clean_text"))
        meta = with_defaults(F.col("meta"), facts)
    # a generated row is worked out once; else a filter on the fate would work out both texts
    # anew for each of its checks
    texts = F.explode(F.array(F.struct(source.alias("input"), clean.alias("refined_text")))).alias("t")
    once = rows.select("id", "scene", "oral_text", meta.alias("meta"), texts)
    return once.select(
        "id", "scene", "t.input", "oral_text", "t.refined_text", "meta",
        assembly_fate(F.col("t.input"), F.col("t.refined_text"), F.col("scene")).alias("fate"),
    )


def rule_reason(source: Column, refined: Column) -> Column:
    """Reason why the rules reject a record, or null; the first rule that fails names it."""
    empty = F.coalesce(source, F.lit("")).eqNullSafe("") | F.coalesce(refined, F.lit("")).eqNullSafe("")
    grown = (F.length(refined) > 1.8 * F.length(source)) & (F.length(refined) - F.length(source) > 30)
    return F.when(empty, "empty").when(grown, "expanded").when(F.length(strip(source)) <= 2, "too_short")


def judge_verdict(reply: Column) -> Column:
    """Whether a reviewer's reply passes a record.

    A JSON object passes by the truth of ``pass`` (any non-empty string is true, absent
    means pass); other text passes if it begins with true; a failed call (null) rejects.
    """
    text = strip(reply)
    is_object = F.try_parse_json(text).isNotNull() & text.startswith("{")
    value = F.get_json_object(text, "$.pass")
    # a missing key passes, an explicit null does not
    absent = value.isNull() & ~text.rlike(r'"pass"\s*:')
    truthy = value.isNotNull() & ~value.isin("", "false", "0", "0.0", "[]", "{}")
    quoted_false = text.rlike(r'"pass"\s*:\s*"(?:false|0|0\.0|\[\]|\{\})"')
    by_text = F.lower(text).startswith("true")
    return F.coalesce(F.when(is_object, absent | truthy | quoted_false).otherwise(by_text), F.lit(False))


def targets(scenes: DataFrame, total: int, least: int = 1) -> DataFrame:
    """``scenes`` with its target: the scene's share of the total, at least ``least``."""
    ratios = F.create_map(*[x for k, (r, _) in SCENES.items() for x in (F.lit(k), F.lit(r))])
    ratio = F.coalesce(F.try_element_at(ratios, F.col("scene")), F.lit(DEFAULT_RATIO))
    return scenes.withColumn("ratio", ratio).withColumn("target", F.greatest(F.lit(least), (F.lit(total) * ratio).cast("int")))


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str, by: Column | None = None, running: str | None = None, pieces: int = PIECES) -> DataFrame:
    """``rows`` with ``name``: the number, from 1, of each row among those of equal ``keys``
    in the given ``order``, and ``name``_size, how many these are.

    No task sorts all rows of a key: ``order[0]`` is cut at sampled quantiles into at most
    ``pieces`` ranges, rows are counted in each (key, range), and numbered within it on top
    of the rows of the ranges before. ``by`` tells ranges from ``order[0]`` otherwise.
    With ``running``, ``name``_before is the sum of that column over the rows before.
    """
    first = F.col(order[0])
    if by is None:
        # a quantile sketch: its size does not grow with the rows
        cuts = rows.agg(F.percentile_approx(first, [k / pieces for k in range(1, pieces)], 100 * pieces)).first()[0] or []
        cuts = sorted(set(cuts))
        by = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: first > c)) if cuts else F.lit(0)
    piece = f"_{name}_piece"
    ranged = rows.withColumn(piece, by)
    summed = F.coalesce(F.sum(running), F.lit(0)) if running else F.lit(0)
    counts = ranged.groupBy(*keys, piece).agg(F.count("*").alias("_n"), summed.alias("_s"))
    every = Window.partitionBy(*keys)  # of at most ``pieces`` rows a key
    before = every.orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"_{name}_{k}") for k in keys], F.col(piece).alias(f"_{name}_at"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(f"_{name}_first"), F.sum("_n").over(every).alias(f"{name}_size"),
        F.coalesce(F.sum("_s").over(before), F.lit(0)).alias(f"_{name}_sum"),
    )
    met = F.col(piece).eqNullSafe(F.col(f"_{name}_at"))
    for k in keys:
        met &= F.col(k).eqNullSafe(F.col(f"_{name}_{k}"))
    within = Window.partitionBy(*keys, piece).orderBy(*order)
    out = ranged.withColumn(name, F.row_number().over(within))
    if running:
        earlier = within.rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(f"{name}_before", F.coalesce(F.sum(running).over(earlier), F.lit(0)))
    out = out.join(offsets, met).withColumn(name, (F.col(name) + F.col(f"_{name}_first")).cast("long"))
    if running:
        out = out.withColumn(f"{name}_before", F.col(f"{name}_before") + F.col(f"_{name}_sum"))
    return out.drop(piece, f"_{name}_first", f"_{name}_sum", f"_{name}_at", *[f"_{name}_{k}" for k in keys])


def take_per_scene(rows: DataFrame, total: int) -> DataFrame:
    """The first ``target`` rows of each scene in order of ``pos``."""
    return numbered(targets(rows, total), ["scene"], ["pos"], "n").where("n <= target").drop("n", "n_size")


def qc_until_target(rows: DataFrame, batch: int = 2 * SETTINGS.concurrency) -> DataFrame:
    """Which rows a reviewer sees, passes and rejects when it stops at the target.

    ``rows`` has scene, pos, target and passed. Rows are checked in batches and judged in
    order until ``target`` have passed: ``outcome`` is passed, rejected, ``checked`` (in
    the last batch, after the row that met the target) or unseen.
    """
    counted = numbered(rows.withColumn("_passed", F.col("passed").cast("int")), ["scene"], ["pos"], "n", running="_passed")
    open_ = F.col("n_before") < F.col("target")
    last = counted.where(open_).groupBy(F.col("scene").alias("_scene")).agg(F.max("n").alias("last"))
    counted = counted.join(last, F.col("scene").eqNullSafe(F.col("_scene")), "left")
    seen = F.ceil(F.col("last") / batch) * batch
    outcome = F.when(open_, F.when(F.col("passed"), "passed").otherwise("rejected")).when(F.col("n") <= seen, "checked").otherwise("unseen")
    return counted.withColumn("outcome", outcome).drop("n", "n_before", "n_size", "last", "_passed", "_scene")


def distribution(records: DataFrame) -> DataFrame:
    """(dimension, value, count) of scene, language and is_fragment, and the total.

    An empty table has no rows, not even a total."""
    keyed = records.select(
        F.coalesce("scene", F.lit("unknown")).alias("scene"), F.coalesce("language", F.lit("unknown")).alias("language"),
        F.initcap(F.coalesce("is_fragment", F.lit(False)).cast("string")).alias("is_fragment"),
    )
    sets = keyed.groupingSets([[], ["scene"], ["language"], ["is_fragment"]], "scene", "language", "is_fragment").agg(
        F.count("*").alias("count"), F.grouping_id().alias("gid")
    )
    kind = F.when(F.col("gid") == 7, "total").when(F.col("gid") == 3, "scene").when(F.col("gid") == 5, "language").otherwise("is_fragment")
    value = F.when(F.col("gid") == 7, "").otherwise(F.coalesce("scene", "language", "is_fragment"))
    return sets.select(kind.alias("dimension"), value.alias("value"), "count")


def drift(records: DataFrame, limit: float = SETTINGS.drift) -> DataFrame:
    """(scene, target, actual, warned): configured scenes against their share of records."""
    spark = records.sparkSession
    wanted = spark.createDataFrame([(k, r) for k, (r, _) in SCENES.items()], "scene string, target double")
    everything = Window.partitionBy()  # over one row a scene
    counts = records.groupBy("scene").count().withColumn("total", F.sum("count").over(everything))
    joined = wanted.join(counts, "scene", "left").withColumn("total", F.coalesce(F.max("total").over(everything), F.lit(0)))
    actual = F.when(F.col("total") > 0, F.coalesce("count", F.lit(0)) / F.col("total")).otherwise(F.lit(0.0))
    out = joined.select("scene", "target", actual.alias("actual"), "total")
    return out.select("scene", "target", "actual", ((F.col("total") > 0) & (F.abs(F.col("actual") - F.col("target")) > limit)).alias("warned"))


def coverage(records: DataFrame, total: int) -> DataFrame:
    return records.agg(F.count("*").alias("total_samples")).select(
        "total_samples", F.lit(total).cast("long").alias("target_samples"), (F.col("total_samples") / total).alias("coverage")
    )


def stratified_split(rows: DataFrame, ratio: float = SETTINGS.validation_ratio, seed: int = SETTINGS.shuffle_seed) -> DataFrame:
    """``split`` train or val: within (scene, length bucket of input) the first
    ``int(size * ratio)`` rows of a repeatable shuffle, one at least from 5 rows on."""
    strata = rows.withColumn("bucket", length_bucket(F.col("input"))).withColumn("_key", hash_rank(seed, F.col("id")))
    ranked = numbered(strata, ["scene", "bucket"], ["_key", "id"], "_rank", by=F.conv(F.substring("_key", 1, 2), 16, 10).cast("int"))
    n = (F.col("_rank_size") * ratio).cast("int")
    n = F.when((F.col("_rank_size") >= 5) & (n == 0), 1).otherwise(n)
    return ranked.withColumn("split", F.when(F.col("_rank") <= n, "val").otherwise("train")).drop("_key", "_rank", "_rank_size")


def random_split(rows: DataFrame, ratio: float = SETTINGS.validation_ratio, seed: int = SETTINGS.shuffle_seed) -> DataFrame:
    """The first ``int(N * ratio)`` rows of a repeatable shuffle are val.

    The threshold is found by counting in hash ranges, so no task sorts all rows.
    """
    keyed = rows.withColumn("_k", hash_rank(seed, F.col("id"))).withColumn("_b", F.substring("_k", 1, 3))
    counts = keyed.groupBy("_b").count()  # at most 4096 rows
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"),
        F.sum("count").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"),
    )
    ranked = keyed.join(F.broadcast(offsets), "_b").withColumn(
        "_rank", F.col("_first") + F.row_number().over(Window.partitionBy("_b").orderBy("_k", "id"))
    )
    split = F.when(F.col("_rank") <= (F.col("_total") * ratio).cast("long"), "val").otherwise("train")
    return ranked.withColumn("split", split).drop("_k", "_b", "_first", "_total", "_rank")


# Control levels of oral text generation.
CORRECTION_LEVELS = ("none", "light", "medium", "heavy")
ORAL_LEVELS = ("light", "medium", "heavy")


def controls(rows: DataFrame, seed: int, ratio: float = SETTINGS.passthrough_ratio) -> DataFrame:
    """Repeatable draws of passthrough, correction and oral level for each id."""
    pick = lambda levels, name: F.element_at(
        F.array(*map(F.lit, levels)), (hash_unit(seed, name, F.col("id")) * len(levels)).cast("int") + 1
    )
    through = hash_unit(seed, "passthrough", F.col("id")) < ratio
    return rows.select(
        "*", through.alias("passthrough"), F.when(~through, pick(CORRECTION_LEVELS, "correction")).alias("correction"),
        F.when(~through, pick(ORAL_LEVELS, "oral")).alias("oral"),
    )


def select_for_asr(rows: DataFrame, seed: int, mode: str = "text_sim", ratio: float = SETTINGS.asr_ratio) -> DataFrame:
    """The mode of each row: passthrough rows stay, else a draw selects the simulation."""
    drawn = hash_unit(seed, "asr", F.col("id")) < ratio
    return rows.withColumn("asr_mode", F.when(F.col("passthrough"), "passthrough").when(drawn, mode).otherwise("none"))


def rounds(remaining: Column, round_size: int = SETTINGS.round_size) -> Column:
    """Number of rounds for what is left, one at least."""
    return F.greatest(F.lit(1), F.ceil(remaining / round_size).cast("int"))


def seed_windows(pool: DataFrame, items: DataFrame, per_item: int = 5, seed: int = 0) -> DataFrame:
    """(scene, item, seeds): each item takes the next ``per_item`` seeds of a shuffled pool
    of its scene; the pool is shuffled anew when the next window no longer fits.

    A scene of fewer seeds than ``per_item`` raises. ``pool``: scene, seed; ``items``:
    scene, item (0, 1, ...).
    """
    sizes = pool.groupBy("scene").agg(F.count("*").alias("size"))
    short = sizes.where(F.col("size") < per_item).limit(1).collect()
    if short:
        raise ValueError(f"scene {short[0]['scene']} has fewer than {per_item} seeds")
    windows = F.floor(F.col("size") / per_item)
    placed = items.join(F.broadcast(sizes), "scene").select(
        "scene", "item", F.floor(F.col("item") / windows).alias("epoch"), F.pmod(F.col("item"), windows).alias("slot")
    )
    epochs = placed.select("scene", "epoch").distinct()
    shuffled = pool.join(epochs, "scene").withColumn(
        "rank", F.row_number().over(Window.partitionBy("scene", "epoch").orderBy(hash_rank(seed, F.col("epoch"), F.col("seed")), "seed")) - 1
    )
    chosen = shuffled.withColumn("slot", F.floor(F.col("rank") / per_item)).groupBy("scene", "epoch", "slot").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "seed"))), lambda x: x["seed"]).alias("seeds")
    )
    return placed.join(chosen, ["scene", "epoch", "slot"]).select("scene", "item", "seeds")


def sft_rows(records: DataFrame, system: str | None = None) -> DataFrame:
    """(id, conversations): turns for fine-tuning; rows with an empty side are dropped."""
    turn = lambda who, value: F.struct(F.lit(who).alias("from"), value.alias("value"))
    turns = [turn("human", F.col("input")), turn("gpt", F.col("refined_text"))]
    if system:
        turns.insert(0, turn("system", F.lit(system)))
    filled = records.where("coalesce(input, '') <> '' and coalesce(refined_text, '') <> ''")
    return filled.select("id", F.array(*turns).alias("conversations"))

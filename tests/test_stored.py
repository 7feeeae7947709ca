"""What the batch flow has stored goes when nothing reads it any more."""

import os

from quillet.operators import refinement as rf
from quillet.plans.text_queries import DICTIONARY, dictionary_view
from quillet.sources.store import application_folder, discard, shared_table


def _stored(spark) -> dict[str, str]:
    folder = application_folder(spark).removeprefix("file:")
    return {name: f"{folder}/{name}" for name in os.listdir(folder)}


def test_texts_are_not_kept(spark):
    before = set(_stored(spark))
    rows = spark.createDataFrame([(1, " thtion 12 ok "), (2, "plain"), (3, "hention AB")], "id long, text string")
    lose = lambda text, hints, strict: text if strict else text.replace("__ENTITY_001__", "")
    out = rf.refine_batch(rows, dictionary_view(spark, DICTIONARY), lambda: lose, mode="auto")
    left = {k: v for k, v in _stored(spark).items() if k not in before}
    assert not {k.split("-")[0] for k in left} & {"segments", "exact", "matches", "prepared"}
    first, second = sorted((spark.read.parquet(v) for k, v in left.items() if k.startswith("checked-")), key=lambda d: d.columns.count("o1"))
    assert {(r.id.id, r.text) for r in first.collect()} == {(1, " thtion 12 ok "), (2, None), (3, "hention AB")}
    assert {r.text for r in second.collect()} == {None}
    got = {r.id: (r.clean_text, r.accepted, r.retries, r.normalizations) for r in out.collect()}
    assert got == {1: ("Thention 12 ok", True, 1, ["thtion->Thention"]), 2: ("plain", True, 0, []), 3: ("Thention AB", True, 1, ["hention->Thention"])}


def test_only_stored_tables_are_removed(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/x")
    discard(spark.read.parquet(f"{tmp_path}/x"))
    assert spark.read.parquet(f"{tmp_path}/x").count() == 3
    own = shared_table(spark.range(3), "own")
    discard(own.where("id > 0"))
    assert not any(k.startswith("own-") for k in _stored(spark))

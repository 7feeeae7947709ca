"""The texts of a record are worked out once, not again by each check of its fate."""

from pyspark.sql import functions as F

from quillet.functions import text as tx
from quillet.operators import records as rc


def test_fate_is_checked_on_finished_texts(spark, capsys):
    rows = spark.createDataFrame([(1, "meeting", "a“b”  c d e f g h i j", "en")], "id long, scene string, t string, language string")
    heard = tx.simulate_asr(F.col("t"))
    rows = rows.select("id", "scene", "language", heard.alias("input"), F.col("t").alias("oral_text"), F.lit("").alias("refined_text"), heard.alias("clean_text"), F.lit(None).cast("map<string,string>").alias("meta"))
    kept = rc.assemble(rows).where("fate = 'kept'")
    kept.explain()
    plan = capsys.readouterr().out
    assert not any("regexp_replace" in line for line in plan.splitlines() if "Filter" in line)
    assert [r.input for r in kept.collect()] == ["a b c d e f g h i j"]


def test_simulation_takes_marks_and_spaces_as_one_run(spark):
    texts = ["“a”（b） …c　·d\x1c-e", "···", "", None, "x: y： [z]", "北京，（上海）", "a b c "]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    for strength in ("light", "medium", "heavy", "other"):
        marks = tx.dropped_punctuation(strength)
        wanted = [None if t is None else " ".join("".join(" " if c in marks else c for c in t).split()) for t in texts]
        assert [r[0] for r in rows.select(tx.simulate_asr(F.col("t"), strength)).collect()] == wanted

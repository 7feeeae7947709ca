"""Fuzzy windows are cut from short stretches, and alike wherever blocks end."""

from pyspark.sql import functions as F

from quillet.operators import fuzzy
from quillet.operators.matching import MatchConfig
from quillet.plans.text_queries import DICTIONARY, dictionary_view


def test_spans_do_not_depend_on_blocks(spark, capsys):
    config, known = MatchConfig(), fuzzy.Sounds(None)
    surfaces = fuzzy.surface_rows(dictionary_view(spark, DICTIONARY), config, known)
    texts = spark.createDataFrame([(i, "x" * (fuzzy.BLOCK - 9 + i) + " thentoin 。kundash ") for i in range(12)], "id long, text string")
    found = {}
    for width in (fuzzy.BLOCK, 1000):
        blocks = fuzzy.text_blocks(texts, 2 * fuzzy._longest(surfaces) + 8, width).withColumn("readings", known.columns(F.col("units")))
        spans = fuzzy.hopeful_spans(blocks, surfaces, config, "general")
        found[width] = {tuple(r) for r in spans.select("id", "start", "end", "observed").collect()}
    assert len({i for i, *_ in found[1000]}) == 12
    assert found[fuzzy.BLOCK] == found[1000]
    spans.explain(True)
    assert "substring(stretch" in capsys.readouterr().out

"""Fuzzy windows are found on arrays; only those that are close enough become rows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillet.operators import fuzzy
from quillet.operators.matching import MatchConfig
from quillet.plans.text_queries import DICTIONARY, dictionary_view


def test_places_of_texts_are_no_rows(spark, capsys):
    config, known = MatchConfig(), fuzzy.Sounds(None)
    surfaces = fuzzy.surface_rows(dictionary_view(spark, DICTIONARY), config, known)
    texts = spark.createDataFrame([(1, "weiß " + "then " * 2000 + "Thenton."), (2, "kund。ach"), (3, None)], "id long, text string")
    blocks = fuzzy.text_blocks(texts, 2 * fuzzy._longest(surfaces) + 8).withColumn("readings", known.columns(F.col("units")))
    spans = fuzzy.hopeful_spans(blocks, surfaces, config, "general")
    spans.explain()
    assert "regexp_extract_all" not in capsys.readouterr().out
    found = {(r.id, r.start, r.observed) for r in spans.collect()}
    assert (1, 10005, "Thenton") in found and {i for i, *_ in found} == {1}


def test_folding_and_cutting():
    fold, text = fuzzy._Folding(), "Aß, ﬃ🙂é。x\n"
    units, at = fold(text)
    assert (units, at.tolist()) == ("assffi🙂é\nx\n", [0, 1, 1, 4, 4, 4, 5, 6, 7, 8, 9])
    cut = fuzzy._cut(fuzzy._codes(text), np.array([0, 4, 3]), np.array([2, 7, 3]))
    assert cut.equals(pa.array(["Aß", "ﬃ🙂é", ""]))

"""The last word of a text, found from its end."""

import re
import time

from pyspark.sql import functions as F

from quillet.plans.text_queries import last_word


def test_last_word_is_that_of_the_plain_pattern(spark):
    texts = ["", "abc", "one two", "one two!? ", "a\nb2\n", "\n", "语言 v2 语言", "é9é", "…", "x" * 5000 + " é", "tail\r\n", "A-b_c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").orderBy("i")
    found = [r[0] for r in rows.select(last_word(F.col("text"))).collect()]
    assert found == [(re.findall(r"[A-Za-z0-9]+", t) or [""])[-1] for t in texts]


def test_long_runs_take_linear_time(spark):
    rows = spark.range(1).select(F.concat(F.repeat(F.lit("x"), 120_000), F.lit("\u00e9 end")).alias("text"))
    began = time.time()
    assert rows.select(last_word(F.col("text"))).first()[0] == "end"
    assert time.time() - began < 10

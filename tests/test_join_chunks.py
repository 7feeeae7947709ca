"""Chunks are joined in time linear in the text."""

import random

from pyspark.sql import functions as F

from quillet.functions import text as tx
from quillet.functions.chunking import join_parts


def test_join_is_linear_and_that_of_one_text(spark, capsys):
    rnd = random.Random(3)
    lists = [[rnd.choice(["a", " b ", "é", "世界", "", " ", "x。", "🙂", "ok."]) for _ in range(rnd.randrange(9))] for _ in range(60)]
    rows = spark.createDataFrame([*enumerate(lists), (90, None), (91, ["a", None, "b"])], "id int, c array<string>")
    out = rows.select("id", tx.join_chunks(F.col("c")).alias("t"))
    out.explain()
    assert "aggregate(" not in capsys.readouterr().out
    got = {r.id: r.t for r in out.collect()}
    assert got == {**{i: join_parts(x) for i, x in enumerate(lists)}, 90: None, 91: "a b"}

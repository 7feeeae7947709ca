"""Chunks and windows as columns against the plain functions."""

import random

import pytest
from pyspark.sql import functions as F

from quillet.functions import chunking as ck

BITS = ["a", "word ", "字", "🙂", ".", "。", "!", "? ", "\n", " ", "　", "\x1c", ",", "， ", "、", "; ", "：", ")", "】", "x" * 30, " " * 90, "é" * 50, "。" + " " * 79, "]"]


def test_split_columns_equal_the_functions(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choices(BITS, k=rng.randrange(60))) for _ in range(300)] + [None, "", " \n", "x" * 5000, " " * 3000 + "y", "a. " * 2000, "x" * 79 + ".", "x" * 79 + ". y", "x" * 80 + ". y", "x" * 78 + ". y", "x" * 81]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    for limit in (32, 33, 80):
        got = rows.select(ck.chunks_column(F.col("t"), limit), ck.windows_column(F.col("t"), limit)).collect()
        for t, (chunks, windows) in zip(texts, got):
            assert chunks == ([] if t is None else ck.stable_chunks(t.strip(), limit, flush=True)[0]), t
            assert windows == ([] if t is None else ck.refinement_windows(t, limit)), t
    with pytest.raises(ValueError):
        ck.windows_column(F.col("t"), 31)


def test_windows_need_no_python(spark, capsys):
    rows = spark.createDataFrame([("a",)], "t string")
    rows.select(ck.windows_column(F.col("t"))).explain()
    assert "Python" not in capsys.readouterr().out


def test_chunks_are_cut_in_slices(spark):
    """Two batches of long texts: rows stay in order across slices."""
    texts = [f"{i}. " + "abc de. " * 3000 for i in range(60)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(1).select("i", ck.chunks_column(F.col("t")).alias("c")).collect()
    assert all(r.c == ck.stable_chunks(texts[r.i].strip(), flush=True)[0] for r in got) and len(got) == 60
    assert sum(map(len, texts)) > ck.SLICE_BYTES


def test_guard_equals_the_function(spark):
    pairs = [("a b c", " a b c\n"), (" ", " "), ("", ""), (None, None), ("x", None), ("x" * 30, "x"), ("same", "other"), ("long text。" * 30, "long text。"), ("　a", "a")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, x string, y string").orderBy("i")
    got = [r[0] for r in rows.select(ck.guard_column(F.col("x"), F.col("y"))).collect()]
    assert got == [ck.guard_reasons(x or "", y or "") for x, y in pairs]

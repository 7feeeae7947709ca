"""Chunking, the guard, edit distance, near-dup removal and sampling against plain Python."""

import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quillet.functions import chunking as ck
from quillet.functions import keywords as kw
from quillet.functions import metrics as mx
from quillet.functions import text as tx
from quillet.operators import dedup, records as rc, windows as wn


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@given(st.text("abc", max_size=90), st.text("abc", max_size=90))
@settings(max_examples=200, deadline=None)
def test_edit_distance(a, b):
    assert mx.edit_distance(a, b) == plain_distance(a, b)


def test_text_metrics(spark):
    rows = spark.createDataFrame([("你好 world", "你好 word"), ("", "x"), (None, None), ("ＡＢ，ß", "ab ss")], "a string, b string")
    got = [tuple(r.m) for r in rows.select(mx.text_metrics(F.col("a"), F.col("b")).alias("m")).collect()]
    assert got == [(1, 2, 1, 7, 1, 3), (1, 0, 1, 0, 1, 0), (0, 0, 0, 0, 0, 0), (0, 2, 0, 4, 0, 2)]


def test_longest_phrases_are_simplified():
    table = {"乾": "干", "乾隆": "乾隆", "乾淨": "干净", "頭髮": "头发", "髮": "发", "發": "发", "只": "只", "一隻": "一只", "一隻手機": "一部手机", "": "x"}
    to = mx.Simplifier(table)
    # a map of characters would write 干隆
    assert to("乾隆很乾淨，頭髮乾") == "乾隆很干净，头发干" and to("一隻手錶，一隻手機") == "一只手錶，一部手机"
    assert to("") == "" and to("abc") == "abc" and mx.fold_text("乾隆！", to) == "乾隆"


def test_fold_text():
    assert mx.fold_text("  Ａ-b，C　！ß ") == "a b c ss" and mx.fold_text("龍", mx.Simplifier({"龍": "龙"})) == "龙"
    assert mx.matching_ratio("abcd", "bcde") == SequenceMatcher(None, "abcd", "bcde", autojunk=False).ratio()


def test_windows_are_lossless():
    text = "这是一个十六个字的句子，大概如此。" * 12
    parts = ck.refinement_windows(text)
    assert "".join(parts) == text and max(map(len, parts)) <= 80
    assert ck.refinement_windows("  ") == [] and len(ck.refinement_windows("x" * 1200)) == 15
    with pytest.raises(ValueError):
        ck.refinement_windows("x", 31)


def test_stable_chunks():
    assert ck.stable_chunks("第一句。第二") == (["第一句。"], 4)
    assert ck.stable_chunks("第一句。第二", flush=True)[0] == ["第一句。", "第二"]
    assert ck.stable_chunks("a" * 100, 80) == (["a" * 80], 80)
    assert ck.stable_chunks("aaaa, bbbb, cccc dddd", 12)[0] == ["aaaa, bbbb,"]
    # the full stop of a late sentence end is no soft break, a comma before the limit is
    assert ck.stable_chunks("a" * 15 + ". b", 10)[0][0] == "a" * 10


def test_join():
    assert ck.join_parts(["第一段。", "第二段。"]) == "第一段。第二段。" and ck.join_parts(["hello ", "", " world"]) == "hello world"


def test_guard():
    assert ck.guard_reasons("一句话说完了。", "这是重复的一句话。" * 4)[0] == "repeated_sentence"
    assert ck.guard_reasons("abc " * 30, "abc") == ["severe_content_loss"] and ck.guard_reasons("x", " ") == ["empty_refiner_output"]


def grams(t):
    t = t.strip()
    return {t} if len(t) < 3 else {t[i : i + 3] for i in range(len(t) - 2)}


def plain_greedy(texts, limit=0.75):
    kept = []
    for i, t in enumerate(texts):
        if not t:
            kept.append((i, None))
            continue
        g = grams(t)
        if all(k is None or len(g & k) / len(g | k) < limit for _, k in kept):
            kept.append((i, g))
    return [i for i, _ in kept]


def test_greedy_dedup(spark):
    rng = random.Random(9)
    texts = ["", None, " ", "  ", "ab", "ab", "\U0001f600\U0001f600鬼灵"]
    for _ in range(25):
        base = "".join(rng.choices("abcdef ", k=rng.randint(10, 60)))
        for _ in range(rng.randint(1, 5)):
            base = base[: rng.randrange(len(base))] + rng.choice("abcdefgh") + base[rng.randrange(len(base)) :] if rng.random() < 0.3 else base + rng.choice("abc")
            texts.append(base)
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "pos long, text string, size string")
    assert sorted(r.pos for r in dedup.deduplicate(rows).collect()) == plain_greedy(texts)
    assert dedup.deduplicate(rows.where("false")).count() == 0


def test_kept_rows_only_suppress(spark):
    # b is like a, c is like b but not like a: b goes, c stays
    a, b, c = "abcdefghijklmnopqrst", "abcdefghijklmnopqrXY", "efghijklmnopqrXYzwAB"
    rows = spark.createDataFrame(list(enumerate([a, b, c])), "pos long, text string")
    assert sorted(r.pos for r in dedup.deduplicate(rows, 0.55).collect()) == plain_greedy([a, b, c], 0.55) == [0, 2]


def test_ngrams_on_code_points(spark):
    row = spark.createDataFrame([("a\U0001f600b\U0001f600c",)], "t string").select(tx.char_ngrams(F.col("t")).alias("g")).first()
    assert row.g == ["a\U0001f600b", "\U0001f600b\U0001f600", "b\U0001f600c"]


def test_greedy_spans(spark):
    rng = random.Random(1)
    spans = [(i, s, s + rng.randint(1, 9)) for i, s in enumerate(rng.choices(range(60), k=25))]
    rows = spark.createDataFrame([(spans,)], "s array<struct<rank:int,start:int,end:int>>")
    kept = []
    for s in spans:
        if not any(k[1] < s[2] and s[1] < k[2] for k in kept):
            kept.append(s)
    assert [tuple(x) for x in rows.select(wn.greedy_spans(F.col("s")).alias("k")).first().k] == kept


def test_seed_windows(spark):
    pool = spark.createDataFrame([("a", f"s{i}") for i in range(12)] + [("b", "x")] * 0, "scene string, seed string")
    items = spark.createDataFrame([("a", i) for i in range(6)], "scene string, item int")
    got = {r["item"]: list(r.seeds) for r in rc.seed_windows(pool, items).collect()}
    assert len(got) == 6 and all(len(v) == 5 for v in got.values())
    assert not set(got[0]) & set(got[1])  # one epoch has two windows of distinct seeds
    with pytest.raises(ValueError):
        rc.seed_windows(pool.limit(4), items).collect()


def test_qc_until_target(spark):
    rows = spark.createDataFrame([("a", i, 2, i in (1, 3, 4)) for i in range(9)], "scene string, pos int, target int, passed boolean")
    got = {r.pos: r.outcome for r in rc.qc_until_target(rows, batch=3).collect()}
    assert got == {0: "rejected", 1: "passed", 2: "rejected", 3: "passed", 4: "checked", 5: "checked", 6: "unseen", 7: "unseen", 8: "unseen"}


def test_empty_records(spark):
    none = spark.createDataFrame([], "scene string, language string, is_fragment boolean")
    assert rc.distribution(none).collect() == []
    assert not any(r.warned for r in rc.drift(none).collect())


def test_loops_in_long_texts():
    rng = random.Random(4)
    pattern = ck._LOOP
    for _ in range(30):
        text = "".join(rng.choices("ab\n", weights=(5, 5, 1), k=450))
        if rng.random() < 0.7:
            phrase = "".join(rng.choices("abcdefgh", k=rng.randint(8, 60)))
            at = rng.randrange(len(text))
            text = text[:at] + phrase * 3 + text[at:]
        found = pattern.search(text)
        assert ck.first_loop(text) == (found[1] if found else None)


def test_strip(spark):
    texts = [" \u3000a b\u00a0\x1f\n", "", "\u2028", "x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    assert [r[0] for r in rows.select(tx.strip(F.col("t"))).collect()] == [t.strip() for t in texts]


KEYWORDS = [
    # keywords, deduplicated, normalised to the text "use C++ and GPT-4 in 北京大学 v2", passes QC
    ('["GPT-4", " GPT-4 ", "the", ""]', "GPT-4,the", "GPT-4", False), ('["C++"]', "C++", "C++", True), ('["北京"]', "北京", "北京", True),
    ('["学大京北"]', "学大京北", "学大京北", True), ('["zq"]', "zq", "zq", False), ('["？"]', "？", "", False), ("[]", "", "", True), (None, "", "", True),
    ('["的", "v2"]', "的,v2", "v2", False),
]
SOURCE = "use C++ and GPT-4 in 北京大学 v2"
WORDS = [
EVIDENCE = [("GPT-4", True), ("abc", False), ("北大", True), ("大学", True), ("天", False), ("2", True), ("xyzzy", False), ("Cand", True)]
SHAPES = [("C++", True), ("F#", True), ("v2.1", True), ("50%", True), ("3元", True), ("12:30", True), ("!=", True), ("北京", True), ("京", False), ("？！", False), ("é", False), ("x", False)]


def test_keyword_functions(spark):
    rows = spark.createDataFrame([(i, k[0]) for i, k in enumerate(KEYWORDS)], "i int, x string").select("i", F.from_json("x", "array<string>").alias("k"))
    source, none = F.lit(SOURCE), F.lit("")
    got = rows.orderBy("i").select(F.array_join(kw.dedupe(F.col("k")), ","), F.array_join(kw.normalize_targets(F.col("k"), source, none), ","), kw.keyword_qc(F.col("k"), source, none)).collect()
    assert [tuple(r) for r in got] == [k[1:] for k in KEYWORDS]
    for cases, test in ((WORDS, kw.is_common), (EVIDENCE, lambda c: kw.has_evidence(c, source, none)), (SHAPES, kw.looks_like_target)):
        rows = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(cases)], "i int, k string").orderBy("i")
        assert [r[0] for r in rows.select(test(F.col("k"))).collect()] == [wanted for _, wanted in cases]

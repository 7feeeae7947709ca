"""Spans are looked for where one can be: every place of a text is no row of its own."""

from test_spans import ENTITIES, frame, sample, single  # noqa: F401

from quillet.operators import masking as mk
from quillet.operators import spans as sp
from quillet.plans.text_queries import dictionary_view


def test_few_places_meet_the_dictionary(spark, capsys):
    """The text's own rows are cut at places of the surfaces, not at each character."""
    surfaces = spark.createDataFrame([(1, "needle"), (2, "北航")], "name int, surface string")
    found = sp.surface_spans(frame(spark, ["hay " * 1000 + "NEEDLE", "北航" * 3, "hay"]), surfaces)
    found.explain()
    plan = capsys.readouterr().out
    assert "regexp_extract_all(seen" not in plan
    assert sorted((r.id, r.name, r.start) for r in found.collect()) == [(0, 1, 4000), (1, 2, 0), (1, 2, 2), (1, 2, 4)]


def test_long_and_short_dictionaries_find_the_same(spark, monkeypatch):
    texts, names = sample(12), ["北航", "aaa", "aa", "BUAA", "XÉ", "kelvin", "。", "a", "x" * 550]
    surfaces = spark.createDataFrame([(k, s) for k, s in enumerate(names)], "name int, surface string")
    machine = mk.Surfaces([(s, k) for k, s in enumerate(names)])
    wanted = sorted((i, k, a, b, t[a:b]) for i, t in enumerate(texts) if t for a, b, k in machine.find(t))
    for listed in (0, 200):
        monkeypatch.setattr(sp, "LISTED_GRAMS", listed)
        assert sorted((r.id, r.name, r.start, r.end, r.original) for r in sp.surface_spans(frame(spark, texts), surfaces).collect()) == wanted


def test_rules_by_tokens(spark):
    texts = sample(13) + ["a 1-2\x1cB.c　-5 x@y.zz", "  12:30 ", "字" * 700 + "12月3日" + "字" * 700 + "A.b", "no rule here at all. None", "://", ". . .", "x 12"]
    got = sorted((r.id, r.start, r.end, r.original, r.entity_type) for r in sp.rule_spans(frame(spark, texts)).collect())
    assert got == sorted((i, s.start, s.end, s.original, s.entity_type) for i, t in enumerate(texts) for s in mk.rule_spans(t or ""))


def test_long_texts_are_masked_in_blocks(spark):
    texts = ["x" * 512 + " 12 " + "🙂" * 1000 + " buaa" + " " * 507 + "7 8", "北航" * 600, "12" + "y" * 1022, "y" * 1021 + " 12"]
    wanted = single(texts)
    for r in sp.protect(frame(spark, texts), dictionary_view(spark, ENTITIES)).collect():
        assert r.masked_text == wanted[r.id].masked_text

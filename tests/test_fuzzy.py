"""Fuzzy matching as a join, against the matcher of single texts, and by sound."""

import random

import pytest

from quillet.operators import fuzzy as fz
from quillet.operators.masking import Entity
from quillet.operators.matching import MatchConfig, Matcher
from quillet.plans.text_queries import dictionary_view

TABLE = {"们": ["men"], "门": ["men"], "闷": ["men"], "厉": ["li"], "李": ["li"], "飞": ["fei"], "羽": ["yu"], "鱼": ["yu"], "重": ["zhong", "chong"], "虫": ["chong"], "庆": ["qing"]}


def sound_table(spark, table=TABLE):
    return spark.createDataFrame([(c, s, k) for c, all_of in table.items() for k, s in enumerate(all_of)], "character string, sound string, rank int")


def by_join(spark, texts, entities, blocked=None, **how):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    spans = spark.createDataFrame(blocked, "id long, start int, end int") if blocked else None
    out = {i: [] for i in range(len(texts))}
    for r in fz.fuzzy_matches(rows, dictionary_view(spark, entities), blocked=spans, **how).collect():
        out[r.id].append({k: v for k, v in r.asDict().items() if k != "id"})
    return [sorted(out[i], key=lambda m: m["start"]) for i in range(len(texts))]


def one_by_one(texts, entities, allow_auto=False, blocked=(), **how):
    m = Matcher(list(entities), **how)
    return [[x.__dict__ for x in m.match(t or "", allow_auto, [(a, b) for j, a, b in blocked or () if i == j])] for i, t in enumerate(texts)]


def corpus(rng, n=40, texts=50):
    letters = "abcdeé"
    entities = [
        Entity(i, "".join(rng.choices(letters + " -", k=rng.randrange(2, 14))).strip() or "x", rng.choice(["TERM", "ORG", "PROJECT"]), rng.choice(["general", "law"]), rng.choice(["normalize", "normalize", "preserve"]),
               rng.randrange(-2, 25), tuple("".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(rng.randrange(3))), rng.random() > 0.1)
        for i in range(n)
    ]

    def spoilt(s):
        s = list(s)
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(s) + 1)
            s[i : i + rng.randrange(2)] = rng.choices(letters + "ßﬁ½Å", k=rng.randrange(2))
        return "".join(s)

    words = lambda: spoilt(rng.choice(rng.choice(entities).surfaces)) if rng.random() < 0.5 else "".join(rng.choices(letters + " ,.", k=8))
    out = [" ".join(words() for _ in range(rng.randrange(14))) + rng.choice(["", "。", "\n!", "\r\n"]) for _ in range(texts)]
    return entities, [*out, None, "", " ", "a" * 1500, "abc dé" * 300, "\U00010348" + out[0]]


@pytest.mark.parametrize("mode, allow_auto", [("hint", True), ("auto", True)])
def test_join_equals_single_texts(spark, mode, allow_auto):
    entities, texts = corpus(random.Random(len(mode)))
    how = dict(domain="law", mode=mode, allow_auto=allow_auto)
    got, wanted = by_join(spark, texts, entities, **how), one_by_one(texts, entities, **how)
    assert got == wanted and sum(map(len, wanted)) > 100


def test_blocked_spans_and_one_candidate(spark):
    entities, texts = corpus(random.Random(77), texts=25)
    blocked = [(i, a, a + 5) for i in range(25) for a in (3, 20)]
    config = MatchConfig(max_candidates_per_span=1, max_logged_candidates=4)
    how = dict(domain="law", config=config)
    assert by_join(spark, texts, entities, blocked, **how) == one_by_one(texts, entities, blocked=blocked, **how)


def test_homophones_and_ambiguous_ones(spark):
    entities = [Entity(1, "鬼灵门"), Entity(2, "厉飞羽"), Entity(3, "重庆")]
    sounds = sound_table(spark)
    (gate,), (name,), apart, (city,) = by_join(spark, ["鬼灵们是副本入口。", "我是李飞鱼。", "鬼灵。们", "去虫庆"], entities, mode="auto", allow_auto=True, sounds=sounds)
    assert (gate["observed"], gate["decision"], gate["match_type"]) == ("鬼灵们", "AUTO_NORMALIZE", "PINYIN_FUZZY")
    assert name["decision"] == "AUTO_NORMALIZE" and abs(name["char_score"] - 1 / 3) < 1e-9 and name["pinyin_score"] == 1
    # a surface is read in all of its ways
    assert apart == [] and city["pinyin_score"] == 1
    twins = [Entity(1, "鬼灵门"), Entity(2, "鬼灵闷")]
    (found,), = by_join(spark, ["鬼灵们"], twins, mode="auto", allow_auto=True, sounds=sounds)
    assert found["decision"] == "HINT_ONLY" and "candidate_margin_too_small" in found["reasons"]


def test_texts_are_read_in_the_ways_of_their_characters(spark):
    (found,), = by_join(spark, ["去重庆"], [Entity(1, "虫庆")], mode="hint", sounds=sound_table(spark))
    assert found["observed"] == "重庆" and found["pinyin_score"] == 1 and found["char_score"] == 0.5
    with pytest.raises(ValueError):
        fz.Sounds(sound_table(spark)).readings("重" * 7)


def test_spacing_variants(spark):
    (found,), = by_join(spark, ["Alpha Beta 项目"], [Entity(1, "AlphaBeta")], mode="auto", allow_auto=True)
    assert (found["observed"], found["canonical"]) == ("Alpha Beta", "AlphaBeta")


def test_guards(spark):
    with pytest.raises(ValueError, match="other domains"):
        by_join(spark, ["x"], [Entity(1, "x", domain="medical")], domain="legal")
    with pytest.raises(ValueError, match="limit"):
        by_join(spark, ["x"], [Entity(i, "x") for i in range(3)], config=MatchConfig(max_entities=2))
    assert by_join(spark, ["abcdef"], [Entity(1, "abcdeg")], mode="off") == [[]]
    assert by_join(spark, ["abcdef"], [Entity(1, "abcdeg", enabled=False), Entity(2, "。 ")]) == [[]]
    with pytest.raises(ValueError, match="mode"):
        by_join(spark, ["x"], [], mode="loud")


def test_pieces_leave_one_unchanged():
    least = fz.least_similarity(MatchConfig())
    assert [len(fz.pieces("a" * n, least)) for n in (1, 2, 3, 4, 7, 8, 12)] == [0, 1, 2, 2, 3, 3, 4]
    assert fz.pieces("abcdefgh", least) == [("ab", 0, 2), ("cde", 2, 2), ("fgh", 5, 2)]
    # a low bound leaves no pieces of two units
    assert {len(g) for g, _, _ in fz.pieces("abcdef", 0.2)} == {2}


def test_large_dictionary_in_turns(spark, monkeypatch):
    rng = random.Random(8)
    syllables = [a + b for a in "bcdfglmnprstv" for b in "aeiou"]
    names = sorted({"".join(rng.choices(syllables, k=rng.randrange(3, 6))) for _ in range(30_000)})[:20_000]
    rng.shuffle(names)
    entities = [Entity(i, name) for i, name in enumerate(names)]
    drop = lambda s: s[: (k := rng.randrange(len(s)))] + s[k + 1 :]
    texts = [f"so {drop(rng.choice(names))} it is" for _ in range(12)]
    config = MatchConfig(max_entities=20_000)
    view = dictionary_view(spark, entities)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    monkeypatch.setattr(fz, "POSTINGS_A_TURN", 25_000)
    got = {}
    for r in fz.fuzzy_matches(rows, view, config=config, mode="hint").collect():
        got.setdefault(r.id, []).append((r.start, r.canonical, r.final_score, r.runner_up_score))
    wanted = {i: [(x["start"], x["canonical"], x["final_score"], x["runner_up_score"]) for x in found] for i, found in enumerate(one_by_one(texts, entities, config=config, mode="hint")) if found}
    assert {i: sorted(m) for i, m in got.items()} == wanted and len(wanted) > 8


def test_blocks_hold_every_unit_with_its_place(spark):
    texts = ["Straße, ﬁn. ½ " * 90, "x", "。。a!\n", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    units = {}
    for b in fz.text_blocks(rows, 30, 100).orderBy("id").collect():
        own = slice(b.lead, b.lead + b.size)
        units.setdefault(b.id, []).extend(zip(b.units[own], b.places[own]))
        assert b.source == texts[b.id][b.places[0] : b.places[-1] + 1] and b.source_at == b.places[0] and len(b.units) <= 160
    from quillet.operators import matching as mt

    wanted = {}
    for i, t in enumerate(texts):
        for at, run in mt.runs(t or ""):
            wanted.setdefault(i, []).extend(zip(*mt.units(run, at)))
    for i, pairs in units.items():
        kept = [p for p in pairs if p[0] != "\n"]
        assert kept == wanted.get(i, [])

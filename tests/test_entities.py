"""The dictionary, masking, restoring, fuzzy matching and segments."""

import random
import zlib

import pytest

from quillet.operators import entities as en
from quillet.operators import masking as mk
from quillet.operators import refinement as rf
from quillet.operators import segments as sg
from quillet.operators.masking import Entity, Protector
from quillet.operators.matching import MatchConfig, Matcher
from quillet.plans.text_queries import dictionary_view


def protect(text, entities=(), **kw):
    return Protector(list(entities)).protect(text, **kw)


def test_bare_markers_are_repaired_and_restored():
    p = protect("版本是2.0。预算是12.5万。")
    assert [s.original for s in p.spans] == ["2.0", "12.5"]
    assert mk.restore("版本是ENTITY_000。预算是ENTITY_001万。", p) == ("版本是2.0。预算是12.5万。", [])


@pytest.mark.parametrize("bad", ["ENTITY_000和__ENTITY_000__。", "版本是ENTITY_000和ENTITY_999。", "版本是ENTITY_001。"])
def test_restore_rejects(bad):
    p = protect("版本是2.0。")
    text, reasons = mk.restore(bad, p)
    assert text == "版本是2.0。" and reasons


def test_restore_reasons():
    p = protect("版本2.0，预算12.5万。")
    a, b = (s.placeholder for s in p.spans)
    assert mk.restore(f"{b}{a}", p)[1] == ["placeholder_order_changed"]
    assert mk.restore(a, p)[1] == [f"placeholder_count:{b}:0"]
    assert mk.restore(f"{a}{b}__ENTITY_777__", p)[1][0].startswith("unknown_placeholders:__ENTITY_777__")
    assert mk.restore("__ENTITY_0", p)[1] == ["malformed_placeholder"]
    assert mk.restore("  <KEY>[a、b] ", p)[1] == ["empty_or_metadata_output"]
    two = protect("版本是2.0。预算是12.5万。")
    assert mk.restore("ENTITY_000、ENTITY_001。", two)[1] == ["entity_sentence_boundary_lost"]
    literal = protect("ENTITY_000 was 2.0")
    assert mk.restore("ENTITY_000", literal)[1] == ["ambiguous_literal_placeholder"]


def test_rule_types_and_priorities():
    kinds = {s.original: s.entity_type for s in protect("预算12.5万，使用Alpha3-XYZ模型 at https://a.b/c 2024-01-02 12:30 me@x.org ABC").spans}
    assert kinds == {"12.5": "NUMBER", "Alpha3-XYZ": "IDENTIFIER", "https://a.b/c": "URL", "2024-01-02": "DATE", "12:30": "TIME", "me@x.org": "EMAIL", "ABC": "ACRONYM"}


def test_dictionary_wins_over_rules_and_normalises():
    p = protect("北航的ABC实验 and abc", [Entity(1, "北京航空航天大学", "ORG", aliases=("北航",)), Entity(2, "Alphabet", aliases=("abc",), normalization_policy="preserve")])
    assert [(s.original, s.replacement, s.match_type) for s in p.spans] == [("北航", "北京航空航天大学", "EXACT_ALIAS"), ("ABC", "ABC", "EXACT_ALIAS"), ("abc", "abc", "EXACT_ALIAS")]
    assert mk.hints(p) == ["北京航空航天大学"] and mk.restore(p.masked_text, p)[0].startswith("北京航空航天大学的ABC")
    assert mk.audit("北航的", p) == ["missing_TERM"] and mk.audit(" ", p) == ["empty_refiner_output"]


def test_session_entries_and_overlap():
    p = protect("鬼灵门和鬼灵", trusted=[{"canonical_text": "鬼灵", "aliases": ["鬼灵门"], "entity_type": "TERM", "trust_level": "ACCEPTED"}])
    assert [(s.start, s.end, s.source) for s in p.spans] == [(0, 3, "session:ACCEPTED"), (4, 6, "session:ACCEPTED")]


SOUNDS = {"们": "men", "门": "men", "闷": "men", "厉": "li", "李": "li", "飞": "fei", "羽": "yu", "鱼": "yu"}


def sounds(text):
    return tuple(SOUNDS.get(c, c) for c in text)


def matcher(*entities, **kw):
    return Matcher(list(entities), sounds=sounds, **kw)


def test_homophone_is_automatic():
    m = matcher(Entity(1, "鬼灵门"), mode="auto").match("鬼灵们是副本入口。", allow_auto=True)
    assert [(x.observed, x.decision, x.match_type) for x in m] == [("鬼灵们", "AUTO_NORMALIZE", "PINYIN_FUZZY")]
    low = matcher(Entity(1, "厉飞羽"), mode="auto").match("我是李飞鱼。", allow_auto=True)[0]
    assert low.decision == "AUTO_NORMALIZE" and abs(low.char_score - 1 / 3) < 1e-9


def test_decisions():
    e = Entity(1, "鬼灵门")
    assert matcher(e, mode="auto").match("鬼灵们")[0].reasons == ["partial_event"]
    assert matcher(e, mode="hint").match("鬼灵们", True)[0].reasons == ["hint_mode"]
    assert matcher(e).match("鬼灵们", True)[0].decision == "KEEP_RAW"
    assert "high_risk_entity_type" in matcher(Entity(1, "鬼灵门", "PERSON"), mode="auto").match("鬼灵们", True)[0].reasons
    assert "candidate_margin_too_small" in matcher(e, Entity(2, "鬼灵闷"), mode="hint").match("鬼灵们", True)[0].reasons
    assert matcher(e, mode="off").match("鬼灵们") == [] and matcher(e).match("鬼灵们", blocked=[(2, 3)]) == []
    assert matcher(e).match("鬼灵。们") == []


def test_spacing_variants():
    got = Matcher([Entity(1, "AlphaBeta")], mode="auto").match("Alpha Beta 项目", True)
    assert [(x.observed, x.canonical) for x in got] == [("Alpha Beta", "AlphaBeta")]


def test_guards_of_the_matcher():
    with pytest.raises(ValueError):
        Matcher([Entity(1, "x", domain="medical")], domain="legal")
    with pytest.raises(ValueError):
        Matcher([Entity(i, "x") for i in range(3)], config=MatchConfig(max_entities=2))
    with pytest.raises(ValueError):
        MatchConfig(pinyin_weight=0.9)


def test_segments():
    p, m = Protector([]), matcher(Entity(1, "鬼灵门"), mode="hint")
    ready = sg.prepare("鬼灵们是入口", p, m)
    assert ready.hints == ["鬼灵门"] and ready.baseline == "鬼灵们是入口"
    assert sg.finalize("鬼灵门是入口", ready) == ("鬼灵门是入口", [])
    assert sg.finalize("鬼灵们是入口鬼灵门", ready)[1] == ["introduced_entity_from_hint:鬼灵门"]


def test_retry_once_then_baseline():
    calls = []

    def drops_once(text, hints, strict):
        calls.append(strict)
        return text if strict else "版本没有了"

    out = sg.refine_segment("版本是2.0。", drops_once, Protector([]))
    assert (out.clean_text, out.accepted, out.retries, out.placeholder_retries, calls) == ("版本是2.0。", True, 1, 1, [False, True])
    lost = sg.refine_segment("版本是2.0。", lambda *a: "没有", Protector([]))
    assert not lost.accepted and lost.clean_text == "版本是2.0。" and lost.retries == 1
    failed = sg.refine_segment("文本", sg.failing, Protector([]))
    assert failed.clean_text == "文本" and failed.error.startswith("refiner_error")


def test_merged_reasons_are_numbered():
    text = "第一句很长的话，说了很多东西，还有更多的内容在这里。" * 6 + "版本是2.0。"
    out = sg.refine_text(text, lambda t, h, s: "坏" if "2.0" in t or "ENTITY" in t else t, Protector([]))
    assert not out.accepted and all(r.startswith("segment_") for r in out.reasons) and out.clean_text == text


def rows_of(spark, rows, entities, refiner, **how):
    frame = spark.createDataFrame(rows, "id long, text string").repartition(2)
    view = dictionary_view(spark, entities) if entities else None
    return {r.id: r.asDict() for r in rf.refine_batch(frame, view, lambda: refiner, **how).collect()}


def test_batch_refinement(spark):
    got = rows_of(spark, [(1, "a  b"), (2, None), (3, " "), (1, "a  b")], [Entity(1, "Bee", aliases=("b",))], sg.squeezing)
    assert got[1]["clean_text"] == "a Bee" and got[1]["normalizations"] == ["b->Bee"] and len(got) == 3
    assert got[2]["error"] == got[3]["error"] == "input_error: missing text"


def spoiler():
    """A refiner that breaks some texts, at first only or for good, as their checksum tells."""

    def refine(text, hints, strict):
        kind = zlib.crc32(text.encode()) % 8
        if kind == 0:
            raise RuntimeError("down")
        broken = {1: text.replace("__ENTITY_000__", ""), 2: text[: len(text) // 3], 3: text + " ".join(hints), 4: text.replace("__", ""), 5: text + "__ENTITY_9"}
        return text if strict and kind in (1, 4) else broken.get(kind, " ".join(text.split()))

    return refine


@pytest.mark.parametrize("mode, limit", [("off", 40), ("auto", 40), ("hint", None)])
def test_batch_refinement_is_that_of_single_texts(spark, mode, limit):
    rng = random.Random(limit)
    entities = [Entity(1, "鬼灵门", aliases=("灵门",)), Entity(2, "Alpha Beta", "PROJECT", aliases=("ab",)), Entity(3, "Straße", "ORG")]
    bits = ["鬼灵们。", "鬼灵 门", "灵门, ", "alphabeta ", "Alpha  Bet ", "ab ", "2.0。", "x" * 9 + " ", "Strase", "\n", "。", "见 https://a.b/c ", "normal words here. "]
    rows = [(i, "".join(rng.choices(bits, k=rng.randrange(1, 16)))) for i in range(60)]
    got = rows_of(spark, rows, entities, spoiler(), mode=mode, limit=limit)
    matcher = Matcher(entities, mode=mode) if mode != "off" else None
    protector, seen = Protector(entities), set()
    for i, text in rows:
        if not text.strip():
            continue
        one = sg.refine_text(text, spoiler(), protector, matcher, limit, True) if limit else sg.refine_segment(text, spoiler(), protector, matcher, True)
        assert got[i] == {"id": i, **one.__dict__}, text
        seen |= {r.split(":")[-1 if "segment" in r else 0] for r in one.reasons + one.retry_reasons}
    assert len(seen) > 4


def test_store(spark):
    s = en.EntityStore.empty(spark).add("北航", "org", aliases=(" 北京航空航天大学 ", "北航", "")).add("心梗", domain="medical").add("合同", domain="legal", priority=5)
    assert [(r.entity_id, r.entity_type, list(r.aliases)) for r in s.view("general").collect()] == [(1, "ORG", ["北京航空航天大学"])]
    assert [r.canonical_text for r in s.view("medical").collect()] == ["北航", "心梗"]
    assert [r.canonical_text for r in s.view().collect()] == ["合同", "北航", "心梗"]
    off = s.enable(1, False)
    assert off.view("general").count() == 0 and off.get("北航").entity_id == 1
    again = off.add("北航", "ORG", priority=3, aliases=("BUAA",))
    assert [(r.entity_id, r.priority, list(r.aliases)) for r in again.view("general").collect()] == [(1, 3, ["BUAA"])]
    assert s.remove(1).aliases.count() == 0 and s.get("nobody") is None
    assert list(s.update(2, priority=7, aliases=["MI"]).get("心梗", "medical").aliases) == ["MI"]
    with pytest.raises(en.EntityError):
        s.update(2, canonical_text="合同", domain="legal")
    with pytest.raises(en.UnknownEntity):
        s.remove(99)
    with pytest.raises(en.EntityError):
        s.add(" ")
    assert [r.canonical_text for r in en.search(s.view(), "京航").collect()] == ["北航"]

"""Rule spans, dictionary occurrences, greedy choice, masking and restoring as relations and
columns, against the protector of single texts."""

import random
from dataclasses import replace

from pyspark.sql import functions as F

from quillet.operators import masking as mk
from quillet.operators import spans as sp
from quillet.operators.masking import Entity, Protector
from quillet.operators.matching import Match
from quillet.plans.text_queries import dictionary_view

BITS = [
    "https://a.b/c?d=1。", "me@x.org", "ME_2@sub.x.com.", "a@b@c.de", "2024-01-02", "2024/1/2x", "12月3日", "２０２４年1月", "12:30", "23:59:01", "3：05", "-5.5%", "+7％", "x12", "1.2.3", "3..4", "Alpha3-XYZ",
    "a.b_c-d", "ABC", "ABCd", "XÉ", "é12", "ENTITY_000", "北航", "buaa", "BUAA", "aaa", "aaaa", "\n", "\t", "。", ", ", "🙂", "no", "Kelvin",
]
ENTITIES = [
    Entity(1, "北京航空航天大学", "ORG", aliases=("北航", "buaa")), Entity(2, "aa", "TERM", priority=3, aliases=("aaa",)), Entity(3, "Alphabet", "PROJECT", normalization_policy="preserve", aliases=("ABC", "abc")),
    Entity(4, "kelvin", aliases=("XÉ",)), Entity(5, "off", enabled=False, aliases=("no",)), Entity(6, "12:30"),
]


def sample(seed, n=60):
    rng = random.Random(seed)
    joined = ["".join(rng.choice(BITS) + rng.choice(["", " ", ""]) for _ in range(rng.randrange(14))) for _ in range(n)]
    return [*joined, None, "", " ", "x" * 600 + "北航" + "aa" * 400 + " 12:30", "1 2 3 " * 500]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)


def test_rule_spans_have_their_places(spark):
    texts = sample(1)
    got = sorted((r.id, r.start, r.end, r.original, r.entity_type, r.priority) for r in sp.rule_spans(frame(spark, texts)).collect())
    wanted = sorted((i, s.start, s.end, s.original, s.entity_type, s.priority) for i, t in enumerate(texts) for s in mk.rule_spans(t or ""))
    assert got == wanted and len({x[4] for x in wanted}) == 7


def test_surfaces_are_found_as_by_the_automaton(spark):
    texts, names = sample(2), ["北航", "aaa", "aa", "BUAA", "XÉ", "kelvin", "🙂🙂", "。", "x" * 550, "longer than any"]
    surfaces = spark.createDataFrame([(k, s) for k, s in enumerate(names)], "name int, surface string")
    got = sorted((r.id, r.name, r.start, r.end, r.original) for r in sp.surface_spans(frame(spark, texts), surfaces).collect())
    machine = mk.Surfaces([(s, k) for k, s in enumerate(names)])
    assert got == sorted((i, k, a, b, t[a:b]) for i, t in enumerate(texts) if t for a, b, k in machine.find(t))
    none = spark.createDataFrame([], "name int, surface string")
    assert sp.surface_spans(frame(spark, texts), none).collect() == []


def test_greedy_choice(spark):
    rng = random.Random(4)
    rows = [(g, a := rng.randrange(60), a + rng.randrange(1, 9), rng.randrange(4)) for g in range(8) for _ in range(40)]
    rows += [(9, 2 * i, 2 * i + 3, 0) for i in range(400)] + rows[:5]
    spans = spark.createDataFrame(rows, "g int, start int, end int, low int")
    wanted = set()
    for g in {r[0] for r in rows}:
        kept = []
        for r in sorted({r for r in rows if r[0] == g}, key=lambda r: (r[3], r[1], r[2])):
            if not any(r[1] < k[2] and k[1] < r[2] for k in kept):
                kept.append(r)
        wanted |= set(kept)
    got = [tuple(r) for r in sp.greedy(spans, ["g"], ["low"]).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted


def protections(spark, texts, trusted=(), fuzzy=()):
    entries = spark.createDataFrame([(i, m["canonical_text"], list(m["aliases"]), m["entity_type"], m["trust_level"]) for i, all_of in trusted for m in all_of], "id long, canonical_text string, aliases array<string>, entity_type string, trust_level string") if trusted else None
    matches = spark.createDataFrame([(i, m.start, m.end, m.observed, m.entity_id, m.canonical, m.entity_type, m.domain, m.match_type, m.final_score, m.priority, m.decision) for i, m in fuzzy],
                                    "id long, start int, end int, observed string, entity_id long, canonical string, entity_type string, domain string, match_type string, final_score double, priority int, decision string") if fuzzy else None
    return sp.protect(frame(spark, texts), dictionary_view(spark, ENTITIES), entries, matches)


def single(texts, trusted=(), fuzzy=()):
    p = Protector([e for e in ENTITIES if e.enabled])
    return [p.protect(t or "", dict(trusted).get(i, ()), [m for j, m in fuzzy if i == j]) for i, t in enumerate(texts)]


def test_protected_texts(spark):
    texts = sample(3)
    trusted = [(i, [{"canonical_text": "no", "aliases": ["🙂", "a.b"], "entity_type": "TERM", "trust_level": "ACCEPTED"}]) for i in range(0, 60, 2)]
    auto = Match(0, 2, "", 4, "kelvin", "TERM", "general", "kelvin", "CHAR_FUZZY", 1, 1, 1, 1, 0, 0.9, None, 1.0, 0, "AUTO_NORMALIZE", [])
    fuzzy = [(i, replace(auto, observed=t[:2], decision="AUTO_NORMALIZE" if i % 5 else "HINT_ONLY", **({"entity_id": 3, "canonical": "Alphabet"} if i % 7 == 0 else {}))) for i, t in enumerate(texts) if t and len(t) > 2]
    wanted = single(texts, trusted, fuzzy)
    for r in protections(spark, texts, trusted, fuzzy).collect():
        p = wanted[r.id]
        assert r.masked_text == (None if texts[r.id] is None else p.masked_text)
        assert [s.asDict() for s in r.spans] == [s.row() for s in p.spans], texts[r.id]


def test_repeated_rows_count_once(spark):
    rows = spark.createDataFrame([(1, "北航 12"), (1, "北航 12")], "id long, text string")
    (r,) = sp.protect(rows, dictionary_view(spark, ENTITIES)).collect()
    assert r.masked_text == "__ENTITY_000__ __ENTITY_001__"
    assert sp.protect(rows.limit(0), dictionary_view(spark, ENTITIES)).collect() == []


def changes(rng, masked):
    """A refined form of a masked text, right or wrong in some way."""
    marks = mk.PLACEHOLDER.findall(masked)
    one = rng.choice(marks) if marks else "__ENTITY_000__"
    return rng.choice([
        masked, f"  {masked} <KEY>[a、b] ", masked.replace("__ENTITY_000__", "ENTITY_000"), masked.replace(one, ""), masked + one, masked.replace(one, "__ENTITY_77__"), masked + "__ENTITY_777__",
        masked.replace("。", ""), masked.replace("\n", " "), "", " <KEY>[x]", "<KEY> " + masked, "".join(reversed(marks)), masked.replace("__", ""), masked.lower(), "、".join(marks), None,
    ])


def test_restored_texts(spark):
    rng = random.Random(6)
    texts = [t for seed in (5, 6, 7) for t in sample(seed) if t]
    plain = single(texts)
    refined = [changes(rng, p.masked_text) for p in plain]
    texts, refined = [*texts, "ENTITY_000 was 2.0"], [*refined, "ENTITY_000 was __ENTITY_001__"]
    plain = single(texts)
    p = protections(spark, texts).join(spark.createDataFrame(list(enumerate(refined)), "id long, refined string"), "id")
    seen = set()
    for r in p.select("id", sp.restored(F.col("refined"), F.col("text"), F.col("masked_text"), F.col("spans")).alias("r")).collect():
        text, reasons = mk.restore(refined[r.id] or "", plain[r.id])
        assert (r.r.text, r.r.reasons) == (text, reasons), (texts[r.id], refined[r.id])
        seen |= {x.split(":")[0] for x in reasons} or {""}
    assert len(seen) == 8, seen


def test_hints_audit_and_aliases(spark):
    texts = ["北航的ABC实验 and abc 12:30", "plain", "Kelvin 12:30 北航"]
    p = protections(spark, texts).orderBy("id")
    spans, text = F.col("spans"), F.col("text")
    rows = p.select(sp.hints(spans).alias("h"), sp.audit(F.lit("北航的 KELVIN"), spans).alias("a"), sp.audit(F.lit(" "), spans).alias("e"), sp.normalized_aliases(F.concat(text, F.lit(" <KEY>[x]")), spans).alias("n")).collect()
    assert [r.h for r in rows] == [["北京航空航天大学"], [], ["kelvin", "北京航空航天大学"]]
    assert [r.a for r in rows] == [["missing_PROJECT", "missing_TERM"], [], ["missing_TERM"]] and rows[0].e == ["empty_refiner_output"]
    assert rows[0].n.text == "北京航空航天大学的ABC实验 and abc 12:30" and [c.observed for c in rows[0].n.changes] == ["北航"]
    assert rows[1].n.text == "plain" and rows[1].n.changes == []

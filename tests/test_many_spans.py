"""Texts of a thousand spans and more: their marks have four digits."""

from test_spans import frame, single

from quillet.operators import masking as mk
from quillet.operators import refinement as rf
from quillet.operators import segments as sg
from quillet.operators import spans as sp


def test_marks_of_four_digits_are_restored(spark):
    text = " AB" * 1002 + "."
    p = single([text])[0]
    assert p.spans[-1].placeholder == "__ENTITY_1001__"
    bare = p.masked_text.replace("__ENTITY_1001__", "ENTITY_1001")
    swapped = p.masked_text.replace("__ENTITY_1001__", "x").replace("__ENTITY_1000__", "__ENTITY_1001__").replace("x", "__ENTITY_1000__")
    changed = [p.masked_text, bare, swapped, p.masked_text.replace("__ENTITY_1000__", ""), p.masked_text + " __ENTITY_1002__"]
    reasons = [[], [], ["placeholder_order_changed"], ["placeholder_count:__ENTITY_1000__:0"], ["unknown_placeholders:__ENTITY_1002__"]]
    assert [mk.restore(c, p)[1] for c in changed] == reasons
    assert mk.restore(bare, p)[0] == text.strip()
    rows = sp.protect(frame(spark, [text])).crossJoin(spark.createDataFrame(list(enumerate(changed)), "k int, refined string"))
    got = rows.select("k", sp.restored(rows.refined, rows.text, rows.masked_text, rows.spans).alias("r")).collect()
    assert [r.r.reasons for r in sorted(got)] == reasons
    assert {r.r.text for r in got if not r.r.reasons} == {text.strip()}


def test_identity_is_accepted(spark):
    [r] = rf.refine_batch(frame(spark, [" AB" * 1001]), None, lambda: sg.identity, mode="off").collect()
    assert (r.accepted, r.retries, r.clean_text) == (True, 0, ("AB " * 1001).strip())

"""A refiner's answers stay beside their segments: no join brings them back."""

from quillet.operators import refinement as rf


def test_calls_add_columns_without_a_shuffle(spark, capsys):
    def upper(text, hints, strict):
        if text == "b":
            raise RuntimeError("down")
        return text.upper() + ",".join(hints) + str(strict)

    rows = spark.createDataFrame([(1, "a", ["h"]), (2, "b", []), (3, None, [])], "id long, masked_text string, hints array<string>")
    out = rf.called(rows.where("id < 3"), lambda: upper, True)
    out.explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Join" not in plan and plan.count("ArrowEvalPython") == 1
    assert sorted((r.id, r.hints, r.output, r.error) for r in out.collect()) == [(1, ["h"], "AhTrue", None), (2, [], None, "refiner_error: down")]

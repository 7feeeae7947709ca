"""Calls that are made once, over failures and restarts."""

import pytest

from quillet.operators import calls as cl


def counting(log, broken=()):
    """A service that writes down what it is called with and fails for some requests."""

    def make():
        def call(text):
            with open(log, "a") as out:
                out.write(text + "\n")
            if text in broken:
                raise RuntimeError("down")
            return text.upper()

        return call

    return make


def test_calls_are_made_once(spark, tmp_path):
    log, path = str(tmp_path / "log"), str(tmp_path / "cache")
    rows = spark.createDataFrame([(i, f"t{i % 40}" if i else None) for i in range(100)], "id long, text string")
    ask = lambda broken=(), **how: cl.answered(rows, "text", path, counting(log, broken), pause_s=0.0, chunk=4, **how)
    called = lambda: open(log).read().split()
    first = {r.id: (r.answer, r.error) for r in ask(("t3", "t7")).collect()}
    assert first[0] == (None, None) and first[1] == ("T1", None) == first[81 - 40] and first[3] == (None, "RuntimeError: down")
    assert called().count("t3") == 3 and all(called().count(f"t{i}") == 1 for i in range(40) if i not in (3, 7))
    again = {r.id: (r.answer, r.error) for r in ask().collect()}
    assert again[3] == ("T3", None) and len(again) == 100 and called().count("t3") == 4 and called().count("t5") == 1
    assert {r.id: r.answer for r in ask(name="other").collect()}[5] == "T5" and called().count("t5") == 2
    assert cl.answered(rows.limit(0), "text", path, counting(log)).collect() == []


def test_a_run_that_stops_half_way(spark, tmp_path, monkeypatch):
    log, path = str(tmp_path / "log"), str(tmp_path / "cache")
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(60)], "id long, text string")
    state = tmp_path / "die"
    state.write_text("x")
    service = counting(log)

    def make():
        inner = service()

        def call(text):
            if len(open(log).read().split()) >= 30 and state.exists():
                raise KeyboardInterrupt  # the worker goes, and no handler of errors sees it
            return inner(text)

        open(log, "a").close()
        return call

    with pytest.raises(Exception):
        cl.answered(rows, "text", path, make, chunk=5).collect()
    kept = {r.key for r in cl.read_answers(spark, path).collect()}
    before = open(log).read().split()
    state.unlink()
    got = cl.answered(rows, "text", path, make, chunk=5).collect()
    assert all(r.answer == r.text.upper() for r in got) and len(got) == 60
    after = open(log).read().split()[len(before) :]
    # only the chunks that were under way are called again
    assert len(kept) > 0 and len(after) == 60 - len(kept)

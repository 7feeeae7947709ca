"""Trust where the mean of confidences equals the least one."""

from itertools import permutations

import duckdb

from quillet.plans.session_queries import SQL_TRUSTED
from quillet.streaming import steps


def _level(confidences):
    m = steps.MemoryState(min_confidence=0.3)
    return [m.observe("a", 0, confidence=c, observation_id=str(i)) for i, c in enumerate(confidences)][-1]["trust_level"]


def test_mean_at_the_least_confidence_is_accepted():
    assert _level([0.3] * 10) == "ACCEPTED"
    assert {_level(p) for p in permutations([0.1, 0.5, 0.2, 0.4])} == {"ACCEPTED"}
    assert {_level(p) for p in permutations([0.1, 0.5, 0.2, 0.3999])} == {"OBSERVED"}


def test_sql_states_the_same_rule():
    for values in ([0.3] * 10, [0.1, 0.5, 0.2, 0.4], [0.1, 0.5, 0.2, 0.3999], [0.3]):
        (trusted,) = duckdb.connect().execute(f"SELECT {SQL_TRUSTED} FROM (SELECT unnest(?::DOUBLE[]) AS c)", [values]).fetchone()
        assert trusted == (_level(values) == "ACCEPTED")

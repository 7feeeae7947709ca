"""Vector search, URL filters, preference formatting, the network and the graph."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from quillet.llm.chat_format import conversations_of, echo_pairs, format_preferences
from quillet.llm.common import shingle_sets, word_fingerprints
from quillet.llm.graph import connected_components
from quillet.llm.near_dedup import fast_similarity_sketch
from quillet.llm.recurrent_lm import Network
from quillet.llm.url_filter import Rule, judge_urls
from quillet.llm.vector_search import nearest


def brute_nearest(rows, is_query, k):
    out = set()
    usable = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    for q, a in usable:
        if is_query(q):
            scores = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in usable if c != q and len(a) == len(b))
            out |= {(q, r + 1, c, round(-s, 9)) for r, (s, c) in enumerate(scores[:k])}
    return out


def vectors(spark, n=400):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 8))
    data = [(i, np.float32(centres[i % 12] + 0.2 * rng.standard_normal(8)).tolist()) for i in range(n)]
    data += [(1000 + i, data[5][1]) for i in range(60)]  # one very common vector
    data += [(2000, None), (2001, [0.0] * 8), (2002, [None] + [1.0] * 7), (2003, [math.nan] + [1.0] * 7), (2004, [math.inf] + [1.0] * 7), (None, [1.0] * 8)]
    data += [(3000, [1.0, 2.0]), (3010, [2.0, 1.0]), data[0]]
    return data, spark.createDataFrame([(i, v, 1, 2) for i, v in data], "vec_id long, embedding array<float>, rank int, score int").repartition(4)


def test_nearest_is_exact_at_factor_one(spark):
    data, table = vectors(spark)
    for shard_rows in (50, 5000):
        got = nearest(table, F.col("vec_id") % 10 == 0, k=7, shard_rows=shard_rows, query_rows=30)
        assert {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got.collect()} == brute_nearest(data, lambda q: q % 10 == 0, 7)


def test_relaxed_factor_keeps_recall(spark):
    data, table = vectors(spark, 1500)
    want = {(q, c) for q, _, c, _ in brute_nearest(data, lambda q: q % 10 == 0, 10)}
    got = {(r.query_id, r.vec_id) for r in nearest(table, F.col("vec_id") % 10 == 0, k=10, factor=0.6, shard_rows=500).collect()}
    assert len(want & got) / len(want) >= 0.9


def test_nearest_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest(none, F.col("vec_id") % 20 == 0).collect() == []


RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]


def test_urls(spark):
    link = '<html><link href="{}" rel=canonical>'
    pages = spark.createDataFrame([
        (1, "https://A.Net/x", None, 0), (2, "http://www.example.net/en/1?q=/", "", 0), (3, "http://notnet/", "", 0), (4, None, link.format("http://a.net/"), 0),
        (5, "nourl", "", 0), (6, "https://m.example.com/de/", "", 0), (7, "https://example.com/fr", link.format("http://q.net/z"), 0),
        (8, "http://x.org/fr/1", link.format("http://q.net/z"), 0), (9, "http://alias.io/a", link.format("//example.com/de/7"), 0),
        (10, "http://far.io/b", '<META http-equiv="refresh" content="0; URL=http://alias.io/a">', 0), (11, "http://rel.io/d/e", link.format("/de"), 0),
        (12, "ftp://HOST#://net/", "", 0), (1, "https://A.Net/x", None, 0),
    ], "page_id long, url string, html string, node int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, RULES).collect()}
    assert judge_urls(pages, RULES).count() == 13
    assert got[1] == ("a.net", "/x", "net/", "block") and got[2][2:] == ("example.net/en/", "allow")
    assert got[3][2:] == (None, "allow") and got[4] == ("", "", None, "allow") == got[5]
    assert got[6][2:] == ("example.com/de/", "block") and got[12] == ("host", "", None, "allow")
    # 8 is explicitly allowed, which also spares 7, though both name a blocked page
    assert got[8][2:] == ("org/fr/", "allow") and got[7][2:] == (None, "allow")
    assert got[9][3] == got[10][3] == "block" and got[11][3] == "allow"
    extra = spark.createDataFrame([("http://rel.io/de", "http://b.net/")], "from_url string, to_url string")
    assert {r.page_id: r.verdict for r in judge_urls(pages, RULES, extra).collect()}[11] == "block"
    assert judge_urls(pages.where("false"), RULES).collect() == []


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(0, i) for i in range(400, 480)] + [(None, 3), (5, 5)]
    edges += [(i, i + 1) for i in range(1000, 1060)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in list(up)} and len(got) == len(up)


def test_preferences(spark):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "go on"), (1, 3, "assistant", "end"), (1, 4, "user", "thanks"),
        (2, 0, "user", "only me"), (3, 0, "assistant", "first"), (4, 0, None, None), (4, 1, "assistant", None), (5, 1, "assistant", "b"), (5, 0, "user", "b"),
    ]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in format_preferences(echo_pairs(conversations_of(table))).collect()}
    assert got[1].prompt_turns == 3 and got[1].prompt.count("<|end|>") == 3 and got[1].chosen_mask == [1] and got[1].usable
    assert got[1].chosen_text == "<|assistant|>\nend\n<|end|>\n" and got[1].rejected_text == "<|assistant|>\ngo on\n<|end|>\n"
    assert got[2].prompt_turns == 1 and not got[2].usable and got[2].chosen_text == ""
    assert got[3].rejected_text == "<|assistant|>\n\n<|end|>\n" and got[3].prompt == ""
    assert got[4].prompt.startswith("<|unknown|>") and not got[4].usable  # null echoes null
    assert got[5].prompt_turns == 2 and not got[5].usable  # the echo equals the answer
    pairs = spark.createDataFrame(
        [(1, [("user", "q"), ("assistant", "a")], [("user", "q"), ("assistant", "b"), ("user", "c"), ("assistant", "d")], "x"), (2, None, [("user", "q")], "x")],
        "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt string",
    )
    out = {r.pair_id: r for r in format_preferences(pairs).collect()}
    assert out[1].rejected_mask == [1, 0, 1] and out[1].prompt == "<|user|>\nq\n<|end|>\n"
    assert out[2].prompt_turns == 0 and not out[2].usable
    assert format_preferences(pairs.where("false")).collect() == []


def test_sketch_agreement_is_near_jaccard():
    rng = np.random.default_rng(0)
    t, errors = 255, []
    for _ in range(40):
        common, own = rng.integers(0, 2**63, 150, dtype=np.uint64), rng.integers(0, 2**63, 100, dtype=np.uint64)
        a, b = np.concatenate([common, own[:50]]), np.concatenate([common, own[50:]])
        s = fast_similarity_sketch(np.concatenate([a, b]), np.repeat([0, 1], 200), 2, t)
        assert (s != np.iinfo(np.uint64).max).all()
        errors.append((s[0] == s[1]).mean() - 150 / 250)
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.15


def test_fingerprints():
    words, counts = word_fingerprints([b"a bb a", b"", b" \t\n", b"bb"])
    assert counts.tolist() == [3, 0, 0, 1] and words[0] == words[2] and words[1] == words[3] != words[0]
    sets = shingle_sets([b"a b c d e f", b"a b c d e", b"a b", b"a  b\n", b"b a", b""])
    assert list(map(len, sets)) == [2, 1, 1, 1, 1, 0] and sets[1][0] in sets[0] and sets[2] == sets[3] != sets[4]


def test_network_gradients_and_carried_state():
    rng = np.random.default_rng(0)
    net = Network(70, hidden=5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    inputs, targets = rng.integers(0, 71, (6, 4)), rng.integers(0, 71, (6, 4))
    keep, h0 = (rng.random((6, 4)) > 0.2).astype(float), rng.standard_normal((4, 5))

    def loss():
        table, h, states = net.p["emb"] @ net.p["wx"] + net.p["b"], h0, []
        for t in range(6):
            h = net.step(h * keep[t][:, None], table[inputs[t]])[0]
            states.append(h)
        return -net.log_probs(np.concatenate(states), targets.ravel()).sum()

    _, grad, _ = net.window_gradient(inputs, targets, keep, h0)
    for name, value in net.p.items():
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in value.shape)
            old = value[at]
            value[at] = old + 1e-5
            high = loss()
            value[at] = old - 1e-5
            low = loss()
            value[at] = old
            assert abs((high - low) / 2e-5 - grad[name][at]) < 1e-4 * max(1, abs(grad[name][at]))
    # whole-document scores do not depend on what is scored together
    lengths = np.array([100, 3, 57, 1])
    tokens = rng.integers(0, 71, lengths.sum())
    together = net.score(tokens, lengths)
    starts = np.cumsum(lengths) - lengths
    for i, (s, n) in enumerate(zip(starts, lengths)):
        assert abs(net.score(tokens[s : s + n], np.array([n]))[0] - together[i]) < 1e-3
    total = np.exp([net.log_probs(np.ones((1, 5)), np.array([k]))[0] for k in range(71)]).sum()
    assert abs(total - 1) < 1e-6

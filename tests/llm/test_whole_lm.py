"""The language model learns from all training documents and from words of any rank."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillet.llm import recurrent_lm as rl
from quillet.llm.recurrent_lm import score_documents


@pytest.mark.parametrize("vocabulary", [64, 2])
def test_word_order_outside_of_the_sample_reaches_the_score(spark, vocabulary):
    """The order of the words is shown by the documents outside of the sample only; with a vocabulary of two
    the words whose order is asked for lie outside of that too."""
    rng, words = random.Random(7), ["ka", "lo", "mi", "nu", "po", "ru", "sa", "te"]
    sampled = spark.range(2000).orderBy(F.xxhash64("id"), "id").first()[0]
    rows = [(sampled, " ".join(rng.choices(words, k=160)))]
    for i in set(range(2000)) - {sampled}:
        at = rng.randrange(8)
        rows.append((i, " ".join(words[(at + k) % 8] for k in range(160))))
    mixed = words * 20
    rng.shuffle(mixed)
    rows += [(10000, " ".join(words * 20)), (10001, " ".join(mixed))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in score_documents(docs, F.col("doc_id") >= 10000, vocabulary=vocabulary, sample_docs=1, steps=60).collect()}
    assert got[10000].n_tokens == got[10001].n_tokens and got[10000].base_score == pytest.approx(got[10001].base_score)
    assert got[10000].score > got[10001].score + 30


def scalar_scores(net, token_of, rest_log, texts):
    """log10 probabilities by the network's equations, one token after the other."""
    p, n = {k: v.astype(float) for k, v in net.p.items()}, net.hidden
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for words in texts:
        h, last, total = np.zeros(n), net.end_token, 0.0
        for w in words:
            gx, u = p["emb"][last] @ p["wx"] + p["b"], h @ p["wh"]
            r, z = sigmoid(gx[:n] + u[:n]), sigmoid(gx[n : 2 * n] + u[n : 2 * n])
            h = (1 - z) * np.tanh(gx[2 * n :] + r * u[2 * n :]) + z * h
            classes, token = softmax(h @ p["wc"] + p["bc"]), token_of(w)
            if token < net.size:
                k = token // rl.CLASS_WORDS
                members = range(k * rl.CLASS_WORDS, min(net.size, (k + 1) * rl.CLASS_WORDS))
                inner = softmax(p["wo"][list(members)] @ h + p["bo"][list(members)])
                total += math.log10(classes[k] * inner[token - members[0]])
            else:
                total += math.log10(classes[net.classes + token - net.size]) + rest_log(w)
            last = token
        yield total


@pytest.mark.parametrize("head", [1 << 17, 50])
def test_scores_match_a_scalar_network(spark, monkeypatch, head):
    """All counts of the words but a few are equal, so the vocabulary is cut within a tie."""
    rng, kept = random.Random(1), {}
    learn_all = rl._learn_all

    def keep(training, words, ids, model):
        kept.update(words=words, ids=ids, model=learn_all(training, words, ids, model))
        return kept["model"]

    monkeypatch.setattr(rl, "_learn_all", keep)
    names = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.sample(names, 300))) for i in range(1, 11)] + [(20, "w1 W2 never seen"), (30, None), (40, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in score_documents(docs, F.col("doc_id") % 10 == 0, head=head, vocabulary=40, steps=20).collect()}
    net = rl.Network.load(kept["model"])
    assert net.size == 40 and len(kept["words"]) == 40
    mark = lambda w: int(rl.word_fingerprints([w.encode()])[0][0]) if w else int(rl.END)
    of = dict(zip(kept["words"].tolist(), kept["ids"].tolist()))
    token_of = lambda w: of.get(mark(w), net.size + mark(w) % rl.REST)
    texts = {i: [*(t or "").lower().split(), None] for i, t in rows}
    counts = Counter(w for i, ws in texts.items() if i % 10 for w in ws)
    outside = [w for w in counts if mark(w) not in of]
    total, size = Counter(), Counter()
    for w in outside:
        total[mark(w) % rl.REST] += counts[w]
        size[mark(w) % rl.REST] += 1

    def rest_log(w):
        k = mark(w) % rl.REST
        return math.log10((counts[w] + 0.1) / (total[k] + 0.1 * (size[k] + 1)))

    for i, want in zip(texts, scalar_scores(net, token_of, rest_log, texts.values())):
        assert got[i].score == pytest.approx(want, rel=1e-4, abs=1e-3)


def test_commonest_words_keep_ties_up_to_the_limit(spark):
    end = int(rl.END.view(np.int64))
    counts = spark.createDataFrame([(i, 5) for i in range(1000)] + [(2000, 9), (2001, 1), (end, 1)], "word long, n long")
    got = {r.word for r in rl._commonest(counts, 500).collect()}
    assert got == {2000, end, *range(499)}

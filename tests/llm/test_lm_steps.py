"""The network's work is done on few large arrays, with the values of the plain equations."""

import numpy as np
import pytest

from quillet.llm.recurrent_lm import CLASS_WORDS, SCORED_TOKENS, Network


def plain_log_probs(net, states, tokens):
    p, cls = {k: v.astype(float) for k, v in net.p.items()}, net.class_of(tokens)
    log_softmax = lambda x: x - x.max() - np.log(np.exp(x - x.max()).sum())
    for h, k, token in zip(states.astype(float), cls.tolist(), tokens.tolist()):
        value = log_softmax(h @ p["wc"] + p["bc"])[k]
        if token < net.size:
            part = slice(k * CLASS_WORDS, min(net.size, (k + 1) * CLASS_WORDS))
            value += log_softmax(p["wo"][part] @ h + p["bo"][part])[token - part.start]
        yield value


@pytest.mark.parametrize("scale", [1, 3000])
def test_softmax_of_small_and_of_huge_logits(scale):
    """A last class that is not full, more rows than are taken at a time, and logits whose exp overflows."""
    rng = np.random.default_rng(2)
    net = Network(70, hidden=5, rest=3)
    net.p = {k: v * np.float32(scale) if k in ("wc", "wo", "bo") else v for k, v in net.p.items()}
    tokens = rng.integers(0, 73, 5000)
    states = np.tanh(rng.standard_normal((5000, 5))).astype(np.float32)
    got = net.log_probs(states, tokens)
    assert np.allclose(got, list(plain_log_probs(net, states, tokens)), rtol=1e-4, atol=1e-4)
    grad = {k: np.zeros_like(v) for k, v in net.p.items()}
    again, back = net.log_probs(states, tokens, grad)
    assert np.array_equal(got, again) and np.isfinite(back).all() and all(np.isfinite(g).all() for g in grad.values())


def test_scores_take_the_softmax_of_many_windows_at_once():
    """Long documents leave few streams, so a window holds few tokens; a softmax of each window was slow."""
    rng = np.random.default_rng(3)
    net, calls = Network(70, hidden=5), []
    log_probs = net.log_probs

    def counted(states, tokens, grad=None):
        calls.append(len(tokens))
        return log_probs(states, tokens, grad)

    net.log_probs = counted
    lengths = np.array([6000, 5000, 900, 1, 400])
    tokens = rng.integers(0, 71, lengths.sum())
    got = net.score(tokens, lengths)
    assert sum(calls) == lengths.sum() and len(calls) <= 1 + lengths.sum() // (SCORED_TOKENS // 2)
    ends = np.cumsum(lengths)
    alone = [net.score(tokens[e - n : e], lengths[i : i + 1])[0] for i, (e, n) in enumerate(zip(ends, lengths))]
    assert np.allclose(got, alone, rtol=1e-5)

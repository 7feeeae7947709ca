"""Language-model scoring by a gated recurrent network in numpy.

Corpus counts. The tokens of all training documents are counted; words are 64-bit
fingerprints. The commonest ``HEAD`` words are broadcast, rarer ones meet their counts in
one shuffle, so frequent words never gather in a task.

Network. A GRU reads the previous token; the output softmax is factored into classes of
words of similar frequency and words within the class. The words outside of the
vocabulary are dealt over ``REST`` more classes by fingerprint; each class is read and
predicted as a token, and within it a word has its smoothed corpus probability, so the
model gives every text a probability and every word is context.

Training is truncated backpropagation with Adam. ``STEPS`` windows of a sample of
documents give the weights to begin with. From these every task then reads all of its
training documents, whole and once each, and the tasks' weights are averaged by their
tokens. They are summed in a fixed order, but how the input is cut into tasks moves the
weights a little.

Scoring. Documents are laid into parallel streams; the state is carried from window to
window and set to zero where a document begins, so the log-likelihood is that of the
whole document.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import lowered, slabs, small_batches, stored, word_fingerprints

END = np.uint64(0x5DEECE66D1234567)
HEAD = 1 << 17
VOCABULARY = 1024
CLASS_WORDS = 32
#: Classes of the words outside of the vocabulary, a power of two.
REST = 32
HIDDEN = 16
SAMPLE_DOCS = 1024
STEPS = 800
WINDOW = 32
STREAMS = 64
POOL_TOKENS = 1 << 22
#: The pass over all documents: tokens laid out at a time, most streams, learning rate,
#: and rows of weights held by a task that sums them.
PASS_TOKENS = 1 << 20
PASS_STREAMS = 256
PASS_RATE = 0.003
SUM_ROWS = 16
SUM_TASKS = 8
SMOOTH = 0.1
#: Rows of a softmax at a time, so that they stay in the cache, and tokens whose states a
#: score gathers for it.
SOFTMAX_ROWS = 2048
SCORED_TOKENS = 1 << 14
#: Logits below are summed as they are; one of a word that isn't there.
SMALL = 60.0
NEVER = -1e4


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words, an END after each text, and tokens per text."""
    words, counts = word_fingerprints(texts)
    out = np.insert(words, np.cumsum(counts), END)
    return out, counts + 1


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [lowered(t) for t in batch["text"]]
        for a, b in slabs(texts):
            word, n = np.unique(_tokens(texts[a:b])[0], return_counts=True)
            yield pd.DataFrame({"word": word.view(np.int64), "n": n})


class Network:
    """GRU with class-factored softmax; arrays are float32.

    Tokens are 0 .. size - 1 for the vocabulary, most frequent first, and size .. size +
    rest - 1 for all other words, each a class of its own after those of the vocabulary.
    """

    NAMES = ("emb", "wx", "wh", "b", "wc", "bc", "wo", "bo")

    def __init__(self, size: int, hidden: int = HIDDEN, seed: int = 7, arrays: dict | None = None, rest: int = 1):
        self.size, self.hidden, self.rest = size, hidden, rest
        self.classes = -(-size // CLASS_WORDS)
        if arrays is None:
            rng = np.random.default_rng(seed)
            normal = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
            h = hidden
            arrays = dict(
                emb=normal(size + rest, h), wx=normal(h, 3 * h), wh=normal(h, 3 * h), b=np.zeros(3 * h, np.float32),
                wc=normal(h, self.classes + rest), bc=np.zeros(self.classes + rest, np.float32),
                wo=normal(size, h), bo=np.zeros(size, np.float32),
            )
        self.p = {k: arrays[k] for k in self.NAMES}
        self.end_token = 0

    def class_of(self, tokens: np.ndarray) -> np.ndarray:
        return np.where(tokens < self.size, tokens // CLASS_WORDS, tokens - self.size + self.classes)

    def table(self) -> np.ndarray:
        """What each token read adds to the gates."""
        return self.p["emb"] @ self.p["wx"] + self.p["b"]

    def _forward(self, table: np.ndarray, inputs: np.ndarray, keep: np.ndarray, h: np.ndarray) -> tuple:
        """States before each step, inverse gates r and z, candidates, recurrent parts of
        all gates and new states, each (steps, units, streams), so that a step is a few
        calls on whole arrays. ``h`` is (units, streams)."""
        n, (steps, streams) = self.hidden, inputs.shape
        h = h.astype(np.result_type(h, table), copy=False)
        # the inverse of a sigmoid is 1 + exp(-x): what goes into the gates is negated beforehand
        sign = np.ones(3 * n, h.dtype)
        sign[: 2 * n] = -1
        wh = np.ascontiguousarray((self.p["wh"] * sign).T)
        gx = np.ascontiguousarray((table * sign)[inputs].transpose(0, 2, 1))
        into_gates, into_c = gx[:, : 2 * n], gx[:, 2 * n :]
        before, c, states = (np.empty((steps, n, streams), h.dtype) for _ in range(3))
        u, inverse = np.empty((steps, 3 * n, streams), h.dtype), np.empty((steps, 2 * n, streams), h.dtype)
        ones, begins = np.ones((2 * n, streams), h.dtype), (keep < 1).any(axis=1).tolist()
        with np.errstate(over="ignore"):
            for t in range(steps):
                was, now, gates, part, to = before[t], states[t], inverse[t], u[t], c[t]
                if begins[t]:
                    np.multiply(h, keep[t], out=was)
                else:
                    was[...] = h
                np.dot(wh, was, out=part)
                np.add(part[: 2 * n], into_gates[t], out=gates)
                np.exp(gates, out=gates)
                np.add(gates, ones, out=gates)
                np.divide(part[2 * n :], gates[:n], out=to)
                np.add(to, into_c[t], out=to)
                np.tanh(to, out=to)
                np.subtract(was, to, out=now)
                np.divide(now, gates[n:], out=now)
                np.add(now, to, out=now)
                h = now
        return before, inverse, c, u, states

    def step(self, h: np.ndarray, gx: np.ndarray) -> tuple:
        """(new states, gates r and z, candidates) of one step, a stream a row; ``gx`` are
        the table's rows of the tokens read."""
        n, keep = self.hidden, np.ones((1, len(h)), h.dtype)
        _, inverse, c, _, states = self._forward(gx, np.arange(len(h))[None], keep, h.T)
        return states[0].T, 1 / inverse[0, :n].T, 1 / inverse[0, n:].T, c[0].T

    def log_probs(self, states: np.ndarray, tokens: np.ndarray, grad: dict | None = None):
        """Natural log-probabilities of the tokens (of their class alone, if outside the
        vocabulary); with ``grad``, adds the gradients of their negative sum to it and
        returns those of the states too."""
        p, n, dtype = self.p, self.hidden, states.dtype
        # in order of classes; a last column of ones carries the biases
        order = _order(self.class_of(tokens), self.classes + self.rest)
        tokens = tokens[order]
        cls = self.class_of(tokens)
        s = np.ones((len(tokens), n + 1), dtype)
        s[:, :n] = states[order]
        wc = np.vstack([p["wc"], p["bc"]])
        wo = np.zeros((self.classes * CLASS_WORDS, n + 1), dtype)
        wo[: self.size, :n], wo[: self.size, n], wo[self.size :, n] = p["wo"], p["bo"], NEVER
        wo = wo.reshape(self.classes, CLASS_WORDS, n + 1)
        # exp needs no maximum taken off where no logit can be large
        most = max(np.abs(wc).sum(axis=0).max(), (np.abs(p["wo"]).sum(axis=1) + np.abs(p["bo"])).max())
        small = most * max(1.0, np.abs(s).max(initial=0.0)) < SMALL
        value, ds = np.empty(len(tokens), dtype), np.empty_like(states) if grad is not None else None
        to_wc, to_wo = np.zeros_like(wc), np.zeros_like(wo)
        rows, ones = np.arange(SOFTMAX_ROWS), np.ones(max(wc.shape[1], CLASS_WORDS), dtype)

        def softmax(x, local) -> np.ndarray:
            """Log-probabilities; leaves the gradients of their negative sum in ``x``."""
            if not small:
                x -= x.max(axis=1, keepdims=True)
            own = x[rows[: len(x)], local]
            np.exp(x, out=x)
            total = x @ ones[: x.shape[1]]
            own -= np.log(total)
            if grad is not None:
                x *= (1 / total)[:, None]
                x[rows[: len(x)], local] -= 1
            return own

        for a in range(0, len(tokens), SOFTMAX_ROWS):
            at = slice(a, a + SOFTMAX_ROWS)
            x = s[at] @ wc
            value[at] = softmax(x, cls[at])
            if grad is not None:
                to_wc += s[at].T @ x
                np.matmul(x, wc[:n].T, out=ds[at])
        ends = np.searchsorted(cls, np.arange(self.classes + 1))
        for a in range(0, int(ends[-1]), SOFTMAX_ROWS):
            b = min(a + SOFTMAX_ROWS, int(ends[-1]))
            x = np.empty((b - a, CLASS_WORDS), dtype)
            cuts = np.clip(ends, a, b).tolist()
            parts = [(k, slice(cuts[k], cuts[k + 1]), slice(cuts[k] - a, cuts[k + 1] - a)) for k in range(int(cls[a]), int(cls[b - 1]) + 1)]
            for k, at, own in parts:
                np.matmul(s[at], wo[k].T, out=x[own])
            value[a:b] += softmax(x, tokens[a:b] - cls[a:b] * CLASS_WORDS)
            if grad is not None:
                back = np.empty((b - a, n), dtype)
                for k, at, own in parts:
                    to_wo[k] += x[own].T @ s[at]
                    np.matmul(x[own], wo[k, :, :n], out=back[own])
                ds[a:b] += back
        out = np.empty_like(value)
        out[order] = value
        if grad is None:
            return out
        to_wo = to_wo.reshape(-1, n + 1)[: self.size]
        for name, g in (("wc", to_wc[:n]), ("bc", to_wc[n]), ("wo", to_wo[:, :n]), ("bo", to_wo[:, n])):
            grad[name] += g
        back = np.empty_like(ds)
        back[order] = ds
        return out, back

    def window_gradient(self, inputs: np.ndarray, targets: np.ndarray, keep: np.ndarray, h: np.ndarray, real: np.ndarray | None = None):
        """Truncated backpropagation through one window (steps x streams); targets where
        ``real`` is false are padding and count for nothing."""
        p, n, (steps, streams) = self.p, self.hidden, inputs.shape
        before, inverse, c, u, states = self._forward(self.table(), inputs, keep, h.T)
        flat = lambda x: x.transpose(0, 2, 1).reshape(targets.size, -1)
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        if real is None or real.all():
            out, ds = self.log_probs(flat(states), targets.ravel(), grad)
        else:
            at = np.flatnonzero(real)
            ds = np.zeros((targets.size, n), states.dtype)
            out, ds[at] = self.log_probs(flat(states)[at], targets.ravel()[at], grad)
        ds = np.ascontiguousarray(ds.reshape(steps, streams, n).transpose(0, 2, 1))
        # what the gradient of a state is multiplied by on its way to each gate, and from
        # there to the state before
        rz = np.divide(1, inverse, out=inverse)
        r, z, u = rz[:, :n], rz[:, n:], u[:, 2 * n :]
        gates = np.empty((steps, 3, n, streams), states.dtype)
        to_c = np.multiply(1 - z, 1 - c * c, out=gates[:, 2])
        np.multiply((before - c) * z, 1 - z, out=gates[:, 1])
        np.multiply(to_c * u * r, 1 - r, out=gates[:, 0])
        back = gates.copy()
        back[:, 2] *= r
        begins, wh = (keep < 1).any(axis=1).tolist(), np.ascontiguousarray(p["wh"])
        dh, through = np.zeros((n, streams), states.dtype), np.empty((n, streams), states.dtype)
        for t in range(steps - 1, -1, -1):
            to, into = ds[t], back[t]
            np.add(to, dh, out=to)
            np.multiply(into, to, out=into)
            np.dot(wh, into.reshape(3 * n, streams), out=dh)
            np.multiply(to, z[t], out=through)
            np.add(dh, through, out=dh)
            if begins[t]:
                np.multiply(dh, keep[t], out=dh)
        gates *= ds[:, None]
        grad["wh"] += np.matmul(before, back.reshape(steps, 3 * n, streams).transpose(0, 2, 1)).sum(axis=0)
        order = _order(inputs.ravel(), self.size + self.rest)
        read = inputs.ravel()[order]
        starts = np.flatnonzero(np.concatenate(([True], read[1:] != read[:-1])))
        by_token, tokens = np.add.reduceat(flat(gates.reshape(steps, 3 * n, streams))[order], starts, axis=0), read[starts]
        grad["wx"] += p["emb"][tokens].T @ by_token
        grad["b"] += by_token.sum(axis=0)
        grad["emb"][tokens] += by_token @ p["wx"].T
        return out.mean(), grad, states[-1].T

    def train(self, sequence: np.ndarray, begins: np.ndarray, steps: int = STEPS) -> list[float]:
        """Adam over windows of a token sequence; ``begins`` marks each document's first
        token. Returns the mean log-probability of each step."""
        streams = max(1, min(STREAMS, len(sequence) // (2 * WINDOW)))
        length = len(sequence) // streams
        grid = sequence[: length * streams].reshape(streams, length).T
        fresh = begins[: length * streams].reshape(streams, length).T.copy()
        fresh[0] = True
        adam, h, at, history = Adam(self.p), np.zeros((streams, self.hidden), np.float32), 0, []
        end = self.end_token
        for i in range(1, steps + 1):
            if at >= length:
                at = 0
            targets, keep = grid[at : at + WINDOW], ~fresh[at : at + WINDOW]
            inputs = np.where(keep, grid[np.maximum(np.arange(at, at + len(targets)) - 1, 0)], end)
            value, grad, h = self.window_gradient(inputs, targets, keep.astype(np.float32), h)
            at += WINDOW
            history.append(float(value))
            adam.step(grad, 0.02 * min(1, i / 20) * (1 - 0.9 * i / steps), targets.size)
        return history

    def train_documents(self, tokens: np.ndarray, lengths: np.ndarray, adam: "Adam") -> None:
        """Adam over all windows of whole documents, laid out as for scores: every token
        is learnt once. Few tokens go into fewer streams, for more steps."""
        grid, owner, fresh = self._streams(tokens, lengths, min(PASS_STREAMS, max(1, int(lengths.sum()) // (128 * WINDOW))))
        h, last = np.zeros((grid.shape[1], self.hidden), np.float32), np.full(grid.shape[1], self.end_token)
        for a in range(0, len(grid), WINDOW):
            targets, keep, real = grid[a : a + WINDOW], ~fresh[a : a + WINDOW], owner[a : a + WINDOW] >= 0
            inputs = np.where(keep, np.vstack([last, targets[:-1]]), self.end_token)
            _, grad, h = self.window_gradient(inputs, targets, keep.astype(np.float32), h, real)
            last = targets[-1]
            adam.step(grad, PASS_RATE * min(1, (adam.steps + 1) / 20), int(real.sum()))

    def _streams(self, tokens: np.ndarray, lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token, document or -1, whether a document begins) of each step and stream.
        Long documents come first and each goes to the shortest stream."""
        order = np.argsort(-lengths, kind="stable")
        streams = int(max(1, min(most, lengths.sum() // lengths.max())))
        load = np.zeros(streams, dtype=np.int64)
        parts: list[list[int]] = [[] for _ in range(streams)]
        heap = [(0, s) for s in range(streams)]
        for doc in order.tolist():
            size, s = heapq.heappop(heap)
            parts[s].append(doc)
            load[s] = size + int(lengths[doc])
            heapq.heappush(heap, (int(load[s]), s))
        steps = int(load.max())
        starts = np.cumsum(lengths) - lengths
        grid = np.full((steps, streams), self.end_token, dtype=np.int32)
        owner = np.full((steps, streams), -1, dtype=np.int32)
        fresh = np.ones((steps, streams), dtype=bool)
        for s, docs in enumerate(parts):
            t = 0
            for doc in docs:
                n = int(lengths[doc])
                grid[t : t + n, s] = tokens[starts[doc] : starts[doc] + n]
                owner[t : t + n, s] = doc
                fresh[t + 1 : t + n, s] = False
                t += n
        return grid, owner, fresh

    def score(self, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log-probability (natural) of each document; tokens lie one document after the
        other."""
        out = np.zeros(len(lengths))
        if not len(tokens):
            return out
        grid, owner, fresh = self._streams(tokens, lengths, 512)
        steps, streams = grid.shape
        table = self.table()
        h = np.zeros((self.hidden, streams), np.float32)
        last = np.full(streams, self.end_token, dtype=np.int32)
        held: list[np.ndarray] = []
        for a in range(0, steps, WINDOW):
            targets = grid[a : a + WINDOW]
            inputs = np.where(fresh[a : a + WINDOW], self.end_token, np.vstack([last, targets[:-1]]))
            states = self._forward(table, inputs, (~fresh[a : a + WINDOW]).astype(np.float32), h)[-1]
            h, last = states[-1], targets[-1]
            held.append(states.transpose(0, 2, 1).reshape(-1, self.hidden))
            # the softmax takes the states of several windows at a time
            if len(held) * WINDOW * streams >= SCORED_TOKENS or a + WINDOW >= steps:
                b = a + len(targets)
                done = slice(b - sum(map(len, held)) // streams, b)
                own = owner[done].ravel()
                real = own >= 0
                value = self.log_probs(np.concatenate(held)[real], grid[done].ravel()[real])
                out += np.bincount(own[real], weights=value.astype(float), minlength=len(lengths))
                held.clear()
        return out

    def dump(self) -> bytes:
        raw = io.BytesIO()
        np.savez(raw, size=self.size, hidden=self.hidden, rest=self.rest, end=self.end_token, **self.p)
        return raw.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> "Network":
        arrays = np.load(io.BytesIO(raw))
        net = cls(int(arrays["size"]), int(arrays["hidden"]), arrays=arrays, rest=int(arrays["rest"]))
        net.end_token = int(arrays["end"])
        return net


class Adam:
    """Adam's moments for the arrays of ``p``, which become parts of one array that its
    steps change."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.flat, self.steps, at = np.concatenate([v.ravel() for v in p.values()]), 0, 0
        for k, v in p.items():
            p[k] = self.flat[at : at + v.size].reshape(v.shape)
            at += v.size
        self.names = list(p)
        self.first, self.second = np.zeros_like(self.flat), np.zeros_like(self.flat)

    def step(self, grad: dict[str, np.ndarray], rate: float, size: int) -> None:
        """``grad`` is a sum over ``size`` tokens."""
        self.steps += 1
        i, first, second = self.steps, self.first, self.second
        g = np.concatenate([grad[k].ravel() for k in self.names])
        g *= 1 / size
        first += 0.1 * (g - first)
        second += 0.01 * (g * g - second)
        self.flat -= rate * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.99**i)) + 1e-8)


def _order(values: np.ndarray, most: int) -> np.ndarray:
    """Stable order of whole numbers from 0 to ``most``; short ones are sorted by digits."""
    return np.argsort(values.astype(np.min_scalar_type(most)), kind="stable")


class Lookup:
    """Finds the place of fingerprints in a sorted array."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def __call__(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, found)"""
        if not len(self.words):
            return np.zeros(len(asked), dtype=np.int64), np.zeros(len(asked), dtype=bool)
        at = np.minimum(np.searchsorted(self.words, asked), len(self.words) - 1)
        return at, self.words[at] == asked


def _network_ids(tokens: np.ndarray, vocab: Lookup, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(token of the network, whether in the vocabulary) of each word."""
    at, found = vocab(tokens)
    other = size + (tokens & np.uint64(REST - 1)).astype(np.int64)
    return (np.where(found, ids[at], other) if len(ids) else other), found


def _commonest(counts: DataFrame, most: int) -> DataFrame:
    """The ``most`` words of the largest counts, ties in order of the fingerprints, and the
    end. A histogram of logarithmic steps, a few thousand rows, tells the step in which
    the last of them lies, so only that step is ordered and no task and no driver ever
    sees more than the result."""
    step = F.floor(F.log2("n") * 64).cast("int")
    steps = sorted(((r["step"], r["count"]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True)
    end = F.col("word") == int(END.view(np.int64))
    held = 0
    for at, size in steps:
        if held + size > most:
            last = counts.where((step == at) & ~end).orderBy(F.desc("n"), "word").limit(most - held)
            return counts.where((step > at) | end).unionByName(last)
        held += size
    return counts


def _fit(words: np.ndarray, ids: np.ndarray, size: int, steps: int):
    """Trains the network on the rows of one bounded group and returns it in a row."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "doc_id"], kind="stable")
        texts = [lowered(t) for t in rows["text"]]
        lookup, sequence, begins = Lookup(words), [], []
        for a, b in slabs(texts):
            tokens, counts = _tokens(texts[a:b])
            sequence.append(_network_ids(tokens, lookup, ids, size)[0])
            first = np.zeros(len(tokens), dtype=bool)
            first[np.cumsum(counts) - counts] = True
            begins.append(first)
        net = Network(size, rest=REST)
        net.end_token = int(ids[lookup(np.array([END]))[0][0]])
        net.train(np.concatenate(sequence).astype(np.int64), np.concatenate(begins), steps)
        return pd.DataFrame({"model": [net.dump()]})

    return run


def _pass(shared):
    """Trains the network on all documents of a task and returns its weights, times the
    task's tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, ids, model = shared.value
        net, vocab, seen = Network.load(model), Lookup(words), 0
        adam, pool, size = Adam(net.p), [], 0

        def learn():
            net.train_documents(np.concatenate([p[0] for p in pool]), np.concatenate([p[1] for p in pool]), adam)
            pool.clear()

        for batch in batches:
            texts = [lowered(t) for t in batch["text"]]
            for a, b in slabs(texts):
                tokens, counts = _tokens(texts[a:b])
                pool.append((_network_ids(tokens, vocab, ids, net.size)[0].astype(np.int32), counts))
                size, seen = size + len(tokens), seen + len(tokens)
                if size > PASS_TOKENS:
                    learn()
                    size = 0
        if pool:
            learn()
        if seen:
            flat = np.concatenate([net.p[k].ravel() for k in net.NAMES]).astype(np.float64) * seen
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "tokens": [seen], "weights": [flat.tobytes()]})

    return run


def _sum_weights(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, tokens, total = 0, 0, None
    for batch in batches:
        for p, n, raw in zip(batch["part"], batch["tokens"], batch["weights"]):
            flat = np.frombuffer(raw)
            part, tokens, total = (p, n, flat.copy()) if total is None else (part, tokens + n, total + flat)
    if total is not None:
        yield pd.DataFrame({"part": [part], "tokens": [tokens], "weights": [total.tobytes()]})


def _learn_all(training: DataFrame, words: np.ndarray, ids: np.ndarray, model: bytes) -> bytes:
    """The mean of the weights that the tasks reach from ``model`` over all training
    documents. A few tasks sum them; the driver gets a row of each of these."""
    spark = training.sparkSession
    schema = "part long, tokens long, weights binary"
    reached = stored(training.select("text").mapInPandas(_pass(spark.sparkContext.broadcast((words, ids, model))), schema), "lm-pass")
    dealt = reached.repartition(SUM_TASKS, "part").sortWithinPartitions("part")
    with small_batches(spark, SUM_ROWS):
        sums = sorted(dealt.mapInPandas(_sum_weights, schema).collect(), key=lambda r: r["part"])
    if not sums:
        return model
    net, at = Network.load(model), 0
    flat = np.sum([np.frombuffer(r["weights"]) for r in sums], axis=0) / sum(r["tokens"] for r in sums)
    for k in net.NAMES:
        net.p[k] = flat[at : at + net.p[k].size].reshape(net.p[k].shape).astype(np.float32)
        at += net.p[k].size
    return net.dump()


def score_documents(docs: DataFrame, held_out, head: int = HEAD, vocabulary: int = VOCABULARY, sample_docs: int = SAMPLE_DOCS, steps: int = STEPS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` is a condition on doc_id; all other documents are learnt from. Tokens are
    the words, A-Z lower-cased, and one end; null and empty texts are an end alone. A null
    doc_id is neither held out nor learnt from, and is scored. Scores are log10
    probabilities of whole texts. Repeated rows are learnt from and scored each; an empty
    table gives an empty result; without any training document every token is unknown.
    """
    spark = docs.sparkSession
    held = F.coalesce(held_out, F.lit(False))
    training = docs.where(F.col("doc_id").isNotNull() & ~held).select("doc_id", "text")
    counts = stored(
        training.select("text").mapInPandas(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts"
    )
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = _commonest(counts, head).toPandas().sort_values(["n", "word"], ascending=[False, True])  # at most head + 1 rows
    sort = np.argsort(top["word"].to_numpy(dtype=np.int64).view(np.uint64), kind="stable")
    words = top["word"].to_numpy(dtype=np.int64).view(np.uint64)[sort]
    head_counts = top["n"].to_numpy(dtype=np.int64)[sort]
    # the network's vocabulary: the commonest words, and the end whatever its place
    wanted = top["word"].to_numpy(dtype=np.int64).view(np.uint64)[:vocabulary]
    if total and END not in wanted:
        wanted = np.append(wanted[: vocabulary - 1], END)
    by = np.argsort(wanted, kind="stable")
    vocab_words, vocab_ids = wanted[by], np.arange(len(wanted))[by]
    # tokens and words of each class of the rest
    rest_total, rest_words = np.zeros(REST), np.zeros(REST)
    outside = counts.where(~F.col("word").isin(wanted.view(np.int64).tolist()))
    for r in outside.groupBy(F.col("word").bitwiseAND(F.lit(REST - 1)).alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        rest_total[r["k"]], rest_words[r["k"]] = r["n"], r["words"]

    model = None
    if total:
        keyed = training.where("text is not null").select("doc_id", F.xxhash64("doc_id").alias("key")).distinct()
        # a hash range that holds about four times the sample goes to the sort
        documents = int(top.loc[top["word"] == END.view(np.int64), "n"].sum())
        keyed = keyed.where(F.pmod("key", F.lit(1 << 40)) < int(min(1, 4 * sample_docs / max(documents, 1)) * (1 << 40)))
        chosen = stored(keyed.orderBy("key", "doc_id").limit(sample_docs), "lm-sample")
        # one bounded group: at most sample_docs ids, their texts once each
        sample = training.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
        fitted = sample.groupBy(F.lit(0).alias("all")).applyInPandas(_fit(vocab_words, vocab_ids, len(wanted), steps), "model binary").collect()
        model = fitted[0]["model"] if fitted else None
    if model is None:
        net = Network(max(1, len(wanted)), rest=REST)
        if total:  # texts are null, each an end alone
            net.end_token = int(vocab_ids[Lookup(vocab_words)(np.array([END]))[0][0]])
        model = net.dump()
    if total:
        model = _learn_all(training, vocab_words, vocab_ids, model)
    shared = spark.sparkContext.broadcast((words, head_counts, vocab_words, vocab_ids, model))
    base_total = total + SMOOTH * (distinct + 1)
    rest_total += SMOOTH * (rest_words + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, head_counts, vocab_words, vocab_ids, model = shared.value
        net = Network.load(model)
        common, vocab = Lookup(words), Lookup(vocab_words)
        base_log = np.log10((head_counts + SMOOTH) / base_total)
        rest_log = np.log10((head_counts + SMOOTH) / rest_total[(words & np.uint64(REST - 1)).astype(np.int64)])
        pool: list[tuple] = []

        def flush():
            ids = np.concatenate([p[2] for p in pool])
            lengths = np.concatenate([p[1] for p in pool])
            scores = net.score(ids, lengths) / np.log(10)
            start = 0
            for rows, counts, _, known, base, inside, tails in pool:
                part = scores[start : start + len(counts)]
                start += len(counts)
                yield pd.DataFrame({
                    "doc_id": rows["doc_id"].array, "held_out": rows["held_out"].array, "n_tokens": counts,
                    "n_known": known, "base_score": base, "score": part + inside, "rare": tails,
                })
            pool.clear()

        size = 0
        for batch in batches:
            texts = [lowered(t) for t in batch["text"]]
            for a, b in slabs(texts):
                tokens, counts = _tokens(texts[a:b])
                owner = np.repeat(np.arange(b - a), counts)
                sums = lambda v, w: np.bincount(owner[w], weights=v, minlength=b - a)
                at, found = common(tokens)
                ids, inside = _network_ids(tokens, vocab, vocab_ids, net.size)
                middle = found & ~inside
                rare = ~found & ~inside
                # a word of the vocabulary may be outside the head (the end in a tiny head)
                base = sums(base_log[at[found]], found)
                cut = np.searchsorted(owner[rare], np.arange(1, b - a))
                pool.append((
                    batch[["doc_id", "held_out"]].iloc[a:b], counts, ids.astype(np.int32), np.bincount(owner[found], minlength=b - a), base,
                    sums(rest_log[at[middle]], middle), np.split(tokens[rare].view(np.int64), cut),
                ))
                size += len(tokens)
                if size > POOL_TOKENS:
                    yield from flush()
                    size = 0
        if pool:
            yield from flush()

    scored = docs.select("doc_id", "text", held.alias("held_out")).mapInPandas(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>"
    )
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    asked = scored.select("row", F.explode("rare").alias("word"))
    n = F.coalesce(F.col("n"), F.lit(0))
    of_class = F.array(*[F.lit(float(x)) for x in rest_total])[F.col("word").bitwiseAND(F.lit(REST - 1)).cast("int")]
    met = asked.join(counts, "word", "left").groupBy("row").agg(
        F.count("n").alias("more_known"), F.sum(F.log10((n + SMOOTH) / F.lit(base_total))).alias("more_base"),
        F.sum(F.log10((n + SMOOTH) / of_class)).alias("more_score"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("more_known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base_score") + zero("more_base")).alias("base_score"),
        (F.col("score") + zero("more_score")).alias("score"),
    )

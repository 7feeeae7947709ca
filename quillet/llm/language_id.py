"""Language ID as a mixture of languages, fitted to each document by expectation-maximisation.

Model. Each language has a smoothed multinomial over byte n-grams (1 to 3 bytes of the
lower-cased UTF-8, with everything that is no letter as one space), learnt from labelled
documents. A document's n-grams are drawn from a mixture of languages; EM estimates the
proportions. Language sets are grown from the single best language, one language at a
time, and the set of the highest penalised likelihood is taken: each further language
costs ``penalty * log(n)`` for n n-grams. The prediction is the language of the largest
proportion in that set, and the score is that proportion.

Only the features are bounded: ``SAMPLE_DOCS`` labelled documents a language (of the
smallest hashes) are learnt from, and the ``FEATURES`` n-grams that tell languages apart
best are kept, or fewer where languages are so many that they would pass ``CELLS``
together. Every label that has been sampled can be predicted. Prediction reads every byte
of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillet.llm.common import slabs, stored

SAMPLE_DOCS = 400
FEATURES = 4096
#: Languages times n-grams that come to the driver.
CELLS = 4 << 20
RARE = 5
BROADCAST_ROWS = 1_000_000
PENALTY = 4.0
ROUNDS = 12
UNDETERMINED = "und"

_ASCII = np.arange(256, dtype=np.uint8)
_ASCII[[c for c in range(128) if not chr(c).isalpha()]] = 0x20


def fold(text: str | None) -> bytes:
    """Lower-case UTF-8 in which each ASCII character that is no letter is a space."""
    return b"" if text is None else text.lower().encode().translate(_ASCII.tobytes())


def has_letter(text: str | None) -> bool:
    return text is not None and (any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text)))


def grams(raw: bytes) -> np.ndarray:
    """Numbers of the n-grams of 1, 2 and 3 bytes: the bytes after a leading mark.

    N-grams of spaces only say nothing about the language and are left out.
    """
    b = np.frombuffer(b" " + raw + b" ", dtype=np.uint8).astype(np.int32)
    two = (b[:-1] << 8) | b[1:]
    three = (two[:-1] << 8) | b[2:]
    one = b[b != 0x20]
    two = two[two != 0x2020]
    three = three[(three & 0xFFFF) != 0x2020]
    return np.concatenate((one | 1 << 24, two | 2 << 24, three | 3 << 24))


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    features: np.ndarray  # sorted n-gram numbers
    log_probs: np.ndarray  # languages x features, float32


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        folded = batch["text"].map(fold)
        for lang, texts in folded.groupby(batch["lang"]):
            for a, b in slabs(list(texts)):
                gram, count = np.unique(np.concatenate([grams(t) for t in texts.iloc[a:b]]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": gram, "n": count})


def learn(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, features: int = FEATURES) -> LanguageModel:
    """Fit the model to the columns text, lang and doc_id of ``labelled``.

    At most ``sample_docs`` documents a language are used, those of the smallest hash of
    doc_id and lang. Rows whose text or lang is null, and labels none of whose sampled
    texts has an n-gram, are left out. Without any row the model knows no language.
    """
    rank = Window.partitionBy("lang").orderBy("key", "doc_id")
    ids = labelled.where("lang is not null and text is not null and doc_id is not null").select(
        "doc_id", "lang", F.xxhash64("doc_id", "lang").alias("key")
    )
    # a hash range of each language that holds about four times its sample goes to the ranking
    sizes = stored(ids.groupBy("lang").count(), "labels")
    labels = sizes.count()
    small = lambda df, rows: F.broadcast(df) if rows <= BROADCAST_ROWS else df
    share = F.least(F.lit(1.0), F.lit(4.0 * sample_docs) / F.col("count"))
    ids = ids.join(small(sizes, labels), "lang").where(F.pmod("key", F.lit(1 << 40)) < share * (1 << 40)).drop("count")
    chosen = ids.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= sample_docs)
    chosen = stored(chosen.select("doc_id", "lang").distinct(), "language-sample")
    sample = labelled.select("doc_id", "lang", "text").join(small(chosen, labels * sample_docs), ["doc_id", "lang"])
    counts = sample.select("lang", "text").mapInPandas(_count_grams, "lang string, gram int, n long")
    counts = stored(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    # the commonest n-grams bound what comes to the driver; the most telling are picked there
    most = max(1, min(8 * features, CELLS // max(1, labels)))
    top = counts.groupBy("gram").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "gram").limit(most)
    table = counts.join(F.broadcast(top.select("gram")), "gram").toPandas()
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not languages:
        return LanguageModel([], np.empty(0, np.int32), np.empty((0, 0), np.float32))
    wide = table.pivot_table(index="lang", columns="gram", values="n", fill_value=0, aggfunc="sum").reindex(languages, fill_value=0)
    common = wide.sum() >= RARE
    if common.sum() >= features:  # rare n-grams count only where there are few others
        wide = wide.loc[:, common]
    c = wide.to_numpy(dtype=float) + 0.5
    p = c / c.sum(axis=1, keepdims=True)
    mean = p.mean(axis=0)
    telling = (p * np.log(p / mean)).sum(axis=0)  # each n-gram's part of the Jensen-Shannon divergence
    best = np.sort(np.argsort(-telling, kind="stable")[:features])
    p = c[:, best] / c[:, best].sum(axis=1, keepdims=True)
    return LanguageModel(list(map(str, languages)), wide.columns.to_numpy(dtype=np.int32)[best], np.log(p).astype(np.float32))


def _em(counts: np.ndarray, probs: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihoods of documents (rows of counts) over allowed languages."""
    n = counts.sum(axis=1, keepdims=True)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        mix = share @ probs
        share = share * ((counts / mix) @ probs.T) / n
        share /= share.sum(axis=1, keepdims=True)
    return share, np.einsum("ij,ij->i", counts, np.log(share @ probs))


def mixtures(counts: np.ndarray, model: LanguageModel, penalty: float = PENALTY) -> np.ndarray:
    """Proportions of each document's languages, 0 for those outside its chosen set.

    ``counts`` is documents x features with at least one count a row. Sets are grown
    greedily by the proportions of the full mixture; documents whose penalised
    likelihood no longer rises leave the search.
    """
    k = len(model.languages)
    probs = np.exp(model.log_probs)
    likelihood = counts @ model.log_probs.T
    out = np.zeros((len(counts), k), dtype=np.float32)
    first = likelihood.argmax(axis=1)
    out[np.arange(len(counts)), first] = 1
    value = likelihood.max(axis=1).astype(float)
    n = counts.sum(axis=1)
    live = np.flatnonzero(n > 0)
    if k > 1 and len(live):
        full, _ = _em(counts[live], probs, np.ones((len(live), k), dtype=np.float32))
        full[np.arange(len(live)), first[live]] = -1
        order = np.argsort(-full, axis=1, kind="stable")
        chosen = out[live].copy()
        for size in range(1, k):
            at = np.arange(len(live))
            chosen[at, order[:, size - 1]] = 1
            share, fitted = _em(counts[live], probs, chosen)
            gain = fitted - penalty * size * np.log(n[live] + 1) > value[live] + 1e-6
            out[live[gain]] = share[gain]
            value[live[gain]] = fitted[gain] - penalty * size * np.log(n[live[gain]] + 1)
            live, order, chosen = live[gain], order[gain], chosen[gain]
            if not len(live):
                break
    return out


class FeatureCounter:
    """Counts a model's n-grams in folded texts.

    Bytes that occur in no feature share one code, so the tables over code pairs and
    triples are small.
    """

    def __init__(self, features: np.ndarray):
        self.size = n = len(features)
        kinds, used = features >> 24, np.zeros(256, dtype=bool)
        for shift in range(3):
            used[((features >> 8 * shift) & 0xFF)[kinds > shift]] = True
        self.code = np.where(used, np.cumsum(used), 0).astype(np.int32)
        self.base = int(used.sum()) + 1
        self.tables = []
        for k in (1, 2, 3):
            at = np.flatnonzero(kinds == k)
            place = np.zeros(len(at), dtype=np.int64)
            for shift in range(k - 1, -1, -1):
                place = place * self.base + self.code[(features[at] >> 8 * shift) & 0xFF]
            table = np.full(self.base**k, n, dtype=np.uint16)
            table[place] = at
            self.tables.append(table)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        counts = np.zeros((len(texts), self.size + 1), dtype=np.float32)
        for i, raw in enumerate(texts):
            for start in range(0, len(raw), 1 << 21):  # whole texts, in bounded parts
                b = self.code[np.frombuffer(b" " + raw[start : start + (1 << 21)] + b" ", dtype=np.uint8)]
                two = b[:-1] * self.base + b[1:]
                three = two[:-1] * self.base + b[2:]
                for table, at in zip(self.tables, (b, two, three)):
                    counts[i] += np.bincount(table[at], minlength=self.size + 1)
        return counts[:, : self.size]


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with the columns lang_pred, score and languages added (or replaced).

    ``languages`` lists (lang, share) of the chosen set, largest share first. Null texts
    and texts without letters, and every text if the model knows no language, get
    ``und``, a score of 0 and no languages. A text with letters but none of the model's
    n-grams gets the first language with a score of 0. Only the text is an input, so
    equal texts get equal rows; an empty table gives no rows. No shuffle is needed.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, languages array<struct<lang:string,share:double>>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = broadcast.value
        count = FeatureCounter(model.features)
        names = model.languages
        kind = pa.struct({"lang_pred": pa.string(), "score": pa.float64(), "languages": pa.list_(pa.struct({"lang": pa.string(), "share": pa.float64()}))})
        for batch in batches:
            rows: list[tuple] = []
            for a in range(0, len(batch), 256):
                texts = batch.slice(a, 256).to_pylist()
                part = [(UNDETERMINED, 0.0, [])] * len(texts)
                known = [i for i, t in enumerate(texts) if names and has_letter(t)]
                counts = count([fold(texts[i]) for i in known])
                some = counts.sum(axis=1) > 0
                share = np.zeros((len(known), len(names)), dtype=np.float32)
                if some.any():
                    share[some] = mixtures(counts[some], model)
                for i, s, ok in zip(known, share, some):
                    order = np.argsort(-s, kind="stable")
                    best = int(order[0])
                    found = [(names[j], float(s[j])) for j in order if s[j] > 0]
                    part[i] = (names[best], float(min(1.0, s[best])) if ok else 0.0, found)
                rows += part
            yield pa.array(
                [{"lang_pred": p, "score": s, "languages": [{"lang": x, "share": y} for x, y in f]} for p, s, f in rows], kind
            )

    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "languages")]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return docs.select(row, predict("text").alias("_p")).select(
        *[F.col(f"_row.`{c}`") for c in kept], "_p.lang_pred", "_p.score", "_p.languages"
    )

"""Operators on documents against brute force, with nulls, ties, repeats and odd texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillet.llm import decontamination as dec
from quillet.llm.language_id import identify, learn
from quillet.llm.near_dedup import near_duplicates
from quillet.llm.packing import crc_of_ids, pack, piece_lengths
from quillet.llm.recurrent_lm import score_documents
from quillet.llm import sharding
from quillet.llm.sharding import group_hash, minimax_cuts, shard_documents
from quillet.llm.token_counts import token_counts

SCHEMA = "doc_id long, text string, lang string, kept string, _row string, n_words int, bucket string"
ODD = [
    None, "", " ", "\n\n", "a", "A b", "a  b", "  a b ", "x <|endoftext|> y<|endoftext|>z ", "\x1c a \x1d b", "Σας ΣΑΣ Ας",
    "don't  I'll　b é é", "a  b  c", " \t a", "İstanbul ŉ \U0001f600 ok", "word " * 3000, "z" * 5000,
    "one two three four five six", "ONE two three four five six", "one two three four", "12 34 ÀÉ", "***", "*** 42",
]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(400)]
    base = [rng.choices(vocab, k=rng.randint(8, 120)) for _ in range(60)]
    texts = list(ODD)
    for words in base:
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            near = list(words)
            for _ in range(rng.randint(0, 3)):
                near[rng.randrange(len(near))] = rng.choice(vocab)
            texts.append(" ".join(near))
    rows = [(i, t, rng.choice(["en", "de", None]), "x", "y", 1, "z") for i, t in enumerate(texts)]
    rows += [rows[30], rows[30], (31, rows[31][1], None, None, None, None, None), (None, rows[40][1], "en", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def words5(text):
    w = (text or "").encode().lower().split()
    if len(w) < 5:
        return frozenset([b" ".join(w)]) if w else frozenset()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(len(w) - 4))


def brute_components(rows):
    up = {i: i for i, _ in rows if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, words5(t)) for i, t in rows if i is not None]
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            both = len(x & y)
            if both and 100 * both >= 75 * (len(x) + len(y) - both):
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    return {i: find(i) for i in up}


def test_near_duplicates_match_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_components(rows)
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == want[r.doc_id]) for r in got)
    sizes = {i: len(words5(t)) for i, t in rows}
    assert all(r.n_shingles == sizes[r.doc_id] for r in got)


def test_near_duplicates_chain_in_blocks(spark, monkeypatch):
    import quillet.llm.near_dedup as nd

    monkeypatch.setattr(nd, "BLOCK_BYTES", 400)
    rng = random.Random(5)
    words = [f"w{rng.randrange(9999)}" for _ in range(60)]
    rows = []
    for i in range(40):  # each differs a little from the one before: a chain
        words[rng.randrange(60)] = f"n{i}"
        rows.append((100 - i, " ".join(words)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows)


def test_repeated_ids_of_different_texts_are_one_node(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "p q r s t u v")
    rows = [(3, a), (5, a), (5, b), (9, b), (9, None), (7, c), (2, ""), (2, c), (None, c)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [
        (-1, -1, True), (2, 2, True), (2, 2, True), (3, 3, True), (5, 3, False), (5, 3, False), (7, 2, False), (9, 3, False), (9, 3, False),
    ]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    path = public_tokenizers.path("byte_bpe_50k.json")
    items = spark.createDataFrame([], "item_id long, text string")
    held = F.col("doc_id") < 0
    for out in (
        near_duplicates(none), token_counts(none, path), pack(none, path), shard_documents(none),
        dec.contamination(none, items), identify(none, learn(none)), score_documents(none, held),
    ):
        assert out.collect() == []


def test_no_benchmark_and_no_training(spark, docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert dec.contamination(docs, items).where("contamination.contaminated or contamination.n_hit > 0").count() == 0
    scored = score_documents(docs, F.lit(True)).collect()
    assert all(r.n_known == 0 or r.doc_id is None for r in scored) and len(scored) == docs.count()
    assert identify(docs, learn(docs.where("false"))).select("lang_pred").distinct().collect()[0][0] == "und"


def test_token_counts_match_the_library(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    got = token_counts(docs, path, batch_bytes=2000).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()), len(plain.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert Counter(map(tuple, got)) == want


def test_packing_round_trip(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    got = pack(docs, path).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 and 2**r.bucket == r.length for r in got)
    pieces = Counter((r.doc_id, r.start, r.length, zlib.crc32(r.ids), r.doc_tokens) for r in got)
    want = Counter()
    for r in docs.collect():
        ids, start = plain.encode(r.text or "", add_special_tokens=False).ids + [1], 0
        for n in piece_lengths(len(ids), 2048):
            want[r.doc_id, start, n, crc_of_ids(ids[start : start + n]), len(ids)] += 1
            start += n
        assert start == len(ids)
    assert pieces == want


def test_piece_lengths():
    assert piece_lengths(1, 2048) == [1]
    assert piece_lengths(2048 * 2 + 11, 2048) == [2048, 2048, 8, 2, 1]
    with pytest.raises(ValueError):
        pack(None, "", max_length=1000)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def a_to_z(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_contamination(text, items):
    w = WORD.findall(a_to_z(text))
    hit, found = set(), set()
    for item, t in items:
        p = WORD.findall(a_to_z(t))
        k = min(13, len(p))
        for s in range(len(p) - k + 1) if k else ():
            for i in range(len(w) - k + 1):
                if w[i : i + k] == p[s : s + k]:
                    hit |= set(range(i, i + k))
                    found.add(item)
    return len(w), len(hit), sorted(map(str, found)), bool(hit) and 20 * len(hit) >= len(w)


def test_contamination_matches_brute_force(spark, docs):
    rng = random.Random(1)
    texts = [r.text for r in docs.collect() if r.text and len(r.text.split()) > 25]
    items = [(1, " ".join(texts[0].split()[3:20])), (2, texts[1].upper()), (3, "a"), (4, None), (5, ""), (6, "six"), (7, "Nowhere at all"), (8, "a b"), (None, "one")]
    items += [(10 + i, " ".join(rng.choice(texts).split()[5:25]) + " odd end") for i in range(5)] + [(10, "!a!"), (3, "a")]
    items.append((30, "word " * 20))
    bench = spark.createDataFrame(items, "item_id long, text string")
    usable = [x for x in items if x[0] is not None]
    got = dec.contamination(docs, bench).collect()
    assert len(got) == docs.count()
    for r in got:
        c = r.contamination
        assert (c.n_words, c.n_hit, c["items"], c.contaminated) == brute_contamination(r.text, usable), r.text[:80]


def test_contamination_of_repetitive_texts(spark):
    rng = random.Random(12)
    two = lambda n: " ".join(rng.choices(["ha", "he"], k=n))
    items = [(1, "ha " * 40), (2, "ha he " * 15), (3, two(60)), (4, two(60)), (5, "ha " * 13), (6, "tick " * 12), (7, two(30) + " stop " + "ha " * 20)]
    texts = ["ha " * 12, "ha " * 13, "ha " * 90 + "x " + "he ha " * 20, two(200), "tick " * 50, "stop " + "ha " * 20, items[2][1] + " " + items[3][1], "he " * 30]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, t) for t in texts] + [(3, "another text under one id " + items[3][1])]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = dec.contamination(docs, bench).collect()
    assert len(got) == len(rows)
    for r in got:
        c = r.contamination
        assert (c.n_words, c.n_hit, c["items"], c.contaminated) == brute_contamination(r.text, items), r.text[:80]


def test_contamination_of_many_equal_words_and_items(spark):
    words, ids = 20_000, 3000
    same = " ".join(["ha"] * words)
    passage = "this passage of more than thirteen words stands in thousands of items of the very same benchmark"
    items = [(0, same), *((i, passage) for i in range(1, ids))]
    docs = spark.createDataFrame([(1, same), (2, passage), (None, f"before {passage} after"), (4, "ha ha")], "doc_id long, text string")
    got = {r.doc_id: r.contamination for r in dec.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1]["items"]) == (words, words, ["0"])
    assert got[2]["items"] == sorted(map(str, range(1, ids))) == got[None]["items"] and got[None].n_hit == 17
    assert got[4].n_hit == 0


def test_contamination_without_broadcast(spark, docs, monkeypatch):
    monkeypatch.setattr(dec, "BROADCAST_WORDS", 0)
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert dec.contamination(docs, bench).where("contamination.n_hit > 0").count() == 2


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x b y c"), (2, "c b a"), (3, "a x x x x x x b c"), (4, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(9, "A b c"), (8, "a zz"), (7, None)], "query_id long, text string")
    terms = asked.select(F.explode(dec.words(F.col("text"))).alias("w")).select(F.xxhash64("w").alias("term")).distinct()
    found = dec.proximity_matches(dec.build_index(docs, terms), asked, slop=2)
    assert {(r.query_id, r.doc_id) for r in found.collect()} == {(9, 1), (9, 2)}


def test_minimax_cuts_against_dynamic_programming():
    rng = random.Random(2)
    for _ in range(60):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(1, 14))]
        parts = rng.randint(1, 5)
        best = {0: 0}
        for _ in range(parts):
            best = {e: min([best.get(e, math.inf)] + [max(best[s], sum(sizes[s:e])) for s in best if s < e]) for e in range(len(sizes) + 1)}
        cuts = minimax_cuts(sizes, parts)
        sums = [sum(sizes[a:b]) for a, b in zip([0, *cuts], cuts)]
        assert len(cuts) <= parts and cuts[-1] == len(sizes) and max(sums) == best[len(sizes)]
    assert minimax_cuts([], 3) == []


def test_sharding_keeps_groups_and_balances(spark, docs):
    got = shard_documents(docs, 6).collect()
    assert len(got) == docs.count()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and 0 <= s < 6
    assert len({(r.size, r.text_crc32, r.shard) for r in got}) == len({(r.size, r.text_crc32) for r in got})
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    many = many.withColumn("text", F.when(F.col("doc_id") % 3 == 0, "hot " * 100).otherwise(F.concat("text", F.col("doc_id").cast("string"))))
    load = Counter()
    for r in shard_documents(many, 24).collect():
        load[r.shard] += r.size
    light = sorted(load.values())[:-1]  # the hot group has a shard of its own
    assert len(load) == 24 and max(light) < 1.15 * min(light)


@pytest.mark.parametrize("bins, cells", [(2, 3), (16, 1024)])
def test_shards_have_the_smallest_capacity_of_groups(spark, monkeypatch, bins, cells):
    """Also where ranges hold many groups of very different sizes and few are split at a time."""
    monkeypatch.setattr(sharding, "BIN_BITS", bins)
    monkeypatch.setattr(sharding, "SPLIT_CELLS", cells)
    rng = random.Random(bins)
    rows = [(i, "".join(rng.choices("abcdef ", k=int(rng.paretovariate(0.8)) % 900))) for i in range(700)] + [(None, None), (3, "")]
    rows += [(1000 + i, "copy " * 9) for i in range(12)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {(r.key, r.bytes) for r in table.groupBy(group_hash(F.col("text")).alias("key")).agg(
        F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 8).alias("bytes")).collect()}
    for parts in (2, 5, 9):
        assert all(size * parts < sum(b for _, b in groups) for _, size in groups)
        sizes = [b for _, b in sorted(groups)]
        best = [0] + [math.inf] * len(sizes)
        for _ in range(parts):
            best = [0] + [min(max(best[s], sum(sizes[s:e])) for s in range(e)) for e in range(1, len(sizes) + 1)]
        load = Counter()
        for r in shard_documents(table, parts).collect():
            load[r.shard] += r.size
        assert max(load.values()) == best[-1]


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    told = identify(docs.where(held), learn(docs.where(~held))).where("lang is not null")
    right, total = told.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / total > 0.97


def test_language_id_mixtures_and_odd_texts(spark, docs):
    rng = random.Random(4)
    words = {"aa": ["bako", "tiru", "mana"], "bb": ["grzx", "strv", "klmp"]}
    text = lambda lang, n: " ".join(rng.choices(words[lang], k=n))
    labelled = spark.createDataFrame([(i, text(x, 60), x) for i, x in enumerate(["aa", "bb"] * 30)], "doc_id long, text string, lang string")
    model = learn(labelled)
    mixed = spark.createDataFrame([(1, text("aa", 60) + " " + text("bb", 30), "?"), (2, text("bb", 40), "?")], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in identify(mixed, model).collect()}
    assert [x.lang for x in got[1].languages] == ["aa", "bb"] and abs(got[1].score - 0.66) < 0.1
    assert [x.lang for x in got[2].languages] == ["bb"] and got[2].score == 1
    for r in identify(docs, model).collect():
        letters = any(map(str.isalpha, r.text or ""))
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    assert identify(docs, model).columns[:7] == docs.columns


def test_mixtures_match_a_scalar_version():
    """EM and the growing of language sets by plain loops."""
    import numpy as np

    from quillet.llm.language_id import PENALTY, ROUNDS, LanguageModel, mixtures

    rng = np.random.default_rng(5)
    probs = rng.dirichlet(np.ones(30) * 0.3, 5) * 0.99 + 0.01 / 30
    model = LanguageModel([f"l{i}" for i in range(5)], np.arange(30, dtype=np.int32), np.log(probs).astype(np.float32))
    truth = [[0], [3], [0, 1], [1, 4], [2, 3, 4], [1], [0, 2]]
    counts = np.stack([rng.multinomial(400, probs[t].mean(axis=0)) for t in truth]).astype(np.float32)
    counts[5] = np.eye(30)[7]

    def em(c, allowed):
        share = {k: 1 / len(allowed) for k in allowed}
        for _ in range(ROUNDS):
            new = {k: sum(c[j] * share[k] * probs[k][j] / sum(share[m] * probs[m][j] for m in allowed) for j in range(30)) / c.sum() for k in allowed}
            share = {k: v / sum(new.values()) for k, v in new.items()}
        return share, sum(c[j] * math.log(sum(share[k] * probs[k][j] for k in allowed)) for j in range(30))

    got = mixtures(counts, model)
    for c, found in zip(counts.astype(float), got):
        full, _ = em(c, range(5))
        chosen = [max(range(5), key=lambda k: sum(c[j] * math.log(probs[k][j]) for j in range(30)))]
        share, value = em(c, chosen)
        while len(chosen) < 5:
            more = max((k for k in range(5) if k not in chosen), key=lambda k: full[k])
            next_share, next_value = em(c, [*chosen, more])
            if next_value - value <= PENALTY * math.log(c.sum()):
                break
            chosen, share, value = [*chosen, more], next_share, next_value
        assert {k: pytest.approx(v, abs=2e-3) for k, v in share.items()} == {k: found[k] for k in range(5) if found[k] > 0}


def test_every_sampled_label_is_learnt(spark, monkeypatch):
    from quillet.llm import language_id

    few = spark.createDataFrame([(1, "hi", "en"), (2, "hé", "fr"), (3, "42", "zxx"), (4, "", "no")], "doc_id long, text string, lang string")
    told = {r.text: r.lang_pred for r in identify(few, learn(few)).collect()}
    assert told == {"hi": "en", "hé": "fr", "42": "und", "": "und"} and learn(few).languages == ["en", "fr"]
    # many labels leave fewer n-grams to each, but all of them are learnt
    many = spark.createDataFrame([(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 9, f"l{i:03d}") for i in range(600)], "doc_id long, text string, lang string")
    monkeypatch.setattr(language_id, "CELLS", 600 * 40)
    monkeypatch.setattr(language_id, "BROADCAST_ROWS", 0)
    model = learn(many)
    assert len(model.languages) == 600 and len(model.features) <= 40
    assert und_free(identify(many, model))


def und_free(told):
    return told.where("lang_pred = 'und'").count() == 0


def test_lm_counts_and_scores(spark, docs):
    held = F.col("doc_id") % 4 == 0
    for head in (1 << 17, 40):
        got = score_documents(docs, held, head=head, steps=5).collect()
        rows = docs.collect()
        tokens = lambda t: (t or "").encode().lower().split() + [None]
        counts = Counter(w for r in rows if r.doc_id is not None and r.doc_id % 4 for w in tokens(r.text))
        n, v = sum(counts.values()), len(counts)
        want = sorted(
            (r.doc_id or -1, len(tokens(r.text)), sum(counts[w] > 0 for w in tokens(r.text)),
             round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(r.text)), 6)) for r in rows
        )
        assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
        assert all(r.train_tokens == n and r.score < 0 and r.held_out == (r.doc_id is not None and r.doc_id % 4 == 0) for r in got)


def test_lm_beats_unigram_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scored = score_documents(docs, F.crc32(F.col("doc_id").cast("string")) % 10 == 0, steps=300).where("held_out")
    base, score = scored.agg(F.sum("base_score"), F.sum("score")).first()
    assert score > 0.96 * base, score / base


def test_group_hash_of_null(spark):
    a, b = spark.range(1).select(group_hash(F.lit(None)), group_hash(F.lit(""))).first()
    assert a == b == int(hashlib.md5(b"").hexdigest()[:15], 16)

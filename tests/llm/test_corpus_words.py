"""Source divergence, spelling variants and sentencepiece coding against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillet.llm.piece_codec import MergeCoder, encode_documents
from quillet.llm.source_divergence import divergence
from quillet.llm.spelling import Trie, group_spellings, near_words, word_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


# --- source divergence -------------------------------------------------------------------


def brute_divergence(rows, min_docs, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, docs, groups = Counter(), Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        n.update((lang, source, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        sources = sorted(s for x, s in groups if x == lang)
        kept = [t for (x, t), c in docs.items() if x == lang and c >= min_docs]
        count = {s: {t: n[lang, s, t] for t in kept} for s in sources}
        count[None] = {t: sum(count[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept} for s, c in count.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            term = [(-f(p[s][t], p[None][t]), t.encode(), t) for t in kept if count[s][t] and p[s][t] > p[None][t]]
            for part, ranked in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out |= {(lang, s, part, item, -value, k) for k, (value, _, item) in enumerate(ranked, 1)}
    return out


DOCS = "doc_id long, text string, lang string, source string, n long, term string, vector int, no int"


def docs_frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 1, 2) for r in rows], DOCS).repartition(3)


def test_divergence_is_that_of_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["Ab", "ab", "é", "É", "don't", "x1y", "_q", "Zoë", "", "ß-ss", "word", "\U00010348", "퟿"]
    rows = [
        (i, " ".join(rng.choices(vocabulary, k=rng.randrange(30))), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", None, "", "Ω", "\U00010348", "￿"]))
        for i in range(60)
    ]
    rows += rows[:5] + [(900, None, "en", "quiet"), (901, "", "en", "quiet2"), (902, "rare words only", "de", "a"), (903, None, "de", "b"), (904, "one", "lone", "s")]
    rows += [(None, "ab " * 20_000, "fr", "hot")]
    for min_docs, top in ((10, 10), (1, 3), (10**6, 10)):
        got = divergence(docs_frame(spark, rows), min_docs, top).collect()
        assert len(got) == len({tuple(r) for r in got})
        assert {tuple(r) for r in got} == brute_divergence(rows, min_docs, top)


def test_divergence_of_an_empty_table(spark):
    assert divergence(docs_frame(spark, [])).collect() == []


# --- spelling variants -------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


@settings(max_examples=80, deadline=None)
@given(st.sets(st.text("abà", min_size=1, max_size=6), min_size=1, max_size=40), st.text("abà", max_size=6))
def test_automaton_accepts_each_neighbour_once(words, word):
    ordered = sorted(words)
    trie = Trie.unpack(*Trie.of(ordered, list(range(1, len(ordered) + 1))).pack())
    got = list(trie.neighbours(word))
    assert sorted(got) == [(w, i) for i, w in enumerate(ordered, 1) if near(w, word)]


def brute_groups(counts, ratio=5):
    forms, out = {}, {}
    for w, n in counts.items():
        around = sorted(((-counts[o], o) for o in counts if near(w, o)))
        best = around[0] if around else None
        forms[w] = best[1] if best and -best[0] >= ratio * n else None
        out[w] = len(around)
    rows = set()
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.add((w, forms[w], root, n, out[w], counts[forms[w]] if forms[w] else None))
    return rows


def test_groups_over_many_shards_and_waves(spark):
    rng = random.Random(3)
    counts = {"".join(rng.choices("abé", k=rng.randrange(6, 9))): rng.choice([5, 6, 25, 30, 125, 700, 700, 3125]) for _ in range(400)}
    # a chain whose counts grow by the ratio at each step
    counts |= {"zzzzzz" + "y" * i: 5 ** (i + 1) for i in range(7)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    wanted = brute_groups(counts)
    assert max(len({r[2] for r in wanted if r[0] == w}) for w in counts) == 1
    for shard_words, wave_bytes in ((50_000, 1 << 26), (37, 1), (64, 4000)):
        assert {tuple(r) for r in group_spellings(words, 5, shard_words, wave_bytes).collect()} == wanted
    assert {r.word for r in near_words(words).collect()} == {r[0] for r in wanted if r[4]}


def test_words_are_spoilt_by_their_checksum(spark):
    rng = random.Random(9)
    vocabulary = ["Straße", "ÉCOLES", "couleur", "COULEUR", "abcdef", "abcdefg", "too", "naïveté", "under_score", "x×yzzzzz", "Ωmegaword"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=40)) + "1" * (i % 2), "en", "s") for i in range(500)]
    rows += rows[:9] + [(None, "nullid nullid couleur", "en", "s"), (7, None, "en", "s"), (8, "", "en", "s"), (9, "longword" * 5000, "en", "s")]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, spoilt = Counter(), 0
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                spoilt += 1
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) > 5
    assert spoilt
    got = {tuple(r) for r in word_counts(docs_frame(spark, rows)).collect()}
    assert got == {(w, n) for w, n in counts.items() if n >= 5 and len(w) > 5}


def test_spellings_of_empty_tables(spark):
    assert word_counts(docs_frame(spark, [])).collect() == []
    assert group_spellings(word_counts(docs_frame(spark, []))).collect() == []


# --- sentencepiece -----------------------------------------------------------------------


ODD = [
    "", " ", "  ", "a", " a ", "▁", "▁▁x ▁", "\n", "a\n\nb", " \n ", "x\r\n\ty", "</s> <s> <unk> <0x0A>", "鬼灵门，𠀀𠀀", "é é ﬁ ½", "\x00\x01", "﻿​", "a" * 3000, " " * 300 + "b",
    "https://x.y/z?q=1", "Straße", "🙂🙂 👩‍👩‍👧", "1234567890" * 30, "tabs\t\tand  spaces   here",
]


def test_agenda_codes_as_the_library_does():
    coder = MergeCoder(MODEL)
    rng = random.Random(1)
    alphabet = "aàbcdeint ▁\n\té鬼🙂0.,'<>/s"
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(500)]
    texts += [" ".join(rng.choices(ODD, k=5)) for _ in range(50)]
    ids, decoded = coder.code(texts)
    for t, i, d in zip(texts, ids, decoded):
        wanted = coder.library.encode(t, add_eos=True)
        assert memoryview(i).cast("i").tolist() == wanted and d == coder.library.decode(wanted), repr(t)
        assert coder.decode(wanted) == d
    # the units' own ids are what was held against the library
    assert coder.checked > 500 and coder.differing == 0


def test_what_differs_is_coded_by_the_library():
    coder = MergeCoder(MODEL)
    coder.ranks["▁hello"] = 10.0**12
    right = coder.library.encode("hello world", add_eos=True)
    ids, decoded = coder.code(["hello world"])
    assert memoryview(ids[0]).cast("i").tolist() == right and decoded == ["hello world"] and coder.differing


def test_documents_are_coded_whole(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(ODD)] + [(1, None, "en", "s"), (1, " ", "en", "s"), (None, "x", None, None), (99, "many words of it, " * 30_000, "en", "s")]
    got = defaultdict(list)
    for r in encode_documents(docs_frame(spark, rows), MODEL, batch_bytes=200).collect():
        got[r.doc_id].append((r.ids, r.decoded))
    library = MergeCoder.get(MODEL).library
    wanted = defaultdict(list)
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_eos=True)
        wanted[doc_id].append((ids, library.decode(ids)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in wanted.items()}
    assert encode_documents(docs_frame(spark, []), MODEL).collect() == []


def test_only_vocabularies_with_byte_pieces(tmp_path):
    with pytest.raises(Exception):
        MergeCoder(str(tmp_path / "none.model"))


def test_query_rows_are_those_of_the_library(spark):
    import hashlib

    from quillet.llm.queries import op13_piece_codec

    sf = "/root/testdata/sf0.001"
    library = MergeCoder.get(MODEL).library
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in op13_piece_codec(spark, sf).collect():
        ids = library.encode(texts[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids)))

"""The corpus pipeline and its stages against brute force, on a small odd table."""

import random
import threading
import zlib
from collections import Counter

import public_tokenizers
import pytest
from test_documents_ops import brute_components, brute_contamination
from tokenizers import Tokenizer

import corpus_pipeline as cp
from quillet.llm.packing import piece_lengths

SCHEMA = "doc_id long, text string, lang string, source string, contamination string, _id string"


def text_of(rng, lang, n=40):
    words = {"aa": ["bako", "tiru", "mana", "selo", "vupi", "nado"], "bb": ["grzx", "strv", "klmp", "wrtz", "hjkl", "bcdf"]}[lang]
    return " ".join(rng.choice(words) + str(rng.randrange(90)) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    items = [(1, text_of(rng, "aa", 30)), (2, "solo"), (3, None)]
    rows = [(i, text_of(rng, "aa" if i % 2 else "bb"), "aa" if i % 2 else "bb") for i in range(40)]
    near = rows[3][1].split()
    near[20] = "odd"
    rows += [(100, rows[3][1], "aa"), (101, rows[4][1].upper(), None), (102, " ".join(near * 1), "aa")]
    rows += [(103, items[0][1] + " " + text_of(rng, "aa", 30), "aa"), (104, text_of(rng, "bb", 300) + " solo", "bb"), (105, "solo", "aa")]
    rows += [(50, None, "aa"), (51, "", None), (52, " 12 ** ", "bb"), (53, "漢字", None)]
    twice = text_of(rng, "bb")
    rows += [(60, twice, "bb"), (60, twice, "bb"), (60, text_of(rng, "aa"), "aa"), (61, twice + " tail", "bb")]
    lost = text_of(rng, "aa")
    rows += [(None, lost, "aa"), (None, lost, "aa"), (None, rows[5][1], "aa"), (None, None, None)]
    rows.append((70, text_of(rng, "bb", 9000), "bb"))
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(*r, "s", "c", "x") for r in rows], SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), items


def docs_of(spark, folder):
    return spark.read.parquet(f"{folder[0]}/documents.parquet")


def counted(rows):
    return Counter((r.doc_id, r.text, r.lang, r.source, r.contamination, r._id) for r in rows)


def test_language_stage(spark, folder):
    docs = docs_of(spark, folder)
    got = cp.language_id(spark, docs, folder[0])
    assert got.columns == docs.columns
    kept = [r for r in docs.collect() if any(map(str.isalpha, r.text or "")) and r.text != "漢字"]
    assert counted(got.collect()) == counted(kept)
    unlabelled = cp.language_id(spark, docs.where("lang is null"), folder[0]).collect()
    assert {r.doc_id for r in unlabelled} == {53, 101}


def test_near_dedup_stage(spark, folder):
    docs = docs_of(spark, folder)
    got = cp.near_dedup(spark, docs, folder[0])
    assert got.columns == docs.columns
    # brute force: distinct (doc_id, text); groups by similarity of texts; the smallest id stays
    rows = list(dict.fromkeys((r.doc_id, r.text) for r in docs.collect()))
    group = brute_components(list(enumerate(t for _, t in rows)))
    of = {}
    for k, row in enumerate(rows):
        of.setdefault(group[k], []).append(row)
    kept = Counter(tuple(r[:2]) for r in got.select("doc_id", "text").collect())
    assert set(kept.values()) == {1}
    for members in of.values():
        stays = [m for m in members if m in kept]
        assert len(stays) == 1
        ids = [m[0] for m in members if m[0] is not None and sum(r[0] == m[0] for r in rows) == 1]
        if ids:
            assert stays[0][0] == min(ids)


def test_decontamination_stage(spark, folder):
    docs = docs_of(spark, folder)
    got = cp.decontaminate(spark, docs, folder[0])
    assert got.columns == docs.columns
    usable = [x for x in folder[1] if x[1]]
    kept = [r for r in docs.collect() if not brute_contamination(r.text, usable)[3]]
    assert counted(got.collect()) == counted(kept) and not {103, 105} & {r.doc_id for r in kept} and 104 in {r.doc_id for r in kept}


def test_whole_pipeline_round_trip(spark, folder):
    docs = docs_of(spark, folder)
    for _, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder[0]).collect(), docs.schema)
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in docs.collect():
        ids, start = plain.encode(r.text or "", add_special_tokens=False).ids + [1], 0
        for n in piece_lengths(len(ids), 2048):
            want[r.doc_id, start, n, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[start : start + n]))] += 1
            start += n
    assert Counter((r.doc_id, r.start, r.length, zlib.crc32(r.ids)) for r in cp.run(spark, folder[0]).collect()) == want


def test_stages_of_nothing(spark, folder):
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in cp.STAGES:
        assert stage(spark, none, folder[0]).collect() == []


def test_runs_of_two_threads_keep_apart(spark, folder):
    docs, out, failed = docs_of(spark, folder).where("doc_id < 30"), {}, []

    def work(k):
        try:
            part = docs
            for _, stage in cp.STAGES[1:3]:
                part = spark.createDataFrame(stage(spark, part, folder[0]).collect(), docs.schema)
            out[k] = counted(part.collect())
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and out[0] == out[1] and len(out[0]) == 30

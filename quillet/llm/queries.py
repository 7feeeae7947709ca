"""The registered queries of the training-data operators, with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.llm.chat_format import conversations_of, echo_pairs, format_preferences
from quillet.llm.common import table
from quillet.llm.decontamination import contamination
from quillet.llm.language_id import identify, learn
from quillet.llm.near_dedup import near_duplicates
from quillet.llm.packing import pack
from quillet.llm.piece_codec import encode_documents
from quillet.llm.recurrent_lm import score_documents
from quillet.llm.sharding import shard_documents
from quillet.llm.source_divergence import divergence
from quillet.llm.spelling import group_spellings, word_counts
from quillet.llm.token_counts import token_counts
from quillet.llm.url_filter import Rule, judge_urls
from quillet.llm.vector_search import nearest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = contamination(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    )
    return judged.select(
        "doc_id", "contamination.n_words", "contamination.n_hit",
        F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("contamination.items", ","), 256).alias("items_sha256"),
        "contamination.contaminated",
    )


ORACLE_OP1 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, list_slice(w, s, s + least(13, len(w)) - 1) AS win
  FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(s) WHERE len(w) > 0
), ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, s, list_slice(w, s, s + k - 1) AS win
  FROM d, ks, unnest(range(1, len(w) - k + 2)) AS t(s) WHERE len(w) >= k
), hit AS (SELECT doc_id, dw.k, s, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(s, s + k)) AS t(p) GROUP BY doc_id),
ids AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
  FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
""".replace("\\\\", "\\")

TOKEN_LIMIT = 1024


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = learn(docs.where(~held_out))
    predicted = identify(docs.select("doc_id", "text"), model)
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"), 24)
    return placed.select("*", F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard"))


def op6_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, factor=1.0)


ORACLE_OP6 = """
WITH v AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

URL_RULES = [
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
]


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_OP8 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') AS shingle
  FROM d, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS t(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM met JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)
), reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
component AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN component ON component.a = d.doc_id
"""


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 10 == 0)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = echo_pairs(conversations_of(table(spark, sf_dir, "conversations")))
    digits = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "").alias(c)
    return format_preferences(pairs).select(
        "conv_id", "prompt_turns", "prompt", "chosen_text", digits("chosen_mask"), "rejected_text", digits("rejected_mask"), "usable"
    )


ORACLE_OP10 = """
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
  FROM conversations
), e AS (
  SELECT conv_id, max(k) FILTER (WHERE role = 'assistant') AS last, max(k) AS n FROM t GROUP BY conv_id
), c AS (
  SELECT conv_id, k, role, text, CASE WHEN k = last THEN coalesce(lag(text) OVER w, CASE WHEN k = 1 THEN '' END) ELSE text END AS other
  FROM t JOIN e USING (conv_id) WHERE k <= coalesce(last, n) WINDOW w AS (PARTITION BY conv_id ORDER BY k)
), p AS (
  SELECT conv_id, coalesce(min(k) FILTER (WHERE text IS DISTINCT FROM other) - 1, max(k)) AS same FROM c GROUP BY conv_id
), r AS (
  SELECT conv_id, same, k, role, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10) AS a,
    '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(other, '') || chr(10) || '<|end|>' || chr(10) AS b,
    CASE WHEN role = 'assistant' THEN '1' ELSE '0' END AS m
  FROM c JOIN p USING (conv_id)
)
SELECT conv_id, same::INT AS prompt_turns, coalesce(string_agg(a, '' ORDER BY k) FILTER (WHERE k <= same), '') AS prompt,
  coalesce(string_agg(a, '' ORDER BY k) FILTER (WHERE k > same), '') AS chosen_text,
  coalesce(string_agg(m, '' ORDER BY k) FILTER (WHERE k > same), '') AS chosen_mask,
  coalesce(string_agg(b, '' ORDER BY k) FILTER (WHERE k > same), '') AS rejected_text,
  coalesce(string_agg(m, '' ORDER BY k) FILTER (WHERE k > same), '') AS rejected_mask,
  coalesce(bool_or(m = '1') FILTER (WHERE k > same), false) AS usable
FROM r GROUP BY conv_id, same
"""

ORACLE_OP7 = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u
), r(action, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT page_id, host, path, action, rhost || rpath AS rule,
    row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
  FROM h LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE k = 1
"""



def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


ORACLE_OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, coalesce(n, 0)::HUGEINT AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, sum(n) OVER (PARTITION BY lang, term) AS m,
  1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source))::HUGEINT AS p FROM f),
q AS (SELECT *, 1 + (1000000000 * (m + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * (SELECT count(*) FROM k WHERE k.lang = p.lang))::HUGEINT AS q FROM p),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL
), terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM q WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM terms QUALIFY rank <= 10
"""

def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(word_counts(table(spark, sf_dir, "documents")))


#: The checksum is taken over bytes by its table, which is made from the polynomial.
ORACLE_OP12 = r"""
WITH RECURSIVE tab(b, k, c) AS (
  SELECT b, 0, b FROM range(256) t(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM tab WHERE k < 8
), crc AS (SELECT list(c ORDER BY b) AS l FROM tab WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
  FROM documents
), seen AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, run, count(*) AS n FROM runs WHERE length(run) > 5 GROUP BY ALL),
h AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(id || ':' || run, ''),
      lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))),
    lambda a, b: xor(l[xor(a, b) % 256 + 1], a // 256)), 4294967295::BIGINT) AS h
  FROM seen, crc
), spoilt AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM h
), w AS (SELECT word, sum(n)::BIGINT AS n FROM spoilt WHERE length(word) > 5 GROUP BY word HAVING sum(n) > 4),
v AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM w, unnest(range(1, length(word) + 1)) AS t(i)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM v a JOIN v b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.less = w.word
  UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.less = w.word
), b AS (SELECT word, other, n AS other_n, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, other) = 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n FROM w LEFT JOIN b USING (word)),
r(word, reached, next) AS (SELECT word, word, form FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON r.next = f.word)
SELECT f.word, form, reached AS root, n, n_near, form_n FROM f JOIN r ON f.word = r.word AND r.next IS NULL
"""

def op13_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES["op1_benchmark_decontamination"] = op1_benchmark_decontamination
ORACLES["op1_benchmark_decontamination"] = ORACLE_OP1
QUERIES["op2_token_counts"] = op2_token_counts
QUERIES["op3_packing"] = op3_packing
QUERIES["op4_language_id"] = op4_language_id
QUERIES["op5_sharding"] = op5_sharding
QUERIES["op6_vector_search"] = op6_vector_search
ORACLES["op6_vector_search"] = ORACLE_OP6
QUERIES["op7_url_filters"] = op7_url_filters
# the pages hold no canonical links and no redirects, so the rules decide; aliases are tested on fixtures
ORACLES["op7_url_filters"] = ORACLE_OP7
QUERIES["op8_minhash_near_dedup"] = op8_minhash_near_dedup
ORACLES["op8_minhash_near_dedup"] = ORACLE_OP8
QUERIES["op9_lm_scoring"] = op9_lm_scoring
QUERIES["op10_chat_formatting"] = op10_chat_formatting
ORACLES["op10_chat_formatting"] = ORACLE_OP10
QUERIES["op11_source_divergence"] = op11_source_divergence
ORACLES["op11_source_divergence"] = ORACLE_OP11
QUERIES["op12_spelling_variants"] = op12_spelling_variants
ORACLES["op12_spelling_variants"] = ORACLE_OP12
QUERIES["op13_piece_codec"] = op13_piece_codec

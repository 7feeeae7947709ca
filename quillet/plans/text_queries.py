"""Queries of keywords, near-dup removal, entities, masking, chunking and refinement."""

from __future__ import annotations

from itertools import product

import pandas as pd
from pyspark.sql import functions as F

from quillet.functions import chunking as ck
from quillet.functions import keywords as kw
from quillet.functions import text as tx
from quillet.operators import dedup, entities as en, refinement as rf, segments as sg, windows as wn
from quillet.operators.fuzzy import fuzzy_matches
from quillet.operators.masking import Entity, Surfaces
from quillet.operators.matching import units
from quillet.plans.base import SQL_SPACE, sql_collapse, sql_strip, table
from quillet.plans.evaluation_queries import literal, sql_expected
from quillet.registry import query

_COMMON = ", ".join(f"'{w}'" for w in kw.COMMON)
SQL_WORDS = f"w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS raw, unnest(range(len(string_split(text, ' ')))) AS i FROM documents), k AS (SELECT doc_id, i, {sql_strip('raw')} AS k FROM w)"
SQL_COMMON = f"(k = '' OR k IN ({_COMMON}) OR length(k) <= 1 AND NOT regexp_matches(k, '[一-鿿A-Za-z0-9+#%]'))"
SQL_TARGET = r"(regexp_matches(k, '[A-Za-z][A-Za-z0-9_+#.\-]|\p{Nd}|[A-Za-z][A-Za-z0-9_+#.\-]*\+\+|>=|<=|!=|==|->|::|\+=|-=|\*=|/=|%d') OR length(k) >= 2 AND regexp_matches(k, '[一-鿿]'))"


def _words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("words"))


@query("d07_dedupe_keywords", f"WITH {SQL_WORDS}, f AS (SELECT doc_id, k, min(i) AS i FROM k WHERE k <> '' GROUP BY ALL), g AS (SELECT doc_id, count(*) AS n, md5(string_agg(k, '|' ORDER BY i)) AS words_md5 FROM f GROUP BY doc_id) SELECT d.doc_id, coalesce(n, 0)::INT AS n, coalesce(words_md5, md5('')) AS words_md5 FROM documents d LEFT JOIN g USING (doc_id)")
def d07(spark, sf_dir):
    """The words of each text, stripped, the first of equals."""
    kept = _words(spark, sf_dir).select("doc_id", kw.dedupe(F.col("words")).alias("k"))
    return kept.select("doc_id", F.size("k").alias("n"), F.md5(F.array_join("k", "|")).alias("words_md5"))


@query("x12_common_keyword", f"WITH {SQL_WORDS} SELECT d.doc_id, count(*) FILTER ({SQL_COMMON})::INT AS common FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id")
def x12(spark, sf_dir):
    """Words of each text that are too common to review."""
    none = F.array().cast("array<string>")
    return _words(spark, sf_dir).select("doc_id", F.size(F.filter(F.coalesce("words", none), kw.is_common)).alias("common"))


@query("x11_target_shapes", f"WITH {SQL_WORDS} SELECT d.doc_id, count(*) FILTER ({SQL_TARGET})::INT AS targets FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id")
def x11(spark, sf_dir):
    """Words of each text that look like review targets."""
    none = F.array().cast("array<string>")
    return _words(spark, sf_dir).select("doc_id", F.size(F.filter(F.coalesce("words", none), lambda w: kw.looks_like_target(tx.strip(w)))).alias("targets"))


#: Keywords of a document: its labels and its last word, as they are and spelt backwards.
SQL_KEYS = f"""r AS (SELECT doc_id, text, unnest([lang, ' ' || source || ' ', reverse(source), lang || '§', regexp_extract(text, '([A-Za-z0-9]+)[^A-Za-z0-9]*$', 1), reverse(regexp_extract(text, '([A-Za-z0-9]+)[^A-Za-z0-9]*$', 1)), source]) AS raw, unnest(range(7)) AS i FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, text, k, min(i) AS i FROM (SELECT *, {sql_strip('raw')} AS k FROM r) WHERE k <> '' GROUP BY ALL),
e AS (SELECT *, contains(text, k) OR length(k) > 1 AND len(g) > 0 AND len(list_filter(g, lambda x: contains(text, x))) >= greatest(1, len(g) - 1)
  OR length(k) = 1 AND (contains(text, k || '是') OR contains(text, k || '叫') OR contains(text, k || '为')) AS evident FROM (SELECT *, list_filter(string_split(k, ''), lambda x: regexp_matches(x, '[一-鿿A-Za-z0-9+#%]')) AS g FROM k))"""


def last_word(text):
    """The last run of Latin letters and digits, looked for from the end: from the start
    every other run would be tried at each of its places, which is quadratic for long ones."""
    return F.reverse(F.regexp_extract(F.reverse(text), r"\A[^A-Za-z0-9]*+([A-Za-z0-9]++)", 1))


def _keywords(spark, sf_dir):
    last = last_word(F.col("text"))
    listed = F.array("lang", F.concat(F.lit(" "), "source", F.lit(" ")), F.reverse("source"), F.concat("lang", F.lit("§")), last, F.reverse(last), F.col("source"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", listed.alias("k"))


@query("x13_keyword_evidence", f"WITH {SQL_KEYS} SELECT doc_id, k AS keyword, evident FROM e")
def x13(spark, sf_dir):
    """Which of a document's keywords its text gives evidence of."""
    keys = _keywords(spark, sf_dir).select("doc_id", "text", F.explode(kw.dedupe(F.col("k"))).alias("keyword"))
    return keys.select("doc_id", "keyword", kw.has_evidence(F.col("keyword"), F.col("text"), F.lit("")).alias("evident"))


@query("x14_normalize_targets", f"WITH {SQL_KEYS} SELECT d.doc_id, coalesce(string_agg(k, ',' ORDER BY i) FILTER (NOT {SQL_COMMON} AND (evident OR {SQL_TARGET})), '') AS result FROM documents d LEFT JOIN e USING (doc_id) WHERE d.text IS NOT NULL GROUP BY d.doc_id")
def x14(spark, sf_dir):
    return _keywords(spark, sf_dir).select("doc_id", F.array_join(kw.normalize_targets(F.col("k"), F.col("text"), F.lit("")), ",").alias("result"))


@query("p07_keyword_qc", f"WITH {SQL_KEYS} SELECT d.doc_id, coalesce(bool_and(NOT {SQL_COMMON} AND evident), true) AS result FROM documents d LEFT JOIN e USING (doc_id) WHERE d.text IS NOT NULL GROUP BY d.doc_id")
def p07(spark, sf_dir):
    """Whether none of a document's keywords is common or without evidence."""
    return _keywords(spark, sf_dir).select("doc_id", kw.keyword_qc(F.col("k"), F.col("text"), F.lit("")).alias("result"))


@query("x15_first_keywords", "SELECT doc_id, CASE WHEN lang = 'en' THEN source WHEN doc_id % 2 = 0 THEN lang || ',' || source ELSE '' END AS result FROM documents")
def x15(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    none = F.array().cast("array<string>")
    first = F.when(F.col("lang") == "en", F.array("source", "source")).otherwise(none)
    second = F.when(F.col("doc_id") % 2 == 0, F.array("lang", F.lit(" "), "source"))
    return docs.select("doc_id", F.array_join(kw.first_keywords(first, second), ",").alias("result"))


# --- near-dup removal -------------------------------------------------------------------

SQL_GRAMS = f"""t AS (SELECT doc_id AS pos, {sql_strip('text')} AS s FROM documents WHERE text IS NOT NULL AND text <> ''),
g AS (SELECT pos, CASE WHEN length(s) < 3 THEN [s] ELSE list_distinct(list_transform(range(1, length(s) - 1), lambda i: substr(s, i::INT, 3))) END AS grams FROM t)"""


@query("d01_trigrams", f"WITH {SQL_GRAMS} SELECT pos AS doc_id, len(grams)::INT AS grams FROM g")
def d01(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.size(tx.char_ngrams(F.col("text"))).alias("grams"))


SQL_PAIRS = f"""{SQL_GRAMS}, e AS (SELECT pos, len(grams) AS n, unnest(grams) AS gram FROM g),
pairs AS (SELECT a.pos AS earlier, b.pos AS later, count(*) / (any_value(a.n) + any_value(b.n) - count(*))::DOUBLE AS jaccard
  FROM e a JOIN e b ON a.gram = b.gram AND a.pos < b.pos AND a.n >= 0.75 * b.n AND b.n >= 0.75 * a.n GROUP BY 1, 2 HAVING count(*) >= 0.75 * (any_value(a.n) + any_value(b.n) - count(*)))"""


@query("j10_similar_pairs", f"WITH {SQL_PAIRS}, f AS (SELECT text, min(doc_id) AS first FROM documents GROUP BY text) SELECT earlier, later, round(jaccard, 9) AS jaccard FROM pairs WHERE earlier IN (SELECT first FROM f) AND (later IN (SELECT first FROM f) OR EXISTS (SELECT 1 FROM documents x, documents y WHERE x.doc_id = earlier AND y.doc_id = later AND x.text = y.text))")
def j10(spark, sf_dir):
    """Similar pairs of different texts, and each copy with its text's first row."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "text")
    return dedup.similar_pairs(rows).select("earlier", "later", F.round("jaccard", 9).alias("jaccard"))


@query("d03_deduplicate", f"""WITH RECURSIVE {SQL_PAIRS}, st(id, keep) USING KEY (id) AS (
  SELECT doc_id, CASE WHEN doc_id NOT IN (SELECT later FROM pairs) THEN true END FROM documents
  UNION SELECT r.id, CASE WHEN bool_or(k.keep) THEN false WHEN bool_and(k.keep = false) THEN true END
  FROM recurring.st r JOIN pairs p ON p.later = r.id JOIN recurring.st k ON k.id = p.earlier WHERE r.keep IS NULL GROUP BY r.id
  HAVING bool_or(k.keep) OR count(k.keep) = count(*)
) SELECT id AS doc_id FROM st WHERE keep""")
def d03(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "text")
    return dedup.deduplicate(rows).select(F.col("pos").alias("doc_id"))


@query("d02_d04_is_duplicate", f"""WITH g AS (SELECT item_id, list_distinct(list_transform(range(1, length(s) - 1), lambda i: substr(s, i::INT, 3))) AS g,
  list_distinct(list_transform(range(1, length(s2) - 1), lambda i: substr(s2, i::INT, 3))) AS h FROM (SELECT item_id, {sql_strip('text')} AS s, {sql_strip("replace(text, 'e', '')")} AS s2 FROM benchmark))
SELECT item_id, round(len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h)))::DOUBLE, 9) AS jaccard, len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h)))::DOUBLE >= 0.5 AS duplicate FROM g""")
def d02(spark, sf_dir):
    other = F.regexp_replace("text", "e", "")
    j = tx.jaccard(tx.char_ngrams(F.col("text")), tx.char_ngrams(other))
    return table(spark, sf_dir, "benchmark").select("item_id", F.round(j, 9).alias("jaccard"), dedup.is_duplicate(F.col("text"), F.array(other), 0.5).alias("duplicate"))


def _pool(spark, sf_dir, name, key, text, size):
    t = table(spark, sf_dir, name)
    item = F.when(F.col(key) % 2 == 0, F.to_json(F.struct(F.col(text).alias("name")))).otherwise(F.concat(F.lit('"'), F.upper(text), F.lit('"')))
    return t.select(F.lit("meeting").alias("scene"), (F.col(key) % size).cast("string").alias("category"), F.col(key).alias("pos"), item.alias("item"))


@query("d05_seed_dedupe", f"""SELECT 'meeting' AS scene, (p_partkey % 3)::VARCHAR AS category, {sql_collapse('lower(p_brand)')} AS key, min(p_partkey) AS pos FROM part GROUP BY ALL""")
def d05(spark, sf_dir):
    return dedup.merge_seeds(_pool(spark, sf_dir, "part", "p_partkey", "p_brand", 3)).select("scene", "category", "key", "pos")


@query("d06_seed_merge", f"""WITH p AS (SELECT (p_partkey % 3)::VARCHAR AS category, {sql_collapse('lower(p_brand)')} AS key, 0 AS pool, p_partkey AS pos FROM part
  UNION ALL SELECT (p_partkey % 4)::VARCHAR, {sql_collapse('lower(p_type)')}, 1, p_partkey FROM part)
SELECT category, key, min_by(pool, (pool, pos))::INT AS pool, min_by(pos, (pool, pos)) AS pos FROM p GROUP BY ALL""")
def d06(spark, sf_dir):
    a, b = _pool(spark, sf_dir, "part", "p_partkey", "p_brand", 3), _pool(spark, sf_dir, "part", "p_partkey", "p_type", 4)
    return dedup.merge_seeds(a, b).select("category", "key", "pool", "pos")


@query("a13_seed_counts", f"SELECT category, count(DISTINCT {sql_collapse('lower(p_brand)')}) AS seeds FROM (SELECT (p_partkey % 3)::VARCHAR AS category, p_brand FROM part) GROUP BY category")
def a13(spark, sf_dir):
    return dedup.merge_seeds(_pool(spark, sf_dir, "part", "p_partkey", "p_brand", 3)).groupBy("category").agg(F.count("*").alias("seeds"))


@query("d08_concat_inputs", "SELECT 'a' AS origin, c_custkey AS key FROM customer UNION ALL SELECT 'b', s_suppkey FROM supplier")
def d08(spark, sf_dir):
    part = lambda n, k, o: table(spark, sf_dir, n).select(F.lit(o).alias("origin"), F.col(k).alias("key"))
    return part("customer", "c_custkey", "a").unionByName(part("supplier", "s_suppkey", "b"))


@query("d09_d10_set_differences", "SELECT k, n FROM (VALUES (0, 'B'), (1, ''), (2, 'A,C')) v(k, n)")
def d09(spark, sf_dir):
    """Markers in the output that were not expected, and asked questions not answered."""
    rows = spark.createDataFrame([(0, ["B", "A", "B"], ["A"]), (1, ["A"], ["A", "B"]), (2, ["C", "A"], ["B"])], "k int, found array<string>, expected array<string>")
    return rows.select("k", F.array_join(F.array_sort(F.array_except("found", "expected")), ",").alias("n"))


@query("d11_ordered_distinct", "SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL) GROUP BY conv_id")
def d11(spark, sf_dir):
    listed = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return listed.select("conv_id", F.array_join(F.array_distinct(F.transform("r", lambda x: x["role"])), ",").alias("roles"))


# --- entity dictionary -------------------------------------------------------------------


def store(spark, sf_dir) -> en.EntityStore:
    """nations as entities of their region's domain, with suppliers' names as aliases."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    entities = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("long").alias("entity_id"), F.col("n_name").alias("canonical_text"), F.lit("ORG").alias("entity_type"),
        F.when(F.col("n_nationkey") % 4 == 0, "general").otherwise(F.col("r_name")).alias("domain"), F.lit("normalize").alias("normalization_policy"),
        (F.col("n_nationkey") % 3).cast("int").alias("priority"), (F.col("n_nationkey") % 7 != 3).alias("enabled"), F.lit("seed").alias("source"),
    )
    aliases = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("alias_id"), F.col("s_nationkey").cast("long").alias("entity_id"), F.col("s_name").alias("alias"))
    return en.EntityStore(entities, aliases)


SQL_STORE = """ent AS (SELECT n_nationkey::BIGINT AS entity_id, n_name AS canonical_text, CASE WHEN n_nationkey % 4 = 0 THEN 'general' ELSE r_name END AS domain,
  (n_nationkey % 3)::INT AS priority, n_nationkey % 7 <> 3 AS enabled FROM nation JOIN region ON n_regionkey = r_regionkey),
al AS (SELECT s_suppkey AS alias_id, s_nationkey::BIGINT AS entity_id, s_name AS alias FROM supplier)"""


@query("j06_entity_view", f"WITH {SQL_STORE} SELECT e.entity_id, domain, priority, coalesce(string_agg(alias, ',' ORDER BY alias_id), '') AS aliases FROM ent e LEFT JOIN al USING (entity_id) GROUP BY ALL")
def j06(spark, sf_dir):
    s = store(spark, sf_dir)
    return en.entity_view(s.entities, s.aliases, enabled_only=False).select("entity_id", "domain", "priority", F.array_join("aliases", ",").alias("aliases"))


@query("e04_list_entities", f"WITH {SQL_STORE} SELECT entity_id, canonical_text, row_number() OVER (ORDER BY priority DESC, entity_id)::INT AS place FROM ent WHERE enabled AND domain IN ('ASIA', 'general')")
def e04(spark, sf_dir):
    from pyspark.sql import Window

    s = store(spark, sf_dir)
    return en.entity_view(s.entities, s.aliases, "ASIA").select("entity_id", "canonical_text", F.row_number().over(Window.orderBy(*en.view_order())).alias("place"))


@query("e05_get_entity", f"WITH {SQL_STORE} SELECT entity_id, enabled FROM ent WHERE canonical_text = (SELECT n_name FROM nation WHERE n_nationkey = 3)")
def e05(spark, sf_dir):
    s = store(spark, sf_dir)
    name = table(spark, sf_dir, "nation").where("n_nationkey = 3").select(F.col("n_name").alias("canonical_text"))
    return s.entities.join(F.broadcast(name), "canonical_text", "left_semi").select("entity_id", "enabled")


@query("p17_search_entities", f"WITH {SQL_STORE} SELECT entity_id FROM ent WHERE contains(lower(canonical_text), '1') OR entity_id IN (SELECT entity_id FROM al WHERE contains(lower(alias), '1'))")
def p17(spark, sf_dir):
    s = store(spark, sf_dir)
    return en.search(en.entity_view(s.entities, s.aliases, enabled_only=False), "1").select("entity_id")


@query("e01_upsert", f"""WITH {SQL_STORE}, inc AS (SELECT canonical_text, domain, 9 AS priority FROM ent WHERE entity_id % 2 = 0 UNION ALL SELECT r_name, 'general', 9 FROM region WHERE (r_name, 'general') NOT IN (SELECT canonical_text, domain FROM ent)),
nw AS (SELECT *, row_number() OVER (ORDER BY canonical_text, domain) AS k FROM inc WHERE (canonical_text, domain) NOT IN (SELECT canonical_text, domain FROM ent))
SELECT entity_id, canonical_text, domain, CASE WHEN entity_id % 2 = 0 THEN 9 ELSE priority END::INT AS priority, enabled OR entity_id % 2 = 0 AS enabled FROM ent
UNION ALL SELECT (SELECT max(entity_id) FROM ent) + k, canonical_text, domain, 9, true FROM nw""")
def e01(spark, sf_dir):
    s = store(spark, sf_dir)
    extra = [F.lit("org").alias("entity_type"), F.lit("preserve").alias("normalization_policy"), F.lit(9).alias("priority"), F.lit("api").alias("source"), F.array(F.lit(" new ")).alias("aliases"), F.lit(0).alias("pos")]
    old = s.entities.where("entity_id % 2 = 0").select("canonical_text", "domain", *extra)
    new = table(spark, sf_dir, "region").select(F.col("r_name").alias("canonical_text"), F.lit("general").alias("domain"), *extra)
    return en.upsert(s.entities, s.aliases, old.unionByName(new))[0].select("entity_id", "canonical_text", "domain", "priority", "enabled")


@query("e03_disable_delete", f"WITH {SQL_STORE} SELECT entity_id, CASE WHEN entity_id = 5 THEN false ELSE enabled END AS enabled, (SELECT count(*) FROM al WHERE al.entity_id = ent.entity_id) AS aliases FROM ent WHERE entity_id <> 7")
def e03(spark, sf_dir):
    s = store(spark, sf_dir)
    entities, aliases = en.delete(en.set_enabled(s.entities, 5, False), s.aliases, 7)
    n = aliases.groupBy("entity_id").agg(F.count("*").alias("aliases"))
    return entities.join(n, "entity_id", "left").select("entity_id", "enabled", F.coalesce("aliases", F.lit(0)).alias("aliases"))


# --- masking and refinement --------------------------------------------------------------

SURFACES = ["tion", "Elle", "und der", "ción", "über"]


@query("j08_dictionary_hits", "SELECT doc_id, s AS surface, ((length(t) - length(replace(t, u, ''))) / length(u))::INT AS hits FROM (SELECT doc_id, s, CASE WHEN s IN ('ción', 'über') THEN text ELSE lower(text) END AS t, CASE WHEN s IN ('ción', 'über') THEN s ELSE lower(s) END AS u FROM documents, (VALUES "
       + ", ".join(f"('{s}')" for s in SURFACES) + ") v(s)) WHERE contains(t, u)")
def j08(spark, sf_dir):
    @F.pandas_udf("array<string>")
    def hits(texts: pd.Series) -> pd.Series:
        machine = Surfaces([(s, s) for s in SURFACES])
        return texts.map(lambda t: [owner for _, _, owner in machine.find(t or "")])

    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(hits("text")).alias("surface"))
    return found.groupBy("doc_id", "surface").agg(F.count("*").cast("int").alias("hits"))


DICTIONARY = [
    Entity(1, "Thention", "TERM", aliases=("thtion", "hention")), Entity(2, "Éelle", "PROJECT", aliases=("elle la",)), Entity(3, "Kundach", "ORG", normalization_policy="preserve"),
]


@query("e21_refine_batch", f"SELECT doc_id AS id, md5({sql_strip('text')}) AS clean_md5, true AS accepted, 0 AS retries FROM documents")
def e21(spark, sf_dir):
    """The batch flow with the identity refiner gives every stripped text back."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    out = rf.refine_batch(rows, None, lambda: sg.identity, mode="off")
    return out.select("id", F.md5("clean_text").alias("clean_md5"), "accepted", "retries")


@query("g17_refine_windows")
def g17(spark, sf_dir):
    """The segment loop: windows of 80 characters, masked, squeezed, guarded and joined."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    out = rf.refine_batch(rows, dictionary_view(spark, DICTIONARY), lambda: sg.squeezing, mode="off", limit=80)
    return out.select("id", F.md5("clean_text").alias("clean_md5"), "accepted", F.size("normalizations").alias("normalizations"))


def dictionary_view(spark, entities: list[Entity]):
    """The entities as an entity view."""
    columns = ("entity_id", "canonical_text", "entity_type", "domain", "normalization_policy", "priority", "aliases", "enabled")
    schema = "entity_id long, canonical_text string, entity_type string, domain string, normalization_policy string, priority int, aliases array<string>, enabled boolean"
    return spark.createDataFrame([tuple(list(v) if isinstance(v, tuple) else v for v in (getattr(e, c) for c in columns)) for e in entities], schema)


# Letters that sound alike in the texts at hand; c has two sounds.
SOUNDS = [("é", "e", 0), ("è", "e", 0), ("ê", "e", 0), ("c", "k", 0), ("c", "s", 1), ("q", "k", 0), ("y", "i", 0), ("z", "s", 0)]
HOMOPHONES = [Entity(1, "mentecz", priority=3), Entity(2, "Zenquell", "PROJECT", aliases=("rekuell",)), Entity(3, "elliment", "ORG")]


# single bytes that no comparable character has
_CODES = "'" + "".join(map(chr, [*range(1, 9), *range(14, 27), *range(65, 91)])) + "'"


def sql_matches(entities: list[Entity], sounds: list[tuple] = (), auto: bool = False) -> str:
    """CTEs up to ``chosen``: matches by brute force over all windows of all runs. Letters
    beyond ASCII are recoded to single bytes, as DuckDB's distance counts bytes."""
    most = max((k for _, _, k in sounds), default=0) + 1
    tables = [{c: s for k in range(r + 1) for c, s, x in sounds if x == k} for r in range(most)]
    coded = lambda x: f"translate({x}, odd, left({_CODES}, length(odd)))"
    ways = ", ".join(coded(f"translate(s, '{''.join(t)}', '{''.join(t.values())}')") for t in tables)
    of = {c: [s for x, s, _ in sounds if x == c] for c, _, _ in sounds}
    rows = []
    for e in entities:
        for number, surface in enumerate(e.surfaces):
            plain = units(surface)[0]
            readings = ", ".join(f"'{''.join(r)}'" for r in product(*(of.get(c, [c]) for c in plain)))
            rows.append(f"({e.entity_id}, '{e.canonical_text}', '{e.entity_type}', '{e.normalization_policy}', {e.priority}, {number}, '{surface}', '{plain}', [{readings}])")
    similar = lambda a, b: f"1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b}))"
    bigrams = lambda x: f"list_transform(range(1, length({x})), lambda k: substr({x}, k, 2))"
    decision, reasons = "'HINT_ONLY'", "''"
    if auto:
        checks = {
            "entity_too_short": "n = 1 OR (su = b AND n < 4)", "preserve_policy": "policy <> 'normalize'", "entity_type_not_auto": "kind NOT IN ('TERM', 'PROJECT', 'MODEL')",
            "high_risk_entity_type": "kind IN ('PERSON', 'ORG')", "pinyin_score_below_threshold": "sound < 0.88", "candidate_margin_too_small": "margin < 0.12",
        }
        failed = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{name}' END" for name, c in checks.items()) + ")"
        decision, reasons = f"CASE WHEN {failed} = '' THEN 'AUTO_NORMALIZE' ELSE 'HINT_ONLY' END", f"CASE WHEN {failed} = '' THEN 'score_pass,margin_pass,final_event' ELSE {failed} END"
    return rf"""WITH RECURSIVE ch AS (
  SELECT doc_id, unnest(range(length(text))) AS place, unnest(string_split(text, '')) AS c FROM documents WHERE text <> ''
), un AS (
  SELECT doc_id, place, unnest(CASE WHEN c IN ('。', '！', '？', '!', '?', chr(10), chr(13)) THEN [chr(10)] WHEN c = 'ß' THEN ['s', 's'] WHEN regexp_matches(c, '[\p{{P}}\p{{Z}}]') THEN [] ELSE [lower(c)] END) AS u FROM ch
), nr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS i FROM un),
rn AS (SELECT *, sum((u = chr(10))::INT) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM nr),
codes AS (SELECT string_agg(DISTINCT u, '' ORDER BY u) AS odd FROM (SELECT u FROM un UNION SELECT unnest(string_split('éèêçàùüöäß', ''))) WHERE unicode(u) > 127),
rs AS (SELECT doc_id, r, string_agg(u, '' ORDER BY i) AS s, list(place ORDER BY i) AS places FROM rn WHERE u <> chr(10) GROUP BY ALL),
runs AS MATERIALIZED (SELECT doc_id, r, {coded("s")} AS c, places, [{ways}] AS said FROM rs, codes),
su AS MATERIALIZED (
  SELECT eid, canonical, kind, policy, prio, number, surface, su, list_transform(readings, lambda x: {coded("x")}) AS heard, {coded("su")} AS b, length(su) AS n, greatest(1, least(2, length(su) // 4)) AS slack
  FROM (VALUES {", ".join(rows)}) v(eid, canonical, kind, policy, prio, number, surface, su, readings), codes
), said AS (SELECT DISTINCT doc_id, r, unnest(said) AS h FROM runs),
lengths AS (SELECT DISTINCT h AS heard, n, m FROM su, unnest(heard) t(h), unnest(range(greatest(2, n - slack), n + slack + 1)) v(m)),
near AS (
  SELECT DISTINCT doc_id, r, p, m FROM (SELECT doc_id, r, h, unnest(range(1, length(h))) AS p FROM said) w, lengths
  WHERE p + m <= length(h) + 1 AND 4 * levenshtein(substr(h, p, m), heard) <= greatest(m, n)
), wi AS (SELECT doc_id, r, p, m, places[p] AS a, places[p + m - 1] + 1 AS z FROM near JOIN runs USING (doc_id, r)),
-- a letter of two units starts two windows of one span
wide AS (
  SELECT DISTINCT w.doc_id, w.r, q AS p, e - q + 1 AS m, a, z FROM wi w JOIN runs USING (doc_id, r), unnest(range(greatest(1, p - 1), p + 2)) t(q), unnest(range(p + m - 2, p + m + 1)) v(e)
  WHERE e <= length(c) AND e > q AND places[q] = a AND places[e] + 1 = z
), full_rows AS (
  SELECT w.*, substr(c, w.p, w.m) AS x, list_transform(said, lambda h: substr(h, w.p, w.m)) AS xs, su.*, substr(d.text, a + 1, z - a) AS seen
  FROM wide w JOIN runs USING (doc_id, r) JOIN documents d USING (doc_id), su WHERE abs(w.m - n) <= slack
), al AS (
  SELECT *, list_max(list_transform(xs, lambda x1: list_max(list_transform(heard, lambda h: {similar("x1", "h")})))) AS sound, {similar("x", "b")} AS written
  FROM full_rows WHERE lower(seen) <> lower(surface) AND (list_has_any({bigrams("b")}, {bigrams("x")})
    OR list_has_any(flatten(list_transform(heard, lambda h: {bigrams("h")})), flatten(list_transform(xs, lambda x1: {bigrams("x1")}))))
), fi AS (
  SELECT *, 0.55::DOUBLE * sound + 0.25::DOUBLE * written + 0.10::DOUBLE * (1 - abs(m - n)::DOUBLE / greatest(m, n)) + 0.08::DOUBLE * 1.0 + 0.02::DOUBLE * (least(20, greatest(0, prio)) / 20.0::DOUBLE) AS final FROM al
), en AS (SELECT * FROM fi QUALIFY row_number() OVER (PARTITION BY doc_id, a, z, eid ORDER BY final DESC, number) = 1),
rk AS (SELECT *, row_number() OVER w AS k, lead(final) OVER w AS second FROM en WINDOW w AS (PARTITION BY doc_id, a, z ORDER BY final DESC, prio DESC, eid)),
ma AS (SELECT *, coalesce(final - second, 1.0) AS margin FROM rk WHERE k = 1 AND final >= 0.8),
de AS (SELECT *, {decision} AS decision, {reasons} AS reasons FROM ma),
tp AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY decision, final DESC, z - a DESC, prio DESC, eid, a) AS k2 FROM de QUALIFY k2 <= 20),
li AS (SELECT doc_id, list({{'a': a, 'z': z}} ORDER BY k2) AS l FROM tp GROUP BY doc_id),
gr AS (
  SELECT doc_id, l, 0 AS n, []::INT[] AS kept FROM li
  UNION ALL SELECT doc_id, l, n + 1, CASE WHEN len(list_filter(kept, lambda k: l[k].a < l[n + 1].z AND l[n + 1].a < l[k].z)) > 0 THEN kept ELSE list_append(kept, n + 1) END FROM gr WHERE n < len(l)
), chosen AS (SELECT tp.* FROM tp JOIN gr ON gr.doc_id = tp.doc_id AND gr.n = len(gr.l) AND list_contains(kept, k2))
"""


SQL_MATCH_ROWS = "SELECT doc_id, a::INT AS start, z::INT AS \"end\", seen AS observed, canonical, round(final, 9) AS final_score, round(margin, 9) AS margin, decision FROM chosen"


def _matches(spark, sf_dir, entities, sounds=None, **how):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    known = spark.createDataFrame(sounds, "character string, sound string, rank int") if sounds else None
    return fuzzy_matches(docs, dictionary_view(spark, entities), sounds=known, **how).withColumnRenamed("id", "doc_id")


def _match_rows(found):
    return found.select("doc_id", "start", "end", "observed", "canonical", F.round("final_score", 9).alias("final_score"), F.round("margin", 9).alias("margin"), "decision")


@query("j09_fuzzy_matches", sql_matches(DICTIONARY) + SQL_MATCH_ROWS)
def j09(spark, sf_dir):
    """Fuzzy matches of the dictionary in the documents."""
    return _match_rows(_matches(spark, sf_dir, DICTIONARY, mode="hint"))


@query("e13_homophones", sql_matches(HOMOPHONES, SOUNDS) + SQL_MATCH_ROWS)
def e13(spark, sf_dir):
    """Matches by sound: letters of the table count as their sounds."""
    return _match_rows(_matches(spark, sf_dir, HOMOPHONES, SOUNDS, mode="hint", allow_auto=True))


@query("e17_e18_decisions", sql_matches(DICTIONARY, auto=True) + "SELECT doc_id, a::INT AS start, canonical, surface AS matched_surface, decision, reasons, round(second, 9) AS runner_up FROM chosen")
def e18(spark, sf_dir):
    """What is decided of each match, and why, with automatic normalisation allowed."""
    found = _matches(spark, sf_dir, DICTIONARY, mode="auto", allow_auto=True)
    return found.select("doc_id", "start", "canonical", "matched_surface", "decision", F.array_join("reasons", ",").alias("reasons"), F.round("runner_up_score", 9).alias("runner_up"))


GUARD = [
    ("normal text here, nothing wrong", "normal text here, nothing wrong", ""), ("some raw text", " ", "empty_refiner_output"),
    ("x" * 30, "short", "severe_content_loss"), ("一句话说完了。", "这是重复的一句话。" * 4, "repeated_sentence,repeated_phrase"),
    ("a" * 119 + "。", "a" * 90, "truncated_refiner_output"), ("abcdefghijklmnop", "abcdefgh", ""), ("abcdefghijklmnop", "zz", "severe_content_loss"),
]


@query("x04_guard", sql_expected([g[2] for g in GUARD]))
def x04(spark, sf_dir):
    rows = literal(spark, sf_dir, [g[0] for g in GUARD]).withColumn("y", F.get(F.array(*[F.lit(g[1]) for g in GUARD]), F.col("k")))
    return rows.select("doc_id", F.array_join(ck.guard_column(F.col("x"), F.col("y")), ",").alias("result"))


CJK = [("鬼 灵 门", "鬼灵门"), ("你好 ， 世界", "你好，世界"), ("hi 鬼", "hi 鬼"), ("wait , what ?", "wait, what?"), ("A 计划 。 B", "A 计划。 B"), (None, None)]


@query("x05_normalize_cjk", sql_expected([r for _, r in CJK]))
def x05(spark, sf_dir):
    return literal(spark, sf_dir, [x for x, _ in CJK]).select("doc_id", tx.normalize_cjk(F.col("x")).alias("result"))


@query("x01_chunks", rf"""
WITH RECURSIVE t AS (SELECT doc_id, {sql_strip('text')} AS t FROM documents WHERE text IS NOT NULL),
c(doc_id, k, b, chunk) AS (
  SELECT doc_id, 0, 0, NULL::VARCHAR FROM t
  UNION ALL
  SELECT doc_id, k + 1, b + n, substr(w, 1, n) FROM (
    SELECT doc_id, k, b, w, CASE WHEN sentence <> '' AND length(sentence) <= 80 THEN length(sentence)
      WHEN length(w) <= 80 THEN length(w) WHEN soft <> '' THEN length(soft) ELSE 80 END AS n
    FROM (
      SELECT doc_id, k, b, w, regexp_extract(w, '^[^{tx.SENTENCE_END}]*[{tx.SENTENCE_END}]{SQL_SPACE}*') AS sentence,
        regexp_extract(substr(w, 1, 80), '^(?s:.*)[{tx.SOFT_BREAK}]{SQL_SPACE}*') AS soft
      FROM (SELECT c.doc_id, k, b, substr(t, b + 1, 81) AS w FROM c JOIN t USING (doc_id) WHERE b < length(t))
    )
  )
), p AS (SELECT doc_id, k, {sql_strip('chunk')} AS chunk FROM c WHERE k > 0)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS index, length(chunk)::INT AS chars, md5(chunk) AS chunk_md5
FROM p WHERE chunk <> ''
""")
def x01(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(ck.chunks_column(F.col("text"))).alias("index", "chunk"))
    return docs.select("doc_id", "index", F.length("chunk").alias("chars"), F.md5("chunk").alias("chunk_md5"))


@query("x03_windows", f"SELECT doc_id, md5({sql_strip('text')}) AS joined_md5, true AS bounded FROM documents")
def x03(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", ck.windows_column(F.col("text")).alias("w"))
    return w.select("doc_id", F.md5(F.array_join("w", "")).alias("joined_md5"), F.forall("w", lambda x: F.length(x) <= 80).alias("bounded"))


RETRIES = [("placeholder_count:__ENTITY_000__:0", True), ("severe_content_loss", True), ("repeated_phrase", False), ("entity_sentence_boundary_lost", True), ("", False)]


@query("e24_retryable", sql_expected([r for _, r in RETRIES], "BOOLEAN"))
def e24(spark, sf_dir):
    reasons = F.array("x")
    again = F.exists(reasons, lambda r: r.isin(*sg.RETRYABLE) | F.exists(F.array(*map(F.lit, sg.PLACEHOLDER_FAILURES)), lambda p: F.startswith(r, p)))
    return literal(spark, sf_dir, [x for x, _ in RETRIES]).select("doc_id", again.alias("result"))


# --- ordered windows ---------------------------------------------------------------------


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session"), F.col("turn").alias("pos"), "text", "role", (F.length("text") / 20.0).alias("seconds")
    )


def sql_glue(a: str, b: str) -> str:
    return f"CASE WHEN coalesce({a}, '') = '' THEN coalesce({b}, '') WHEN coalesce({b}, '') = '' THEN {a} WHEN unicode(right({a}, 1)) < 128 AND unicode(left({b}, 1)) < 128 THEN {a} || ' ' || {b} ELSE {a} || {b} END"


@query("w01_sliding_refinement", f"""WITH t AS (SELECT conv_id AS session, turn AS pos, {sql_strip('text')} AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
l AS (SELECT *, lag(c) OVER w AS b, lag(c, 2) OVER w AS a FROM t WINDOW w AS (PARTITION BY session ORDER BY pos)),
g AS (SELECT *, {sql_glue('a', 'b')} AS ab FROM l) SELECT session, pos, md5({sql_glue('ab', 'c')}) AS active_md5, greatest(k - 3, 0)::INT AS committed FROM g""")
def w01(spark, sf_dir):
    out = wn.sliding_refinement(turns(spark, sf_dir))
    return out.select("session", "pos", F.md5("active").alias("active_md5"), "committed")


@query("w02_join_chunks", f"""WITH t AS (SELECT conv_id AS session, turn AS pos, {sql_strip('text')} AS c FROM conversations), n AS (SELECT *, lag(c) OVER (PARTITION BY session ORDER BY pos) AS b FROM t WHERE c <> '')
SELECT session, md5(string_agg(CASE WHEN b IS NOT NULL AND unicode(right(b, 1)) < 128 AND unicode(left(c, 1)) < 128 THEN ' ' || c ELSE c END, '' ORDER BY pos)) AS joined_md5 FROM n GROUP BY session""")
def w02(spark, sf_dir):
    listed = turns(spark, sf_dir).groupBy("session").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("c"))
    return listed.select("session", F.md5(tx.join_chunks(F.col("c"))).alias("joined_md5"))


def scores(spark, sf_dir):
    best = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.round(F.max("value"), 6).alias("score"))
    return best.select(F.col("user_id").alias("span"), F.col("event_type").alias("entity_id"), "score", F.lit(0).alias("priority"))


@query("w05_margin", """WITH s AS (SELECT user_id AS span, event_type AS entity_id, round(max(value), 6) AS score FROM events GROUP BY ALL)
SELECT span, entity_id, score, round(coalesce(score - nxt, 1.0), 6) AS margin FROM (SELECT *, lead(score) OVER w AS nxt, row_number() OVER w AS k FROM s WINDOW w AS (PARTITION BY span ORDER BY score DESC, entity_id)) WHERE k = 1""")
def w05(spark, sf_dir):
    return wn.ranked_margin(scores(spark, sf_dir)).select("span", "entity_id", "score", F.round("margin", 6).alias("margin"))


@query("t12_top_per_span", """SELECT span, entity_id, score FROM (SELECT user_id AS span, event_type AS entity_id, round(max(value), 6) AS score FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY span ORDER BY score DESC, entity_id) <= 3""")
def t12(spark, sf_dir):
    return wn.top_per_group(scores(spark, sf_dir), "span", [F.desc("score"), F.asc("entity_id")], 3).select("span", "entity_id", "score")


SQL_ORDERED = "o AS (SELECT conv_id AS session, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, text, length(text) / 20.0::DOUBLE AS seconds FROM conversations)"


@query("w06_rotations", f"""WITH RECURSIVE {SQL_ORDERED}, f AS (SELECT session, 0::BIGINT AS k, 0.0::DOUBLE AS held, 0 AS n FROM (SELECT DISTINCT session FROM o)
  UNION ALL SELECT o.session, o.k, CASE WHEN c THEN 0.0 ELSE total END, n + c::INT FROM (SELECT f.session, o.k, f.n, f.held + o.seconds AS total, (f.held + o.seconds >= 45 OR (f.held + o.seconds >= 30 AND regexp_matches(o.text, '[.!?。！？]["''”’》〉』】）)]*$'))) AS c FROM f JOIN o ON o.session = f.session AND o.k = f.k + 1) o)
SELECT session, max(n)::INT AS rotations FROM f GROUP BY session""")
def w06(spark, sf_dir):
    return wn.rotations(turns(spark, sf_dir))


@query("g12_rolling_triggers", f"""WITH RECURSIVE {SQL_ORDERED}, f AS (SELECT session, 0::BIGINT AS k, 0.0::DOUBLE AS fresh, 0 AS n FROM (SELECT DISTINCT session FROM o)
  UNION ALL SELECT f.session, o.k, CASE WHEN f.fresh + o.seconds >= 6 THEN 0.0 ELSE f.fresh + o.seconds END, f.n + (f.fresh + o.seconds >= 6)::INT FROM f JOIN o ON o.session = f.session AND o.k = f.k + 1)
SELECT session, max(n + CASE WHEN fresh > 0 THEN 1 ELSE 0 END) FILTER (WHERE k = last)::INT AS triggers FROM (SELECT *, max(k) OVER (PARTITION BY session) AS last FROM f) GROUP BY session""")
def g12(spark, sf_dir):
    return wn.rolling_triggers(turns(spark, sf_dir), 6.0)


@query("g01_energy_segments", """WITH RECURSIVE o AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, value > 50 AS loud FROM events),
f AS (SELECT session, 0::BIGINT AS k, 0 AS speech, 0 AS silence, false AS active, 0 AS n FROM (SELECT DISTINCT session FROM o)
  UNION ALL SELECT session, k, speech, silence, was AND NOT off OR starts, n + off::INT FROM (SELECT f.session, o.k, CASE WHEN loud THEN f.speech + 1 ELSE 0 END AS speech, CASE WHEN loud THEN 0 ELSE f.silence + 1 END AS silence,
    f.active AS was, loud AS starts, f.active AND NOT loud AND f.silence + 1 >= 2 AS off, f.n FROM f JOIN o ON o.session = f.session AND o.k = f.k + 1))
SELECT session, max(n)::INT AS utterances FROM f GROUP BY session""")
def g01(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("pos"), F.col("value").alias("rms"), F.lit(0.25).alias("seconds"))
    return wn.energy_segments(e, threshold=50.0)


@query("w07_changed_text", "SELECT session, pos, text FROM (SELECT user_id AS session, event_id AS pos, event_type AS text, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE text IS DISTINCT FROM b")
def w07(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("pos"), F.col("event_type").alias("text"))
    return wn.changed_text(e)


@query("w08_resume_offset", "SELECT session, pos FROM (SELECT conv_id AS session, turn AS pos, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k > 2")
def w08(spark, sf_dir):
    return wn.after_offset(turns(spark, sf_dir), F.lit(2)).select("session", "pos")


@query("g13_latest_only", "SELECT user_id AS session, event_type, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type")
def g13(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.struct("user_id", "event_type").alias("session"), F.struct("ts", "event_id").alias("pos"), "event_id")
    return wn.latest_only(e).select(F.col("session.user_id").alias("session"), "session.event_type", "event_id")


@query("j11_outside_blocked", "WITH s AS (SELECT conv_id, turn, turn * 10 AS a, turn * 10 + length(text) % 25 AS b FROM conversations), k AS (SELECT * FROM s WHERE turn % 3 = 0) SELECT conv_id, turn FROM s WHERE turn % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM k WHERE k.conv_id = s.conv_id AND s.a < k.b AND k.a < s.b)")
def j11(spark, sf_dir):
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") * 10).alias("start"), (F.col("turn") * 10 + F.length("text") % 25).alias("end"))
    return wn.outside_blocked(s.where("turn % 3 <> 0"), s.where("turn % 3 = 0"), "conv_id").select("conv_id", "turn")


@query("j12_shared_prefix", "SELECT conv_id, coalesce(min(k) FILTER (WHERE role <> CASE WHEN k % 2 = 1 THEN 'user' ELSE 'assistant' END) - 1, max(k))::INT AS shared FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) GROUP BY conv_id")
def j12(spark, sf_dir):
    listed = turns(spark, sf_dir).groupBy("session").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "role"))), lambda x: x["role"]).alias("r"))
    plan = F.transform(F.sequence(F.lit(1), F.size("r")), lambda k: F.when(k % 2 == 1, "user").otherwise("assistant"))
    return listed.select(F.col("session").alias("conv_id"), wn.shared_prefix(F.col("r"), plan).alias("shared"))


@query("t13_greedy_spans", """
WITH RECURSIVE s AS (
  SELECT conv_id, list_sort(list({'rank': -length(text), 's': turn * 10, 'e': turn * 10 + length(text) % 25})) AS l FROM conversations GROUP BY conv_id
), r AS (
  SELECT conv_id, l, 0 AS k, []::STRUCT(s BIGINT, e BIGINT)[] AS kept FROM s
  UNION ALL
  SELECT conv_id, l, k + 1, CASE WHEN len(list_filter(kept, lambda x: x.s < l[k + 1].e AND l[k + 1].s < x.e)) > 0 THEN kept
    ELSE list_append(kept, {'s': l[k + 1].s, 'e': l[k + 1].e}) END
  FROM r WHERE k < len(l)
)
SELECT conv_id, len(l)::INT AS spans, len(kept)::INT AS kept FROM r WHERE k = len(l)
""")
def t13(spark, sf_dir):
    s = F.struct((-F.length("text")).alias("rank"), (F.col("turn") * 10).cast("int").alias("start"), (F.col("turn") * 10 + F.length("text") % 25).cast("int").alias("end"))
    ranked = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(s)).alias("s"))
    return ranked.select("conv_id", F.size("s").alias("spans"), F.size(wn.greedy_spans(F.col("s"))).alias("kept"))


@query("p20_reply_shape", sql_expected(["a b c d", "a b c d", None, "text", None]))
def p20(spark, sf_dir):
    """First text of a model's reply: a list's first item, what a wrapper holds, or the
    object itself; texts of fewer than 4 characters are none."""
    replies = ['["a b c d", "e"]', '{"data": [{"text": "a b c d"}]}', '["a"]', '{"text": "text"}', "broken"]
    v = F.try_parse_json("x")
    at = lambda p: F.try_variant_get(v, F.lit(p), "string")
    wrappers = ("data", "results", "sentences", "items", "instructions")
    found = F.coalesce(at("$[0].text"), at("$[0]"), *[at(f"$.{w}[0].text") for w in wrappers], *[at(f"$.{w}[0]") for w in wrappers], at("$.text"))
    return literal(spark, sf_dir, replies).select("doc_id", F.when(F.length(found) >= 4, found).alias("result"))

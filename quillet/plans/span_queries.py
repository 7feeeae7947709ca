"""Queries of rule spans, masking, restoring and auditing over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillet.operators import refinement as rf, segments as sg, spans as sp
from quillet.operators.masking import Entity
from quillet.plans.base import SQL_SPACE, sql_strip, table
from quillet.plans.text_queries import DICTIONARY, dictionary_view
from quillet.registry import query

# (rule, priority, pattern at the start of what follows, what may not come before, what may not come after)
_SQL_RULES = [
    ("URL", 900, r"(?i:https?)://[^，。！？；]+", "", ""),
    ("EMAIL", 890, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", None, r"\p{L}\p{N}_"),
    ("DATE", 880, r"(?:\p{Nd}{4}[./-]\p{Nd}{1,2}[./-]\p{Nd}{1,2}|(?:\p{Nd}{4}年)?\p{Nd}{1,2}月\p{Nd}{1,2}日?)", r"\p{Nd}", r"\p{Nd}"),
    ("TIME", 870, r"(?:[01]?\p{Nd}|2[0-3])[:：][0-5]\p{Nd}(?:[:：][0-5]\p{Nd})?", r"\p{Nd}", r"\p{Nd}"),
    ("NUMBER", 700, r"[+-]?\p{Nd}+(?:\.\p{Nd}+)?(?:%|％)?", "A-Za-z0-9_.", "A-Za-z0-9_."),
    ("IDENTIFIER", 650, r"[A-Za-z][A-Za-z0-9]*(?:[-_.][A-Za-z0-9]+)+", "A-Za-z0-9", "A-Za-z0-9"),
    ("ACRONYM", 640, r"[A-Z][A-Z0-9]{1,}", "A-Za-z0-9", "A-Za-z0-9"),
]


def _sql_rule(kind: str, priority: int, pattern: str, before: str | None, after: str) -> str:
    end = f"(?:[^{after}]|$)" if after else ""
    if before is None:  # a word end: letters and digits on one side only
        clear = r"(b <> '' AND regexp_matches(b, '[\p{L}\p{N}_]')) <> regexp_matches(w, '^[\p{L}\p{N}_]')"
    else:
        clear = f"NOT (b <> '' AND regexp_matches(b, '[{before}]'))" if before else "true"
    return f"SELECT doc_id, k, pos, '{kind}' AS kind, {priority} AS prio, i, regexp_extract(w, '^({pattern}){end}', 1) AS m FROM w WHERE {clear}"


#: No rule reaches over white space, so each token is tried at each of its places; of one
#: rule's matches in a token those from the left are taken.
SQL_RULE_SPANS = rf"""tl AS (SELECT doc_id, regexp_extract_all(text, '{SQL_SPACE}+|{SQL_SPACE.replace("[", "[^", 1)}+') AS l FROM documents),
tk AS (SELECT doc_id, unnest(range(len(l))) AS k, unnest(l) AS t FROM tl),
ps AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS pos FROM tk),
ca AS (SELECT * FROM ps WHERE regexp_matches(t, '\p{{Nd}}|@|://|[A-Z][A-Z]|[A-Za-z0-9][-_.][A-Za-z0-9]')),
w AS (SELECT doc_id, k, pos, i, substr(t, i, length(t)) AS w, CASE WHEN i > 1 THEN substr(t, i - 1, 1) ELSE '' END AS b FROM ca, unnest(range(1, length(t) + 1)) u(i)),
al AS ({" UNION ALL ".join(_sql_rule(*r) for r in _SQL_RULES)}),
mt AS (SELECT * FROM al WHERE m <> ''),
nx AS (SELECT a.*, (SELECT min(b.i) FROM mt b WHERE b.doc_id = a.doc_id AND b.k = a.k AND b.kind = a.kind AND b.i >= a.i + length(a.m)) AS follower FROM mt a),
tn AS (
  SELECT * FROM nx QUALIFY row_number() OVER (PARTITION BY doc_id, k, kind ORDER BY i) = 1
  UNION ALL SELECT nx.* FROM tn JOIN nx ON nx.doc_id = tn.doc_id AND nx.k = tn.k AND nx.kind = tn.kind AND nx.i = tn.follower
), rule_spans AS (SELECT doc_id, kind, prio, (pos + i - 1)::INT AS a, (pos + i - 1 + length(m))::INT AS z, m AS original FROM tn)"""


@query("e06_rule_spans", f'WITH RECURSIVE {SQL_RULE_SPANS} SELECT doc_id, kind AS entity_type, a AS start, z AS "end", original FROM rule_spans')
def e06(spark, sf_dir):
    """All matches of the seven rules with their places."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return sp.rule_spans(texts).select(F.col("id").alias("doc_id"), "entity_type", "start", "end", "original")


def sql_spans(entities: list[Entity]) -> str:
    """CTEs up to ``kept`` (the chosen spans in order), ``masked`` and ``base`` (the text
    with all replacements)."""
    rows = []
    for e in entities:
        for s in e.surfaces:
            t, u = ("lower(text)", s.lower()) if s.isascii() else ("text", s)
            rows.append(f"SELECT doc_id, '{e.canonical_text}' AS canonical, '{e.entity_type}' AS kind, '{e.normalization_policy}' AS policy, {1000 + e.priority} AS prio, {e.entity_id} AS eid, {len(u)} AS n, string_split({t}, '{u}') AS parts FROM documents")
    return rf"""{SQL_RULE_SPANS},
sf AS ({" UNION ALL ".join(rows)}),
pt AS (SELECT * EXCLUDE (parts), unnest(parts) AS part, unnest(range(len(parts))) AS j, len(parts) AS total FROM sf),
oc AS (SELECT *, (sum(length(part)) OVER (PARTITION BY doc_id, eid, n, total, canonical ORDER BY j) + j * n)::INT AS a FROM (SELECT DISTINCT * FROM pt)),
di AS (SELECT o.doc_id, o.kind, o.prio, o.a, o.a + o.n AS z, substr(d.text, o.a + 1, o.n) AS original, policy, canonical, eid FROM oc o JOIN documents d USING (doc_id) WHERE j < total - 1),
ev AS (
  SELECT doc_id, kind, prio, a, z, original, CASE WHEN policy = 'normalize' THEN canonical ELSE original END AS replacement, 'database' AS source, eid FROM di
  UNION ALL SELECT doc_id, kind, prio, a, z, original, original, 'rule', -1 FROM rule_spans
), i1 AS (SELECT *, coalesce(a >= max(z) OVER (PARTITION BY doc_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM ev),
i2 AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS island FROM i1),
i3 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY prio DESC, z - a DESC, a, eid) AS rk FROM i2),
il AS (SELECT doc_id, island, list({{'a': a, 'z': z}} ORDER BY rk) AS l FROM i3 GROUP BY ALL),
gr AS (
  SELECT doc_id, island, l, 0 AS n, []::INT[] AS kept FROM il
  UNION ALL SELECT doc_id, island, l, n + 1, CASE WHEN len(list_filter(kept, lambda q: l[q].a < l[n + 1].z AND l[n + 1].a < l[q].z)) > 0 THEN kept ELSE list_append(kept, n + 1) END FROM gr WHERE n < len(l)
), kept AS (
  SELECT i3.*, row_number() OVER (PARTITION BY i3.doc_id ORDER BY a) - 1 AS no, coalesce(lag(z) OVER (PARTITION BY i3.doc_id ORDER BY a), 0) AS since
  FROM i3 JOIN gr ON gr.doc_id = i3.doc_id AND gr.island = i3.island AND gr.n = len(gr.l) AND list_contains(gr.kept, rk)
), bt AS (
  SELECT doc_id, string_agg(substr(text, since + 1, a - since) || printf('__ENTITY_%03d__', no), '' ORDER BY a) AS m, string_agg(substr(text, since + 1, a - since) || replacement, '' ORDER BY a) AS r, max(z) AS last, count(*) AS n
  FROM kept JOIN documents USING (doc_id) GROUP BY doc_id
), masked AS (
  SELECT doc_id, text, coalesce(m || substr(text, last + 1, length(text)), text) AS masked, coalesce(r || substr(text, last + 1, length(text)), text) AS base, coalesce(n, 0) AS n FROM documents LEFT JOIN bt USING (doc_id)
)"""


def protected(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return sp.protect(texts, dictionary_view(spark, DICTIONARY))


@query("e07_protect", f"WITH RECURSIVE {sql_spans(DICTIONARY)} SELECT doc_id, md5(masked) AS masked_md5, n::INT AS spans, len(regexp_extract_all(masked, '__ENTITY_[0-9]{{3}}__'))::INT AS markers FROM masked")
def e07(spark, sf_dir):
    """Texts with their best non-overlapping spans masked."""
    marks = F.regexp_extract_all("masked_text", F.lit("__ENTITY_[0-9]{3}__"), F.lit(0))
    return protected(spark, sf_dir).select(F.col("id").alias("doc_id"), F.md5("masked_text").alias("masked_md5"), F.size("spans").alias("spans"), F.size(marks).alias("markers"))


@query("t14_non_overlapping", f'WITH RECURSIVE {sql_spans(DICTIONARY)} SELECT doc_id, a AS start, z AS "end", kind AS entity_type, original, replacement, printf(\'__ENTITY_%03d__\', no) AS placeholder FROM kept')
def t14(spark, sf_dir):
    """The spans that are chosen of all overlapping ones."""
    return protected(spark, sf_dir).select(F.col("id").alias("doc_id"), F.inline("spans")).select("doc_id", "start", "end", "entity_type", "original", "replacement", "placeholder")


# By doc_id: marks as they were, without underscores, the second one lost, the first one twice, an unknown one.
_CHANGES = [
    ("masked", lambda m: m), ("replace(masked, '__ENTITY_000__', 'ENTITY_000')", lambda m: F.replace(m, F.lit("__ENTITY_000__"), F.lit("ENTITY_000"))),
    ("replace(masked, '__ENTITY_001__', '')", lambda m: F.replace(m, F.lit("__ENTITY_001__"), F.lit(""))),
    ("masked || ' __ENTITY_000__'", lambda m: F.concat(m, F.lit(" __ENTITY_000__"))), ("masked || ' __ENTITY_99'", lambda m: F.concat(m, F.lit(" __ENTITY_99"))),
]


@query("e08_restore", rf"""WITH RECURSIVE {sql_spans(DICTIONARY)}, r AS (
  SELECT *, CASE WHEN {sql_strip("text")} = '' AND doc_id % 5 < 3 THEN 'empty_or_metadata_output'
    WHEN doc_id % 5 = 4 THEN 'malformed_placeholder' WHEN n = 0 THEN ''
    WHEN doc_id % 5 = 1 AND regexp_matches(masked, '[A-Za-z0-9_]__ENTITY_000__|__ENTITY_000__[A-Za-z0-9_]') THEN 'placeholder_count:__ENTITY_000__:0'
    WHEN doc_id % 5 = 2 AND n > 1 THEN 'placeholder_count:__ENTITY_001__:0' WHEN doc_id % 5 = 3 THEN 'placeholder_count:__ENTITY_000__:2' ELSE '' END AS reasons FROM masked WHERE text IS NOT NULL
) SELECT doc_id, reasons, md5(CASE WHEN reasons <> '' THEN text WHEN n = 0 AND doc_id % 5 = 3 THEN {sql_strip("text || ' __ENTITY_000__'")} ELSE {sql_strip("base")} END) AS text_md5 FROM r""")
def e08(spark, sf_dir):
    """Masked texts with their marks changed in five ways, restored or rejected."""
    p = protected(spark, sf_dir).where("text is not null")
    changed = F.get(F.array(*[change(F.col("masked_text")) for _, change in _CHANGES]), F.col("id") % len(_CHANGES))
    out = p.select(F.col("id").alias("doc_id"), sp.restored(changed, F.col("text"), F.col("masked_text"), F.col("spans")).alias("r"))
    return out.select("doc_id", F.array_join("r.reasons", ",").alias("reasons"), F.md5("r.text").alias("text_md5"))


@query("e09_e10_e11_audit", rf"""WITH RECURSIVE {sql_spans(DICTIONARY)}, rn AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS q FROM kept WHERE source = 'database' AND original <> replacement
), nt AS (
  SELECT doc_id, {sql_strip("text")} AS t, 0 AS q, 0 AS changes FROM documents
  UNION ALL SELECT nt.doc_id, replace(t, original, replacement), rn.q, changes + contains(t, original)::INT FROM nt JOIN rn ON rn.doc_id = nt.doc_id AND rn.q = nt.q + 1
), fin AS (SELECT doc_id, t, changes FROM nt QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY q DESC) = 1),
hi AS (SELECT doc_id, string_agg(replacement, ',' ORDER BY first) AS hints FROM (SELECT doc_id, replacement, min(a) AS first FROM rn GROUP BY ALL) GROUP BY doc_id),
au AS (SELECT doc_id, string_agg('missing_' || kind, ',' ORDER BY first) AS lost FROM (
  SELECT doc_id, kind, min(a) AS first FROM kept JOIN documents USING (doc_id) WHERE kept.source = 'database' AND NOT contains(lower(text), original) AND NOT contains(lower(text), replacement) GROUP BY ALL) GROUP BY doc_id)
SELECT d.doc_id, coalesce(hints, '') AS hints, CASE WHEN {sql_strip("d.text")} = '' THEN 'empty_refiner_output' ELSE coalesce(lost, '') END AS lost, md5(t) AS normalized_md5, changes
FROM documents d LEFT JOIN hi USING (doc_id) LEFT JOIN au USING (doc_id) LEFT JOIN fin USING (doc_id)""")
def e09(spark, sf_dir):
    """Hints of each text, what its lower-cased form has lost, and its aliases replaced."""
    p, spans = protected(spark, sf_dir), F.col("spans")
    out = p.select(
        F.col("id").alias("doc_id"), F.array_join(sp.hints(spans), ",").alias("hints"), F.array_join(sp.audit(F.lower("text"), spans), ",").alias("lost"),
        sp.normalized_aliases(F.col("text"), spans).alias("n"),
    )
    return out.select("doc_id", "hints", "lost", F.md5("n.text").alias("normalized_md5"), F.size("n.changes").alias("changes"))


@query("e22_e25_refine_with_dictionary", rf"""WITH RECURSIVE {sql_spans(DICTIONARY)}, cn AS (SELECT doc_id, count(*) AS changed FROM kept WHERE original <> replacement GROUP BY doc_id)
SELECT doc_id AS id, coalesce({sql_strip("text")}, '') <> '' AS accepted, coalesce(changed, 0)::INT AS normalizations, 0 AS audit_issues, md5(coalesce({sql_strip("base")}, '')) AS clean_md5 FROM masked LEFT JOIN cn USING (doc_id)""")
def e22(spark, sf_dir):
    """Whole texts masked by the dictionary, refined by the identity and restored."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    out = rf.refine_batch(rows, dictionary_view(spark, DICTIONARY), lambda: sg.identity, mode="off")
    return out.select("id", "accepted", F.size("normalizations").alias("normalizations"), F.size("audit_issues").alias("audit_issues"), F.md5("clean_text").alias("clean_md5"))

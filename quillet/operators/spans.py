"""Protected spans of texts as a relation, and masking, restoring and auditing as columns.

Rule matches and dictionary occurrences are rows (id, start, end, ...) made by built-in
functions: a rule's matches and the gaps between them give positions as running sums, and
dictionary surfaces meet the texts by a join on grams. Of overlapping spans the better one
is taken; a text's spans then become one array beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.functions.text import strip as stripped
from quillet.operators.masking import NUMBER, PLACEHOLDER, RULES
from quillet.operators.windows import greedy_spans
from quillet.sources.store import shared_table

BLOCK = 512
GRAM = 4
#: Dictionary rows up to which they are broadcast; beyond, Spark joins by shuffle.
BROADCAST_SURFACES = 200_000
#: First grams of surfaces up to which one pattern finds their places; beyond, all places are
#: met with the dictionary.
LISTED_GRAMS = 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZK", "abcdefghijklmnopqrstuvwxyzk"
FIELDS = ["start", "end", "original", "replacement", "entity_type", "source", "priority", "entity_id", "match_type", "match_score", "decision"]
#: What a text has to hold for a rule to match at all.
NEEDED = {"URL": "://", "EMAIL": "@"}
_MARK = PLACEHOLDER.pattern
_BARE = rf"E(?<![A-Za-z0-9_]E)NTITY_({NUMBER})(?![A-Za-z0-9_])"
_SPACE = r"[\s\x1c-\x1f]"
_BOUNDARY = r"[。！？!?；;\n]"


def _unicode(kind: str, pattern: str) -> str:
    """A rule's pattern with digits, spaces and word ends of all scripts."""
    return "(?U)" + _FIRST.get(kind, "") + pattern.replace(r"[^\s", r"[^\s\x1c-\x1f")


#: Where a token begins in which some rule may match: a digit, "@", "://", two capitals, or a joint before a
#: letter or digit. No rule reaches over white space. Each part is possessive: linear time.
#: The second condition keeps the halves of a character beyond the first plane together.
_TOKEN = r"(?U)(?<!\S)(?![\x{dc00}-\x{dfff}])(?=(?:[^\s\d@:A-Z_.\-]++|(?!\d|@|://|[A-Z][A-Z0-9]|[-_.][A-Za-z0-9])\S)*+\S)"
#: What each rule can begin with; most places of a text are passed by it.
_FIRST = {"DATE": r"(?=\d)", "TIME": r"(?=\d)", "NUMBER": r"(?=[+\-\d])", "IDENTIFIER": "(?=[A-Za-z])", "ACRONYM": "(?=[A-Z][A-Z0-9])"}


# --- rule spans --------------------------------------------------------------------------


def rule_spans(texts: DataFrame) -> DataFrame:
    """(id, start, end, original, entity_type, priority) of all rule matches in ``texts``
    (id, text), overlapping ones of different rules included.

    One pass finds the tokens in which a rule may match, and the rules run on these. What
    is shuffled is one row per token, and the rest of the work follows its text's tokens.
    Null and empty texts have none; repeated rows have theirs each.
    """
    rules = []
    for kind, pattern, priority in RULES:
        p = F.lit(_unicode(kind, pattern))
        gaps = F.transform(F.split("token", p, -1), F.length)
        some = F.struct(F.lit(kind).alias("entity_type"), F.lit(priority).alias("priority"), F.arrays_zip(F.regexp_extract_all("token", p, F.lit(0)).alias("original"), gaps.alias("gap")).alias("found"))
        rules.append(F.when(F.contains("token", F.lit(NEEDED[kind])), some) if kind in NEEDED else some)
    # the text is cut where such a token begins; what precedes the first one may be one too
    numbered = texts.where("text <> ''").select("id", "text", F.monotonically_increasing_id().alias("row"))
    cut = numbered.select("id", "row", F.posexplode(F.split("text", F.lit(_TOKEN), -1)).alias("nth", "piece"))
    pieces = cut.select("id", "row", "nth", F.length("piece").alias("size"), F.regexp_extract("piece", r"(?U)^\S*", 0).alias("token"))
    base = F.sum("size").over(Window.partitionBy("row").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1))
    tokens = pieces.withColumn("base", F.coalesce(base, F.lit(0))).where("token <> ''")
    ruled = tokens.select("id", "row", "nth", "base", F.explode(F.array(*rules)).alias("r"))
    matches = ruled.select("id", "row", "nth", "base", "r.entity_type", "r.priority", F.posexplode("r.found").alias("k", "f")).select("*", "f.original", "f.gap").where("original is not null")
    before = Window.partitionBy("row", "nth", "entity_type").orderBy("k")
    gaps = F.sum("gap").over(before.rowsBetween(Window.unboundedPreceding, 0))
    found = F.coalesce(F.sum(F.length("original")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = matches.withColumn("start", (F.col("base") + gaps + found).cast("int"))
    return placed.select("id", "start", (F.col("start") + F.length("original")).alias("end"), "original", "entity_type", "priority")


# --- dictionary occurrences --------------------------------------------------------------


def _any_case(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _any_of(grams: list[str]) -> str:
    """A pattern for any of the grams in any case, parted by their first characters."""
    ways = {low: low + up for up, low in zip(UPPER[:26], LOWER)} | {"k": "k" + UPPER[10] + UPPER[26]}
    code = lambda c: "".join(f"\\x{{{ord(x):x}}}" for x in ways.get(c, c))
    coded = lambda x: "".join(f"[{code(c)}]" for c in x)
    grams = sorted({_lowered(g) for g in grams})
    firsts = dict.fromkeys(g[0] for g in grams)
    if not firsts:
        return "(?!)"
    of = lambda c: "|".join(coded(g[1:]) for g in grams if g[0] == c)
    return f"(?=[{''.join(map(code, firsts))}])(?:" + "|".join(f"{coded(c)}(?:{of(c)})" for c in firsts) + ")"


def _lowered(gram: str) -> str:
    return gram.translate(str.maketrans(UPPER, LOWER))


def surface_spans(texts: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Non-overlapping occurrences of each surface: the columns of ``surfaces`` but
    ``surface``, with start, end, original.

    ``surfaces`` has ``surface`` and what belongs to it; with a column ``id`` a surface is
    looked for in that text only. ASCII surfaces match in any case. Occurrences of one
    surface are taken from the left; those of different surfaces may overlap. An id
    stands for one text.
    """
    own = [c for c in surfaces.columns if c != "surface"]
    ascii_only = F.octet_length("surface") == F.length("surface")
    keyed = surfaces.where("surface <> ''").select(*own, ascii_only.alias("folds"), F.when(ascii_only, _any_case(F.col("surface"))).otherwise(F.col("surface")).alias("key"))
    keyed = keyed.withColumn("gram", F.left("key", F.lit(GRAM)))
    keyed = shared_table(keyed, "surfaces")
    count, longest, lengths, cased = keyed.agg(F.count("*"), F.max(F.length("key")), F.collect_set(F.length("gram")), F.collect_set("folds")).first()
    if not count:
        texts = texts.where(F.lit(False))
    longest = longest or 0
    width = max(BLOCK, longest)

    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    listed = texts.where("text <> ''").select("id", pieces.alias("p"))
    following = F.concat(F.slice("p", F.lit(2), F.size("p")), F.array(F.lit("")))
    blocks = listed.select("id", F.posexplode(F.zip_with("p", following, lambda p, q: F.struct(F.length(p).alias("size"), F.concat(p, F.left(q, F.lit(longest))).alias("block")))).alias("k", "b"))
    blocks = blocks.select("id", (F.col("k") * width).alias("at"), "b.size", "b.block")
    cases, lengths = F.array(*map(F.lit, sorted(cased or [False]))), sorted(lengths or [1])
    seen = lambda c: F.when(F.col("folds"), _any_case(F.col(c))).otherwise(F.col(c))
    begins = [r["gram"] for r in keyed.select("gram").distinct().limit(LISTED_GRAMS + 1).collect()]
    if len(begins) <= LISTED_GRAMS:
        # blocks are cut where a gram begins, so the lengths of the pieces sum up to the places
        some = _any_of(begins)
        sized = blocks.withColumn("sizes", F.transform(F.split("block", F.lit(f"(?={some})"), -1), F.length))
        sized = sized.where((F.size("sizes") > 1) | F.rlike(F.left("block", F.lit(GRAM)), F.lit(f"^{some}")))
        places = F.aggregate("sizes", F.array(F.lit(0)), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)))
        near = sized.select("*", F.explode(places).alias("i")).where("i < size")
        near = near.select("id", "at", "i", F.substring("block", F.col("i") + 1, F.lit(longest)).alias("stretch"), F.explode(cases).alias("folds")).withColumn("seen", seen("stretch"))
        placed = near.select("*", F.explode(F.array_distinct(F.array(*[F.left("seen", F.lit(n)) for n in lengths]))).alias("gram"))
    else:
        blocks = blocks.select("*", F.explode(cases).alias("folds")).withColumn("seen", seen("block"))
        grams = [F.regexp_extract_all("seen", F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)) for n in lengths]
        placed = blocks.select("*", F.explode(F.array(*grams)).alias("g")).select("*", F.posexplode("g").alias("i", "gram")).drop("g").where("i < size")
        placed = placed.select("id", "at", "i", "folds", "gram", *[F.substring(c, F.col("i") + 1, F.lit(longest)).alias(name) for c, name in (("block", "stretch"), ("seen", "seen"))])
    on = ["folds", "gram", *(["id"] if "id" in own else [])]
    met = placed.join(F.broadcast(keyed) if count <= BROADCAST_SURFACES else keyed, on)
    hits = met.where(F.startswith("seen", "key")).select(
        *[met[c] for c in {"id": 0, **dict.fromkeys(own)}], "key", (F.col("at") + F.col("i")).alias("start"), (F.col("at") + F.col("i") + F.length("key")).alias("end"),
        F.left("stretch", F.length("key")).alias("original"),
    )
    # only a surface that begins as it ends can overlap itself
    bordered = F.exists(F.sequence(F.lit(1), F.length("key") - 1), lambda n: F.left("key", n) == F.right("key", n))
    selfish = F.when(F.length("key") > 1, bordered).otherwise(False)
    alone = hits.where(~selfish)
    taken = greedy(hits.where(selfish), [c for c in hits.columns if c not in ("start", "end", "original")], [])
    return alone.unionByName(taken).drop("key")


# --- greedy choice -----------------------------------------------------------------------


def greedy(spans: DataFrame, by: list[str], rank: list[str]) -> DataFrame:
    """Of the spans (start, end, ...) that share ``by``, each one in order of ``rank`` (all
    ascending, then start and end) is kept unless a kept one overlaps it.

    Spans are first parted into islands that don't touch each other; lone spans are kept
    as they are, and only the few of an island are compared. Rows keep their columns;
    equal ones count once. One shuffle by ``by`` serves all steps.
    """
    order = Window.partitionBy(*by).orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = spans.withColumn("_new", F.coalesce(F.col("start") >= reached, F.lit(True)).cast("int"))
    apart = apart.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    rest = [c for c in spans.columns if c not in by]
    first = list(dict.fromkeys([*rank, "start", "end"]))
    row = F.struct(*first, *[c for c in rest if c not in first])
    islands = apart.groupBy(*by, "_island").agg(F.sort_array(F.collect_list(row)).alias("_spans"))
    kept = F.when(F.size("_spans") == 1, F.col("_spans")).otherwise(greedy_spans(F.col("_spans")))
    return islands.select(*by, F.inline(kept)).select(*spans.columns)


# --- protect -----------------------------------------------------------------------------


def dictionary_spans(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Spans of the entity view ``dictionary``: canonical texts and aliases, literally."""
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    listed = dictionary.select("entity_id", "canonical_text", "entity_type", "domain", "normalization_policy", "priority", F.explode(F.array_distinct(F.concat(F.array("canonical_text"), aliases))).alias("surface"))
    found = surface_spans(texts, listed.where("surface is not null"))
    folded = lambda c: F.lower(F.upper(F.lower(c)))
    same = folded(F.col("original")) == folded(F.col("canonical_text"))
    return found.select(
        "id", "start", "end", "original", F.when(F.col("normalization_policy") == "normalize", F.col("canonical_text")).otherwise(F.col("original")).alias("replacement"), "entity_type",
        F.concat(F.lit("database:"), "domain").alias("source"), (F.col("priority") + 1000).alias("priority"), F.col("entity_id").cast("long").alias("entity_id"),
        F.when(same, "EXACT_CANONICAL").otherwise("EXACT_ALIAS").alias("match_type"), F.lit(1.0).alias("match_score"), F.lit("EXACT").alias("decision"),
    )


def protect(texts: DataFrame, dictionary: DataFrame | None = None, trusted: DataFrame | None = None, fuzzy: DataFrame | None = None) -> DataFrame:
    """``texts`` (id, text) with masked_text and spans, the protected spans in order.

    Spans are those of the enabled entities of the view ``dictionary``, of ``trusted``
    (id, canonical_text, aliases, entity_type, trust_level), the session entries of each
    text, automatic ones of ``fuzzy`` (id and the fields of a match) that touch no rule
    span and whose entity may be normalised, and the rules' own. Where they overlap, the
    higher priority wins, then the longer one, then the first.

    An id stands for one text: rows that repeat both count once. A null text has no
    spans and stays null.
    """
    return protect_unique(shared_table(texts.select("id", "text").distinct(), "texts"), dictionary, trusted, fuzzy)


def protect_unique(texts: DataFrame, dictionary: DataFrame | None = None, trusted: DataFrame | None = None, fuzzy: DataFrame | None = None) -> DataFrame:
    """``protect`` of stored ``texts`` (id, text) that hold each id once."""
    nothing = lambda kind: F.lit(None).cast(kind)
    rules = rule_spans(texts)
    ruled = rules.select(
        "id", "start", "end", "original", F.col("original").alias("replacement"), "entity_type", F.lit("rule").alias("source"), "priority",
        nothing("long").alias("entity_id"), F.lit("RULE").alias("match_type"), nothing("double").alias("match_score"), F.lit("EXACT").alias("decision"),
    )
    found = ruled
    if dictionary is not None:
        found = found.unionByName(dictionary_spans(texts, dictionary.where("enabled")))
    if trusted is not None:
        aliases = F.array_sort(F.coalesce("aliases", F.array().cast("array<string>")))
        listed = trusted.select("id", "entity_type", "trust_level", F.explode(F.array_distinct(F.concat(F.array("canonical_text"), aliases))).alias("surface"))
        met = surface_spans(texts, listed)
        found = found.unionByName(met.select(
            "id", "start", "end", "original", F.col("original").alias("replacement"), "entity_type", F.concat(F.lit("session:"), "trust_level").alias("source"), F.lit(950).alias("priority"),
            nothing("long").alias("entity_id"), F.lit("SESSION_EXACT").alias("match_type"), F.lit(1.0).alias("match_score"), F.lit("EXACT").alias("decision"),
        ))
    if fuzzy is not None and dictionary is not None:
        able = dictionary.where("enabled and normalization_policy = 'normalize'").select(F.col("entity_id").cast("long").alias("entity_id"), F.col("canonical_text").alias("canonical"))
        auto = fuzzy.where("decision = 'AUTO_NORMALIZE'").join(able, ["entity_id", "canonical"], "left_semi")
        r = rules.select(F.col("id").alias("_id"), F.col("start").alias("_start"), F.col("end").alias("_end"))
        auto = auto.join(r, (F.col("id") == F.col("_id")) & (F.col("start") < F.col("_end")) & (F.col("_start") < F.col("end")), "left_anti")
        found = found.unionByName(auto.select(
            "id", "start", "end", F.col("observed").alias("original"), F.col("canonical").alias("replacement"), "entity_type", F.concat(F.lit("fuzzy:"), "domain").alias("source"),
            (F.col("priority") + 980).alias("priority"), "entity_id", "match_type", F.col("final_score").alias("match_score"), "decision",
        ))
    ranked = found.withColumns({"_low": -F.col("priority"), "_short": F.col("start") - F.col("end")})
    # of equal spans that of the smaller entity stands first
    chosen = greedy(ranked.withColumn("_none", F.coalesce("entity_id", F.lit(-1).cast("long"))), ["id"], ["_low", "_short", "start", "_none"])
    listed = chosen.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(*FIELDS))).alias("_spans"))
    named = F.transform("_spans", lambda s, i: F.struct(F.format_string("__ENTITY_%03d__", i).alias("placeholder"), *[s[f].alias(f) for f in FIELDS if f != "priority"]))
    out = texts.join(listed.select("id", named.alias("spans")), "id", "left").withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{SPAN_ROW}>")))
    return out.select("id", "text", _masked(F.col("text"), F.col("spans")).alias("masked_text"), "spans")


SPAN_ROW = (
    "struct<placeholder:string,start:int,end:int,original:string,replacement:string,entity_type:string,"
    "source:string,entity_id:bigint,match_type:string,match_score:double,decision:string>"
)


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once: what is used within a function over an
    array would be worked out again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _masked(text: Column, spans: Column) -> Column:
    """The text with its spans replaced by their placeholders, in time linear in both."""

    def joined(v):
        since = lambda i: F.coalesce(F.get(v["ends"], i - 1), F.lit(0))
        parts = F.transform(spans, lambda s, i: F.concat(_cut(v["blocks"], since(i), s["start"]), s["placeholder"]))
        return F.concat(F.array_join(parts, ""), _cut(v["blocks"], F.element_at(v["ends"], -1), F.size(v["blocks"]) * BLOCK))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}+"), F.lit(0))
    given = F.struct(blocks.alias("blocks"), F.transform(spans, lambda s: s["end"]).alias("ends"))
    return F.when(F.size(spans) == 0, text).otherwise(let(given, joined))


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """Part of a text that is given in blocks; only the blocks it lies in are looked at."""
    first = F.floor(start / BLOCK).cast("int")
    held = F.array_join(F.slice(blocks, first + 1, F.greatest(F.ceil(end / BLOCK).cast("int") - first, F.lit(0))), "")
    return F.substring(held, start - first * BLOCK + 1, F.greatest(end - start, F.lit(0)))


# --- restore, audit, hints ---------------------------------------------------------------


def plain(refined: Column) -> Column:
    """What a refiner returned, without a key list at its end and without outer spaces."""
    return stripped(F.when(F.contains(refined, F.lit("<KEY>[")), F.regexp_replace(refined, rf"(?U){_SPACE}*<KEY>\[[^\]]*\]{_SPACE}*$", "")).otherwise(refined))


def restored(refined: Column, text: Column, masked: Column, spans: Column) -> Column:
    """Struct (text, reasons): the refined text with its spans back and no reasons, or the
    original text and why the refined one is rejected.

    Marks that lost their underscores are mended first, unless the source itself has such
    a word. Marks have to be the wanted ones, each once and in order, and a sentence end
    between two of them may not get lost.
    """
    none = F.array().cast("array<string>")
    listed = lambda name: F.array(F.lit(name))
    ended = lambda gap: F.rlike(gap, F.lit(_BOUNDARY))
    named = lambda **values: F.struct(*[v.alias(k) for k, v in values.items()])

    def of_marks(m):
        """What is wrong where the marks are not the wanted ones in order."""
        unknown = F.array_sort(F.array_except(m["marks"], m["wanted"]))
        times = F.transform(m["wanted"], lambda w: F.struct(w.alias("mark"), F.size(F.filter(m["marks"], lambda x: x == w)).alias("n")))
        wrong = F.transform(F.filter(times, lambda t: t["n"] != 1), lambda t: F.concat(F.lit("placeholder_count:"), t["mark"], F.lit(":"), t["n"].cast("string")))
        moved = F.filter(m["marks"], lambda x: F.array_contains(m["wanted"], x)) != m["wanted"]
        return let(named(unknown=unknown, wrong=wrong), lambda v: F.concat(
            F.when(F.size(v["unknown"]) > 0, F.array(F.concat(F.lit("unknown_placeholders:"), F.array_join(v["unknown"], ",")))).otherwise(none), v["wrong"],
            F.when((F.size(v["wrong"]) == 0) & moved, listed("placeholder_order_changed")).otherwise(none),
        ))

    def judged(m):
        between = lambda parts: F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(m["wanted"]) - 1, F.lit(0))), ended)
        lost = F.exists(F.zip_with(between(F.split(masked, F.lit(_MARK), -1)), between(m["gaps"]), lambda a, b: a & ~b), lambda x: x)
        reasons = (
            F.when((m["clean"] == "") | F.contains(m["clean"], F.lit("<KEY>")), listed("empty_or_metadata_output"))
            .when(m["bare"] & F.rlike(text, F.lit(_BARE)), listed("ambiguous_literal_placeholder"))
            .when(F.exists(m["gaps"], lambda g: F.contains(g, F.lit("__ENTITY_"))), listed("malformed_placeholder"))
            .when(F.size(m["wanted"]) == 0, none)
            # the usual case is settled without counting
            .when((m["marks"] == m["wanted"]) & lost, listed("entity_sentence_boundary_lost"))
            .when(m["marks"] == m["wanted"], none)
            .otherwise(of_marks(m))
        )
        back = F.zip_with(m["gaps"], F.transform(spans, lambda s: s["replacement"]), lambda g, r: F.concat(g, F.coalesce(r, F.lit(""))))
        whole = F.when(F.size(m["wanted"]) > 0, F.array_join(back, "")).otherwise(m["mended"])
        return let(reasons, lambda r: F.struct(F.when(F.size(r) == 0, whole).otherwise(text).alias("text"), r.alias("reasons")))

    def cut(m):
        more = named(marks=F.regexp_extract_all(m["mended"], F.lit(_MARK), F.lit(0)), gaps=F.split(m["mended"], F.lit(_MARK), -1))
        return let(more, lambda v: let(named(**{k: m[k] for k in ("clean", "wanted", "bare", "mended")}, marks=v["marks"], gaps=v["gaps"]), judged))

    def mended(m):
        fixed = F.when(m["bare"], F.regexp_replace(m["clean"], F.lit(_BARE), F.lit("__ENTITY_$1__"))).otherwise(m["clean"])
        return let(named(clean=m["clean"], wanted=m["wanted"], bare=m["bare"], mended=fixed), cut)

    def cleaned(m):
        bare = (F.size(m["wanted"]) > 0) & F.rlike(m["clean"], F.lit(_BARE))
        return let(named(clean=m["clean"], wanted=m["wanted"], bare=bare), mended)

    return let(named(clean=plain(F.coalesce(refined, F.lit(""))), wanted=F.transform(spans, lambda s: s["placeholder"])), cleaned)


def renamed(spans: Column) -> Column:
    """Dictionary spans whose surface is not the canonical name."""
    return F.filter(spans, lambda s: F.startswith(s["source"], F.lit("database")) & (s["original"] != s["replacement"]))


def hints(spans: Column) -> Column:
    """Canonical names whose alias was found, in order of the text."""
    return F.array_distinct(F.transform(renamed(spans), lambda s: s["replacement"]))


def audit(refined: Column, spans: Column) -> Column:
    """Kinds of spans, but the rules', of which a refined text holds neither the original
    nor the replacement."""
    held = lambda t, s: F.contains(t, s["original"]) | F.contains(t, s["replacement"])
    gone = let(refined, lambda t: F.filter(spans, lambda s: (s["source"] != "rule") & ~held(t, s)))
    kinds = F.array_distinct(F.transform(gone, lambda s: F.concat(F.lit("missing_"), s["entity_type"])))
    return F.when(stripped(refined) == "", F.array(F.lit("empty_refiner_output"))).otherwise(kinds)


def normalized_aliases(refined: Column, spans: Column) -> Column:
    """Struct (text, changes): aliases that were found in the source are replaced by their
    canonical names, one span after the other; changes lists those that were met."""
    kind = "array<struct<observed:string,canonical:string,entity_type:string>>"
    start = F.struct(plain(refined).alias("text"), F.array().cast(kind).alias("changes"))
    change = lambda s: F.array(F.struct(s["original"].alias("observed"), s["replacement"].alias("canonical"), s["entity_type"].alias("entity_type")))
    return F.aggregate(renamed(spans), start, lambda done, s: F.when(
        F.contains(done["text"], s["original"]),
        F.struct(F.replace(done["text"], s["original"], s["replacement"]).alias("text"), F.concat(done["changes"], change(s)).alias("changes")),
    ).otherwise(done))

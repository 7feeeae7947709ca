"""Benchmark decontamination with a distributed positional inverted index.

1. The training texts are tokenised once and the postings (term, doc_id, pos) of every
   term of the benchmark are stored. Only terms that a test item asks for are ever looked
   up, so other terms have no list; the stored table is read by column and by doc order.
2. Corpus frequencies of the terms follow from the postings. Each window of a test item
   takes its rarest terms as anchors.
3. Anchor postings are moved back by the anchor's offset in its item, which puts all
   words of one occurrence on one diagonal (document, item, position minus offset).
   Intersecting the moved lists leaves the diagonals on which the rarest terms agree.
4. On these diagonals the words are compared exactly, which gives the matched windows.
   Only texts of documents with a diagonal are shuffled for it: a broadcast filter of at
   most ``SLOTS`` hashes of their ids lets the others stay where they are read.

Only DataFrame functions are used. What else is broadcast is derived from the benchmark
alone, and only while it holds at most ``BROADCAST_WORDS`` words and item ids; beyond
that the joins are left to Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.llm.common import ascii_lower, stored

#: What lies between words, once A-Z are lower-cased: the complement of the word pattern
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
ANCHORS = 2
BROADCAST_WORDS = 1_000_000
SLOTS = 1 << 18


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN, -1), "")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Stored postings (term, doc_id, pos) of the given terms in the columns doc_id and text.

    ``terms`` has one column ``term`` of 64-bit word hashes. Positions count from 0.
    Null texts have no postings, a null doc_id is left out, repeated rows repeat theirs.
    """
    tokens = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.posexplode(words(F.col("text"))))
    tokens = tokens.select("doc_id", "pos", F.xxhash64("col").alias("term"))
    return stored(tokens.join(terms, "term").select("term", "doc_id", "pos"), "postings")


class Benchmark:
    """Test items as distinct passages, each with those of its windows that no other place
    of the benchmark has already: what is said again and again is looked for once.

    ``passages``: key, passage (its words), size, window, and parts, an array of (items,
    starts): the kept windows' starts by the ids of the items that hold the window
    anywhere. Items without a word, with a null text or a null id are left out.
    """

    def __init__(self, items: DataFrame, window: int = WINDOW, id_column: str = "item_id"):
        tokenised = items.where(F.col(id_column).isNotNull()).select(
            F.col(id_column).cast("string").alias("item_id"), words(F.col("text")).alias("passage")
        )
        grouped = tokenised.where("size(passage) > 0").groupBy("passage").agg(F.collect_set("item_id").alias("items"))
        said = grouped.select(
            F.sha2(F.to_json("passage"), 256).alias("key"), "passage", "items",
            F.size("passage").alias("size"), F.least(F.size("passage"), F.lit(window)).alias("window"),
        )
        said = stored(said, "passages")
        every = said.select("key", "passage", "window", "items", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("window"))).alias("start"))
        every = every.select("key", "start", "items", F.sha2(F.to_json(F.slice("passage", F.col("start") + 1, F.col("window"))), 256).alias("said"))
        kept = every.groupBy("said").agg(
            F.min(F.struct("key", "start")).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
        )
        parts = kept.groupBy("at.key", "items").agg(F.collect_list("at.start").alias("starts"))
        parts = parts.groupBy("key").agg(F.collect_list(F.struct("items", "starts")).alias("parts"))
        self.passages = stored(said.drop("items").join(parts, "key"), "windows")
        total = self.passages.agg(F.sum(F.col("size") + F.aggregate("parts", F.lit(0), lambda n, p: n + F.size(p["items"]) + F.size(p["starts"])))).first()[0] or 0
        self.bounded = total <= BROADCAST_WORDS
        starts = self.passages.select("key", "passage", "window", F.explode(F.flatten(F.transform("parts", lambda p: p["starts"]))).alias("start"))
        self.terms = starts.select("key", "window", "start", F.posexplode(F.slice("passage", F.col("start") + 1, F.col("window"))).alias("i", "word")).select(
            "key", "window", "start", (F.col("start") + F.col("i")).alias("off"), F.xxhash64("word").alias("term")
        )

    def small(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.bounded else df

    def anchors(self, frequencies: DataFrame, count: int = ANCHORS) -> DataFrame:
        """(key, off, term, need): the rarest positions of every kept window.

        A window with a term that the corpus lacks can't occur and has none. ``need`` is
        how many anchors of a passage each of its windows holds at least.
        """
        known = self.terms.join(self.small(frequencies), "term", "left")
        by_window = Window.partitionBy("key", "start")
        ranked = known.withColumn("absent", F.max(F.col("count").isNull()).over(by_window)).where("not absent").withColumn(
            "rank", F.row_number().over(by_window.orderBy("count", "off"))
        )
        chosen = ranked.where(F.col("rank") <= count).select("key", "off", "term", "window").distinct()
        return chosen.select("key", "off", "term", F.least(F.lit(count), "window").alias("need"))


def diagonals(postings: DataFrame, benchmark: Benchmark, count: int = ANCHORS) -> DataFrame:
    """(doc_id, key, delta) on which the rarest terms of some window may all stand."""
    frequencies = postings.groupBy("term").count()
    anchors = benchmark.anchors(frequencies, count)
    moved = postings.join(benchmark.small(stored(anchors, "anchors")), "term").select(
        "doc_id", "key", (F.col("pos") - F.col("off")).alias("delta"), "off", "need"
    )
    seen = moved.groupBy("doc_id", "key", "delta", "need", "off").count()
    return seen.groupBy("doc_id", "key", "delta", "need").agg(F.count("*").alias("met")).where("met >= need").select(
        "doc_id", "key", "delta"
    )


def _begins(doc_words: Column, spot: Column, starts: Column) -> Column:
    """Where in the document (from 0) the windows with these starts stand, on the spot's
    diagonals; each window is compared word by word."""
    w = spot["window"]
    on = lambda d: F.transform(
        F.filter(starts, lambda s: (d + s >= 0) & (d + s + w <= F.size(doc_words)) & (F.slice(doc_words, F.greatest(d + s, F.lit(0)) + 1, w) == F.slice(spot["passage"], s + 1, w))),
        lambda s: d + s,
    )
    return F.flatten(F.transform(spot["deltas"], on))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20, name: str = "contamination") -> DataFrame:
    """``docs`` with a struct ``name`` of n_words, n_hit, items and contaminated.

    A window is ``window`` consecutive words of an item, or all of its words if it has
    fewer. A document word inside any occurrence of a window is hit; ``items`` lists, as
    strings in order, the items with occurring windows; a document is contaminated if
    n_hit > 0 and share * n_hit >= n_words. Null and empty texts have no words. Every
    input row is returned once with all its columns, repeated rows and rows of a
    repeated or null doc_id included: texts are looked up by their doc_id, those without
    one by a hash of the text, and as every place is compared word by word, keys that
    happen to be equal change no result. A column of ``docs`` that is called ``name`` is
    replaced. Empty tables give empty results.
    """
    benchmark = Benchmark(items, window)
    vocabulary = benchmark.small(benchmark.terms.select("term").distinct())
    looked_up = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("text"))
    postings = build_index(docs.select(looked_up.alias("doc_id"), "text"), vocabulary)
    met = diagonals(postings, benchmark).groupBy("doc_id", "key").agg(F.collect_list("delta").alias("deltas"))
    found = met.join(benchmark.small(benchmark.passages.select("key", "passage", "window", "parts")), "key")
    spots = stored(found.groupBy(F.col("doc_id").alias("_doc")).agg(
        F.collect_list(F.struct("deltas", "passage", "window", "parts")).alias("_spots")
    ), "spots")
    slot = lambda c: F.pmod(c, F.lit(SLOTS)).cast("int")
    slots = F.broadcast(spots.select(slot(F.col("_doc")).alias("_slot")).distinct())
    # columns get names of their own, so that none can clash and unused ones can be pruned
    columns = [c for c in docs.columns if c != name]
    carried = docs.select(
        *[F.col(f"`{c}`").alias(f"_column{i}") for i, c in enumerate(columns)],
        looked_up.alias("_id"), F.col("text").alias("_text"), slot(looked_up).alias("_slot"),
    )
    clear = carried.join(slots, "_slot", "left_anti")
    maybe = carried.join(slots, "_slot", "left_semi").join(
        spots.hint("merge"), F.col("_id") == F.col("_doc"), "left"  # spots grow with the documents and unpack to much more than they are stored in
    ).drop("_doc")
    no_ids = F.array().cast("array<string>")
    plain = [F.col(f"_column{i}").alias(c) for i, c in enumerate(columns)]

    def measured(rows: DataFrame, n_hit: Column, ids: Column) -> DataFrame:
        counted = rows.select("*", F.size("_words").cast("long").alias("_n_words"), n_hit.alias("_n_hit"), ids.alias("_items"))
        bad = (F.col("_n_hit") > 0) & (share * F.col("_n_hit") >= F.col("_n_words"))
        result = F.struct(F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.col("_items").alias("items"), bad.alias("contaminated"))
        return counted.select(*plain, result.alias(name))

    def places(spot: Column) -> Column:
        """(at, items) of the spot's parts that occur: the words that are hit, and the ids."""
        tried = F.transform(spot["parts"], lambda p: F.struct(_begins(F.col("_words"), spot, p["starts"]).alias("at"), p["items"].alias("items")))
        met = F.filter(tried, lambda t: F.size(t["at"]) > 0)
        hit = lambda t: F.flatten(F.transform(t["at"], lambda b: F.sequence(b, b + spot["window"] - 1)))
        return F.transform(met, lambda t: F.struct(hit(t).alias("at"), t["items"].alias("items")))

    nothing = F.array().cast("array<struct<at:array<int>,items:array<string>>>")
    tried = maybe.withColumn("_words", words(F.col("_text"))).withColumn("_met", F.coalesce(F.flatten(F.transform("_spots", places)), nothing))
    hits = F.size(F.array_distinct(F.flatten(F.transform("_met", lambda t: t["at"])))).cast("long")
    hit_items = F.array_sort(F.array_distinct(F.flatten(F.transform("_met", lambda t: t["items"]))))
    return measured(tried, hits, hit_items).unionByName(
        measured(clear.withColumn("_words", words(F.col("_text"))), F.lit(0).cast("long"), no_ids)
    )


def proximity_matches(postings: DataFrame, queries: DataFrame, slop: int) -> DataFrame:
    """(query_id, doc_id, pos): places where all of a query's words lie close together.

    ``queries`` has query_id and text. A match is a posting of the query's rarest term
    with every other term at a distance of at most (words of the query - 1 + slop), in
    any order. Positions are binned by that distance, so the join is on equal keys.
    Queries without words, with a null id or with a term that no document has match
    nothing.
    """
    asked = queries.where("query_id is not null").select("query_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    terms = asked.select("query_id", (F.size("w") - 1 + slop).alias("reach"), F.explode(F.array_distinct("w")).alias("word"))
    terms = terms.select("query_id", "reach", F.xxhash64("word").alias("term"))
    frequencies = postings.groupBy("term").count()
    by_query = Window.partitionBy("query_id")
    ranked = terms.join(frequencies, "term", "left").withColumn("absent", F.max(F.col("count").isNull()).over(by_query))
    ranked = ranked.where("not absent").withColumn("rank", F.row_number().over(by_query.orderBy("count", "term"))).withColumn(
        "terms", F.count("*").over(by_query)
    )
    at = postings.join(ranked, "term").withColumn("bin", F.floor(F.col("pos") / (F.col("reach") + 1)))
    anchors = at.where("rank = 1").select("query_id", "doc_id", "reach", "terms", F.col("pos").alias("anchor"), F.explode(
        F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    near = anchors.join(at.select("query_id", "doc_id", "bin", "pos", "term"), ["query_id", "doc_id", "bin"])
    near = near.where(F.abs(F.col("pos") - F.col("anchor")) <= F.col("reach"))
    return near.groupBy("query_id", "doc_id", F.col("anchor").alias("pos"), "terms").agg(
        F.count_distinct("term").alias("met")
    ).where("met = terms").select("query_id", "doc_id", "pos")

"""The entity dictionary: two tables with upserts, domain views and lookups.

Tables are immutable DataFrames; each operation returns new ones. ``entities``:
entity_id, canonical_text, entity_type, domain, normalization_policy, priority, enabled,
source. ``aliases``: alias_id, entity_id, alias.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.functions.text import casefold, strip
from quillet.operators.records import numbered
from quillet.sources.store import shared_table

ENTITY = "entity_id long, canonical_text string, entity_type string, domain string, normalization_policy string, priority int, enabled boolean, source string"
ALIAS = "alias_id long, entity_id long, alias string"
POLICIES = ("normalize", "preserve")
#: Entity ids whose aliases are numbered together.
ID_RANGE = 4096


class EntityError(ValueError):
    """A wrong definition, or a key that another entity has."""


class UnknownEntity(KeyError):
    """No entity has this id."""


def tidy_aliases(aliases: Column, canonical: Column) -> Column:
    """Stripped, distinct, non-empty aliases other than the canonical text."""
    return F.filter(F.array_distinct(F.transform(aliases, strip)), lambda a: (a != "") & (a != canonical))


def entity_view(entities: DataFrame, aliases: DataFrame, domain: str | None = None, enabled_only: bool = True) -> DataFrame:
    """Entities of a domain and of general with their aliases in order of alias id."""
    chosen = entities
    if domain is not None:
        chosen = chosen.where(F.col("domain").isin(domain, "general"))
    if enabled_only:
        chosen = chosen.where("enabled")
    listed = aliases.groupBy("entity_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("alias_id", "alias"))), lambda x: x["alias"]).alias("aliases")
    )
    return chosen.join(listed, "entity_id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def view_order() -> list[Column]:
    return [F.desc("priority"), F.asc("entity_id")]


def search(view: DataFrame, text: str = "", entity_type: str | None = None) -> DataFrame:
    """Entities whose canonical text or an alias holds the text, whatever the case."""
    needle = F.lit(text.casefold())
    hit = F.contains(casefold(F.col("canonical_text")), needle) | F.exists("aliases", lambda a: F.contains(casefold(a), needle))
    found = view.where(hit)
    return found.where(F.upper("entity_type") == entity_type.upper()) if entity_type else found


def upsert(entities: DataFrame, aliases: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after ``incoming`` (canonical_text, entity_type, domain,
    normalization_policy, priority, source, aliases) has been merged in by
    (canonical_text, domain). What exists is updated and enabled anew, its aliases are
    replaced; new rows get the next ids in order of their keys. The last row of a
    repeated key, by ``pos``, counts."""
    keys = ["canonical_text", "domain"]
    given = incoming.withColumn("canonical_text", strip(F.col("canonical_text"))).withColumn("entity_type", F.upper(strip(F.col("entity_type"))))
    rest = [c for c in given.columns if c not in (*keys, "pos")]
    given = given.groupBy(*keys).agg(F.max_by(F.struct(*rest), "pos").alias("g")).select(*keys, "g.*")
    known = given.join(entities.select("entity_id", *keys), keys, "left")
    top = entities.agg(F.coalesce(F.max("entity_id"), F.lit(0))).first()[0]
    fresh = known.where("entity_id is null").drop("entity_id")
    # ids follow the order of the keys; the first characters, whose order is that of the
    # texts, cut them into ranges
    new = numbered(fresh, [], keys, "n", by=F.ascii("canonical_text")).withColumn("entity_id", F.col("n") + F.lit(top))
    merged = known.where("entity_id is not null").unionByName(new.drop("n", "n_size")).withColumn("enabled", F.lit(True))
    columns = entities.columns
    kept = entities.join(merged.select("entity_id"), "entity_id", "left_anti")
    new_entities = kept.select(columns).unionByName(merged.select(columns))
    high = aliases.agg(F.coalesce(F.max("alias_id"), F.lit(0))).first()[0]
    listed = merged.select("entity_id", F.posexplode(tidy_aliases(F.col("aliases"), F.col("canonical_text"))).alias("at", "alias"))
    listed = numbered(listed, [], ["entity_id", "at"], "n", by=F.floor(F.col("entity_id") / ID_RANGE))
    new_aliases = aliases.join(merged.select("entity_id"), "entity_id", "left_anti").select(aliases.columns).unionByName(
        listed.select((F.col("n") + F.lit(high)).alias("alias_id"), "entity_id", "alias")
    )
    return new_entities, new_aliases


def set_enabled(entities: DataFrame, entity_id: int, enabled: bool) -> DataFrame:
    return entities.withColumn("enabled", F.when(F.col("entity_id") == entity_id, F.lit(enabled)).otherwise(F.col("enabled")))


def delete(entities: DataFrame, aliases: DataFrame, entity_id: int) -> tuple[DataFrame, DataFrame]:
    return entities.where(F.col("entity_id") != entity_id), aliases.where(F.col("entity_id") != entity_id)


@dataclass(frozen=True)
class EntityStore:
    """The dictionary as a value: every change returns a new store."""

    entities: DataFrame
    aliases: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> "EntityStore":
        return cls(spark.createDataFrame([], ENTITY), spark.createDataFrame([], ALIAS))

    @property
    def spark(self) -> SparkSession:
        return self.entities.sparkSession

    def settled(self) -> "EntityStore":
        """The same tables, stored: the plans of changes don't pile up."""
        return EntityStore(shared_table(self.entities, "entities"), shared_table(self.aliases, "aliases"))

    def _require(self, entity_id: int):
        found = self.entities.where(F.col("entity_id") == entity_id).limit(1).collect()
        if not found:
            raise UnknownEntity(entity_id)
        return found[0]

    def add(self, canonical_text: str, entity_type: str = "TERM", domain: str = "general", normalization_policy: str = "normalize",
            priority: int = 0, source: str = "manual", aliases: tuple[str, ...] = ()) -> "EntityStore":
        if not canonical_text.strip() or normalization_policy not in POLICIES:
            raise EntityError("an entity needs a canonical text and a known policy")
        row = [(canonical_text, entity_type, domain, normalization_policy, priority, source, list(aliases), 0)]
        kind = "canonical_text string, entity_type string, domain string, normalization_policy string, priority int, source string, aliases array<string>, pos int"
        return EntityStore(*upsert(self.entities, self.aliases, self.spark.createDataFrame(row, kind))).settled()

    def update(self, entity_id: int, **fields) -> "EntityStore":
        """Change fields by id; ``enabled`` stays, ``aliases`` are replaced if given."""
        row = self._require(entity_id).asDict()
        aliases = fields.pop("aliases", None)
        row |= fields
        clash = self.entities.where((F.col("canonical_text") == row["canonical_text"]) & (F.col("domain") == row["domain"]) & (F.col("entity_id") != entity_id))
        if not clash.isEmpty():
            raise EntityError(f"another entity is {row['canonical_text']!r} in {row['domain']!r}")
        changed = self.spark.createDataFrame([tuple(row[c] for c in self.entities.columns)], self.entities.schema)
        out = replace(self, entities=self.entities.where(F.col("entity_id") != entity_id).unionByName(changed))
        if aliases is None:
            return out.settled()
        high = self.aliases.agg(F.coalesce(F.max("alias_id"), F.lit(0))).first()[0]
        tidy = [a for a in dict.fromkeys(x.strip() for x in aliases) if a and a != row["canonical_text"]]
        mine = self.spark.createDataFrame([(high + 1 + i, entity_id, a) for i, a in enumerate(tidy)], ALIAS)
        return replace(out, aliases=self.aliases.where(F.col("entity_id") != entity_id).unionByName(mine)).settled()

    def enable(self, entity_id: int, enabled: bool = True) -> "EntityStore":
        self._require(entity_id)
        return replace(self, entities=set_enabled(self.entities, entity_id, enabled)).settled()

    def remove(self, entity_id: int) -> "EntityStore":
        self._require(entity_id)
        return EntityStore(*delete(self.entities, self.aliases, entity_id)).settled()

    def view(self, domain: str | None = None, enabled_only: bool = True) -> DataFrame:
        return entity_view(self.entities, self.aliases, domain, enabled_only).orderBy(*view_order())

    def get(self, canonical_text: str, domain: str = "general"):
        """The entity of this key, disabled or not, or None."""
        all_ = entity_view(self.entities, self.aliases, enabled_only=False)
        found = all_.where((F.col("canonical_text") == canonical_text) & (F.col("domain") == domain)).limit(1).collect()
        return found[0] if found else None

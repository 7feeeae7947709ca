"""URL filters with redirect equivalence.

Rules name a host and a path prefix. Redirects and canonical links make URLs aliases of
each other; the connected components over these edges are found distributedly, and a
block decision on any URL of a component holds for its aliases. An explicit allow rule
takes precedence twice: a URL under one stays allowed whatever its aliases are, and
aliases without a rule of their own are not blocked if the component has an allowed URL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import UPPER, LOWER, stored
from quillet.llm.graph import connected_components


@dataclass(frozen=True)
class Rule:
    action: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """A URL's place in the alias graph: host, path and query; null without ``://``."""
    query = F.regexp_extract(_rest(url), r"\A[^?#]*(\?[^#]*)", 1)
    return F.when(_rest(url).isNotNull(), F.concat(host_of(url), path_of(url), query))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (action, rule) of the longest fitting rule, else null."""
    out = F.lit(None).cast("struct<action:string,rule:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.action).alias("action"), F.lit(rule.text).alias("rule"))).otherwise(out)
    return out


_CANONICAL = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\burl\s*=\s*[\"']?([^\"'\s>;]+)"


def page_edges(pages: DataFrame) -> DataFrame:
    """(from_url, to_url) of all canonical links and meta redirects in ``html``.

    Relative targets are resolved against the page's URL. Pages without one give none.
    """
    base = F.regexp_extract("url", r"\A([^:/?#]*://[^/?#]*)", 1)
    folder = F.regexp_extract("url", r"\A([^:/?#]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    scheme = F.regexp_extract("url", r"\A([^:/?#]*:)", 1)
    targets = pages.where("url is not null and html is not null").select(
        "url", F.explode(F.concat(*[F.regexp_extract_all("html", F.lit(x), F.lit(1)) for x in (_CANONICAL, _REFRESH)])).alias("href")
    ).where("href <> ''")
    to = (
        F.when(F.col("href").contains("://"), F.col("href"))
        .when(F.col("href").startswith("//"), F.concat(scheme, "href"))
        .when(F.col("href").startswith("/"), F.concat(base, "href"))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(base, F.lit("/"))), "href"))
    )
    return targets.select(F.col("url").alias("from_url"), to.alias("to_url"))


def judge_urls(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    ``pages`` needs page_id, url and html; ``redirects`` may add edges (from_url, to_url).
    A null url, or one without ``://``, has an empty host and path, no rule, no alias and
    is allowed, as is every URL that neither a rule nor an alias blocks. Repeated rows are
    judged each; null html has no links; empty tables give empty results.
    """
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("from_url", "to_url"))
    edges = stored(
        edges.select("from_url", "to_url", node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b"))
        .where("a is not null and b is not null and a <> b").distinct(),
        "alias-edges",
    )
    judged = pages.select("page_id", "url").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node")
    ).withColumn("r", matching_rule(F.col("host"), F.col("path"), rules))
    # the graph's nodes carry their own rules, so targets outside of the table count too
    nodes = edges.select(F.col("a").alias("node"), F.col("from_url").alias("url")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("to_url").alias("url"))
    ).groupBy("node").agg(F.min("url").alias("url"))
    own = nodes.select("node", matching_rule(host_of(F.col("url")), path_of(F.col("url")), rules)["action"].alias("action"))
    components = connected_components(edges.select("a", "b"), "aliases")
    marked = components.join(own, "node")
    decided = marked.groupBy("component").agg(
        F.max((F.col("action") == "block").cast("int")).alias("blocks"), F.max((F.col("action") == "allow").cast("int")).alias("allows")
    ).where("blocks = 1 and coalesce(allows, 0) = 0").select("component")
    blocked = components.join(decided, "component").select("node", F.lit(True).alias("alias_blocked"))
    # pages without a node meet nothing, so they are not dealt out by it
    out = judged.where("node is not null").join(blocked, "node", "left").unionByName(
        judged.where("node is null").withColumn("alias_blocked", F.lit(None).cast("boolean"))
    )
    verdict = F.coalesce(F.col("r.action"), F.when(F.col("alias_blocked"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"))

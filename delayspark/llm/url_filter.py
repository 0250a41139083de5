"""URL filter whose decisions reach aliases: redirect equivalence.

Explicit host and path rules decide first (the longest wins).  Pages without a rule take the decision
of their alias class: the connected component of page addresses, canonical links and redirects
(meta refresh).  In a class one explicit allow outweighs any block; a class with only blocks is
blocked; a class with neither is allowed.  Rules are matched on addresses as written; only the names
of the graph's nodes are normalised (scheme, default port, fragment, tracking parameters and final
slash dropped).

The page texts are read once for their links; only addresses are written and shuffled.

Defined results: null addresses or ones without ``://`` have empty host and path, no rule and no
node, and are allowed unless a link of their own page names a blocked class; equal addresses share a
node; empty pages have no links; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import decode_entities, resolve_url
from .common import let, written
from .graph import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# --- fixed values: patterns (Java and RE2 syntax alike) ------------------------------------------
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
CANONICAL = r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH_URL = r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)"
TRACKING = r"(?i)([?&])(utm_[a-z]+|gclid|fbclid|mc_eid|ref)=[^&#]*"


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for a host, its subdomains, and paths that start with ``path``."""
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), ADDRESS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), ADDRESS, 2)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Name of the longest rule that fits (at equal length an allow first), else null."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "allow")):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.lit(r.name)).otherwise(found)
    return found


def verdict_of(rule: Column, rules: list[Rule]) -> Column:
    out = F.lit(None).cast("string")
    for r in rules:
        out = F.when(rule == r.name, F.lit(r.verdict)).otherwise(out)
    return out


def node_of(url: Column) -> Column:
    """Name of an address in the alias graph; null when it has no host."""
    rest = F.regexp_replace(F.regexp_replace(url, r"(?s)^.*?://[^/?#]*", ""), r"(?s)#.*$", "")
    rest = F.regexp_replace(rest, TRACKING, "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"([?&])&+", "$1"), r"[?&]+$", ""), r"/$", "")
    host = F.regexp_replace(host_of(url), r":(80|443)?$", "")
    return F.when(host != "", F.concat(host, rest))


def links_of(url: Column, html: Column) -> Column:
    """Absolute addresses of a page's canonical links and redirects: entities decoded, relative ones
    joined to the page's own address with their dot segments folded."""
    html = F.coalesce(html, F.lit(""))
    tags = F.concat(
        F.when(F.regexp_like(html, F.lit("(?i)canonical")), F.transform(
            F.regexp_extract_all(html, F.lit(CANONICAL), F.lit(0)), lambda t: F.regexp_extract(t, HREF, 1)))
        .otherwise(F.array().cast("array<string>")),
        F.when(F.regexp_like(html, F.lit("(?i)refresh")), F.transform(
            F.regexp_extract_all(html, F.lit(REFRESH), F.lit(0)), lambda t: F.regexp_extract(t, REFRESH_URL, 1)))
        .otherwise(F.array().cast("array<string>")))
    base = F.coalesce(url, F.lit(""))

    def absolute(t: Column) -> Column:
        return F.when(F.startswith(t, F.lit("//")), F.concat(F.lit("http:"), t)).otherwise(resolve_url(base, t))

    fixed = F.transform(tags, lambda t: F.when(t == "", t).otherwise(let(decode_entities(t), absolute)))
    return let(fixed, lambda x: F.array_distinct(F.filter(x, lambda t: node_of(t).isNotNull())))


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url",
          html_col: str = "html") -> DataFrame:
    """``page_id, host, path, rule, verdict, reason`` (rule, alias or default) for every page."""
    url = F.col(url_col)
    host, path = host_of(url), path_of(url)
    links = F.transform(links_of(url, F.col(html_col)),
                        lambda t: F.struct(node_of(t).alias("node"),
                                           verdict_of(rule_of(host_of(t), path_of(t), rules), rules).alias("said")))
    narrow = written(
        pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"),
                     rule_of(host, path, rules).alias("rule"), node_of(url).alias("own"), links.alias("links"))
        .withColumn("said", verdict_of(F.col("rule"), rules))
        # a page without an address of its own stands at its first link
        .withColumn("node", F.coalesce("own", F.get("links", F.lit(0))["node"])), "url-pages")
    link = narrow.select("node", F.explode("links").alias("to"))
    comps = written(components(link.select("node", F.col("to.node").alias("other")), "node", "other"), "url-classes")
    facts = (narrow.where("own is not null and said is not null").select(F.col("own").alias("n"), "said")
             .unionByName(link.where("to.said is not null").select(F.col("to.node").alias("n"), F.col("to.said").alias("said")))
             .groupBy("n").agg(F.max(F.col("said") == "allow").alias("allow"), F.max(F.col("said") == "block").alias("block")))
    facts = (facts.join(comps, F.col("n") == comps["node"], "left").groupBy(F.coalesce("root", "n").alias("class"))
             .agg(F.max("allow").alias("allow"), F.max("block").alias("block")))
    known = (narrow.where("rule is null").drop("links", "own").join(comps.withColumnRenamed("node", "k"), F.col("node") == F.col("k"), "left")
             .withColumn("c", F.coalesce("root", "node")).join(facts, F.col("c") == F.col("class"), "left"))
    alias = F.when(F.col("allow"), "allow").when(F.col("block"), "block")
    rest = known.select("page_id", "host", "path", "rule", F.coalesce(alias, F.lit("allow")).alias("verdict"),
                        F.when(alias.isNotNull(), "alias").otherwise("default").alias("reason"))
    ruled = narrow.where("rule is not null").select("page_id", "host", "path", "rule", F.col("said").alias("verdict"),
                                                    F.lit("rule").alias("reason"))
    return ruled.unionByName(rest)

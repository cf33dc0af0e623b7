"""URL filters that follow redirects: aliases of a page share its block decision.

Rules are rows (host, path, verdict). A rule fits its host and all subdomains where the url's path starts with the rule's;
the longest wins. Pages whose url and canonical link, or url and redirect target, are equivalent form components; a page
without a rule of its own gets its component's decision: allowed if a member is explicitly allowed, else blocked if a
member is blocked, else allowed.

Nodes are urls without fragment, scheme and host in lower case. A redirect target that is no page of the table still
counts: its own rule is looked up. Rules are joined by host suffix, never looped over; the join is broadcast only when
Spark measures them small.

Defined cases: a NULL url, or one without ``://``, has an empty host and path, no rule and no aliases; NULL html has no
links; repeated pages get equal verdicts; of equally long rules that fit, block wins. Only page_id, url and html are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import kept
from millrace.llm.graph import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
META = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
TARGET = r"""(?is)\burl\s*=\s*([^"'\s>]+)"""


def small(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_of(url: Column) -> Column:
    return F.coalesce(small(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """NULL where there is no ``://``."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    head = F.regexp_extract(bare, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.when(head != "", F.concat(small(head), F.substring(bare, F.length(head) + 1, F.length(bare))))


def resolved(base: Column, link: Column) -> Column:
    """An absolute url for a link found on ``base``."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?:)//", 1)
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    return (
        F.when(link == "", None).when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(folder, F.when(folder.endswith("/"), "").otherwise("/"), link)))


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) between nodes, from canonical links, refresh redirects and rows (from_url, to_url)."""
    canonical = F.regexp_extract(F.regexp_extract("html", LINK, 0), HREF, 1)
    refresh = F.regexp_extract(F.regexp_extract("html", META, 0), TARGET, 1)
    links = pages.filter(F.col("html").rlike(LINK) | F.col("html").rlike(META)).select("url", F.explode(F.array(canonical, refresh)).alias("to"))
    edges = links.filter(F.col("to") != "").select(node_of(F.col("url")).alias("a"), node_of(resolved(F.col("url"), F.col("to"))).alias("b"))
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("from_url")), node_of(F.col("to_url"))))
    return edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))


def longest_rule(places: DataFrame, rules: DataFrame) -> DataFrame:
    """Per distinct (host, path): the longest rule that fits, as ``rule`` and ``verdict``; only places that have one."""
    deep = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    labels = F.split("host", r"\.")
    ends = F.transform(
        F.sequence(F.greatest(F.lit(1), F.size(labels) - (deep - 1)), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    listed = rules.select(F.col("host").alias("__end"), F.col("path").alias("__under"), F.col("verdict").alias("__verdict"))
    fits = (
        places.select("host", "path").distinct().withColumn("__end", F.explode(ends)).join(listed, "__end")
        .filter(F.col("path").startswith(F.col("__under"))))
    best = F.max(F.struct(F.length("__end") + F.length("__under"), F.col("__verdict"), F.concat("__end", "__under").alias("rule"))).alias("__best")
    return fits.groupBy("host", "path").agg(best).select("host", "path", F.col("__best.rule").alias("rule"), F.col("__best.__verdict").alias("own"))


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule (NULL if none fits), verdict."""
    placed = lambda df, url: df.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    edges = kept(alias_edges(pages, redirects))
    reach = kept(components(edges))
    members = placed(reach, F.col("node"))
    ruled = members.join(longest_rule(members, rules), ["host", "path"])
    said = ruled.groupBy("root").agg(F.max(F.col("own") == "allow").alias("freed"), F.max(F.col("own") == "block").alias("barred"))
    alias = reach.join(said, "root").select(
        "node", F.when(F.col("freed"), "allow").when(F.col("barred"), "block").otherwise("allow").alias("shared"))
    own = placed(pages.select("page_id", "url"), F.col("url"))
    best = longest_rule(own, rules)
    out = own.join(best, ["host", "path"], "left").withColumn("node", node_of(F.col("url"))).join(alias, "node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", "shared", F.lit("allow")).alias("verdict"))

"""URL filters: explicit rules, then block decisions spread over redirect equivalence.

Rules decide a URL first.  URLs without a rule take the verdict of their alias
class: distributed connected components over redirects (``<meta
http-equiv=refresh>``), canonical links (``<link rel=canonical>``) and any edges
the caller adds.  A class with a blocked member blocks its undecided members,
unless a member is explicitly allowed: allow has precedence.

All of it is DataFrame expressions.  Defined results: a null URL or one without
``://`` has empty host and path, no rule, no alias, and is allowed; null html has
no edges; repeated rows each get their verdict; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, connected_components

#: Fixed values of the query's contract: verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

_TAGS = r"(?is)<(?:link|meta|base)\b[^>]*>"
_ATTRIBUTE = r"""(?is)[\s"'/]%s\s*=\s*(?:"\s*([^"]*?)\s*"|'\s*([^']*?)\s*'|([^\s>"']+))"""
#: A refresh's target, after its seconds: with url= and, as browsers have it, without.
_REFRESH = (r"""(?is)^[\s\d.]*[;,]?\s*url\s*=\s*['"]?\s*([^'"\s]+)""", r"""(?is)^\s*[\d.]+\s*[;,\s]\s*['"]?\s*([^'"\s]+)""")


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null.

    The rules are a stated list: they become one expression inside the scan's
    generated code, without a join.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def node_of(url: Column) -> Column:
    """A URL's name in the alias graph: scheme and host in lower case, without fragment."""
    bare = F.regexp_extract(url, r"(?s)^([^#]*)", 1)
    return F.when(F.instr(bare, "://") > 0, F.concat(ascii_lower(F.regexp_extract(bare, r"(?s)^(.*?)://", 1)), F.lit("://"), host_of(bare), F.regexp_extract(bare, r"(?s)^.*?://[^/?#]*(.*)$", 1)))


def without_dots(path: Column) -> Column:
    """A path that opens with a slash, its '.' and '..' segments resolved."""

    def step(done: Column, segment: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        return F.when(segment == "..", up).when(segment == ".", done).otherwise(F.concat(done, F.array(segment)))

    kept = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    folder = F.when(path.rlike(r"(?s)/\.\.?$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.when(path.rlike(r"(?s)/\.\.?(?:/|$)"), F.array_join(F.concat(kept, folder), "/")).otherwise(path)


def resolved(base: Column, target: Column) -> Column:
    """``target`` as a URL, read on a page at ``base`` (RFC 3986); null if either is no URL with ``://``."""
    origin, path = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1), path_of(base)
    own, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    query = F.regexp_extract(base, r"(?s)^[^?#]*(\?[^#]*)", 1)

    def normal(url: Column) -> Column:
        return F.concat(F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), without_dots(path_of(url)), F.regexp_extract(url, r"(?s)^.*?://[^?#]*(.*)$", 1))

    return (
        F.when(target.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*://"), normal(target)).when(target.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*:"), None)
        .when(origin == "", None)
        .when(target.startswith("//"), normal(F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), target)))
        .when(target.startswith("/"), F.concat(origin, without_dots(own), rest))
        .when(own != "", F.concat(origin, without_dots(F.concat(folder, own)), rest))
        .when(target.startswith("?"), F.concat(origin, path, rest))
        .otherwise(F.concat(origin, path, query, rest))
    )


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): a page's node and each node it redirects to or names as canonical.

    Relative targets are resolved against the page, or against its first ``<base href>``.
    """

    def attribute(tag: Column, name: str) -> Column:
        return F.concat(*(F.regexp_extract(tag, _ATTRIBUTE % name, k) for k in (1, 2, 3)))

    def kind(tag: Column) -> Column:
        return ascii_lower(F.substring(tag, 2, 4))

    def words(value: Column) -> Column:
        return F.split(ascii_lower(value), r"[\x20\x09-\x0D]+")

    def target(tag: Column) -> Column:
        content = attribute(tag, "content")
        with_name, bare = (F.regexp_extract(content, x, 1) for x in _REFRESH)
        link = F.when(F.array_contains(words(attribute(tag, "rel")), "canonical"), attribute(tag, "href"))
        refresh = F.when(ascii_lower(attribute(tag, "http-equiv")) == "refresh", F.when(with_name != "", with_name).otherwise(bare))
        return F.when(kind(tag) == "link", link).when(kind(tag) == "meta", refresh)

    def spelled(value: Column) -> Column:
        return F.regexp_replace(value, "&amp;", "&")

    # each step is a transform() or stands below explode(), so that what it names is made once; inlined, the plan grows past what the driver holds
    tags = pages.select(F.col(url).alias("u"), F.regexp_extract_all(F.col(html), F.lit(_TAGS), F.lit(0)).alias("tags"))
    u = F.col("u")
    bases = F.filter(F.transform(F.filter("tags", lambda t: kind(t) == "base"), lambda t: spelled(attribute(t, "href"))), lambda x: x != "")
    base = F.transform(F.array(F.try_element_at(bases, F.lit(1))), lambda b: F.when(b.isNull(), u).otherwise(F.coalesce(resolved(u, b), u)))[0]
    targets = F.transform(F.array_distinct(F.filter(F.transform("tags", target), lambda x: x != "")), spelled)
    found = tags.select(node_of(u).alias("a"), base.alias("base"), targets.alias("targets"))
    nodes = F.transform(F.transform("targets", lambda t: resolved(F.col("base"), t)), node_of)
    return found.select("a", F.explode(F.array_distinct(nodes)).alias("b")).where("a is not null and b is not null and a != b")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and decided_by ('rule', 'alias' or 'default').

    ``pages``: page_id, url, html.  ``edges``: more (a, b) URL pairs, such as a
    crawler's redirect log.
    """
    links = page_edges(pages)
    if edges is not None:
        links = links.unionByName(edges.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")))
    aliases = connected_components(links)
    named = aliases.withColumn("m", match_rule(host_of(F.col("node")), path_of(F.col("node")), rules))
    blocked = named.groupBy("root").agg(F.max(F.col("m.verdict") == "block").alias("block"), F.max(F.col("m.verdict") == "allow").alias("allow")).where("block and not coalesce(allow, false)")
    blocked_nodes = aliases.join(blocked.select("root"), "root").select(F.col("node"), F.lit(True).alias("spread"))
    url = F.col("url")
    judged = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    judged = judged.withColumn("m", match_rule(F.col("host"), F.col("path"), rules)).join(blocked_nodes, "node", "left")
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("m.rule").alias("rule"),
        F.when(F.col("m").isNotNull(), F.col("m.verdict")).when(F.col("spread"), "block").otherwise("allow").alias("verdict"),
        F.when(F.col("m").isNotNull(), "rule").when(F.col("spread"), "alias").otherwise("default").alias("decided_by"),
    )


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))

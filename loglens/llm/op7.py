"""URL filters with redirect equivalence, in DataFrame operations only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import components, table

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: What browsers don't read as markup.
HIDDEN = r"(?is)<!--.*?-->|<script[\s>].*?</script>|<style[\s>].*?</style>|<template[\s>].*?</template>"
LINK = r"(?is)<link\s[^>]*>"
REFRESH = r"(?is)<meta\s[^>]*http-equiv\s*=\s*[\"']?refresh[^>]*>"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def vertex(url: Column) -> Column:
    """The URL as a vertex: scheme and host in lower case, without its fragment. Null where it has no '://'."""
    lower = lambda c: F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(lower(F.regexp_extract(url, r"(?s)^(.*?://)", 1)), host_of(url), rest))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The longest rule that fits as a struct (verdict, rule), or null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in reversed(ordered):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def _without_dots(path: Column) -> Column:
    """The path, which starts with '/', without the segments . and .. ."""
    parts = F.split(F.substr(path, F.lit(2)), "/")
    keep = lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    folder = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.lit("/"), F.array_join(F.concat(F.aggregate(parts, F.array().cast("array<string>"), keep), folder), "/"))


def resolved(base: Column, target: Column) -> Column:
    """The target as a page with the base as its URL means it (RFC 3986, 5.2), or null where that is no URL with '://'.

    Targets with a scheme of their own stay as they are.
    """
    scheme, root = F.regexp_extract(base, r"(?s)^(.*?:)//", 1), F.regexp_extract(base, r"(?s)^.*?://[^/?#]*", 0)
    path, query = path_of(base), F.regexp_extract(base, r"(?s)^[^?#]*(\?[^#]*)", 1)
    own, rest = F.regexp_extract(target, r"(?s)^[^?#]*", 0), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"(?s)^.*/", 0))
    full = F.when(F.startswith(own, F.lit("/")), own).otherwise(F.concat(folder, own))
    return (
        F.when(target.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when((target == "") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, target))
        .when(own != "", F.concat(root, _without_dots(full), rest))
        .when(F.startswith(rest, F.lit("?")), F.concat(root, path, rest))
        .otherwise(F.concat(root, path, query, rest))
    )


def target_urls(html: Column, base: Column) -> Column:
    """URLs that a page at the base names as its canonical form or refreshes to, made absolute."""
    html = F.when(html.rlike(r"(?i)canonical|http-equiv"), F.regexp_replace(html, HIDDEN, ""))
    links = F.filter(F.regexp_extract_all(html, F.lit(LINK), F.lit(0)), lambda t: t.rlike(r"(?is)\srel\s*=\s*[\"']?canonical"))
    refresh = F.regexp_extract_all(html, F.lit(REFRESH), F.lit(0))
    hrefs = F.transform(links, lambda t: F.regexp_extract(t, r"(?is)\shref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    urls = F.transform(refresh, lambda t: F.regexp_extract(t, r"(?is)url\s*=\s*[\"']?([^\"'\s>;]+(?:(?<=&amp);[^\"'\s>;]*)*)", 1))
    named = F.transform(F.concat(hrefs, urls), lambda u: resolved(base, F.replace(u, F.lit("&amp;"), F.lit("&"))))
    return F.coalesce(F.filter(F.array_distinct(named), lambda u: u.isNotNull()), F.array().cast("array<string>"))


def filter_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple[tuple[str, str, str], ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(id, host, path, rule, verdict), one row for each page.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest wins and
    settles a page. Other pages follow their aliases: canonical links and refreshes in the pages, and
    optional redirects (source_url, target_url), are edges between URLs, relative ones taken from the page's
    own URL (a <base> isn't read) and '&amp;' decoded; links in comments, scripts, styles and templates
    don't count, and URLs that differ in the case of scheme or host or in the fragment are one. In the
    component of a page's URL one allowed URL allows it, else one blocked URL blocks it, else it is allowed.
    A null URL or one without '://' has empty host and path, no rule and no edges; null pages have no
    edges; repeated rows are judged alike; other columns are not read.

    Only URLs with edges enter the components, which are label tables that never leave the executors;
    a component's verdict is two partial maxima, so its size doesn't matter.
    """
    own = pages.select(F.col(url_col).alias("u"), target_urls(F.col(html_col), F.col(url_col)).alias("to"))
    edges = own.where(F.contains("u", F.lit("://"))).select(F.col("u").alias("a"), F.explode("to").alias("b"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(F.col("source_url").alias("a"), F.col("target_url").alias("b")))
    edges = table(edges.select(vertex(F.col("a")).alias("a"), vertex(F.col("b")).alias("b")).where("a <> b").distinct(), "links")
    judged = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("u"))
    if edges.isEmpty():
        judged = judged.withColumn("alias", F.lit(None).cast("string"))
    else:
        comps = components(edges)
        verdict = rule_of(host_of(F.col("v")), path_of(F.col("v")), rules)["verdict"]
        classes = comps.groupBy("c").agg(F.max(verdict == "allow").alias("some"), F.max(verdict == "block").alias("none"))
        alias = F.when(F.col("some"), "allow").when(F.col("none"), "block")
        judged = judged.join(comps.join(classes, "c").select("v", alias.alias("alias")), vertex(F.col("u")) == F.col("v"), "left")
    judged = judged.withColumn("host", host_of(F.col("u"))).withColumn("path", path_of(F.col("u")))
    judged = judged.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "alias", F.lit("allow")).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql_rule() -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}') THEN '{v} {h}{p}'" for v, h, p in ordered) + " END"


def _sql_lower(x: str) -> str:
    return f"translate({x}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def _sql_vertex(x: str) -> str:
    return f"CASE WHEN contains({x}, '://') THEN {_sql_lower(f"regexp_extract({x}, '(?s)^(.*?://)', 1)")} || {_sql_lower(f"regexp_extract({x}, '(?s)^.*?://([^/?#]*)', 1)")} || regexp_extract({x}, '(?s)^.*?://[^/?#]*([^#]*)', 1) END"


ORACLE = f"""
WITH RECURSIVE plain AS (SELECT url, CASE WHEN regexp_matches(html, '(?i)canonical|http-equiv') THEN regexp_replace(html, '{HIDDEN}', '', 'g') END AS html FROM pages),
tags AS (
  SELECT url, unnest(regexp_extract_all(html, '(?is)<link\\s[^>]*>|<meta\\s[^>]*http-equiv\\s*=\\s*["'']?refresh[^>]*>')) AS t FROM plain WHERE url IS NOT NULL AND html IS NOT NULL
), named AS (
  SELECT url AS a, CASE WHEN regexp_matches(t, '(?is)^<link') THEN CASE WHEN regexp_matches(t, '(?is)\\srel\\s*=\\s*["'']?canonical') THEN regexp_extract(t, '(?is)\\shref\\s*=\\s*["'']?([^"''\\s>]+)', 1) ELSE '' END
    ELSE regexp_extract(t, '(?is)url\\s*=\\s*["'']?([^"''\\s>;]+)', 1) END AS b FROM tags
), whole AS (SELECT {_sql_vertex("a")} AS a, {_sql_vertex("b")} AS b FROM named), edges AS (
  SELECT DISTINCT a, b FROM (SELECT a, b FROM whole UNION ALL SELECT b, a FROM whole) WHERE a <> b
), reach AS (
  SELECT a AS u, a AS v FROM edges UNION SELECT r.u, e.b FROM reach r JOIN edges e ON r.v = e.a
), parts AS (
  SELECT u, coalesce({_sql_lower("regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM (SELECT url AS u FROM pages UNION SELECT v FROM reach)
), ruled AS (SELECT u, host, path, {_sql_rule()} AS r FROM parts),
alias AS (
  SELECT reach.u, max(CASE WHEN prefix(r, 'allow') THEN 2 WHEN prefix(r, 'block') THEN 1 ELSE 0 END) AS k FROM reach JOIN ruled ON ruled.u = reach.v GROUP BY 1
)
SELECT page_id, host, path, split_part(r, ' ', 2) AS rule, coalesce(split_part(r, ' ', 1), CASE WHEN k = 1 THEN 'block' ELSE 'allow' END) AS verdict
FROM pages JOIN ruled ON ruled.u IS NOT DISTINCT FROM pages.url LEFT JOIN alias ON alias.u = {_sql_vertex("pages.url")}
"""

"""URL filters: rules, and block decisions that spread over redirects and canonical links."""

from __future__ import annotations

import html
import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import ascii_lower, materialise, ship, table
from .components import connected_components

Rule = tuple[str, str, str]
#: verdict, host, path
RULES: tuple[Rule, ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Rules travel inside the plan; a longer list is refused instead of being sent to every task.
MAX_RULES = 10_000

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
_TAG = r"""(?is)<(?:link|meta)\b(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+"""
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|["']?([^\s"'>]+))""")
_REFRESH = re.compile(r"""\burl\s*=\s*["']?\s*([^"'\s>]+)""", re.IGNORECASE)
_ABSOLUTE = re.compile(r"[a-zA-Z][a-zA-Z0-9+.-]*://")


def target_of(url: str, tag: str) -> str | None:
    """The full url that a link or meta tag of the page at `url` names as canonical or redirects to, or None."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(tag):
        found.setdefault(name.lower(), html.unescape("".join(values)).strip())
    to = None
    if tag[1:5].lower() == "link":
        if "canonical" in found.get("rel", "").lower().split():
            to = found.get("href")
    elif found.get("http-equiv", "").lower() == "refresh":
        named = _REFRESH.search(found.get("content", ""))
        to = named[1] if named else found.get("url")  # an unquoted content ends at its space
    if not to or _ABSOLUTE.match(to):
        return to or None
    try:
        return urljoin(url, to)
    except ValueError:
        return None


@F.pandas_udf(StringType())
def _targets(urls: pd.Series, tags: pd.Series) -> pd.Series:
    return pd.Series([target_of(u, t) for u, t in zip(urls, tags, strict=True)], dtype=object)


def _part(url: Column, i: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, i), F.lit(""))


def host_of(url: Column) -> Column:
    return ascii_lower(_part(url, 1))


def path_of(url: Column) -> Column:
    return _part(url, 2)


def node_of(url: Column) -> Column:
    """What two spellings of one page share: host, path and query, without scheme and fragment."""
    return F.concat(host_of(url), path_of(url), _part(url, 3))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as a struct (size, rule, verdict), or null. Looks up the host's suffixes: no join."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    by_host: dict[str, list[Rule]] = {}
    for r in rules:
        by_host.setdefault(r[1], []).append(r)
    entry = lambda v, h, p: F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(p).alias("path"))
    known = F.create_map(*[x for h, rs in by_host.items() for x in (F.lit(h), F.array(*[entry(*r) for r in rs]))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.filter(F.try_element_at(known, s), lambda r: path.startswith(r["path"])), F.array().cast("array<struct<size:int,rule:string,verdict:string,path:string>>"))))
    return F.array_max(fits)


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): nodes of a page and of each canonical link and meta refresh that its html names, in either order of attributes.

    Entities in a target are decoded, and relative targets are resolved against the page's url. OP5_SQL knows less: one
    target of each kind, absolute or from the root.
    """
    ship(pages.sparkSession)
    tags = F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_TAG), F.lit(0)))
    named = pages.filter("url IS NOT NULL").select("url", F.explode(tags).alias("tag")).filter(F.col("tag").rlike("(?i)canonical|refresh"))
    full = named.select("url", _targets("url", "tag").alias("to"))
    return full.select(node_of(F.col("url")).alias("a"), node_of(F.col("to")).alias("b")).filter("a <> '' AND b <> ''")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, edges: DataFrame | None = None) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict.

    A page that a rule fits gets its verdict; an explicit allow thereby wins over any alias. A page without a rule is
    blocked if a block rule fits some url of its component over redirect and canonical links (those in html, and
    `edges` (a, b) of urls, if given), and allowed otherwise. Null urls and urls without :// have empty host and path,
    no rule, no aliases. Equal urls are one node. Only linked nodes take part in the components. An empty table gives
    no rows. Columns besides page_id, url and html are not read.
    """
    links = alias_edges(pages)
    if edges is not None:
        a, b = edges.columns[:2]
        links = links.union(edges.select(node_of(F.col(a)), node_of(F.col(b))).toDF("a", "b").filter("a <> '' AND b <> ''"))
    found = connected_components(links)
    host = F.regexp_extract("node", "^[^/?]*", 0)
    path = F.regexp_extract("node", r"^[^/?]*([^?]*)", 1)
    bad = found.filter(rule_of(host, path, rules)["verdict"] == "block").select(F.col("component").alias("c")).distinct()
    blocked = materialise(found.join(bad, F.col("component") == F.col("c"), "left_semi").select("node").distinct())
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("n"))
    ruled = parsed.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    marked = ruled.join(blocked, F.col("n") == F.col("node"), "left")
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("node").isNotNull(), "block").otherwise("allow"))
    return marked.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"))


def op5_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


OP5_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, html,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)', 2) AS path,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)', 3) AS query FROM pages),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
named AS (
  SELECT host, host || path || query AS a, unnest([
    regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_extract(html, '(?is)<link\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)["'']?[^>]*\brel\s*=\s*["'']?canonical\b', 1),
    regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\burl\s*=\s*["'']?([^"''\s>]+)', 1)]) AS t FROM p),
full_url AS (SELECT a, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN 'http:' || t WHEN starts_with(t, '/') THEN 'http://' || host || t END AS u FROM named WHERE t <> ''),
edge AS (SELECT a, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(u, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS b FROM full_url WHERE u IS NOT NULL),
sym AS (SELECT a, b FROM edge WHERE a <> '' AND b <> '' UNION SELECT b, a FROM edge WHERE a <> '' AND b <> ''),
reach(a, b) AS (SELECT a, a FROM sym UNION SELECT r.a, e.b FROM reach r JOIN sym e ON r.b = e.a),
bad AS (SELECT DISTINCT r.a FROM reach r WHERE (SELECT arg_max(verdict, len(rhost || rpath)) FROM rules
        WHERE (regexp_extract(r.b, '^[^/?]*') = rhost OR ends_with(regexp_extract(r.b, '^[^/?]*'), '.' || rhost)) AND starts_with(regexp_extract(r.b, '^[^/?]*([^?]*)', 1), rpath)) = 'block'),
best AS (SELECT page_id, arg_max(rhost || rpath, len(rhost || rpath)) AS rule, arg_max(verdict, len(rhost || rpath)) AS verdict
         FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, best.rule, coalesce(best.verdict, CASE WHEN bad.a IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best ON p.page_id = best.page_id LEFT JOIN bad ON host || path || query = bad.a
"""

"""URL filters whose block decisions reach the aliases of a page.

A page's own rule (host and path prefix) decides first. Pages without a rule follow their aliases: redirects and
canonical links are edges between addresses, connected components of these are one page under several names, and a
component with a blocked address blocks its members without a rule of their own. An explicit allow stays an allow.

DataFrame functions only: links are read from the markup by expressions, components are found by joins.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.llm.components import components


class Rule(NamedTuple):
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

_HOST, _PATH = r"://([^/?#]*)", r"://[^/?#]*([^?#]*)"
_QUERY = r"://[^/?#]*[^?#]*\?([^#]*)"
_CANONICAL = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\bcontent\s*=\s*[\"']?[^\"'>]*?\burl\s*=\s*['\"]?([^\"'>\s]+)"
#: What holds text, not markup: links in it are none of the page's.
_NO_MARKUP = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea)\b.*?(?:</\1\s*>|\z)"
_TRACKING = r"(?i)(^|&)(?:utm_[a-z]+|gclid|fbclid)=[^&]*"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the path, A-Z lower-cased; empty without one or for a null."""
    return F.translate(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What stands between the host and the query or fragment; empty without a host or for a null."""
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def address(url: Column) -> Column:
    """The name under which a page is known: no scheme, fragment or tracking parameters; null if there is no host."""
    query = F.ltrim(F.regexp_replace(F.regexp_extract(url, _QUERY, 1), _TRACKING, ""), F.lit("&"))
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    return F.when(host_of(url) != "", F.concat(host_of(url), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Name and action of the longest rule that fits, as a struct; null if none does. Of equally long ones an allow."""
    found = F.lit(None).cast("struct<name:string,action:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.action == "allow", r.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.action).alias("action"))).otherwise(found)
    return found


def absolute(target: Column, base: Column) -> Column:
    """A link's target seen from the page ``base``; null for an empty one. Dot segments stay as they are written."""
    target = F.replace(F.trim(target), F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(base, r"^([^:/?#]*:)//", 1)
    root = F.regexp_extract(base, r"^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when((target == "") | target.startswith("#"), None)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.startswith("?"), F.concat(root, path_of(base), target))
        .otherwise(F.concat(folder, F.when(folder.endswith("/"), "").otherwise("/"), target))
    )


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source, target) addresses in full: canonical links and refresh redirects in the markup of ``pages``.

    The first of each kind counts; comments, scripts and styles are no markup. Null pages and pages without an
    address have no edges.
    """
    page = pages.select(F.col(url_col).alias("source"), F.col(html_col).alias("html")).where(
        F.lower("html").contains("canonical") | F.lower("html").contains("refresh")
    )
    markup = F.regexp_replace("html", _NO_MARKUP, " ")
    canonical = F.concat(*(F.regexp_extract(markup, _CANONICAL, k) for k in (1, 2, 3)))
    both = page.select("source", F.explode(F.array(canonical, F.regexp_extract(markup, _REFRESH, 1))).alias("link"))
    return both.select("source", absolute(F.col("link"), F.col("source")).alias("target")).where("source IS NOT NULL AND target IS NOT NULL")


def blocked_addresses(edges: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(node) of every address in a component that has a blocked one; ``edges`` (source, target) are full addresses.

    A node is the digest of an address. An address of a hot component or with many links is reduced to counts where
    its rows lie; nothing reaches the driver but a count and a checksum of each round of the components.
    """
    def judged(end: str) -> Column:
        return F.coalesce(rule_of(host_of(F.col(end)), path_of(F.col(end)), rules)["action"] == "block", F.lit(False))

    ends = edges.select(
        F.md5(address(F.col("source"))).alias("a"), F.md5(address(F.col("target"))).alias("b"),
        judged("source").alias("a_blocked"), judged("target").alias("b_blocked"),
    ).where("a <> b").groupBy("a", "b").agg(F.max("a_blocked").alias("a_blocked"), F.max("b_blocked").alias("b_blocked"))
    member = components(ends.select("a", "b"))
    guilty = ends.select(F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.col("a_blocked").alias("blocked")),
        F.struct(F.col("b").alias("node"), F.col("b_blocked").alias("blocked")),
    )).alias("end")).select("end.*").where("blocked").select("node").distinct()
    groups = member.join(guilty, "node").select("component").distinct()
    return member.join(groups, "component").select("node")


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, redirects: DataFrame | None = None, url_col: str = "url",
          html_col: str = "html") -> DataFrame:
    """``pages`` with a struct ``url_filter`` (host, path, rule, verdict, by) for each row.

    ``rule`` is the name of the page's own longest rule, null if none fits; ``by`` says what decided: the ``rule``, an
    ``alias`` (a redirect or canonical link leads, over any number of steps and in either direction, to a blocked
    address) or ``default`` (allow). ``redirects`` (source, target) adds redirects seen elsewhere, as full addresses.
    A null url has empty parts and is allowed; a null page has no links; repeated pages are judged alike; an empty table
    gives no rows. Other columns are kept, except that one named ``url_filter`` is replaced.
    """
    edges = link_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.union(redirects.select("source", "target"))
    blocked = blocked_addresses(edges, rules).select("node", F.lit(True).alias("alias"))
    kept = [c for c in pages.columns if c != "url_filter"]
    url = F.col(url_col)
    row = pages.select(F.struct(*kept).alias("row"), host_of(url).alias("host"), path_of(url).alias("path"), F.md5(address(url)).alias("node"))
    row = row.withColumn("own", rule_of(F.col("host"), F.col("path"), rules)).join(blocked, "node", "left")
    alias = F.coalesce(F.col("alias"), F.lit(False))
    verdict = F.coalesce(F.col("own.action"), F.when(alias, "block").otherwise("allow"))
    by = F.when(F.col("own").isNotNull(), "rule").when(alias, "alias").otherwise("default")
    result = F.struct("host", "path", F.col("own.name").alias("rule"), verdict.alias("verdict"), by.alias("by"))
    return row.select("row.*", result.alias("url_filter"))


_RULE_ROWS = ", ".join(f"('{r.name}', '{r.action}', '{r.host}', '{r.path}')" for r in RULES)
_DUCK_CANONICAL = r"(?is)<link\b[^>]*?\brel\s*=\s*[\"'']?canonical\b[^>]*>"
_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase

#: The same over DuckDB. RE2 has no look-ahead, so a link's tag is found first, then its target.
ORACLE = rf"""
WITH RECURSIVE rules(name, action, host, path) AS (VALUES {_RULE_ROWS}),
page AS (
  SELECT page_id, url, regexp_replace(html, '(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<textarea\b.*?(?:</textarea\s*>|\z)', ' ', 'g') AS markup
  FROM pages),
link AS (
  SELECT url AS source, regexp_extract(regexp_extract(markup, '{_DUCK_CANONICAL}'), '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS link FROM page
  UNION ALL
  SELECT url, regexp_extract(regexp_extract(markup, '(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?i)\burl\s*=\s*["'']?([^"''>\s]+)', 1) FROM page),
edge AS (
  SELECT source, CASE WHEN link = '' OR link LIKE '#%' THEN NULL
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link
    WHEN link LIKE '//%' THEN regexp_extract(source, '^([^:/?#]*:)//', 1) || link
    WHEN link LIKE '/%' THEN regexp_extract(source, '^(.*?://[^/?#]*)', 1) || link
    WHEN link LIKE '?%' THEN regexp_extract(source, '^(.*?://[^/?#]*[^?#]*)', 1) || link
    ELSE rtrim(regexp_extract(source, '^(.*?://[^/?#]*(?:/[^?#]*/|/)?)', 1), '/') || '/' || link END AS target
  FROM (SELECT source, replace(trim(link), '&amp;', '&') AS link FROM link)),
url AS (SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT source FROM edge UNION ALL SELECT target FROM edge)),
part AS (
  SELECT url, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
    ltrim(regexp_replace(coalesce(regexp_extract(url, '://[^/?#]*[^?#]*\?([^#]*)', 1), ''), '(?i)(^|&)(?:utm_[a-z]+|gclid|fbclid)=[^&]*', '', 'g'), '&') AS query
  FROM url),
judged AS (
  SELECT p.url, p.host, p.path, CASE WHEN p.host <> '' THEN p.host || CASE WHEN p.path = '' THEN '/' ELSE p.path END || CASE WHEN p.query <> '' THEN '?' || p.query ELSE '' END END AS address,
    arg_max(r.name, length(r.name)) AS rule, arg_max(r.action, length(r.name)) AS action
  FROM part p LEFT JOIN rules r ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path)
  GROUP BY ALL),
linked AS (
  SELECT DISTINCT a.address AS a, b.address AS b FROM edge e JOIN judged a ON a.url = e.source JOIN judged b ON b.url = e.target
  WHERE e.target IS NOT NULL AND a.address IS NOT NULL AND b.address IS NOT NULL),
reached AS (
  SELECT DISTINCT j.address FROM judged j JOIN linked l ON j.address IN (l.a, l.b) WHERE j.action = 'block'
  UNION
  SELECT CASE WHEN l.a = r.address THEN l.b ELSE l.a END FROM reached r JOIN linked l ON r.address IN (l.a, l.b))
SELECT p.page_id, j.host, j.path, j.rule,
  coalesce(j.action, CASE WHEN r.address IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN j.rule IS NOT NULL THEN 'rule' WHEN r.address IS NOT NULL THEN 'alias' ELSE 'default' END AS "by"
FROM pages p JOIN judged j ON p.url IS NOT DISTINCT FROM j.url LEFT JOIN reached r ON r.address = j.address
"""

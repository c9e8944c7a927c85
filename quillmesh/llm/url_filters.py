"""URL filters: rules for hosts and paths, and block decisions that pass on to redirect and canonical-link aliases.

Rules are a table. Each URL's host suffixes are joined to the rules' hosts, then its path's prefixes, of the lengths that
those hosts have rules for, to the rules themselves; so the number of rules is not bounded by a plan or a task.

Pages that redirect to each other or name each other as canonical are one document under several URLs. Connected
components over those edges pass a block on to all its aliases; an explicit allow anywhere among them takes precedence.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.components import components
from quillmesh.llm.shared import publish

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this number are broadcast (after they are counted); more are merged by a shuffle.
BROADCAST_RULES = 10_000


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains, if the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """Host, path and query of a URL: the scheme and the fragment don't make another page. '' for no URL."""
    return F.concat(host_of(url), F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1), F.lit("")))


def rule_table(spark: SparkSession, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    """Rules as rows: verdict, host, path, place (the order among rules of equal length).

    A DataFrame has verdict, host and path; allow goes before block there, then the lesser host. Rows with a null host
    or path or another verdict fit nothing; repeated rules count once.
    """
    if isinstance(rules, DataFrame):
        table = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), "path", F.lit(0).alias("place"))
    else:
        listed = json.dumps([{"verdict": r.verdict, "host": r.host, "path": r.path, "place": k} for k, r in enumerate(rules)])
        table = spark.range(1).select(F.explode(F.from_json(F.lit(listed), "array<struct<verdict:string,host:string,path:string,place:int>>")).alias("r")).select("r.*")
    return table.filter("host is not null and path is not null and verdict in ('allow', 'block')").distinct()


def sized(table: DataFrame, rows: int) -> DataFrame:
    """A table of rules with the hint for its joins: broadcast only where its counted rows are few."""
    return F.broadcast(table) if rows <= BROADCAST_RULES else table.hint("merge")


def matching_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, name and verdict of the longest rule that fits, for each distinct (host, path) that one fits."""
    rules = publish(rules)
    n = rules.count()
    hosts = rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    asked = urls.select("host", "path").distinct().withColumn("suffix", F.explode(suffixes))
    asked = asked.join(sized(hosts.withColumnRenamed("host", "suffix"), n), "suffix")
    asked = asked.select("host", "path", "suffix", F.explode(F.filter("lengths", lambda k: k <= F.length("path"))).alias("length"))
    asked = asked.select("host", "path", "suffix", F.substring("path", F.lit(1), F.col("length")).alias("prefix"))
    fits = asked.join(sized(rules.select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), "verdict", "place"), n), ["suffix", "prefix"])
    name = F.concat("suffix", "prefix")
    best = F.max(F.struct(F.length(name).alias("size"), (-F.col("place")).alias("place"), (F.col("verdict") == "allow").alias("allowed"), name.alias("name"), F.col("verdict").alias("verdict")))
    return fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.name", "best.verdict")


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted or not; '' where it lacks it."""
    found = F.regexp_extract(tag, rf"(?is)[\s\"']{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    return F.trim(F.regexp_replace(found, "^[\"']|[\"']$", ""))


def resolved(base: Column, link: Column) -> Column:
    """A link in full: absolute, relative to the scheme, to the host or to the page's folder."""
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, "(?s)^(.*?:)//", 1), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), link))
    )


def links_of(pages: DataFrame) -> DataFrame:
    """Edges from each page to its canonical link and to the target of its refresh: source, target."""
    tags = pages.filter("url is not null and html is not null").select("url", F.explode(F.expr(r"regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>', 0)")).alias("tag"))
    canonical = F.when(F.array_contains(F.split(F.lower(attribute(F.col("tag"), "rel")), r"\s+"), "canonical"), attribute(F.col("tag"), "href"))
    refresh = F.when(F.lower(attribute(F.col("tag"), "http-equiv")) == "refresh", F.trim(F.regexp_replace(F.regexp_extract(attribute(F.col("tag"), "content"), r"(?is);\s*url\s*=\s*(.*)$", 1), "^[\"']|[\"']$", "")))
    found = tags.select("url", F.coalesce(canonical, refresh).alias("link")).filter("link is not null and link != ''")
    return found.select(F.col("url").alias("source"), resolved(F.col("url"), F.col("link")).alias("target"))


def judge_pages(pages: DataFrame, rules: Sequence[Rule] | DataFrame = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Judge every page's URL; one row per input row: page_id, host, path, rule, verdict.

    ``rules`` are a sequence or a table of any size (see ``rule_table``). ``redirects`` (source, target) adds edges to
    those that the pages' HTML names. A page with a rule has its verdict. Others: ``allow`` if an alias is explicitly
    allowed, else ``block`` if one is blocked, else ``allow``. A null URL or one without ``://`` has an empty host and
    path and no aliases; null HTML names no links; a null page_id stays null; repeated rows give repeated rows; an
    empty table gives none; other columns are not looked at.
    """
    url = F.col("url")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    edges = links_of(pages.select("url", "html"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select("source", "target"))
    edges = edges.filter(F.col("source").contains("://") & F.col("target").contains("://")).select("source", "target", node_of(F.col("source")).alias("u"), node_of(F.col("target")).alias("v"))
    edges = publish(edges)
    # Targets that are no page of the table have rules of their own.
    ends = edges.select(F.col("u").alias("node"), F.col("source").alias("url")).unionAll(edges.select(F.col("v").alias("node"), F.col("target").alias("url")))
    ends = ends.select("node", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).distinct()
    fits = publish(matching_rules(base.select("host", "path").unionAll(ends.select("host", "path")), rule_table(pages.sparkSession, rules)))
    roots = components(edges)
    said = ends.join(fits.hint("merge"), ["host", "path"]).select("node", "verdict")
    decided = said.join(roots, "node").groupBy("root").agg(F.min("verdict").alias("passed"))  # allow is before block
    passed = roots.join(decided, "root").select("node", "passed")
    judged = base.join(fits.withColumnRenamed("name", "rule").hint("merge"), ["host", "path"], "left").join(passed.hint("merge"), "node", "left")
    verdict = F.coalesce(F.col("verdict"), F.when(F.col("host") != "", F.col("passed")), F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


# Rules and their order for SQL: longest first, so the first that fits wins.
_SQL_RULES = ", ".join(f"({k}, '{r.name}', '{r.verdict}', '{r.host}', '{r.path}')" for k, r in enumerate(sorted(RULES, key=lambda r: -len(r.name))))
_SQL_LINK = re.sub(r"\s+", " ", r"""
  SELECT url, tag, regexp_extract(tag, '(?is)[\s"'']rel\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1) AS rel,
         trim(trim(regexp_extract(tag, '(?is)[\s"'']href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '"''')) AS href,
         lower(trim(regexp_extract(tag, '(?is)[\s"'']http-equiv\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '"''')) AS equiv,
         regexp_extract(tag, '(?is)[\s"'']content\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1) AS content
  FROM (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL)
""")

#: Absolute links only; the reach of each node by a recursive query.
SQL = rf"""
WITH RECURSIVE rules(k, name, verdict, host, path) AS (VALUES {_SQL_RULES}),
tags AS ({_SQL_LINK}),
links AS (SELECT url AS source, href AS target FROM tags WHERE list_contains(string_split(lower(trim(rel, '"''')), ' '), 'canonical') AND href <> ''
  UNION ALL SELECT url, trim(regexp_extract(trim(content, '"'''), '(?is);\s*url\s*=\s*(.*)$', 1), '"''') FROM tags WHERE equiv = 'refresh'),
urls AS (SELECT url FROM pages UNION SELECT source FROM links UNION SELECT target FROM links),
parts AS (SELECT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS rest FROM urls),
fit AS (SELECT p.url, min_by(r.name, r.k) AS name, min_by(r.verdict, r.k) AS verdict FROM parts p JOIN rules r
  ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.url),
nodes AS (SELECT p.url, p.host || p.rest AS node, f.verdict FROM parts p LEFT JOIN fit f ON p.url = f.url),
edges AS (SELECT a.node AS u, b.node AS v FROM links l JOIN nodes a ON a.url = l.source JOIN nodes b ON b.url = l.target WHERE contains(l.target, '://')),
both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach(u, v) AS (SELECT u, v FROM both_ways UNION SELECT r.u, e.v FROM reach r JOIN both_ways e ON r.v = e.u),
passed AS (SELECT r.u AS node, min(n.verdict) AS verdict FROM reach r JOIN nodes n ON n.node = r.v WHERE n.verdict IS NOT NULL GROUP BY r.u)
SELECT p.page_id, coalesce(q.host, '') AS host, coalesce(q.path, '') AS path, f.name AS rule,
  coalesce(f.verdict, CASE WHEN q.host <> '' THEN s.verdict END, 'allow') AS verdict
FROM pages p LEFT JOIN parts q ON p.url = q.url LEFT JOIN fit f ON f.url = p.url LEFT JOIN nodes n ON n.url = p.url LEFT JOIN passed s ON s.node = n.node
"""

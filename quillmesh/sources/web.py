"""A bounded crawl over landed pages, robots rules and sitemaps."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.functions.urls import crawl_key, fetchable, robots_allows, same_origin
from quillmesh.operators.published import shared_folder, written
from quillmesh.sources.html import join

MAX_PAGES = 50
# Name spaces of sitemaps.
SITEMAP_SPACES = ("", "http://www.sitemaps.org/schemas/sitemap/0.9")


def robots_rules(text: str, agent: str) -> list[tuple[str, str]]:
    """Directives and paths of the groups for an agent: those of the longest prefix of its name, else those for all.

    A group ends at a blank line, or at a user-agent line after directives; comments don't end it.
    """
    groups: list[tuple[list[str], list[tuple[str, str]]]] = [([], [])]
    for raw in text.lstrip("﻿").splitlines():
        if not raw.strip():
            groups.append(([], []))
            continue
        key, colon, value = (x.strip() for x in raw.split("#", 1)[0].partition(":"))
        if not colon:
            continue
        if key.lower() == "user-agent":
            if groups[-1][1] or groups[-1][0] and groups[-1][0][-1] == "":
                groups.append(([], []))
            groups[-1][0].append(value.lower())
        elif key.lower() in ("allow", "disallow") and groups[-1][0]:
            groups[-1][1].append((key.lower(), unquote(value)))
    named = agent.lower().split("/", 1)[0].strip()

    def score(names: list[str]) -> int:
        return max((len(n) for n in names if n != "*" and (named.startswith(n) or agent.lower().startswith(n))), default=-1)

    best = max((score(names) for names, _ in groups), default=-1)
    fit = [rules for names, rules in groups if (score(names) == best if best >= 0 else "*" in names)]
    return [(d, p) for rules in fit for d, p in rules if p]


def robots_table(landed: DataFrame, agent: str) -> DataFrame:
    """Landed robots files (origin, text) as rules per origin."""

    @F.pandas_udf("array<struct<directive:string,path:string>>")
    def rules(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"directive": d, "path": p} for d, p in robots_rules(t or "", agent)])

    return landed.select("origin", rules("text").alias("rules"))


def sitemap(url: str, body: str) -> tuple[list[str], bool] | None:
    """Locations of a sitemap in order, and whether it was read without doubt; None if it is none."""
    try:
        root = ElementTree.fromstring(body.lstrip("﻿ \t\r\n"))
    except ElementTree.ParseError:
        return None

    def split(tag: str) -> tuple[str, str]:
        space, brace, name = tag.rpartition("}")
        return space.removeprefix("{") if brace else "", name

    space, name = split(root.tag)
    if space not in SITEMAP_SPACES or name not in ("urlset", "sitemapindex"):
        return None
    found, sure = [], True
    for child in root:
        if not isinstance(child.tag, str):
            continue
        if split(child.tag) != (space, "url" if name == "urlset" else "sitemap"):
            sure = False
            continue
        texts = [(e.text or "").strip() for e in child if isinstance(e.tag, str) and split(e.tag) == (space, "loc")]
        sure &= bool(texts) and all(texts[: next((k + 1 for k, t in enumerate(texts) if t), len(texts))])
        link = join(url, next((t for t in texts if t), "")) if any(texts) else None
        if link is None or link == url:
            sure = False
        else:
            found.append(link)
    return found, sure and bool(found)


def sitemap_links(landed: DataFrame, *keep: str) -> DataFrame:
    """Locations of landed sitemaps (url, text): the columns to keep, position, link, and whether the sitemap was read
    without doubt. Bodies that are no sitemap give none."""

    @F.pandas_udf("struct<links:array<string>,sure:boolean>")
    def read(url: pd.Series, text: pd.Series) -> pd.DataFrame:
        found = [sitemap(u, t or "") or ([], False) for u, t in zip(url, text, strict=True)]
        return pd.DataFrame({"links": [a for a, _ in found], "sure": [b for _, b in found]})

    each = landed.withColumn("found", read("url", "text"))
    return each.select(*keep, F.posexplode("found.links").alias("position", "link"), F.col("found.sure").alias("sure"))


@dataclass(frozen=True)
class SnapshotInfo:
    """Whether a snapshot is whole, and to which ids stale cleanup is limited."""

    complete: bool
    prefixes: tuple[str, ...] = ()


def crawl(
    pages: DataFrame, links: DataFrame | Callable[[DataFrame], DataFrame], seeds: Iterable[str], max_pages: int = MAX_PAGES, robots: DataFrame | None = None, sitemaps: DataFrame | None = None,
) -> tuple[DataFrame, SnapshotInfo]:
    """Pages (url) that a breadth-first crawl from the seeds reaches: key, url, depth, position; at most ``max_pages``.

    ``links``: url, link, position; or a function that adds link and position to the frontier's rows of ``pages`` (so
    that only the frontier's links are ever made). Every round joins the first of the queue with the links of their
    pages and queues the first link to each new page by (position of the page, position of the link). ``sitemaps`` (url,
    text, landed): their locations of a seed's origin are queued behind the seeds, and reading them costs no page.

    A page that didn't land costs an attempt, not a page; there are two attempts a page and one a seed. Links that find
    no room wait, up to ``max_pages`` of them. So the number of rounds and the queue are bounded. Links that can't wait,
    attempts that run out, links that robots forbid, doubtful sitemaps and pages that didn't land make the snapshot
    incomplete. ``robots``: origin, rules.

    What was ever queued is a table (place, key, link, depth), to which each round appends; its keys are those that are
    known, and a round takes the next places. The driver holds counts only.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark)
    landed = written(pages.select(crawl_key(F.col("url")).alias("key"), "url").dropDuplicates(["key"]), f"{folder}/landed")
    start = spark.createDataFrame([(k, u) for k, u in enumerate(seeds)], "position int, link string")
    start = start.filter(fetchable(F.col("link"))).select("position", "link", crawl_key(F.col("link")).alias("key"))
    queued, seen = Appended(spark, f"{folder}/queued", QUEUED), Appended(spark, f"{folder}/seen", SEEN)
    complete = True

    def allowed(found: DataFrame) -> DataFrame:
        """Links that robots allow; one that they forbid leaves the snapshot incomplete."""
        nonlocal complete
        if robots is None:
            return found
        origin = F.lower(F.regexp_extract("link", "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
        judged = found.withColumn("origin", origin).join(robots, "origin", "left").withColumn("allowed", F.coalesce(robots_allows(F.col("link"), F.col("rules")), F.lit(True)))
        complete &= judged.filter("not allowed").isEmpty()
        return judged.filter("allowed")

    def add(found: DataFrame, order: Column, depth: Column, room: int) -> None:
        """Queue the first link to each new page, while they can wait. A queue's room bounds what is numbered here."""
        nonlocal complete
        keyed = found.filter(fetchable(F.col("link"))).withColumn("key", crawl_key(F.col("link")))
        fresh = allowed(keyed.join(queued.table.select("key"), "key", "left_anti"))
        first = fresh.groupBy("key").agg(F.min_by("link", order).alias("link"), F.min_by(depth, order).alias("depth"), F.min(order).alias("o"))
        few = first.orderBy("o").limit(max(0, room) + 1)
        placed = few.select((F.row_number().over(Window.orderBy("o")) - 1 + queued.count).cast("long").alias("place"), "key", "link", F.col("depth").cast("int").alias("depth"))
        complete &= queued.append(placed, room) <= room

    begun = start.groupBy("key").agg(F.min_by("link", "position").alias("link"), F.min("position").alias("p"))
    queued.append(begun.select((F.row_number().over(Window.orderBy("p")) - 1).cast("long").alias("place"), "key", "link", F.lit(0).alias("depth")))
    attempts, taken = 2 * max_pages + queued.count, 0
    if sitemaps is not None:
        found = sitemap_links(sitemaps, "url")
        read = sitemap_links(sitemaps).agg(F.bool_and("sure")).first()[0]
        complete &= bool(read) and found.select("url").distinct().count() == sitemaps.count()
        origins = F.broadcast(start.select(F.col("link").alias("seed")).distinct())
        add(found.join(origins, same_origin(F.col("seed"), F.col("link"))).select("url", "position", "link"), F.struct("url", "position"), F.lit(1), 2 * max_pages - queued.count)
    while taken < queued.count and seen.count < max_pages and attempts > 0:
        take = min(max_pages - seen.count, attempts, queued.count - taken)
        now = queued.table.filter((F.col("place") >= taken) & (F.col("place") < taken + take))
        attempts, taken = attempts - take, taken + take
        got = now.join(landed, "key").select("key", "url", "depth", (F.row_number().over(Window.orderBy("place")) - 1 + seen.count).cast("int").alias("position"))
        complete &= seen.append(got) == take
        source = pages if callable(links) else links
        rows = now.select("key", F.col("place").alias("of_place"), F.col("depth").alias("of_depth"))
        out = rows.join(source.withColumn("key", crawl_key(F.col("url"))), "key")
        out = (links(out) if callable(links) else out).filter(same_origin(F.col("url"), F.col("link"))).drop("key")
        add(out, F.struct("of_place", "position"), F.col("of_depth") + 1, 2 * max_pages - seen.count - (queued.count - taken))
    complete &= taken == queued.count
    return seen.table, SnapshotInfo(complete, ("web:",))


QUEUED, SEEN = "place long, key string, link string, depth int", "key string, url string, depth int, position int"


class Appended:
    """A table that grows by parts; each is written once, and folded with the others after some."""

    PARTS = 8

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.folder, self.count, self.written_parts = folder, 0, 0
        self.parts: list[DataFrame] = []
        self.none = spark.createDataFrame([], schema)

    @property
    def table(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts) if self.parts else self.none

    def append(self, rows: DataFrame, most: int | None = None) -> int:
        """Write more rows, of which the first ``most`` by place count; how many there are."""
        part = self._write(rows)
        n = part.count()
        if most is not None and n > most:
            part = part.filter(F.col("place") < self.count + max(0, most))
        self.count += n if most is None else min(n, max(0, most))
        self.parts.append(part)
        if len(self.parts) > self.PARTS:
            self.parts = [self._write(self.table)]
        return n

    def _write(self, rows: DataFrame) -> DataFrame:
        self.written_parts += 1
        return written(rows, f"{self.folder}/{self.written_parts:06d}")

"""Pages landed as HTML: text, title, links, canonical link; blog posts. Small parsers run in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.urls import credential_like, crawl_key, fetchable, same_origin

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Elements that hold no text of a page; a blog's content and advertisement elements, in order.
PRUNED = {"base", "footer", "head", "header", "link", "meta", "nav", "noscript", "script", "style"}
BLOG_CONTENT = (("div", "class", "entry-content"), ("div", "class", "article"), ("div", "class", "post-content"), ("div", "class", "tt_article_useless_p_margin"), ("div", "class", "contents_style"), ("div", "id", "content"))
BLOG_ADS = (("div", "revenue_unit_wrap"), ("ins", "google-auto-placed"))
#: An ampersand that begins no whole character reference.
BARE = re.compile(r"&(?!(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);)")


class Node:
    """An element (or the whole page, without a name); children are nodes and strings in order."""

    __slots__ = ("name", "attrs", "children", "parent")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None):
        self.name, self.attrs, self.children, self.parent = name, attrs, [], parent

    def all(self, fits: Callable[[Node], bool]) -> list[Node]:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if node is not self and fits(node):
                out.append(node)
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
        return out

    def first(self, name: str) -> Node | None:
        return next(iter(self.all(lambda n: n.name == name)), None)

    def strings(self, skip: Callable[[Node], bool]) -> list[str]:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            elif node is self or not skip(node):
                todo += reversed(node.children)
        return out

    def drop(self) -> None:
        """Cut the links to parents, so that a tree is freed once it is left, not when cycles are collected."""
        for node in self.all(lambda _: True):
            node.parent = None

    def inside(self, name: str) -> bool:
        node = self.parent
        while node is not None and node.name != name:
            node = node.parent
        return node is not None


class Tree(HTMLParser):
    """``bare``: references that lack their semicolon (&amp) are read too; else they are plain text."""

    def __init__(self, html: str, bare: bool = True):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.feed(html if bare else BARE.sub("&amp;", html))
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag.rpartition(":")[2], {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag.rpartition(":")[2], {k: v or "" for k, v in reversed(attrs)}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node, name = self.at, tag.rpartition(":")[2]
        while node is not None and node.name != name:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def clean(strings: list[str]) -> str:
    return "\n".join(x.strip() for s in strings for x in s.splitlines() if x.strip())


def flat(node: Node | None) -> str:
    return "".join(x.strip() for x in node.strings(lambda _: False)) if node else ""


def head_of(root: Node) -> Node | None:
    """The page's head: the first, if only white space stands before it and it is the page's or its html's child."""

    def leads(node: Node) -> bool:
        for c in node.parent.children:
            if c is node:
                return True
            if isinstance(c, Node) or c.strip():
                return False
        return False

    for head in root.all(lambda n: n.name == "head"):
        if leads(head) and (head.parent is root or head.parent.name == "html" and head.parent.parent is root and leads(head.parent)):
            return head
    return None


def join(base: str, link: str) -> str | None:
    try:
        joined = urldefrag(urljoin(base, link.strip()))[0]
        return joined if urlsplit(joined).scheme in ("http", "https") else None
    except ValueError:
        return None


def joined(base: Column, link: Column) -> Column:
    """Links in full, without fragments; null where they lead to no page."""

    @F.pandas_udf("string")
    def run(base: pd.Series, link: pd.Series) -> pd.Series:
        return pd.Series([None if b is None or x is None else join(b, x) for b, x in zip(base, link, strict=True)], dtype=object)

    return run(base, link)


def parse(url: str, html: str, bare: bool = True) -> dict:
    """Title, text, base, canonical link ('' for none), links in order, and whether any was malformed or out of place."""
    root = Tree(html or "", bare).root
    title = flat(root.first("h1")) or flat(root.first("title")) or url
    head, odd = head_of(root), False
    metas = {"base": "", "link": ""}
    for node in root.all(lambda n: n.name == "base" or n.name == "link" and "canonical" in n.attrs.get("rel", "").lower().split()):
        if head is None or node.parent is not head:
            odd = True
        elif not metas[node.name]:
            metas[node.name] = node.attrs.get("href", "").strip()
            odd |= node.name == "link" and not metas["link"]
    base = join(url, metas["base"]) if metas["base"] else url
    odd |= base is None
    base = base or url
    links = []
    for a in root.all(lambda n: n.name == "a" and bool(n.attrs.get("href"))):
        try:
            kind = urlsplit(a.attrs["href"].strip()).scheme.lower()
        except ValueError:
            kind = ""
        if kind in ("", "http", "https"):
            found = join(base, a.attrs["href"])
            odd |= found is None
            if found:
                links.append(found)

    def pruned(n: Node) -> bool:
        return n.name in PRUNED or n.name == "title" and not n.inside("svg")

    kept = [n for n in root.all(lambda n: n.name in ("article", "main", "body")) if not any(map(n.inside, PRUNED))]
    body = next((n for name in ("article", "main", "body") for n in kept if n.name == name), root)
    canonical = join(base, metas["link"]) if metas["link"] else ""
    content = clean(body.strings(pruned))
    root.drop()
    return {"title": title, "content": content, "base": base, "canonical": canonical or "", "links": links, "odd": odd or canonical is None}


#: Pages in a batch that a Python worker is given: what it holds is a batch's pages, several times over.
BATCH_PAGES = 200


def small_batches(spark: SparkSession) -> None:
    """Let the session's Python workers hold BATCH_PAGES rows at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_PAGES)


PAGE = "struct<title:string,content:string,base:string,canonical:string,links:array<string>,odd:boolean>"


def parsed(url: Column | str, html: Column | str, bare: bool = True) -> Column:
    """``parse`` over batches of pages."""

    @F.pandas_udf(PAGE)
    def run(url: pd.Series, html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(u or "", h or "", bare) for u, h in zip(url, html, strict=True)], columns=["title", "content", "base", "canonical", "links", "odd"])

    return run(url, html)


def extract(pages: DataFrame, allowed: Column | None = None, bare: bool = True) -> DataFrame:
    """Pages (url, html) as web documents, with their links. A canonical link of another origin, or one that may not
    be fetched, counts as none and makes the snapshot incomplete; so does a page without text."""
    small_batches(pages.sparkSession)
    p = pages.withColumn("page", parsed("url", "html", bare))
    told = F.col("page.canonical")
    sound = (told != "") & same_origin(F.col("url"), told) & fetchable(told) & (allowed if allowed is not None else F.lit(True))
    canonical = F.when(sound, crawl_key(told)).otherwise(crawl_key(F.col("url")))
    return p.select(
        F.concat(F.lit("web:"), canonical).alias("external_id"), F.col("page.title").alias("title"), F.col("page.content").alias("content"), canonical.alias("url"),
        canonical.alias("canonical_url"), F.lit("Web").alias("platform"), canonical.alias("path"), canonical.alias("updated_at"), F.col("url").alias("fetched_url"),
        F.col("page.links").alias("links"), (~F.col("page.odd") & ((told == "") | sound) & (F.col("page.content") != "")).alias("complete"),
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Links of extracted pages that a crawl may follow: url, link, position; same origin, the first of each crawl key."""
    each = pages.select(F.col("fetched_url").alias("url"), F.posexplode("links").alias("position", "link")).filter(same_origin(F.col("url"), F.col("link")))
    each = each.withColumn("key", crawl_key(F.col("link")))
    return each.groupBy("url", "key").agg(F.min(F.struct("position", "link")).alias("first")).select("url", "key", "first.link", "first.position")


def canonical_replacement(documents: DataFrame) -> DataFrame:
    """One document an id: it stands where the first fetch stood and has the content of the latest canonical fetch, or
    else of the first. ``documents``: external_id, seq, is_canonical and any other columns."""
    rest = [c for c in documents.columns if c not in ("external_id", "seq", "is_canonical")]
    best = F.struct("is_canonical", F.when(F.col("is_canonical"), F.col("seq")).otherwise(-F.col("seq")))
    return documents.groupBy("external_id").agg(F.min("seq").alias("position"), F.max_by(F.struct(*rest), best).alias("row")).select("external_id", "position", "row.*")


def blog_post(post_id: int, html: str, bare: bool = True) -> tuple[str, str, str]:
    """Title, date and content of a blog post; content '' if there is none."""
    root = Tree(html or "", bare).root
    found = blog_parts(post_id, root)
    root.drop()
    return found


def blog_parts(post_id: int, root: Node) -> tuple[str, str, str]:
    h1 = root.first("h1")
    if h1 is not None:
        title = flat(h1)
    else:
        og = next(iter(root.all(lambda n: n.name == "meta" and n.attrs.get("property") == "og:title")), None)
        title = og.attrs.get("content", "").strip() if og is not None else f"Post {post_id}"
    date = next(iter(root.all(lambda n: n.name == "span" and "date" in n.attrs.get("class", "").split())), None) or root.first("time")

    def ad(n: Node) -> bool:
        return any(n.name == name and cls in n.attrs.get("class", "").split() for name, cls in BLOG_ADS)

    for name, attr, value in BLOG_CONTENT:
        node = next(iter(root.all(lambda n: n.name == name and value in n.attrs.get(attr, "").split())), None)  # noqa: B023
        text = "\n".join(x.strip() for x in node.strings(ad) if x.strip()) if node is not None else ""
        if text:
            return title, flat(date), text
    return title, flat(date), ""


def blog_parsed(post_id: Column | str, html: Column | str, bare: bool = True) -> Column:
    @F.pandas_udf("struct<title:string,date:string,content:string>")
    def run(post_id: pd.Series, html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([blog_post(i, h or "", bare) for i, h in zip(post_id, html, strict=True)], columns=["title", "date", "content"])

    return run(post_id, html)


def blog_posts(landed: DataFrame, blog: str, max_id: int = 200, bare: bool = True) -> DataFrame:
    """Posts 1 to max_id of a blog from landed responses (post_id, status, html), as connector rows in order of their ids."""
    small_batches(landed.sparkSession)
    ids = landed.sparkSession.range(1, max_id + 1).withColumnRenamed("id", "post_id")
    rows = landed.filter("status = 200").join(ids, "post_id", "left_semi").withColumn("post", blog_parsed("post_id", "html", bare)).filter("post.content != ''")
    url = F.concat(F.lit(f"https://{blog}.tistory.com/"), F.col("post_id").cast("string"))
    return rows.select(
        F.concat(F.lit("tistory_"), F.col("post_id").cast("string")).alias("id"), F.concat(F.lit(f"{blog}:"), F.col("post_id").cast("string")).alias("external_id"), "post.title", "post.content",
        url.alias("url"), url.alias("canonical_url"), url.alias("path"), F.lit("Tistory").alias("platform"), "post.date", "post_id",
    )


def post_links(links: DataFrame) -> DataFrame:
    """Distinct links of a search page (link) that aren't searches themselves, with the id at their end."""
    found = links.filter(~F.contains("link", F.lit("/search/"))).dropDuplicates(["link"])
    return found.withColumn("post_id", F.nullif(F.regexp_extract("link", r"/(\d+)$", 1), F.lit("")).cast("long"))


def safe_header(value: Column, kind: str) -> Column:
    """A validator header's value if it is well formed and tells no secret, else ''."""
    form = r'^(?:W/)?"[\x20-\x21\x23-\x7e]*"$' if kind == "etag" else r"^(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), )?\d{1,2} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) \d{4} \d{2}:\d{2}(?::\d{2})?(?: (?:GMT|UTC|[+-]\d{4}))?$"
    return F.when(value.rlike(form) & ~credential_like(value), value).otherwise("")

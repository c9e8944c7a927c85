import base64

import pytest
from pyspark.sql import functions as F

from quillmesh import plans
from quillmesh.plans import landed
from quillmesh.sources import github, html, notion, registry, web


def test_block_trees(spark):
    blocks = [("p", "b2", None, 2, "paragraph", "second"), ("p", "b1", None, 1, "heading_1", " first "), ("p", "c1", "b1", 1, "quote", "nested"), ("p", "c2", "b1", 2, "image", "picture"), ("p", "d1", "c2", 1, "code", "below"), ("q", "x", None, 1, "paragraph", "")]
    chain = [("r", f"n{k}", f"n{k - 1}" if k else None, 1, "paragraph", str(k)) for k in range(14)]
    df = spark.createDataFrame(blocks + chain, "page_id string, block_id string, parent_id string, position int, type string, text string")
    got = {r["page_id"]: r["text"] for r in notion.flatten(df).collect()}
    assert got == {"p": "first  nested below second", "r": " ".join(map(str, range(11)))}


def test_object_ids(spark):
    h = "0123456789abcdef0123456789ABCDEF"
    want = "01234567-89ab-cdef-0123-456789abcdef"
    cases = {h: want, want: want, f"https://www.notion.so/Page-{h}?v=1": want, f"https://x.notion.site/{want}#a": want, f"https://evil.example/{h}": None, f"https://notion.so.evil.example/{h}": None, f"https://u@notion.so/{h}": None, "https://notion.so/short": None, f"prefix-{h}": None, "": None}
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, x string")
    assert [r["y"] for r in df.select("k", notion.object_id(F.col("x")).alias("y")).orderBy("k").collect()] == list(cases.values())


def test_pages_as_documents(spark):
    pages = spark.createDataFrame([("1", "u", "c", "", {"Name": ["Title here", "more"]}), ("2", "u", "c", "e", {})], "page_id string, url string, created_time string, last_edited_time string, properties map<string,array<string>>")
    texts = spark.createDataFrame([("1", "body")], "page_id string, text string")
    got = {r["external_id"]: r for r in notion.documents(pages, texts).collect()}
    assert (got["1"]["title"], got["1"]["content"], got["1"]["updated_at"]) == ("Title here", "body", "c")
    assert (got["2"]["title"], got["2"]["content"], got["2"]["updated_at"]) == ("Untitled", "", "e")


SHA = "a" * 40


def test_repository_entries(spark):
    entries = [("r", "b.py", "blob", SHA, 10), ("r", "a.md", "blob", SHA, 10), ("r", "c.txt", "blob", SHA, 10), ("r", "dir", "tree", SHA, None), ("s", "x.py", "blob", "short", 1), ("t", "x.exe", "blob", SHA, 1), ("t", "ok.PY", "blob", SHA.upper(), 1), ("u", "token/x.py", "blob", SHA, 1), ("v", "bad\x01.py", "tree", SHA, 1), ("w", "big.py", "blob", SHA, 99), ("w", "nosize.py", "blob", SHA, None), ("x", "x.exe", "blob", "short", 1)]
    judged = github.select_entries(spark.createDataFrame(entries, "repo string, path string, type string, sha string, size int"), 2, 50)
    assert {(r["repo"], r["path"]): r["verdict"] for r in judged.collect()} == {
        ("r", "a.md"): "keep", ("r", "b.py"): "keep", ("r", "c.txt"): "incomplete", ("r", "dir"): "skip", ("s", "x.py"): "incomplete", ("t", "x.exe"): "skip", ("t", "ok.PY"): "keep",
        ("u", "token/x.py"): "incomplete", ("v", "bad\x01.py"): "incomplete", ("w", "big.py"): "incomplete", ("w", "nosize.py"): "incomplete", ("x", "x.exe"): "incomplete",
    }
    assert {r["repo"]: (r["complete"], r["n_files"]) for r in github.completeness(judged).collect()}["t"] == (True, 1)


def test_blobs(spark):
    e = lambda b: base64.b64encode(b).decode()
    rows = [("ok", "base64", e("é\n".encode()) + "\n", 3, 3), ("plain", "utf-8", "hi", 2, 2), ("size", "base64", e(b"abc"), 4, 4), ("tree", "base64", e(b"abc"), 3, 4), ("bin", "base64", e(b"a\x00b"), 3, 3), ("utf", "base64", e(b"\xff\xfe\xff"), 3, 3), ("bad", "base64", "%%%", 3, 3), ("big", "base64", e(b"x" * 20), 20, 20), ("enc", "gzip", "x", 1, 1)]
    df = spark.createDataFrame(rows, "k string, encoding string, content string, size int, tree_size int")
    got = {r["k"]: (r["text"], r["error"]) for r in github.decode_blobs(df, 10).collect()}
    assert got == {"ok": ("é\n", None), "plain": ("hi", None), "size": (None, "size mismatch"), "tree": (None, "size mismatch"), "bin": (None, "binary"), "utf": (None, "not utf-8"), "bad": (None, "undecodable"), "big": (None, "too large"), "enc": (None, "undecodable")}


def test_repository_specs():
    assert github.parse_spec("Own/re.po@feature/x") == ("Own", "re.po", "feature/x") and github.parse_spec(" a/b ") == ("a", "b", "")
    for bad in ("a", "a/b/c", "-a/b", "a/b@", "a/b@x..y", "a/b@-x", "a/b@x y", "a/..", "a/b@x.lock", "https://github.com/a/b"):
        with pytest.raises(ValueError):
            github.parse_spec(bad)
    with pytest.raises(ValueError):
        github.unique_specs(["a/b", "A/B@x"])


PAGE = """<!doctype html><html><head><title>Title</title><base href="/docs/"><link rel="x canonical" href="page?a=1#f"></head><body><nav><a href="nav">n</a></nav>
<header>gone</header><article><h1> Head <b>line</b></h1><p>One<br>two</p><script>x()</script><x:nav>gone</x:nav><svg><title>kept</title></svg><a href="mailto:a@b">m</a><a href="https://other.example/">o</a><a href="page2">p</a><a href="page2#x">p</a></article></body></html>"""


def test_pages(spark):
    df = spark.createDataFrame([("https://ex.com/a", PAGE), ("https://ex.com/b", "<title>Only</title><p>text</p>"), ("https://ex.com/c", ""), ("https://ex.com/d", "<html><head><link rel=canonical href=https://evil.example/></head><body>x</body></html>"), ("https://ex.com/e", "<body><link rel=canonical href=/z>late</body>"), (None, None)], "url string, html string")
    got = {r["fetched_url"]: r for r in html.extract(df).collect()}
    a = got["https://ex.com/a"]
    assert a["title"] == "Headline" and a["content"] == "Head\nline\nOne\ntwo\nkept\nm\no\np\np" and a["canonical_url"] == "https://ex.com/docs/page?a=1" and a["complete"]
    assert got["https://ex.com/b"]["title"] == "Only" and got["https://ex.com/b"]["content"] == "text"
    assert got["https://ex.com/c"]["title"] == "https://ex.com/c" and not got["https://ex.com/c"]["complete"]
    assert got["https://ex.com/d"]["canonical_url"] == "https://ex.com/d" and not got["https://ex.com/d"]["complete"]
    assert got["https://ex.com/e"]["canonical_url"] == "https://ex.com/e" and not got["https://ex.com/e"]["complete"]
    links = [r["link"] for r in html.page_links(html.extract(df)).filter("url = 'https://ex.com/a'").orderBy("position").collect()]
    assert links == ["https://ex.com/docs/nav", "https://ex.com/docs/page2"]


def test_canonical_replacement_keeps_the_first_position(spark):
    rows = [("d", 1, False, "first"), ("d", 2, True, "canonical"), ("d", 3, False, "later"), ("e", 4, False, "one"), ("e", 5, False, "two")]
    got = {r["external_id"]: (r["position"], r["content"]) for r in html.canonical_replacement(spark.createDataFrame(rows, "external_id string, seq int, is_canonical boolean, content string")).collect()}
    assert got == {"d": (1, "canonical"), "e": (4, "one")}


def test_blog_posts(spark):
    post = "<h1>T</h1><span class='a date'>2024</span><div class='entry-content'> </div><div class='article x'>One<div class='revenue_unit_wrap'>ad</div> two</div>"
    rows = [(1, 200, post), (2, 404, post), (3, 200, "<meta property='og:title' content=' og '><div id=content>c</div>"), (4, 200, "<p>none</p>"), (999, 200, post)]
    got = {r["external_id"]: (r["title"], r["date"], r["content"]) for r in html.blog_posts(spark.createDataFrame(rows, "post_id int, status int, html string"), "b").collect()}
    assert got == {"b:1": ("T", "2024", "One\ntwo"), "b:3": ("og", "", "c")}


def test_robots_groups():
    text = "﻿User-agent: quill\nUser-agent: other\n# note\nDisallow: /a # why\nAllow: /a/b\n\nDisallow: /orphan\nUser-agent: *\nDisallow: /all\nUser-agent: quillbot\nDisallow: /bot%20x\nDisallow:\n"
    assert web.robots_rules(text, "QuillBot/1.0") == [("disallow", "/bot x")]
    assert web.robots_rules(text, "quill/2") == [("disallow", "/a"), ("allow", "/a/b")]
    assert web.robots_rules(text, "stranger") == [("disallow", "/all")]
    assert web.robots_rules("", "x") == []


def test_sitemaps():
    space = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    assert web.sitemap("https://e.c/sitemap.xml", f"<?xml version='1.0'?><urlset {space}><url><loc> https://e.c/a </loc></url><url><loc>/b</loc></url></urlset>") == (["https://e.c/a", "https://e.c/b"], True)
    assert web.sitemap("https://e.c/s", "<sitemapindex><sitemap><loc>x</loc></sitemap><other/></sitemapindex>") == (["https://e.c/x"], False)
    assert web.sitemap("https://e.c/s", "<urlset/>") == ([], False)
    assert web.sitemap("https://e.c/s", "<html/>") is None and web.sitemap("https://e.c/s", "not xml") is None


def site(spark, edges, pages):
    return spark.createDataFrame([(f"https://e.c/{p}",) for p in pages], "url string"), spark.createDataFrame([(f"https://e.c/{a}", f"https://e.c/{b}", k) for k, (a, b) in enumerate(edges)], "url string, link string, position int")


def test_crawl_order_budget_and_completeness(spark):
    pages, links = site(spark, [("a", "c"), ("a", "b"), ("c", "d"), ("b", "d"), ("b", "e"), ("d", "a"), ("e", "missing")], "abcde")
    table, info = web.crawl(pages, links, ["https://e.c/a", "https://e.c/a#x", "https://u:p@e.c/z"])
    assert [r["url"][-1] for r in table.orderBy("position").collect()] == list("acbde") and not info.complete
    pages, links = site(spark, [("a", "c"), ("a", "b"), ("c", "d")], "abcd")
    table, info = web.crawl(pages, links, ["https://e.c/a"])
    assert info.complete and [r["depth"] for r in table.orderBy("position").collect()] == [0, 1, 1, 2]
    table, info = web.crawl(pages, links, ["https://e.c/a"], max_pages=2)
    assert not info.complete and table.count() == 2
    rules = web.robots_table(spark.createDataFrame([("https://e.c", "User-agent: *\nDisallow: /c")], "origin string, text string"), "quill")
    table, info = web.crawl(pages, links, ["https://e.c/a"], robots=rules)
    assert not info.complete and {r["url"][-1] for r in table.collect()} == {"a", "b"}


class Fake:
    source_type = "web"

    def __init__(self, source_id, rows):
        self.source_id, self.rows = source_id, rows

    def read(self, spark):
        if self.rows is None:
            raise RuntimeError("down")
        return spark.createDataFrame(self.rows, "id string, content string"), web.SnapshotInfo(True)


def test_registry(spark):
    r = registry.Registry([Fake("a", [("1", "x")]), Fake("b", None), Fake("c", [("2", "y")]), Fake("a", [("3", "z")])])
    assert [x["source_id"] for x in r.sources(spark).collect()] == ["a", "b", "c"]
    rows, errors = r.read_all(spark)
    assert {x["id"] for x in rows.collect()} == {"2", "3"} and errors == {"b": "RuntimeError"}
    with pytest.raises(ValueError):
        r.get("nothing")


def test_a_crawl_within_one_large_host_makes_only_the_frontiers_links(spark, tmp_path, monkeypatch):
    rows = [(k, f"https://{'big' if k % 3 else f'h{k % 7}'}.c/{k}") for k in range(3000)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")

    def per_host_array(*_):
        raise AssertionError("no array of a host's pages")

    monkeypatch.setattr(landed.F, "collect_list", per_host_array)
    found = [r["url"] for r in landed.sc17_crawl(spark, str(tmp_path)).orderBy("position").collect()]
    want, todo = [], [0, 1, 2]
    hosts = {k: url.split("/")[2] for k, url in rows}
    while todo and len(want) < 20:
        want += todo[: 20 - len(want)]
        nexts = [t for p in todo for t in range(p + 1, min(2 * p + 10, 3000)) if hosts[t] == hosts[p]]
        todo = [t for t in dict.fromkeys(nexts) if t not in want]
    assert found == [rows[k][1] for k in want] and len(found) == 20


def test_links_wait_while_pages_fail_and_sitemaps_cost_no_page(spark):
    url = "https://e.c/"
    pages = spark.createDataFrame([(url + x,) for x in ("a", "b4", "b5", "m1", "m2")], "url string")
    links = spark.createDataFrame([(url + "a", f"{url}b{k}", k) for k in range(6)] + [(url + "b4", url + "b5", 0)], "url string, link string, position int")
    table, info = web.crawl(pages, links, [url + "a"], max_pages=3)
    # b0 to b3 didn't land; each cost an attempt only. b5 couldn't wait, but b4 links to it again (2 * 3 + 1 attempts).
    assert [(r["url"][-2:], r["depth"]) for r in table.orderBy("position").collect()] == [("/a", 0), ("b4", 1), ("b5", 2)] and not info.complete
    table, info = web.crawl(pages, links, [url + "a"], max_pages=4)
    assert [(r["url"][-2:], r["depth"]) for r in table.orderBy("position").collect()] == [("/a", 0), ("b4", 1), ("b5", 1)]
    body = "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in (url + "m1", "https://other.org/m", url + "m2")) + "</urlset>"
    maps = spark.createDataFrame([(url + "sitemap.xml", body)], "url string, text string")
    none = links.filter("false")
    table, info = web.crawl(pages, none, [url + "a"], sitemaps=maps)
    assert [(r["url"][-2:], r["depth"]) for r in table.orderBy("position").collect()] == [("/a", 0), ("m1", 1), ("m2", 1)] and info.complete
    doubtful = maps.unionByName(spark.createDataFrame([(url + "x.xml", "no map")], "url string, text string"))
    assert not web.crawl(pages, none, [url + "a"], sitemaps=doubtful)[1].complete


@pytest.mark.parametrize("name", ["g7_page_titles", "g7_page_documents", "sc10_blog_posts"])
def test_references_cut_short_stay_as_their_sql_has_them(spark, tmp_path, name):
    import duckdb

    pages = [(k, f"https://a.example/{k}", f"<html><body><h1>x &amp;&amp{end}</h1><article><h1>x{end}</h1><p>a &lt; b&amp{end}</p></article></body></html>") for k, end in enumerate(["", "", "&am", "&", "&#38", "&amp;"])]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    df, want = plans.QUERIES[name](spark, str(tmp_path)), con.sql(plans.ORACLES[name])
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())


def test_parsed_pages_leave_no_cycles():
    """What a worker has parsed is freed at once, however rarely cycles are collected."""
    import gc

    page = "<html><body><div><article><h1>t</h1><p>a<b>b</b></p></article><div class='entry-content'><p>x</p></div></div></body></html>"
    gc.collect()
    gc.disable()
    try:
        for k in range(50):
            html.parse("https://a.example/", page)
            html.blog_post(k, page)
        assert gc.collect() < 100
    finally:
        gc.enable()

import duckdb
import pandas as pd

from quillmesh.llm import url_filters as U

SCHEMA = "page_id long, url string, html string, host string, node string, root string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "x", "x") for i, u, h in rows], SCHEMA)


def canonical(url):
    return f"<html><head><link rel='stylesheet' href=a><LINK REL=\"canonical\" HREF=\"{url}\"></head></html>"


def refresh(url):
    return f'<meta http-equiv="Refresh" content="0; URL=\'{url}\'">'


ROWS = [
    (1, "https://a.example.com/en/1", None), (2, "HTTP://A.Example.COM/en/71?q=1#x", ""), (3, "https://b.example.net/de/8x", ""), (4, "https://b.net/de/", ""), (5, "https://notnet/de/", ""),
    (6, "https://x.org/es/1", ""), (7, "https://x.org/es", ""), (8, None, "<a>"), (9, "no scheme/en/", canonical("https://x.org/es/9")), (10, "://com/en/x", ""),
    (20, "https://p.info/1", canonical("https://q.com/en/1")), (21, "https://r.info/1", canonical("https://p.info/1")), (22, "https://s.info/", refresh("https://r.info/1#frag")),
    (23, "https://t.info/1", canonical("https://u.info/1")), (24, "https://u.info/1", refresh("https://example.com/en/7z")), (25, "https://v.info/1", canonical("https://u.info/1")), (26, "https://w.com/en/2", canonical("https://u.info/1")),
    (27, "http://p.info/1", ""), (None, "https://p.info/1#top", None), (28, "https://lonely.info/", canonical("https://lonely.info/other")), (20, "https://p.info/1", None),
]
WANT = {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "allow", 8: "allow", 9: "allow", 10: "block", 20: "block", 21: "block", 22: "block", 23: "allow", 24: "allow", 25: "allow", 26: "block", 27: "block", None: "block", 28: "allow"}


def test_rules_and_aliases(spark):
    found = U.judge_pages(pages(spark, ROWS)).collect()
    assert len(found) == len(ROWS)
    assert {r["page_id"]: r["verdict"] for r in found} == WANT
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in found}
    assert got[2] == ("a.example.com", "/en/71", "example.com/en/7") and got[3][2] == "example.net/de/8" and got[4][2] == "net/de/" and got[5][2] is None
    assert got[8] == ("", "", None) and got[9] == ("", "", None) and got[10] == ("com", "/en/x", "com/en/")


def test_sql_says_the_same(spark):
    con = duckdb.connect()
    con.register("frame", pd.DataFrame([(i, u, h) for i, u, h in ROWS if i is not None], columns=["page_id", "url", "html"]).astype({"page_id": "int64"}))
    con.sql("create view pages as select * from frame")
    want = sorted(map(tuple, con.sql(U.SQL).fetchall()), key=str)
    rows = [r for r in ROWS if r[0] is not None]
    assert sorted((tuple(r) for r in U.judge_pages(pages(spark, rows)).collect()), key=str) == want


def test_redirect_tables_relative_links_and_empty_tables(spark):
    rows = [(1, "https://a.info/x/y.html", canonical("../z")), (2, "https://b.info/1", None), (3, "https://a.info/x/k.html", canonical("m.html")), (4, "https://a.info/x/m.html", refresh("/x/n")), (5, "https://a.info/x/n", canonical("//c.org/es/1"))]
    redirects = spark.createDataFrame([("https://b.info/1", "https://a.info/x/m.html", 1), (None, "https://a.info/x/n", 2), ("https://b.info/1", None, 3)], "source string, target string, url int")
    found = {r["page_id"]: r["verdict"] for r in U.judge_pages(pages(spark, rows), redirects=redirects).collect()}
    assert found == {1: "allow", 2: "block", 3: "block", 4: "block", 5: "block"}
    assert U.judge_pages(pages(spark, [])).count() == 0


def test_a_hub_of_aliases(spark):
    rows = [(k, f"https://m{k}.info/1", canonical("https://hub.info/")) for k in range(300)] + [(999, "https://hub.info/", canonical("https://z.com/en/"))]
    assert {r["verdict"] for r in U.judge_pages(pages(spark, rows)).collect()} == {"block"}


def test_a_hundred_thousand_rules_in_a_table(spark, monkeypatch):
    rules = spark.range(100_000).selectExpr("if(id % 3 = 0, 'allow', 'block') verdict", "concat('H', id % 50000, '.Com') host", "concat('/', id % 7, if(id >= 50000, '/x', '')) path", "id extra")
    rules = rules.unionByName(spark.createDataFrame([("deny", "h1.com", "/", 1), ("block", None, "/", 1), ("block", "h1.com", None, 1), ("allow", "h7.com", "/q", 1), ("block", "h7.com", "/q", 1)], "verdict string, host string, path string, extra long"))
    rows = [(1, "https://h1.com/1", ""), (2, "https://a.b.h3.com/3/x", ""), (3, "https://xh3.com/3", ""), (4, "https://h49999.com/5/x/y", ""), (5, "https://h7.com/q/1", ""), (6, "https://h1.com/2", "")]
    for most in (10, 10**6):
        monkeypatch.setattr(U, "BROADCAST_RULES", most)
        found = {r["page_id"]: (r["rule"], r["verdict"]) for r in U.judge_pages(pages(spark, rows), rules).collect()}
        assert found[1] == ("h1.com/1", "block") and found[2] == ("h3.com/3", "allow") and found[3] == (None, "allow")
        assert found[4] == ("h49999.com/5", "allow" if 49999 % 3 == 0 else "block") and found[5] == ("h7.com/q", "allow") and found[6] == (None, "allow")
    many = [U.Rule("block", f"n{k}.org", "/") for k in range(3000)]
    assert [r["rule"] for r in U.judge_pages(pages(spark, [(1, "http://x.n2999.org/1", None)]), many).collect()] == ["n2999.org/"]

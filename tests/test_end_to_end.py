import json

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import answers, retrieval, wiki
from quillmesh.operators.store import Store
from quillmesh.settings import Settings
from quillmesh.sources import github, notion
from quillmesh.sources.registry import Landing, Registry
from quillmesh.streaming import sync as S


def test_from_landed_rows_to_a_page_on_disk(spark, tmp_path):
    rows = [("a", "Heat", "Heat moves from warm to cold. " * 60, "https://d.example/a"), ("b", "Other", "Nothing of it.", "https://d.example/b"), ("c", "Cold", "The heat is gone.\n\nCold stays.", "https://d.example/c")]
    spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "id string, title string, content string, url string, position int").write.parquet(str(tmp_path / "landed"))
    store, source = Store(spark, str(tmp_path / "state")), Landing("docs", "web", str(tmp_path / "landed"))
    S.register(store, source, "Docs", "2024-01-01 00:00:00")
    assert [x["status"] for x in S.run_all(store, Registry([source]), "2024-01-01 00:00:01")] == ["succeeded"]
    chunks, documents, sources = store.search_corpus()
    best = retrieval.ranked(retrieval.keyword_top_k(chunks, F.col("text"), "heat cold", 5, ["chunk_id"]), F.col("score").desc(), "chunk_id")
    found = retrieval.hydrate_carried(best, documents, sources)
    page = wiki.page(answers.evidence(found, None), "Heat")
    wiki.write_pages(page, str(tmp_path / "wiki"))
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "wiki/markdown/slug=Heat-Wiki")).collect())
    assert text.startswith("# Heat Wiki") and "[C1]" in text and "https://d.example/a" in text and "Nothing of it" not in text
    saved = spark.read.json(str(tmp_path / "wiki/json")).first()
    assert saved["status"] == "generated" and saved["slug"] == "Heat-Wiki"
    payload = json.loads(wiki.prompt_payload(wiki.citations(found), "Heat token=abcdef123456", "Cite.", wiki.backlinks(found), 40).first()[0])
    assert set(payload) == {"topic", "instructions", "output_contract", "evidence", "citations", "backlinks"} and "abcdef" not in payload["topic"]
    assert payload["evidence"][0]["text"].endswith("...") and len(payload["evidence"][0]["text"]) <= 43 and "text" not in payload["citations"][0]
    shown = found.select("rank", "title", "url", F.lit("web").alias("platform"), F.lit("2024").alias("date"), "score", F.col("preview").alias("text"))
    listed = wiki.results_markdown(shown, "heat").first()[0]
    assert listed.startswith("# 🔍 Search results: 'heat'\n\nTotal ") and "**Relevance**: 1.000" in listed
    assert wiki.results_markdown(shown.filter("false"), "heat").first()[0] == "No results found for 'heat'"


def test_enough_local_results_ask_no_web(spark):
    local = spark.range(5)
    assert retrieval.with_fallback(local, lambda: pytest.fail("asked"))[0] == "local"
    origin, rows = retrieval.with_fallback(local.limit(2), lambda: spark.range(9))
    assert origin == "web" and rows.count() == 9
    assert retrieval.with_fallback(local.limit(2), lambda: spark.range(0))[0] == "local"


def test_sources_of_a_request(spark):
    kinds = spark.createDataFrame([("a", "web"), ("b", " GitHub "), ("c", None), ("d", "pdf")], "source_id string, source_type string")
    assert retrieval.chosen_sources(kinds) == [] and retrieval.chosen_sources(kinds, {"source_ids": []}, "", None) == []
    assert retrieval.chosen_sources(kinds, {"source_id": "x\ny", "source_types": ["DOCS"]}, "github", ("a", "z", None, " ")) == ["x", "y", "a", "b", "d", "z"]
    for types in ("notion", ["tistory", "notion"]):
        with pytest.raises(ValueError):
            retrieval.chosen_sources(kinds, {}, types, ["a"])


def test_limits_are_checked():
    read = lambda **env: Settings.read({f"QUILLMESH_{k.upper()}": v for k, v in env.items()})
    assert read() == Settings() and read(repositories=" a/b,\n c/d ,,").repositories == ("a/b", "c/d")
    assert read(max_files="7", crawl_delay="0", synthesis=" ON ", token_variable="MY_1") == Settings(max_files=7, crawl_delay=0.0, synthesis=True, token_variable="MY_1")
    for bad in ({"max_files": "0"}, {"max_files": "x"}, {"max_pages": "-1"}, {"crawl_delay": "-1"}, {"crawl_delay": "nan"}, {"crawl_delay": "inf"}, {"synthesis": "maybe"}, {"token_variable": "lower"}):
        with pytest.raises(ValueError):
            read(**bad)
    for bad in ({"max_files": True}, {"max_files": 1.5}, {"synthesis": 1}, {"crawl_delay": True}, {"web_seeds": "x"}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_snapshots_without_sound_trees_stop(spark):
    sha = "a" * 40
    commits = lambda s=sha, t=sha: spark.createDataFrame([("r", s, ((t,),))], github.COMMIT)
    trees = lambda cut=False, rows=(("p", "blob", sha, 1),): spark.createDataFrame([("r", sha, cut, rows)], github.TREE)
    assert [tuple(r) for r in github.snapshot_entries(commits(), trees()).collect()] == [("r", sha, "p", "blob", sha, 1)]
    for c, t in ((commits(s="zz"), trees()), (commits(t=None), trees()), (commits(t="b" * 40), trees()), (commits(), trees(cut=True)), (commits(), trees(rows=None))):
        with pytest.raises(Exception, match="sha was invalid|truncated|missing"):
            github.snapshot_entries(c, t).collect()


def test_paged_answers_follow_their_cursors(spark):
    page = lambda i: (i, "", "", "")
    make = lambda *rows: spark.createDataFrame(rows, notion.RESULTS)
    good = make(("b", None, False, [page("3")]), (None, "a", True, [page("1"), page("2")]), ("a", "b", True, []))
    assert [r["id"] for r in notion.paged(good).orderBy("position").collect()] == ["1", "2", "3"]
    assert notion.paged(make()).count() == 0
    for bad in (make((None, "a", True, [])), make((None, "a", True, []), ("a", "a", True, []))):
        with pytest.raises(ValueError):
            notion.paged(bad)
    pages = spark.createDataFrame([("p", "u")], "page_id string, url string")
    databases = spark.createDataFrame([("d", "q", "v"), ("d", "r", "w"), ("e", None, None)], "database_id string, page_id string, url string")
    assert notion.target_pages("p", pages, databases).count() == 1 and notion.target_pages("d", pages, databases).count() == 2 and notion.target_pages("e", pages, databases).count() == 0
    with pytest.raises(ValueError):
        notion.target_pages("x", pages, databases)

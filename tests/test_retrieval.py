from pyspark.sql import functions as F

from quillmesh.operators import answers, retrieval, wiki

RESULT = "rank int, chunk_id string, document_id string, source_id string, source_type string, title string, url string, path string, score double, preview string, text string, line_start int, line_end int"


def results(spark, *rows):
    return spark.createDataFrame([(k + 1, f"{d}:chunk:{k}", d, "s", "web", f"T {d}", f"https://e.c/{d}", p, score, text[:9], text, a, b) for k, (d, p, score, text, a, b) in enumerate(rows)], RESULT)


def test_arguments():
    assert [retrieval.clamp_top_k(x) for x in (None, 0, -3, 5, 99)] == [8, 1, 1, 5, 20]
    assert retrieval.source_filter({"source_id": ["a", "b"], "source_ids": ("b", "c", "")}) == ["b", "c", "a"]
    assert retrieval.source_filter(None) == [] and retrieval.source_filter({"source_ids": "x"}) == ["x"]


def test_filter_comes_before_the_limit_for_vectors(spark):
    df = spark.createDataFrame([(k, [float(k), 0.0], k % 3 == 2) for k in range(30)], "id int, embedding array<float>, live boolean")
    assert [r["id"] for r in retrieval.vector_top_k(df, [0.0, 0.0], 3, F.col("live"), "id").collect()] == [2, 5, 8]


def test_repeated_terms_count_twice(spark):
    df = spark.createDataFrame([("alpha",), ("beta",)], "t string")
    assert [r[0] for r in df.select(retrieval.keyword_score(F.col("t"), "Alpha alpha beta")).collect()] == [2 / 3, 1 / 3]
    assert [r[0] for r in df.select(retrieval.keyword_score(F.col("t"), "  ")).collect()] == [0, 0]


def test_rejected_hits_do_not_use_a_chunk_up(spark):
    hits = spark.createDataFrame([(1, "c", False), (2, "c", True), (3, "c", True), (4, "d", False)], "rank int, chunk_id string, ok boolean")
    assert [(r["chunk_id"], r["rank"]) for r in retrieval.first_accepted(hits, F.col("ok"), "chunk_id").collect()] == [("c", 2)]


def test_raw_hits_known_in_any_way_are_suppressed(spark):
    rows = [(1, "free", "", "", "https://n.e/1", ""), (2, "d1", "", "", "", ""), (3, "notion_n1", "", "", "", ""), (4, "tistory_7", "", "", "https://Blog.tistory.com/7", ""), (5, "x", "", "gone-chunk", "", ""), (6, "y", "d2", "", "", ""), (7, "z", "", "", "https://known/", ""), (8, "w", "", "", "", "https://canon/"), (9, "tistory_7", "", "", "https://other.tistory.com/7", "")]
    hits = spark.createDataFrame(rows, "rank int, doc_id string, document_id string, chunk_id string, url string, canonical_url string")
    docs = spark.createDataFrame([("d1", "https://known/", ""), ("n1", "", "https://canon/"), ("blog:7", "", ""), ("d2", "", "")], "document_id string, url string, canonical_url string")
    chunks = spark.createDataFrame([("gone-chunk",)], "chunk_id string")
    assert [r["rank"] for r in retrieval.suppress_raw(hits, chunks, docs).orderBy("rank").collect()] == [1, 9]


def test_query_terms_and_relevance(spark):
    one = spark.range(1)
    terms = lambda q: one.select(answers.query_terms(F.lit(q))).first()[0]
    assert terms("How is the _Graph_ a b-c?") == ["graph", "b-c"]
    assert set(terms("니트코드구조 알려줘")) == {"니트코드구조", "leetcode", "neetcode", "니트코드", "structure", "architecture", "구조"}
    rel = lambda q, text: one.select(answers.relevant(answers.query_terms(F.lit(q)), F.lit("T"), F.lit(None).cast("string"), F.lit(""), F.lit(text))).first()[0]
    assert rel("the", "anything") and rel("graph", "A GRAPH") and not rel("graph", "tree") and not rel("neetcode graph", "graph only") and rel("neetcode graph", "NeetCode")


def test_answers(spark):
    good = results(spark, ("a", "p", 0.9, "graph one", 1, 2), ("b", "", 0.3, "graph low", 1, 1), ("c", "", 0.8, "tree", 1, 1), ("d", "", 0.7, "graph two", None, None))
    row = answers.answer(good, "what about the graph").first()
    assert (row["evidence_status"], row["answer"], row["used_chunks"]) == ("grounded", "graph one\n\ngraph two", "a:chunk:0,d:chunk:3")
    row = answers.answer(good, "zebra").first()
    assert (row["evidence_status"], row["answer"], row["used_chunks"]) == ("insufficient", "", "")


def test_pages(spark):
    rows = results(spark, ("a", "p", 0.9, "one  two", 1, 2), ("b", "", 0.8, "three", None, None), ("a", "p", 0.7, "four", 3, 3))
    row = wiki.page(rows, "topic").first()
    assert row["status"] == "generated" and row["used_chunks"] == "a:chunk:0,b:chunk:1,a:chunk:2"
    assert "- one two [C1]\n- three [C2]\n- four [C3]" in row["markdown"] and "- [C1] T a (s) p:1-2 `a:chunk:0`" in row["markdown"] and "- [C2] T b (s) https://e.c/b `b:chunk:1`" in row["markdown"]
    assert row["markdown"].count("T a (web)") == 1 and row["markdown"].endswith("`a:chunk:2`\n")
    links = wiki.backlinks(rows).orderBy("first_rank").collect()
    assert [(r["document_id"], r["chunk_ids"]) for r in links] == [("a", ["a:chunk:0", "a:chunk:2"]), ("b", ["b:chunk:1"])]
    assert wiki.page(rows.filter("score > 1"), "topic").first()["status"] == "insufficient_evidence"


def test_sentences():
    assert wiki.sentences("# no\n- One is e.g. here. [C1] Two has v1.2.3 and .env files [C2].\n```\ncode.\n```\n1. Three!\n...") == ["One is e.g. here [C1].", "Two has v1.2.3 and .env files [C2].", "Three!"]
    cases = {
        "All done.Next one is here [C1].": ["All done.", "Next one is here [C1]."], "Mr. Smith Jr. came [C1].": ["Mr. Smith Jr. came [C1]."], "- 1. x [C1]": ["x [C1]"],
        "The .env.local file is excluded [C1].": ["The .env.local file is excluded [C1]."], "The file is .env.local.unsupported claim [C1].": ["The file is .env.local.", "unsupported claim [C1]."],
        "The domain is github.com.unsupported claim [C1].": ["The domain is github.com.", "unsupported claim [C1]."], "See src/main.py for U.S. use [C1].": ["See src/main.py for U.S. use [C1]."],
        "The source is github.com. [C1] Unsupported claim.": ["The source is github.com [C1].", "Unsupported claim."], "Python 3.13 is supported [C1].": ["Python 3.13 is supported [C1]."],
        "This concerns U.S. [C1] Unsupported claim.": ["This concerns U.S. [C1]", "Unsupported claim."], "St. Paul": ["St.", "Paul"], "One [C1] [C2] two": ["One [C1] [C2]", "two"], "x [C1] .": ["x [C1]"],
        "Ends.[C1] More": ["Ends.", "[C1]", "More"], "The .gitignore file": ["The .", "gitignore file"], "한국어 문장. 다음": ["한국어 문장.", "다음"], "a. 3 items": ["a.", "3 items"], "": [], "!!!": [],
    }
    for text, want in cases.items():
        assert wiki.sentences(text) == want, text


def test_sections(spark):
    known = F.array(F.lit("C1"), F.lit("C2"))
    one = spark.range(1)
    check = lambda text, *listed: one.select(wiki.section_valid(F.lit(text), F.array(*map(F.lit, listed)), known)).first()[0]
    assert check("x [C1] y [C1]", "C1") and not check("x [C1]", "C2") and not check("x [C3]", "C3") and not check("x", "C1")
    cited = lambda text: one.select(wiki.every_sentence_cited(F.lit(text))).first()[0]
    assert cited("One [C1]. Two [C2].") and not cited("One [C1]. Two.")
    among = lambda text: one.select(wiki.every_sentence_cited(F.lit(text), known)).first()[0]
    assert among("One [C1]. Two [C2].") and not among("One [C1]. Two [C3].") and not among("One [C1] [C9].")


def test_fallbacks_of_all_questions(spark, tmp_path):
    """Enough; too few and the web has some; none and the web has some; too few and the web has none; none at all."""
    from quillmesh import plans

    langs = ["en"] * 3 + ["de"] * 5 + ["en"] * 2 + ["de"] * 6 + ["de"] * 4 + ["fr"] * 4 + ["en"] * 2 + ["fr"] * 6 + ["fr"] * 8
    spark.createDataFrame(list(enumerate(langs)), "doc_id long, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["question"]: (r["origin"], r["n_results"]) for r in plans.QUERIES["t5_fallback"](spark, str(tmp_path)).collect()}
    assert found == {0: ("local", 3), 1: ("web", 6), 2: ("web", 4), 3: ("local", 2), 4: ("local", 0)}


def test_single_searches_write_nothing(spark):
    """A search reads the chunks once; it publishes neither them nor an index."""
    import os

    from quillmesh import plans

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/quillmesh"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    for name in ("t1_keyword_top_k", "a2_backlinks", "f33_prompt_payload"):
        plans.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert (set(os.listdir(folder)) if os.path.isdir(folder) else set()) == before

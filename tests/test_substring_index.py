import random

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import retrieval, substring_index
from quillmesh.operators.substring_index import SubstringIndex

SCHEMA = "chunk_id string, text string"


@pytest.fixture(scope="module")
def chunks(spark):
    r = random.Random(3)
    words = ["the", "heat", "station", "nation", "of", "off", "Über", "straße", "a", "x", "日本語", "🙂🙂🙂", "notion", "a\x00b", "end"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 9))) for _ in range(400)]
    texts += ["", "  ", "of", "THE", "heat the nation of rare", "zz rareword", *["hot copy the of"] * 200]
    return spark.createDataFrame([(f"c{k:04d}", t) for k, t in enumerate(texts)], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def index(spark, chunks, tmp_path_factory):
    return substring_index.build(chunks, f"file://{tmp_path_factory.mktemp('index')}/i", buckets=16)


QUERIES = [
    "the", "THE heat", "tion", "tion heat of", "rareword", "rareword the", "rareword tion of", "nowhere", "nowhere at all", "nowhere the", "of", "a", "a the", "x rareword", "the the the heat", "über STRASSE straße", "日本語 🙂🙂",
    "of of heat", "nation station notion heat the of", "", "   ", "zz", "nd", "qq the",
]


@pytest.mark.parametrize(("query", "k"), [*((q, 10) for q in QUERIES), ("tion heat of", 1), ("the", 1000), ("rareword the", 1000)])
def test_finds_what_a_scan_finds(index, chunks, query, k):
    want = retrieval.keyword_top_k(chunks, F.col("text"), query, k, ["chunk_id"]).select("chunk_id", "text", "score").collect()
    got = index.top_k(query, k, ["chunk_id"])
    assert got.columns == ["chunk_id", "text", "score"] and got.collect() == want


def test_only_the_asked_buckets_are_read(index, spark):
    read = index.looked_up(index.postings, ["rar"])
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "gram" in plan.split("PushedFilters: [")[1].split("]")[0]
    (only,) = {r["bucket"] for r in read.select("bucket").distinct().collect()}
    whole = {f for f in index.postings.inputFiles()}
    assert len({f for f in whole if f"bucket={only}/" in f}) < len(whole) / 2
    # The texts that are verified are those of the candidates.
    assert index.holding([["rar"]]).count() == 2 and index.bounds(["rareword", "of", "a"]) == {"rareword": (1, ["ewo", "ord", "rew"]), "of": index.bounds(["of"])["of"], "a": None}


def test_a_term_is_a_part_of_a_word_and_ends_of_texts_count(index):
    assert [r["text"] for r in index.top_k("rewo", 5, ["chunk_id"]).collect()] == ["zz rareword"]
    assert "of" in {r["text"] for r in index.top_k("of", 1000, ["chunk_id"]).collect()}


def test_additions_are_found_with_what_was_there(spark, chunks, tmp_path):
    first, second = chunks.filter("chunk_id < 'c0300'"), chunks.filter("chunk_id >= 'c0300'")
    i = substring_index.build(first, f"file://{tmp_path}/i", buckets=4).add(second, batch=1)
    i = SubstringIndex(spark, i.folder, 4)
    for query in ("rareword the", "of", "tion heat"):
        want = retrieval.keyword_top_k(chunks, F.col("text"), query, 20, ["chunk_id"]).select("chunk_id", "text", "score").collect()
        assert i.top_k(query, 20, ["chunk_id"]).collect() == want
    assert i.chunks.select("chunk_no").distinct().count() == chunks.count()


def test_an_empty_index_has_no_hits(spark, tmp_path):
    i = substring_index.build(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/i")
    assert i.top_k("the a", 5, ["chunk_id"]).count() == 0 and i.top_k("the", 5, ["chunk_id"]).count() == 0

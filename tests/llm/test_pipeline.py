import os
import sys

import pandas as pd
import pytest
from helpers import WORDS, jaccard, prose, shingles

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402

from quillmesh.llm import toxicity  # noqa: E402

LEAK = prose(30, 99077)


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    clean = [(k, prose(60 + k % 80, k)) for k in range(300)]
    bad = [(1000 + k, " ".join(["vile", *prose(60, 5000 + k).split()[:40], "rotten", WORDS[k % 9]])) for k in range(120)]
    copies = [(2000 + k, clean[k][1] + " more") for k in range(20)]
    leaks = [(3000 + k, f"{prose(40, 6000 + k)} {LEAK}") for k in range(5)]
    secrets = [(4000, prose(50, 7000) + " token = abcdefabcdefabcdefabcdef")]
    odd = [(5000, None), (5001, "")]
    rows = clean + bad + copies + leaks + secrets + odd
    pd.DataFrame({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows], "lang": "en", "source": "s", "n_chars": [len(t or "") for _, t in rows]}).to_parquet(folder / "documents.parquet")
    pd.DataFrame({"doc_id": [i for i, _ in clean[100:] + bad], "quality": 1, "toxic": [0] * 200 + [1] * 120}).astype({"quality": "int32", "toxic": "int32"}).to_parquet(folder / "labels.parquet")
    pd.DataFrame({"item_id": [1, 2], "text": [LEAK, prose(30, 99078)]}).to_parquet(folder / "benchmark.parquet")
    return str(folder), dict(rows)


def test_each_stage_takes_effect_and_keeps_clean_documents(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == columns, name
        left.append({r["doc_id"]: r["text"] for r in docs.collect()})
    one, two, three, four = left
    toxic = {i for i in rows if 1000 <= i < 2000}
    # A few hundred labelled rows are a small sample; the network's accuracy has a test of its own.
    assert len(toxic & one.keys()) <= 0.2 * len(toxic) and len(rows.keys() - toxic - one.keys()) <= 0.05 * len(rows)
    # Brute force: of each class of similar documents the least id stays.
    ids = sorted(one)
    sets = {i: shingles(one[i]) for i in ids}
    gone = {b for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.8}
    assert two.keys() == one.keys() - gone
    assert three.keys() == two.keys() - set(range(3000, 3005))
    assert 4000 in three
    assert four.keys() == three.keys() and four[4000].endswith(" <assign>") and {i for i in four if four[i] != three[i]} == {4000}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r["doc_id"] for r in last} == four.keys() and all((r["n_tokens"] > 0) == bool(four[r["doc_id"]]) for r in last)


def test_run_applies_all_stages(spark, tables, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 20)
    out = corpus_pipeline.run(spark, tables[0])
    assert set(out.columns) >= {"doc_id", "n_tokens", "ids"} and out.count() > 250

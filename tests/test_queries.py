"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os
import subprocess
import sys

import pytest

from quillmesh import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_and_sql_agree(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    want = duck.sql(plans.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_other_queries_have_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_lines_are_counted_in_every_document(spark, tmp_path):
    texts = [None, "", "\n", "a\nb", "a\nb\n", "a\r\n\nb"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["n_lines"] for r in plans.QUERIES["f4_lines"](spark, str(tmp_path)).collect()}
    assert found == {k: None if t is None else len(t.splitlines()) for k, t in enumerate(texts)}


@pytest.mark.parametrize("name", ["f30_error_redaction", "f31_evidence_redaction", "f32_prompt_redaction"])
def test_redaction_of_odd_texts_is_that_of_its_sql(spark, tmp_path, name):
    import duckdb

    odd = ["", "x", "_", "\u00e9", "\u00df", "\u0301", "\uac00", "\u0663", "\u2028", "\xa0", "\x0b", "\x1c", "\r", "\f", "\x85", "\u017f", "\u212a", "\u0131", "\u0130", "\U00010400"]
    forms = (
        "{}token=abc", "token{}=abc", "token:{}abc", "token=ab{}c d", "{}ession=1", "x{}ession=1", "{}ey: 1", "api{}key=1", "s{}d=1", "{}ghp_ab{}cd", "a{}ia" + "Q" * 16, "AKIABCDEFGHIJ12345{}",
        "bearer{}abcdefgh1", "ba{}ic abcdefgh{}", "sk-" + "a" * 16 + "{}", "pass='a{}b' z", "pwd=a{}b;c", "?sig=a{}b#x", "-----BEGIN {}PRIVATE KEY-----z-----END PRIVATE {}EY-----",
    )
    texts = [None, "", *(f.replace("{}", c) for f in forms for c in odd)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df, want = plans.QUERIES[name](spark, str(tmp_path)), con.sql(plans.ORACLES[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "chunk_id" in df.columns


def test_the_rest_stands_without_the_optional_subpackage(tmp_path):
    for name in os.listdir(ROOT):
        if name not in (".git", "corpus_pipeline.py", "quillmesh", "tests"):
            os.symlink(f"{ROOT}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "quillmesh")
    for name in os.listdir(f"{ROOT}/quillmesh"):
        if name != "llm":
            os.symlink(f"{ROOT}/quillmesh/{name}", tmp_path / "quillmesh" / name)
    os.remove(tmp_path / "__spark_entry__.py")
    (tmp_path / "__spark_entry__.py").write_text(open(f"{ROOT}/__spark_entry__.py").read())
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env=os.environ | {"PYTHONPATH": ""})

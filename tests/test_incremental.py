import glob

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import jobs
from quillmesh.operators import store as stores
from quillmesh.operators.chunking import chunk_documents
from quillmesh.operators.store import Delta, Store
from quillmesh.sources.web import SnapshotInfo
from quillmesh.streaming import sync as S

ROW = "id string, title string, content string, position int"
WHOLE, PART = SnapshotInfo(True), SnapshotInfo(False)


class Source:
    """A store with one source, and how many documents each sync chunked."""

    def __init__(self, spark, root, source_id="src"):
        self.spark, self.store, self.source_id, self.chunked, self.n = spark, Store(spark, str(root)), source_id, [], 0

    def sync(self, docs, info=WHOLE, **more):
        def chunk(work, *sizes):
            self.chunked.append(work.count())
            return chunk_documents(work, *sizes)

        self.n += 1
        rows = self.spark.createDataFrame([(i, t, c, k) for k, (i, (t, c)) in enumerate(docs.items())], ROW)
        return S.sync(self.store, rows, self.source_id, info, f"2024-01-{self.n:02d}", f"s{self.n}", chunk=chunk, **more)

    def chunks(self):
        return {r["chunk_id"]: (r["title"], r["text"]) for r in self.store.read("chunks", self.source_id).collect()}

    def rows_written(self, name):
        """Rows of documents or chunks in each version, without marks."""
        folders = sorted(glob.glob(f"{self.store.root}/{name}/source_id={self.source_id}/version=*"))
        return [self.spark.read.parquet(f).filter("not touch").count() for f in folders]


@pytest.fixture(scope="module")
def docs():
    return {f"d{k:03d}": (f"T{k}", f"text of {k} " * (k % 5 + 1)) for k in range(60)}


def test_work_and_bytes_follow_the_change(spark, tmp_path, docs):
    s = Source(spark, tmp_path / "state")
    s.sync(docs)
    first = s.chunks()
    r = s.sync(docs)
    assert s.chunked == [60, 0] and (r.processed_documents, r.skipped_documents, r.indexed_chunks) == (0, 60, 0)
    assert s.rows_written("documents") == [60] and s.rows_written("chunks") == [60]  # nothing was written
    r = s.sync(docs | {"d007": ("T7", "other words")})
    assert s.chunked[-1] == 1 and (r.processed_documents, r.skipped_documents) == (1, 59)
    assert s.rows_written("documents") == [60, 1] and s.rows_written("chunks") == [60, 1]
    now = s.chunks()
    assert len(now) == 60 and sum(now[k] == first.get(k) for k in now) == 59
    # A new title alone is taken over by the chunks without chunking.
    r = s.sync(docs | {"d007": ("T7", "other words"), "d009": ("new title", docs["d009"][1])})
    assert s.chunked[-1] == 0 and r.skipped_documents == 60 and s.rows_written("chunks") == [60, 1, 1]
    assert s.chunks().keys() == now.keys() and {t for k, (t, _) in s.chunks().items() if k.startswith("d009:")} == {"new title"}
    seen = {r["document_id"]: r["last_seen_sync_id"] for r in S.last_seen(s.store, "src").collect()}
    assert set(seen.values()) == {"s4"} and len(seen) == 60
    # Gone and back again; the text of the deleted one isn't written again with others.
    less = {k: v for k, v in docs.items() if k != "d001"}
    r = s.sync(less)
    assert r.missing_documents == 1 and s.chunked[-1] == 1 and s.rows_written("documents")[-1] == 3  # d007, d009 back to what they were, d001 deleted
    assert s.sync(docs).processed_documents == 1 and s.chunked[-1] == 1
    assert s.chunks().keys() == first.keys()


def test_another_chunker_is_compared_by_its_chunks(spark, tmp_path):
    s = Source(spark, tmp_path / "state")
    docs = {"a": ("A", "x" * 30), "b": ("B", "short"), "c": ("C", " ")}
    s.sync(docs)
    r = s.sync(docs, max_chars=10, overlap=2)
    assert s.chunked == [3, 3] and (r.processed_documents, r.skipped_documents, r.indexed_chunks) == (1, 2, 4)
    r = s.sync(docs, max_chars=10, overlap=2)
    assert s.chunked[-1] == 0 and r.skipped_documents == 3
    # The chunker depends on the kind that the title names.
    r = s.sync(docs | {"b": ("B.py", "short")}, max_chars=10, overlap=2)
    assert s.chunked[-1] == 1 and r.skipped_documents == 3 and {t for t, _ in s.chunks().values()} == {"A", "B.py"}


def test_partial_snapshots_and_repeated_rows(spark, tmp_path):
    s = Source(spark, tmp_path / "state")
    s.sync({"a": ("A", "one"), "b": ("B", "two")})
    r = s.sync({"b": ("B", "three")}, PART)
    assert r.missing_documents == 0 and {t for _, t in s.chunks().values()} == {"one", "three"}
    assert {r["document_id"]: r["last_seen_sync_id"] for r in S.last_seen(s.store).collect()} == {"a": "s1", "b": "s2"}
    r = s.sync({"a": ("A", "one")}, SnapshotInfo(True, ("a",)))
    assert r.missing_documents == 0 and len(s.chunks()) == 2  # b lies outside the prefixes


def test_changes_are_folded_and_readers_see_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "FOLD_AFTER", 3)
    s = Source(spark, tmp_path / "state")
    for k in range(3):
        s.sync({"a": ("A", f"text {k}"), "b": ("B", "stays"), "c": ("C", "x" * k)})
    assert len(s.store.pinned("src")["documents"]) == 3
    before = s.chunks(), sorted(map(tuple, s.store.read("documents").collect())), s.store.read("chunk_tombstones").count()
    s.store.compact("src")
    assert all(len(v) == 1 for v in s.store.pinned("src").values()) and s.store.compact("src") is None
    assert (s.chunks(), sorted(map(tuple, s.store.read("documents").collect())), s.store.read("chunk_tombstones").count()) == before
    assert s.store.vacuum() > 0 and s.store.vacuum() == 0
    assert (s.chunks(), sorted(map(tuple, s.store.read("documents").collect())), s.store.read("chunk_tombstones").count()) == before
    for k in range(3):
        s.sync({"a": ("A", f"more {k}"), "b": ("B", "stays"), "c": ("C", "x")})
    assert len(s.store.pinned("src")["documents"]) <= 3 and {t for _, t in s.chunks().values()} == {"more 2", "stays", "x"}


def test_names_of_sources_are_any_text(spark, tmp_path):
    store, names = Store(spark, str(tmp_path / "state")), ("web:https://a.example/x?y=1", "123", "a b%c", "größe")
    for n in names:
        rows = spark.createDataFrame([("c", "d", n)], "chunk_id string, document_id string, text string")
        store.publish({"chunks": Delta(rows)}, n)
    assert {r["source_id"]: r["text"] for r in store.read("chunks").collect()} == {n: n for n in names}
    assert {r["text"] for r in store.read("chunks", but="123").collect()} == set(names) - {"123"}
    assert [r["text"] for r in store.read("chunks", names[0]).collect()] == [names[0]]


class Landed:
    source_type = "web"

    def __init__(self, source_id, docs):
        self.source_id, self.docs = source_id, docs

    def read(self, spark):
        return spark.createDataFrame([(i, i, c, k) for k, (i, c) in enumerate(self.docs.items())], ROW), WHOLE


def claims(store):
    return {r["document_id"]: (r["source_id"], r["job_id"]) for r in store.read("document_claims").collect()}


def begun(store, source_id, job_id, at):
    S.register(store, Landed(source_id, {}), source_id, at)
    running, sources, active = jobs.begin(store.read("sync_jobs", source_id), store.read("sources", source_id), job_id, source_id, at)
    assert active is None
    store.publish({"sync_jobs": running, "sources": sources}, source_id)


def test_claims_of_running_finished_and_stale_jobs(spark, tmp_path):
    store, shared = Store(spark, str(tmp_path / "state")), Landed("b", {"shared": "words", "own": "more words"})
    begun(store, "a", "job-a", "2024-01-01 00:00:00")
    S.claim_documents(store, spark.createDataFrame([("shared",)], "document_id string"), "a", "job-a", "2024-01-01 00:00:00")
    S.register(store, shared, "B", "2024-01-01 00:00:00")
    # A running job of another source holds the document: the second fails, and nothing of it is written.
    failed = S.run(store, shared, "2024-01-01 01:00:00", "job-b1")
    assert failed["status"] == "failed" and "claimed by a" in failed["error_message"] and store.read("documents").count() == 0
    assert claims(store) == {"shared": ("a", "job-a")}
    # Without a sign of life the first job fails by the claim, its source with it.
    done = S.run(store, shared, "2024-01-03 00:00:00", "job-b2")
    assert done["status"] == "succeeded" and store.read("documents").count() == 2
    old = jobs.one(store.read("sync_jobs"), "job-a")
    assert (old["status"], old["error_message"]) == ("failed", S.CLAIM_EXPIRED)
    assert store.read("sources", "a").first()["sync_status"] == "failed" and claims(store) == {}  # released with the job
    # A heartbeat keeps a claim alive; a finished job's claim gives way.
    begun(store, "c", "job-c", "2024-01-03 00:00:00")
    S.claim_documents(store, spark.createDataFrame([("own",)], "document_id string"), "c", "job-c", "2024-01-03 00:00:00")
    alive = jobs.update(store.read("sync_jobs", "c"), "job-c", heartbeat_at="2024-01-04 23:00:00")
    store.publish({"sync_jobs": alive}, "c")
    shared.docs["own"] = "other words"
    assert S.run(store, shared, "2024-01-05 00:00:00", "job-b3")["status"] == "failed"
    over, sources = jobs.fail(store.read("sync_jobs", "c"), store.read("sources", "c"), "job-c", "c", "gone", "2024-01-05 00:30:00")
    store.publish({"sync_jobs": over, "sources": sources}, "c")
    assert claims(store) == {"own": ("c", "job-c")}
    assert S.run(store, shared, "2024-01-05 01:00:00", "job-b4")["status"] == "succeeded"


def test_a_delta_replaces_all_rows_of_its_documents(spark, tmp_path):
    store = Store(spark, str(tmp_path / "state"))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "document_id string")
    rows = lambda *x: spark.createDataFrame(x, "chunk_id string, document_id string, text string").withColumn("source_id", F.lit("s"))
    store.publish({"chunks": Delta(rows(("a1", "a", "x"), ("a2", "a", "y"), ("b1", "b", "z")), ids("a", "b"))}, "s")
    store.publish({"chunks": Delta(rows(("a3", "a", "w")), ids("a", "c"))}, "s")
    store.publish({"chunks": Delta(rows(("c1", "c", "v")).filter("false"), ids("b"))}, "s")
    assert sorted(r["chunk_id"] for r in store.read("chunks").collect()) == ["a3"] == sorted(r["chunk_id"] for r in store.read("chunks", "s").collect())

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import jobs, merge
from quillmesh.operators.documents import live, live_chunks
from quillmesh.operators.store import Store
from quillmesh.sources.web import SnapshotInfo
from quillmesh.streaming import sync as S

ROW = "id string, title string, content string, position int"


def rows(spark, *values):
    return spark.createDataFrame([(i, t, c, k) for k, (i, t, c) in enumerate(values)], ROW)


def state(store):
    docs = {r["document_id"]: (r["content"], r["deleted_at"], r["title"]) for r in store.read("documents").collect()}
    return docs, sorted(r["chunk_id"] for r in store.read("chunks").collect()), sorted(r["chunk_id"] for r in store.read("chunk_tombstones").collect())


def test_the_table_of_decisions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "state"))
    run = lambda n, info, *v, **m: S.sync(store, rows(spark, *v), "src", info, f"t{n}", f"s{n}", **m)
    whole, part = SnapshotInfo(True), SnapshotInfo(False)
    r = run(1, whole, ("a", "A", "alpha"), ("b", "B", "beta"), ("c", "C", " "))
    assert (r.total_documents, r.processed_documents, r.skipped_documents, r.indexed_chunks) == (3, 3, 0, 2)
    r = run(2, whole, ("a", "A", "alpha"), ("b", "B", "beta"), ("c", "C", " "))
    assert (r.processed_documents, r.skipped_documents, r.missing_documents) == (0, 3, 0)
    before = state(store)[1]
    r = run(3, part, ("a", "new title", "alpha"))
    assert r.skipped_documents == 1 and state(store)[0]["a"][2] == "new title" and state(store)[0]["b"][1] == "" and state(store)[1] == before
    r = run(4, whole, ("a", "A", "alpha two"), ("c", "C", " "))
    docs, chunks, gone = state(store)
    assert (r.processed_documents, r.missing_documents) == (1, 1) and docs["b"][1] == "t4" and len(gone) == 1 and gone[0].startswith("a:")
    assert [r["document_id"] for r in live(store.read("documents")).orderBy("document_id").collect()] == ["a", "c"]
    assert {r["document_id"] for r in live_chunks(store.read("chunks"), store.read("documents")).collect()} == {"a"}
    r = run(5, whole, ("a", "A", "alpha two"), ("b", "B", "beta"), ("b", "B", "beta"), ("c", "C", " "))
    assert (r.total_documents, r.processed_documents) == (4, 1) and state(store)[0]["b"][1] == ""
    r = run(6, whole, ("a", "A", "alpha two"), ("b", "B", "beta"), ("c", "C", " "), max_chars=4, overlap=0)
    assert r.processed_documents == 1  # beta still is one chunk
    with pytest.raises(ValueError):
        S.sync(store, rows(spark, ("a", "A", "x")), "other", whole, "t7", "s7")
    assert state(store)[0]["a"][0] == "alpha two"


def test_prefixes_are_literal(spark):
    docs = spark.createDataFrame([("a_1", "s", "old", ""), ("ab1", "s", "old", ""), ("a%1", "s", "old", ""), ("a_2", "s", "now", ""), ("a_3", "s", "old", "gone")], "document_id string, source_id string, last_seen_sync_id string, deleted_at string")
    assert [r["document_id"] for r in merge.stale(docs, "s", "last_seen_sync_id", "now", ("a_",)).collect()] == ["a_1"]


def test_an_unpublished_version_is_invisible(spark, tmp_path):
    store = Store(spark, str(tmp_path / "state"))
    S.sync(store, rows(spark, ("a", "A", "alpha")), "src", SnapshotInfo(True), "t1", "s1")
    store._write("documents", store.read("documents").withColumn("content", F.lit("half written")), store.read("documents"), "src", "00000002-lost")
    assert state(store)[0]["a"][0] == "alpha"
    assert store.read("sources").count() == 0


def test_streams_of_rows(spark, tmp_path):
    store, landed = Store(spark, str(tmp_path / "state")), str(tmp_path / "landed")
    rows(spark, ("a", "A", "one"), ("b", "B", "two")).coalesce(1).write.parquet(landed)
    stream = lambda: spark.readStream.schema(ROW).parquet(landed)
    S.follow(stream(), store, "src", str(tmp_path / "check")).awaitTermination()
    rows(spark, ("b", "B", "three")).coalesce(1).write.mode("append").parquet(landed)
    S.follow(stream(), store, "src", str(tmp_path / "check")).awaitTermination()
    docs = state(store)[0]
    assert {k: v[0] for k, v in docs.items()} == {"a": "one", "b": "three"} and all(v[1] == "" for v in docs.values())


def test_event_rates(spark, tmp_path):
    data = spark.createDataFrame([("s", "failed", "2024-01-01 00:10:00"), ("s", "failed", "2024-01-01 00:20:00"), ("s", "failed", "2024-01-01 03:00:00"), ("s", "failed", "2024-01-01 09:00:00")], "source_id string, status string, at string")
    data.select("source_id", "status", F.to_timestamp("at").alias("at")).coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema("source_id string, status string, at timestamp").parquet(str(tmp_path / "events"))
    q = S.event_rates(stream).writeStream.format("memory").queryName("rates").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.table("rates").collect()) == [1, 1, 2]


def test_jobs(spark):
    now = "2024-01-10 00:00:00"
    data = [("j1", "s", "running", "2024-01-09 20:00:00", ""), ("j2", "s", "running", "2024-01-09 21:00:00", ""), ("j3", "s", "running", "2024-01-01 00:00:00", ""), ("j4", "s", "failed", "2024-01-09 23:00:00", ""), ("j5", "t", "running", "2024-01-01 00:00:00", "2024-01-09 12:00:00"), ("j6", "u", "running", "garbage", ""), ("j7", "v", "succeeded", "2024-01-02 00:00:00", "")]
    df = spark.createDataFrame([(*d, "", "") for d in data], "job_id string, source_id string, status string, started_at string, heartbeat_at string, finished_at string, error_message string")
    assert {r["source_id"]: r["job_id"] for r in jobs.latest(df, now).collect()} == {"s": "j2", "t": "j5", "u": "j6", "v": "j7"}
    got = {r["job_id"]: (r["status"], r["error_message"]) for r in jobs.resolve_active(df, now).collect()}
    assert got["j2"] == ("running", "") and got["j5"] == ("running", "") and got["j4"] == ("failed", "") and got["j7"] == ("succeeded", "")
    assert got["j1"][0] == "failed" and "superseded" in got["j1"][1] and "timed out" in got["j3"][1] and "timed out" in got["j6"][1]
    assert {r["status"] for r in jobs.resolve_active(df, now, 0).filter("job_id in ('j1', 'j2', 'j5')").collect()} == {"failed"}
    assert jobs.allowed("running", "failed") and not jobs.allowed("succeeded", "running") and not jobs.allowed("failed", "succeeded")


class Landed:
    source_type = "web"

    def __init__(self, source_id, make, info=None):
        self.source_id, self.make, self.info = source_id, make, info or SnapshotInfo(True)

    def read(self, spark):
        return self.make(spark), self.info


def test_jobs_and_documents_are_published_together(spark, tmp_path):
    from quillmesh.sources.registry import Registry

    store = Store(spark, str(tmp_path / "state"))
    good = Landed("good", lambda s: rows(s, ("a", "A", "alpha"), ("b", "B", "beta")))

    def broken(s):
        raise RuntimeError("no answer: token=abcdef123456")

    bad = Landed("bad", broken)
    registry = Registry([good, bad])
    assert S.run_all(store, registry, "2024-01-01 00:00:00", ["good"])[0]["error_message"] == "unknown source: good"
    for c in (good, bad):
        S.register(store, c, c.source_id.title(), "2024-01-01 00:00:00", "env:TOKEN")
    out = {x["source_id"]: x for x in S.run_all(store, registry, "2024-01-01 00:00:01", ["bad", "nowhere", "good"])}
    assert out["good"]["status"] == "succeeded" and (out["good"]["total_documents"], out["good"]["indexed_chunks"]) == (2, 2)
    assert out["bad"]["status"] == "failed" and "abcdef" not in out["bad"]["error_message"] and out["nowhere"]["status"] == "failed"
    sources = {r["source_id"]: r for r in store.read("sources").collect()}
    assert (sources["good"]["sync_status"], sources["good"]["last_synced_at"], sources["good"]["auth_ref"]) == ("succeeded", "2024-01-01 00:00:01", "env:TOKEN")
    assert sources["bad"]["sync_status"] == "failed" and "<redacted>" in sources["bad"]["last_error"]
    assert [(r["source_id"], r["job_status"], r["progress"]) for r in S.status(store, "2024-01-01 00:01:00").collect()] == [("bad", "failed", 0.0), ("good", "succeeded", 1.0)]
    # A target without cleanup deletes nothing; names are refreshed, states stay.
    part = Landed("good", lambda s: rows(s, ("a", "A", "alpha")))
    S.run(store, part, "2024-01-02 00:00:00", cleanup=False)
    assert live(store.read("documents")).count() == 2
    S.register(store, good, "New", "2024-01-03 00:00:00")
    kept = store.read("sources", source_id="good").first()
    assert (kept["name"], kept["sync_status"], kept["created_at"], kept["auth_ref"]) == ("New", "succeeded", "2024-01-01 00:00:00", "")
    assert store.vacuum() > 0 and live(store.read("documents")).count() == 2 and store.vacuum() == 0


def test_a_running_job_is_left_alone_and_a_stale_one_gives_way(spark, tmp_path):
    store = Store(spark, str(tmp_path / "state"))
    c = Landed("s", lambda s: rows(s, ("a", "A", "alpha")))
    S.register(store, c, "S", "2024-01-01 00:00:00")
    begun, sources, active = jobs.begin(store.read("sync_jobs"), store.read("sources"), "j1", "s", "2024-01-01 00:00:00")
    assert active is None
    store.publish({"sync_jobs": begun, "sources": sources}, "s")
    assert S.run(store, c, "2024-01-01 01:00:00")["status"] == "already_running"
    assert store.read("documents").count() == 0
    done = S.run(store, c, "2024-01-03 00:00:00", "j2")
    assert done["status"] == "succeeded" and {r["job_id"]: r["status"] for r in store.read("sync_jobs").collect()} == {"j1": "failed", "j2": "succeeded"}


def test_the_life_of_a_job(spark):
    from quillmesh.schemas import SOURCES, SYNC_JOBS

    now = "2024-01-01 00:00:00"
    sources = spark.createDataFrame([("s", "web", "S", True, "", "idle", "", "", now, now)], SOURCES)
    state, sources, _ = jobs.begin(spark.createDataFrame([], SYNC_JOBS), sources, "j1", "s", now)
    state = jobs.update(state, "j1", processed_documents=3, heartbeat_at="2024-01-01 00:05:00")
    assert state.first()["processed_documents"] == 3
    for bad in ({"status": "succeeded"}, {"status": "running"}, {"source_id": "t"}):
        with pytest.raises(ValueError):
            jobs.update(state, "j1", **bad)
    with pytest.raises(ValueError):
        jobs.update(state, "j9", processed_documents=1)
    with pytest.raises(ValueError):
        jobs.fail(state, sources, "j1", "other", "x", now)
    # Another job took over: the first can't finish for the source any more.
    both = state.unionByName(jobs.changed(state, F.lit(True), job_id="j2", started_at="2024-01-01 01:00:00"))
    late, of_source, active = jobs.succeed(both, sources, "j1", "s", {"total_documents": 1}, "2024-01-01 02:00:00")
    assert not active and {r["job_id"]: r["status"] for r in late.collect()} == {"j1": "failed", "j2": "running"} and of_source.first()["sync_status"] == "running"
    failed, of_source = jobs.fail(both, sources, "j1", "s", "gone", "2024-01-01 02:00:00")
    assert of_source.first()["sync_status"] == "running" and failed.filter("job_id = 'j1'").first()["error_message"] == "gone"
    failed, of_source = jobs.fail(failed, of_source, "j2", "s", "gone too", "2024-01-01 03:00:00")
    assert (of_source.first()["sync_status"], of_source.first()["last_error"]) == ("failed", "gone too")
    same, _ = jobs.fail(failed, of_source, "j2", "s", "again", "2024-01-01 04:00:00")
    assert same.filter("job_id = 'j2'").first()["error_message"] == "gone too"


def test_vectors_follow_their_chunks(spark, tmp_path):
    store, whole = Store(spark, str(tmp_path / "state")), SnapshotInfo(True)
    given = []

    def embed(chunks):
        given.append(sorted(r["text"] for r in chunks.select("text").collect()))
        return chunks.withColumn("embedding", F.array(F.length("text").cast("float"), F.lit(1.0).cast("float")))

    run = lambda n, *v: S.sync(store, rows(spark, *v), "src", whole, f"t{n}", f"s{n}", embed=embed)
    run(1, ("a", "A", "alpha"), ("b", "B", "beta"))
    run(2, ("a", "A", "alpha"), ("b", "B", "beta two"), ("c", "C", "gamma"))
    run(3, ("a", "A", "alpha"), ("c", "C", "gamma"))
    assert given == [["alpha", "beta"], ["beta two", "gamma"], []]
    found = {r["document_id"]: r for r in store.read("vectors").collect()}
    assert found.keys() == {"a", "c"} and list(found["c"]["embedding"]) == [5.0, 1.0] and found["a"]["managed"] == "true" and found["a"]["vector_key"].startswith("managed:src:a:chunk:0:")

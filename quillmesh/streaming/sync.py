"""Syncs: one snapshot merged into the store, jobs around it, and streams of landed rows merged batch by batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmesh.functions.redact import error_message, safe_auth_ref
from quillmesh.operators import jobs, merge
from quillmesh.operators.chunking import MAX_CHARS, OVERLAP_CHARS, chunk_documents, chunker
from quillmesh.operators.documents import identity, live, normalize
from quillmesh.operators.store import Delta, Store
from quillmesh.schemas import CLAIMS, SOURCES, names
from quillmesh.sources.registry import Connector, Registry
from quillmesh.sources.web import SnapshotInfo


@dataclass(frozen=True)
class SyncResult:
    version: str
    total_documents: int
    processed_documents: int
    skipped_documents: int
    indexed_chunks: int
    missing_documents: int


#: What a stale job of another source, whose claim gives way, fails with.
CLAIM_EXPIRED = "Document claim expired with stale sync job"


def sync(
    store: Store, rows: DataFrame, source_id: str, info: SnapshotInfo, seen_at: str, sync_id: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_CHARS,
    finish: Callable[[dict[str, int]], dict[str, DataFrame] | None] | None = None, embed: Callable[[DataFrame], DataFrame] | None = None,
    claim: Callable[[DataFrame], None] | None = None, chunk: Callable[..., DataFrame] = chunk_documents,
) -> SyncResult:
    """Merge a source's snapshot (connector rows with ``position``) and publish what changed.

    The last row of a document counts, all are totalled. Only documents that are new, live again, of another content or
    chunked by another chunker are chunked; of the others chunks take over a new title, place or date, and are written only
    if there is one. Documents that a complete snapshot lacks, within its prefixes, are deleted; chunks of changed documents
    are replaced and recorded. When unchanged documents were last seen is noted beside them. A document of another source
    is refused. ``claim`` is given the documents that will be written, before they are chunked, and may refuse them.
    ``finish`` is given the counters and adds tables (the job and its source) to the same publication; None from it
    publishes nothing. ``embed`` adds embeddings to new chunks, whose vectors are published with them; those of chunks
    that are gone go.
    """
    pinned = store.pinned(source_id)
    documents, chunks, tombstones = (store.read(n, source_id, pinned) for n in ("documents", "chunks", "chunk_tombstones"))
    # Rows are numbered once: numbers that were computed again could differ.
    ordered = store.stage(rows if "position" in rows.columns else rows.withColumn("position", F.monotonically_increasing_id()))
    total = ordered.count()
    last = normalize(latest_rows(ordered), F.lit(source_id), seen_at, sync_id).withColumn("chunker", chunker(F.col("path"), F.col("title"), max_chars, overlap))
    triaged = store.stage(merge.triage(last, documents))
    new = triaged.filter("action = 'new'")
    if not new.isEmpty() and not merge.foreign_owners(store.read("documents", but=source_id), last.join(new, "document_id", "left_semi")).isEmpty():
        raise ValueError("a document belongs to another source")
    work = merge.to_chunk(last, triaged)
    same = last.join(triaged.filter("action = 'unchanged'").select("document_id"), "document_id", "left_semi")
    moved = changed_rows(same, documents)
    written = store.stage(work.select("document_id").unionByName(moved.select("document_id")))
    if claim:
        claim(written)
    new_chunks = store.stage(chunk(work, max_chars, overlap))
    changes = store.stage(merge.settle(triaged, new_chunks, chunks))
    count = merge.counters(changes).first()
    numbers = {"total_documents": total, **{n: count[n] for n in ("processed_documents", "skipped_documents", "indexed_chunks")}}
    more = finish(numbers) if finish else {}
    gone = merge.within(changes.filter("action = 'missing'" if info.complete else "false"), info.prefixes).select("document_id")
    missing = gone.count() if info.complete else 0
    version = ""
    if more is not None:
        tables: dict[str, DataFrame | Delta] = dict(more)
        seen = last.select("document_id", "source_id", "last_seen_at", "last_seen_sync_id").join(written, "document_id", "left_anti")
        tables["sightings"] = Delta(seen)
        if missing or not written.isEmpty():
            fresh = last.join(written, "document_id", "left_semi")
            deleted = documents.join(gone, "document_id", "left_semi").withColumn("deleted_at", F.lit(seen_at))
            renewed = store.stage(new_chunks.unionByName(merge.refreshed_chunks(chunks, moved, documents).select(new_chunks.columns)))
            redone = changes.filter("action in ('changed', 'rechunked', 'reappeared')").select("document_id", F.lit(source_id).alias("source_id"))
            recorded = merge.record_tombstones(tombstones.filter("false"), chunks, redone, seen_at).join(tombstones.select("chunk_id"), "chunk_id", "left_anti")
            tables |= {"documents": Delta(fresh.unionByName(deleted.select(fresh.columns))), "chunks": Delta(renewed, written), "chunk_tombstones": Delta(recorded)}
            if embed:
                affected = written.unionByName(gone)
                old = store.read("vectors", source_id, pinned).join(affected, "document_id", "left_semi")
                tables["vectors"] = Delta(merge.merged_vectors(old, renewed, embed), affected)
        version = store.publish(tables, source_id)
        if store.due(source_id):
            store.compact(source_id)
    return SyncResult(version, total, count["processed_documents"], count["skipped_documents"], count["indexed_chunks"], missing)


def changed_rows(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents that differ from the stored ones in more than when they were seen."""
    kept = [c for c in stored.columns if c not in ("last_seen_at", "last_seen_sync_id")]
    before = stored.select("document_id", F.xxhash64(*kept).alias("before"))
    return documents.join(before, "document_id").filter(F.xxhash64(*kept) != F.col("before")).drop("before")


def last_seen(store: Store, source_id: str | None = None) -> DataFrame:
    """Documents with when they were seen last: by their own rows, or by a later sighting."""
    seen = store.read("sightings", source_id).select("document_id", "source_id", F.struct("last_seen_at", "last_seen_sync_id").alias("seen"))
    docs = store.read("documents", source_id)
    own = F.struct("last_seen_at", "last_seen_sync_id")
    best = F.when(F.col("seen.last_seen_at") > F.col("last_seen_at"), F.col("seen")).otherwise(own)
    joined = docs.join(seen, ["document_id", "source_id"], "left").withColumn("best", best)
    return joined.withColumns({"last_seen_at": F.col("best.last_seen_at"), "last_seen_sync_id": F.col("best.last_seen_sync_id")}).select(docs.columns)


def claim_documents(store: Store, wanted: DataFrame, source_id: str, job_id: str, now: str, hours: float = jobs.LEASE_HOURS) -> None:
    """Claim documents for a running job. ValueError where a running job of another source holds one; a claim of a finished
    job gives way, as does that of a job without a sign of life, which fails by it, its source with it."""
    claims = store.read("document_claims")
    held = store.stage(merge.held_claims(claims, store.read("sync_jobs", but=source_id), wanted, source_id, now, hours))
    taken = held.filter("state = 'running'").orderBy("document_id").first()
    if taken is not None:
        raise ValueError(f"document {taken['document_id']} is already claimed by {taken['source_id']}, not {source_id}")
    # One running job a source at most: a bounded few.
    for r in held.filter("state = 'stale'").select("source_id", "job_id").distinct().collect():
        failed, of_source = jobs.fail(store.read("sync_jobs", r["source_id"]), store.read("sources", r["source_id"]), r["job_id"], r["source_id"], CLAIM_EXPIRED, now, hours)
        store.publish({"sync_jobs": failed, "sources": of_source, "document_claims": claims.filter("false")}, r["source_id"])
    mine = merge.claimed(store.read("document_claims", source_id), wanted, held, source_id, job_id, now)
    store.publish({"document_claims": mine}, source_id)


def register(store: Store, connector: Connector, name: str, now: str, auth_ref: str = "") -> None:
    """Add a source, or refresh its name and reference; its state stays."""
    old = store.read("sources", connector.source_id).first()
    fresh = {"source_id": connector.source_id, "source_type": connector.source_type, "name": name, "enabled": True, "auth_ref": auth_ref, "sync_status": "idle", "last_synced_at": "", "last_error": "", "created_at": now}
    if old is not None:
        fresh |= {n: old[n] for n in ("sync_status", "last_synced_at", "last_error", "created_at")}
    row = store.spark.createDataFrame([tuple(fresh.get(n, now) for n in names(SOURCES))], SOURCES)
    store.publish({"sources": row.withColumn("auth_ref", safe_auth_ref(F.col("auth_ref")))}, connector.source_id)


def run(store: Store, connector: Connector, now: str, job_id: str | None = None, cleanup: bool = True, hours: float = jobs.LEASE_HOURS) -> dict:
    """One sync job of a registered source, from its begin to its end; the job's row as a dict.

    A source whose job is running is left alone (``already_running``). The documents, the job's counters and the
    source's state are published together; a failure is published with its message redacted. Without ``cleanup``
    nothing is deleted (targets that are synced on demand).
    """
    source_id, job_id = connector.source_id, job_id or f"job-{uuid.uuid4().hex}"

    def tables() -> tuple[DataFrame, DataFrame]:
        pinned = store.pinned(source_id)
        return store.read("sync_jobs", source_id, pinned), store.read("sources", source_id, pinned)

    released = store.spark.createDataFrame([], CLAIMS)
    begun, sources, active = jobs.begin(*tables(), job_id, source_id, now, hours)
    if active is not None:
        return {"source_id": source_id, "job_id": active, "status": "already_running"}
    store.publish({"sync_jobs": begun, "sources": sources}, source_id)

    def finish(counters: dict[str, int]) -> dict[str, DataFrame] | None:
        done, of_source, active = jobs.succeed(*tables(), job_id, source_id, counters, now, hours)
        ended = {"sync_jobs": done, "sources": of_source, "document_claims": released}
        if not active:
            store.publish(ended, source_id)
        return ended if active else None

    def claim(wanted: DataFrame) -> None:
        claim_documents(store, wanted, source_id, job_id, now, hours)

    try:
        rows, info = connector.read(store.spark)
        sync(store, rows, source_id, info if cleanup else SnapshotInfo(False), now, job_id, finish=finish, claim=claim)
    except Exception as e:  # whatever stops a source becomes its job's message
        message = store.spark.range(1).select(error_message(F.lit(str(e)[:2000]))).first()[0]
        failed, of_source = jobs.fail(*tables(), job_id, source_id, message, now, hours)
        store.publish({"sync_jobs": failed, "sources": of_source, "document_claims": released}, source_id)
    return jobs.one(tables()[0], job_id).asDict()


def run_all(store: Store, registry: Registry, now: str, source_ids: Iterable[str] | None = None, hours: float = jobs.LEASE_HOURS) -> list[dict]:
    """Jobs of several sources (all, if none are named), one after the other; the failure of one, unknown ones too, doesn't stop the others."""
    out = []
    for source_id in registry.ids() if source_ids is None else source_ids:
        try:
            out.append(run(store, registry.get(source_id), now, hours=hours))
        except ValueError as e:
            out.append({"source_id": source_id, "status": "failed", "error_message": str(e)})
    return out


def status(store: Store, now: str) -> DataFrame:
    """Every source with its latest job and how far it has come."""
    sync_jobs = store.read("sync_jobs")
    last = jobs.latest(sync_jobs, now).select("source_id", "job_id", F.col("status").alias("job_status"), jobs.progress(F.col("processed_documents") + F.col("skipped_documents"), F.col("total_documents")).alias("progress"), "error_message")
    return store.read("sources").select("source_id", "source_type", "sync_status").join(last, "source_id", "left").orderBy("source_id")


def latest_rows(rows: DataFrame) -> DataFrame:
    """Of connector rows of one identity the one of the last position."""

    def have(name: str) -> Column:
        return F.col(name).cast("string") if name in rows.columns else F.lit("")

    keyed = rows.withColumn("document_key", identity(have("external_id"), have("document_id"), have("id")))
    newest = keyed.groupBy("document_key").agg(F.max("position").alias("position"))
    return keyed.join(newest, ["document_key", "position"], "left_semi").drop("document_key")


def live_counts(store: Store) -> DataFrame:
    return live(store.read("documents")).groupBy("source_id").agg(F.count("*").alias("documents"))


def follow(stream: DataFrame, store: Store, source_id: str, checkpoint: str) -> StreamingQuery:
    """Merge every micro-batch of a stream of connector rows; a batch is a partial snapshot, so it deletes nothing.

    A batch that is run again after a failure is found unchanged: merging is idempotent by content hashes.
    """

    def batch(rows: DataFrame, number: int) -> None:
        held = rows.persist()
        if not held.isEmpty():
            sync(store, held, source_id, SnapshotInfo(False), f"batch-{number:08d}", f"batch-{number}")
        held.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_rates(stream: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Jobs a source and window by state, from a stream of job events (source_id, status, at); late ones are dropped after ``late``."""
    return stream.withWatermark("at", late).groupBy(F.window("at", window), "source_id", "status").agg(F.count("*").alias("n")).select("source_id", "status", F.col("window.start").alias("start"), "n")

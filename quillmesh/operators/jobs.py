"""Sync jobs: the latest of a source, the active one, and transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

LEASE_HOURS = 24
#: From which state a job may go where.
TRANSITIONS = {"queued": {"running", "failed"}, "running": {"succeeded", "failed"}, "succeeded": set(), "failed": set()}


def is_stale(now: str, hours: float = LEASE_HOURS) -> Column:
    """No sign of life (heartbeat, else start) for the lease's time; an unreadable time or no lease is stale."""
    if hours <= 0:
        return F.lit(True)
    seen = F.try_to_timestamp(F.coalesce(F.nullif(F.col("heartbeat_at"), F.lit("")), F.col("started_at")))
    return F.coalesce(F.unix_micros(F.to_timestamp(F.lit(now))) - F.unix_micros(seen) > int(hours * 3_600_000_000), F.lit(True))


def latest(jobs: DataFrame, now: str, hours: float = LEASE_HOURS) -> DataFrame:
    """One job a source: a running one that isn't stale, else the last started (the greatest id among equals)."""
    active = ((F.col("status") == "running") & ~is_stale(now, hours)).cast("int")
    w = Window.partitionBy("source_id").orderBy(active.desc(), F.col("started_at").desc(), F.col("job_id").desc())
    return jobs.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def resolve_active(jobs: DataFrame, now: str, hours: float = LEASE_HOURS) -> DataFrame:
    """Of a source's running jobs the newest live one stays; others fail as superseded, stale ones as timed out."""
    old = is_stale(now, hours)
    w = Window.partitionBy("source_id", F.col("status") == "running", old).orderBy(F.col("started_at").desc(), F.col("job_id").desc())
    ranked = jobs.withColumn("old", old).withColumn("rn", F.row_number().over(w))
    ends = (F.col("status") == "running") & (F.col("old") | (F.col("rn") > 1))
    why = F.when(F.col("old"), "Sync job timed out.").otherwise("Sync job superseded by a newer running job.")
    return ranked.withColumns({"status": F.when(ends, "failed").otherwise(F.col("status")), "error_message": F.when(ends, why).otherwise(F.col("error_message")), "finished_at": F.when(ends, now).otherwise(F.col("finished_at"))}).select(jobs.columns)


def allowed(old: str, new: str) -> bool:
    return old == new or new in TRANSITIONS.get(old, set())


PROGRESS = ("heartbeat_at", "total_documents", "processed_documents", "indexed_chunks", "skipped_documents", "error_message")


def one(jobs: DataFrame, job_id: str, source_id: str | None = None) -> Row:
    """A job's row; ValueError for an unknown one and for one of another source."""
    row = jobs.filter(F.col("job_id") == job_id).first()
    if row is None:
        raise ValueError(f"unknown job: {job_id}")
    if source_id is not None and row["source_id"] != source_id:
        raise ValueError(f"job {job_id} belongs to {row['source_id']}")
    return row


def changed(rows: DataFrame, which: Column, **values) -> DataFrame:
    """The rows with some columns set where ``which`` holds."""
    return rows.withColumns({n: F.when(which, F.lit(v)).otherwise(F.col(n)).cast(rows.schema[n].dataType) for n, v in values.items()})


def begin(jobs: DataFrame, sources: DataFrame, job_id: str, source_id: str, now: str, hours: float = LEASE_HOURS) -> tuple[DataFrame, DataFrame, str | None]:
    """Jobs and sources with a new running job, or the job that is running already, which stays as it is.

    Stale and superseded jobs of the source are resolved first. ValueError for an unknown source.
    """
    mine = F.col("source_id") == source_id
    if sources.filter(mine).isEmpty():
        raise ValueError(f"unknown source: {source_id}")
    resolved = resolve_active(jobs, now, hours)
    active = resolved.filter(mine & (F.col("status") == "running")).first()
    if active is not None:
        return resolved, sources, active["job_id"]
    row = jobs.sparkSession.range(1).select(
        *[F.lit({"job_id": job_id, "source_id": source_id, "status": "running", "started_at": now, "heartbeat_at": now}.get(f.name, "" if f.dataType.simpleString() == "string" else 0)).cast(f.dataType).alias(f.name) for f in jobs.schema]
    )
    return resolved.unionByName(row), changed(sources, mine, sync_status="running", updated_at=now), None


def update(jobs: DataFrame, job_id: str, **values) -> DataFrame:
    """A job's progress; its state is changed by ``begin``, ``succeed`` and ``fail`` only."""
    one(jobs, job_id)
    if not set(values) <= set(PROGRESS):
        raise ValueError("only a job's progress may be updated")
    return changed(jobs, F.col("job_id") == job_id, **values)


def succeed(jobs: DataFrame, sources: DataFrame, job_id: str, source_id: str, counters: dict[str, int], now: str, hours: float = LEASE_HOURS) -> tuple[DataFrame, DataFrame, bool]:
    """Jobs and sources after a job is done, and whether it was the source's active one; one that wasn't changes nothing of the source."""
    if one(jobs, job_id, source_id)["status"] != "running":
        return jobs, sources, False
    resolved = resolve_active(jobs, now, hours)
    if one(resolved, job_id)["status"] != "running":
        return resolved, settled(resolved, sources, source_id, "Sync job is no longer active", now), False
    done = changed(resolved, F.col("job_id") == job_id, status="succeeded", finished_at=now, error_message="", **counters)
    return done, changed(sources, F.col("source_id") == source_id, sync_status="succeeded", last_synced_at=now, last_error="", updated_at=now), True


def fail(jobs: DataFrame, sources: DataFrame, job_id: str, source_id: str, message: str, now: str, hours: float = LEASE_HOURS) -> tuple[DataFrame, DataFrame]:
    """Jobs and sources after a queued or running job failed; a finished one stays, and so does the state of a source
    with another active job."""
    if one(jobs, job_id, source_id)["status"] not in ("queued", "running"):
        return jobs, sources
    failed = resolve_active(changed(jobs, F.col("job_id") == job_id, status="failed", finished_at=now, error_message=message), now, hours)
    return failed, settled(failed, sources, source_id, message, now)


def settled(jobs: DataFrame, sources: DataFrame, source_id: str, message: str, now: str) -> DataFrame:
    """Sources, with a failure noted where the source has no running job."""
    mine = F.col("source_id") == source_id
    if not jobs.filter(mine & (F.col("status") == "running")).isEmpty():
        return sources
    return changed(sources, mine, sync_status="failed", last_error=message, updated_at=now)


def progress(processed: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(processed / total * 100 + 0.5) / 100).otherwise(F.lit(0.0))


def with_latest(sources: DataFrame, jobs: DataFrame, now: str) -> DataFrame:
    """Sources in order of their id, each with its latest job where it has one."""
    job = latest(jobs, now).select("source_id", "job_id", F.col("status").alias("job_status"), "started_at")
    return sources.join(job, "source_id", "left")

"""Schemas of the engine's tables. Missing text is '', never null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SOURCES = "source_id string, source_type string, name string, enabled boolean, auth_ref string, sync_status string, last_synced_at string, last_error string, created_at string, updated_at string"
SYNC_JOBS = "job_id string, source_id string, status string, started_at string, heartbeat_at string, finished_at string, total_documents int, processed_documents int, indexed_chunks int, skipped_documents int, error_message string"
DOCUMENTS = "document_id string, source_id string, external_id string, title string, content string, url string, canonical_url string, platform string, date string, path string, updated_at string, last_seen_at string, last_seen_sync_id string, deleted_at string, version_id string, content_hash string, chunker string"
CHUNKS = "chunk_id string, document_id string, source_id string, title string, text string, url string, path string, chunk_index int, line_start int, line_end int, version_id string, content_hash string, updated_at string"
TOMBSTONES = "chunk_id string, document_id string, source_id string, recorded_at string"
CLAIMS = "document_id string, source_id string, job_id string, claimed_at string"
SIGHTINGS = "document_id string, source_id string, last_seen_at string, last_seen_sync_id string"

VECTORS = "vector_key string, doc_id string, chunk_id string, document_id string, source_id string, title string, url string, path string, content_hash string, managed string, embedding array<float>"


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def align(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema in its order; absent ones are added, '' for text and null for others; text nulls become ''."""
    out = []
    for c in schema.split(", "):
        name, kind = c.split()
        have = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        out.append((F.coalesce(have, F.lit("")) if kind == "string" else have).alias(name))
    return df.select(*out)

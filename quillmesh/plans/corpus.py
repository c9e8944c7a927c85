"""The driver's tables in the roles of the engine's: documents, chunks, sources, jobs; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.text import strip
from quillmesh.operators.chunking import MAX_CHARS, OVERLAP_CHARS, chunker, number_chunks, plain_parts
from quillmesh.operators import vector_index
from quillmesh.operators.documents import normalize
from quillmesh.operators.published import shared_folder
from quillmesh.operators.vector_index import VectorIndex
from quillmesh.plans.registry import table

SEEN_AT, SYNC_ID, NOW = "2026-01-02T00:00:00+00:00", "sync-2", "2024-01-30 12:00:00"


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where its files have fewer splits than that; a table of many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat("source", F.lit(":"), F.col("doc_id").cast("string"))
    return spread(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("doc_id").cast("string").alias("id"), key.alias("external_id"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("content"),
        F.concat(F.lit("https://docs.example/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("url"), F.col("lang").alias("platform"), F.lit("2026-01-01").alias("date"), F.col("source").alias("source_id"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized documents; one in ten is deleted."""
    rows = normalize(raw_documents(spark, sf_dir), F.col("source_id"), SEEN_AT, SYNC_ID)
    gone = F.regexp_extract("document_id", r"(\d+)$", 1).cast("long") % 10 == 9
    return rows.withColumn("deleted_at", F.when(gone, SEEN_AT).otherwise("")).withColumn("chunker", chunker(F.col("path"), F.col("title")))


def chunks(docs: DataFrame) -> DataFrame:
    """Chunks of documents whose paths are plain text (titles without an extension): native expressions only."""
    return number_chunks(docs.withColumn("body", strip(F.col("content"))).withColumn("parts", plain_parts(F.col("body"))))


_vectors: dict[tuple[str, str], VectorIndex] = {}


def vectors(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The published vectors of these tables by cell, written once an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _vectors:
        _vectors[key] = vector_index.build(table(spark, sf_dir, "embeddings"), "vec_id", shared_folder(spark))
    return _vectors[key]


def sources(docs: DataFrame) -> DataFrame:
    """A source of documents each, with a type by the length of its name; one in the list has none."""
    kind = F.when(F.length("source_id") % 2 == 0, "web").otherwise("github")
    return docs.select("source_id").distinct().filter("source_id != 'src3'").withColumn("source_type", kind)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sync jobs: the user is the source, the type the state."""
    status = F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "error", "failed").otherwise("succeeded")
    return table(spark, sf_dir, "events").select(
        F.format_string("job-%08d", F.col("event_id")).alias("job_id"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("source_id"), status.alias("status"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("started_at"), F.lit("").alias("heartbeat_at"), F.lit("").alias("finished_at"), F.lit("").alias("error_message"), F.col("value").alias("value"),
    )


# The same in SQL, as bodies of common table expressions.
SQL_DOCS = f"""docs AS (SELECT doc_id, source || ':' || doc_id AS document_id, source AS source_id, 'Document ' || doc_id AS title, text AS content,
  'https://docs.example/' || source || '/' || doc_id AS url, 'Document ' || doc_id AS path, '2026-01-01' AS updated_at, md5(text) AS content_hash, lang AS platform,
  CASE WHEN doc_id % 10 = 9 THEN '{SEEN_AT}' ELSE '' END AS deleted_at FROM documents)"""
SQL_CHUNKS = rf"""stripped AS (SELECT *, regexp_replace(content, '^\s+|\s+$', '', 'g') AS body FROM docs),
windows AS (SELECT s.*, w.k AS k, substr(body, w.k * {MAX_CHARS - OVERLAP_CHARS} + 1, {MAX_CHARS}) AS raw, substr(body, 1, w.k * {MAX_CHARS - OVERLAP_CHARS}) AS ahead FROM stripped s,
  LATERAL (SELECT unnest(generate_series(0, CASE WHEN length(body) <= {MAX_CHARS} THEN 0 ELSE CAST(ceil((length(body) - {MAX_CHARS}) / {MAX_CHARS - OVERLAP_CHARS}.0) AS BIGINT) END)) AS k) w),
pieces AS (SELECT *, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS piece, length(ahead) - length(replace(ahead, chr(10), '')) + 1 AS line FROM windows),
numbered AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY k) - 1 AS chunk_index FROM pieces WHERE piece <> ''),
chunks AS (SELECT doc_id, document_id || ':chunk:' || chunk_index || ':' || substr(md5(piece), 1, 12) AS chunk_id, document_id, source_id, title, piece AS text, url, path,
  CAST(chunk_index AS INTEGER) AS chunk_index, CAST(line AS INTEGER) AS line_start, CAST(line + length(piece) - length(replace(piece, chr(10), '')) AS INTEGER) AS line_end,
  md5(piece) AS content_hash, updated_at, deleted_at, '' AS version_id, platform FROM numbered)"""
SQL_SOURCES = "sources AS (SELECT DISTINCT source AS source_id, CASE WHEN length(source) % 2 = 0 THEN 'web' ELSE 'github' END AS source_type FROM documents WHERE source <> 'src3')"
SQL_JOBS = """jobs AS (SELECT 'job-' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS job_id, 'user' || user_id AS source_id,
  CASE event_type WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'succeeded' END AS status, strftime(ts, '%Y-%m-%d %H:%M:%S') AS started_at, value FROM events)"""

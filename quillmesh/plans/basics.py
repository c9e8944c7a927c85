"""Scans, set operations and small projections over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.redact import error_message, payload
from quillmesh.functions.text import content_hash, extension, has_control_bytes, split_lines
from quillmesh.functions.urls import shown
from quillmesh.operators import merge
from quillmesh.operators.documents import identity, live
from quillmesh.operators.store import union
from quillmesh.plans import corpus
from quillmesh.plans.corpus import SQL_CHUNKS, SQL_DOCS, SQL_JOBS, SQL_SOURCES
from quillmesh.plans.registry import query, table


@query(f"WITH {SQL_DOCS} SELECT document_id, source_id, title FROM docs WHERE source_id = 'src1'")
def sc22_documents_of_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.documents(spark, sf_dir).filter("source_id = 'src1'").select("document_id", "source_id", "title")


@query("SELECT label AS vector_key, max(vec_id) AS content_hash FROM embeddings GROUP BY label")
def sc23_stored_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key and hash of each stored vector; of repeated keys the last counts."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.groupBy(F.col("label").alias("vector_key")).agg(F.max_by("vec_id", "vec_id").alias("content_hash"))


@query("SELECT doc_id, md5(text) AS content_hash FROM documents")
def p2_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("content_hash"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'ext' || doc_id WHEN 1 THEN 'doc' || doc_id ELSE 'raw' || doc_id END AS document_id FROM documents")
def p1_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, text = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    made = identity(F.when(n == 0, F.concat(F.lit("ext"), text)).otherwise(""), F.when(n == 1, F.concat(F.lit("doc"), text)), F.concat(F.lit("raw"), text))
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("document_id"))


@query(f"WITH {SQL_DOCS} SELECT source_id, count(*) AS n_live FROM docs WHERE deleted_at = '' GROUP BY source_id")
def p5_live_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(corpus.documents(spark, sf_dir)).groupBy("source_id").agg(F.count("*").alias("n_live"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'token=<redacted> failed' ELSE 'Sync failed. See server logs for details.' END AS error, 'https://e.example/a' AS url FROM events")
def p17_safe_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.when(F.col("event_type") == "error", F.concat(F.lit("token=secret"), F.col("event_id").cast("string"), F.lit(" failed"))).otherwise("")
    return table(spark, sf_dir, "events").select("event_id", error_message(message).alias("error"), shown(F.lit("https://u:p@e.example/a?x=1#y")).alias("url"))


@query("SELECT event_id, '[REDACTED]' AS api_key, props AS props FROM events")
def f36_payload_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = payload(F.create_map(F.lit("apiKey"), F.col("event_id").cast("string"), F.lit("props"), F.col("props")))
    return table(spark, sf_dir, "events").select("event_id", fields["apiKey"].alias("api_key"), fields["props"].alias("props"))


@query("SELECT o_orderkey AS document_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def j5_missing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("document_id"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id")).join(seen, "document_id", "left_anti")


@query(f"WITH {SQL_DOCS}, {SQL_SOURCES} SELECT d.document_id, coalesce(s.source_type, '') AS source_type FROM docs d LEFT JOIN sources s USING (source_id)")
def j3_source_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.documents(spark, sf_dir)
    return docs.join(corpus.sources(docs), "source_id", "left").select("document_id", F.coalesce("source_type", F.lit("")).alias("source_type"))


@query(f"WITH {SQL_DOCS}, {SQL_CHUNKS} SELECT source_id, count(*) AS n_chunks, count(DISTINCT document_id) AS n_documents, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM chunks GROUP BY source_id")
def a5_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = corpus.chunks(corpus.documents(spark, sf_dir))
    return chunks.groupBy("source_id").agg(F.count("*").alias("n_chunks"), F.count_distinct("document_id").alias("n_documents"), F.sum(F.length("text")).alias("n_chars"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (text <> '') AS joined FROM conversations GROUP BY conv_id")
def a7_joined_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    said = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(parts.alias("p"))
    return said.select("conv_id", F.array_join(F.filter(F.transform("p", lambda x: x["text"]), lambda t: t != ""), "\n\n").alias("joined"))


@query("SELECT doc_id AS id, lang AS kind FROM documents UNION ALL SELECT page_id, 'page' FROM pages UNION ALL SELECT item_id, 'item' FROM benchmark")
def u1_union_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"))
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"))
    return union([docs, pages, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("item").alias("kind"))])


@query("""WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.w AS x, b.w AS y FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, CAST(len(list_filter(x, lambda t: NOT list_contains(y, t))) AS BIGINT) AS gone, CAST(len(list_filter(x, lambda t: list_contains(y, t))) AS BIGINT) AS kept, list_sort(x) = list_sort(y) AS same FROM p""".replace("\\\\", "\\"))
def u2_u4_term_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference, intersection and equality of the term sets of adjacent turns."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")).alias("x"))
    nexts = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y"))
    both = rows.join(nexts, ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.size(F.array_except("x", "y")).cast("long").alias("gone"), F.size(F.array_intersect("x", "y")).cast("long").alias("kept"), (F.array_sort("x") == F.array_sort("y")).alias("same"))


@query(r"""WITH t AS (SELECT doc_id, text, string_split_regex(text, '\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS p FROM documents)
SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 WHEN p[-1] = '' THEN len(p) - 1 ELSE len(p) END AS BIGINT) AS n_lines, regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]') AS control, '.txt' AS extension FROM t""")
def f4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(split_lines(F.col("text"))).cast("long").alias("n_lines"), has_control_bytes(F.col("text")).alias("control"), extension(F.concat(F.lit("a/"), F.col("doc_id").cast("string"), F.lit(".TXT"))).alias("extension"))


@query(f"WITH {SQL_JOBS} SELECT source_id, count(*) AS n_jobs, count(*) FILTER (status = 'failed') AS n_failed, max(started_at) AS last_started FROM jobs GROUP BY source_id")
def j9_job_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.jobs(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("n_jobs"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.max("started_at").alias("last_started"))


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id DESC) AS rn FROM documents) SELECT md5(text) AS document_id, doc_id AS position FROM d WHERE rn = 1""")
def w8_last_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(content_hash(F.col("text")).alias("document_id"), F.col("doc_id").alias("position"))
    return merge.last_of_each(rows)

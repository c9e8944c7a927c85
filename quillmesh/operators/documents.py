"""Documents: identity, normalization, and what indexing and the vector store see of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import content_hash, first_filled
from quillmesh.schemas import DOCUMENTS, align


def identity(external_id: Column, document_id: Column, id: Column) -> Column:
    return first_filled(external_id, document_id, id)


def normalize(raw: DataFrame, source_id: Column, seen_at: str, sync_id: str) -> DataFrame:
    """Connector rows as stored documents: one identity, fallbacks filled, stamped as seen now, live."""

    def have(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in raw.columns else F.lit("")

    key = identity(have("external_id"), have("document_id"), have("id"))
    made = {
        "document_id": key, "external_id": key, "source_id": source_id, "title": have("title"), "content": have("content"), "url": have("url"),
        "canonical_url": first_filled(have("canonical_url"), have("url")), "platform": have("platform"), "date": have("date"),
        "path": first_filled(have("path"), have("title")), "updated_at": first_filled(have("updated_at"), have("date")), "last_seen_at": F.lit(seen_at),
        "last_seen_sync_id": F.lit(sync_id), "deleted_at": F.lit(""), "version_id": have("version_id"), "content_hash": content_hash(have("content")),
    }
    return align(raw.select(*[c.alias(n) for n, c in made.items()]), DOCUMENTS)


def live(documents: DataFrame) -> DataFrame:
    return documents.filter(F.coalesce(F.col("deleted_at"), F.lit("")) == "")


def live_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks whose document (same id and source) is live."""
    return chunks.join(live(documents).select("document_id", "source_id"), ["document_id", "source_id"], "left_semi")


def in_order(chunks: DataFrame) -> DataFrame:
    """Chunks by document and index; of one document by index alone."""
    return chunks.orderBy("document_id", "chunk_index")


def chunk_documents(chunks: DataFrame) -> DataFrame:
    """Chunks in the form that indexing takes: a chunk is a document of its own id."""
    return chunks.select(
        F.col("chunk_id").alias("id"), F.col("chunk_id").alias("document_id"), "source_id", F.col("document_id").alias("external_id"), "title", F.col("text").alias("content"), "url",
        F.col("url").alias("canonical_url"), "path", "updated_at", "version_id", "content_hash", "chunk_id", "chunk_index", "line_start", "line_end",
    )


def vector_metadata(chunks: DataFrame) -> DataFrame:
    """Flat metadata of a vector: numbers that are missing are -1, and a flag tells managed vectors."""
    managed = (F.coalesce("chunk_id", F.lit("")) != "") & (F.coalesce("document_id", F.lit("")) != "") & (F.coalesce("source_id", F.lit("")) != "")
    return chunks.select(
        F.col("chunk_id").alias("doc_id"), "chunk_id", "document_id", "source_id", "title", "url", "path", F.coalesce("chunk_index", F.lit(-1)).alias("chunk_index"),
        F.coalesce("line_start", F.lit(-1)).alias("line_start"), F.coalesce("line_end", F.lit(-1)).alias("line_end"), "version_id", "content_hash", "updated_at",
        F.when(managed, "true").otherwise("false").alias("managed"),
        F.concat(F.when(managed, "managed").otherwise("raw"), F.lit(":"), F.col("source_id"), F.lit(":"), F.col("chunk_id")).alias("vector_key"),
    )

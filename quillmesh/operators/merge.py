"""Incremental merge: a snapshot against the stored state, as joins. Nothing here writes; results are new tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import first_filled
from quillmesh.operators.documents import live, vector_metadata
from quillmesh.operators.jobs import is_stale

ACTIONS = ("unchanged", "rechunked", "changed", "new", "reappeared", "missing")


def last_of_each(snapshot: DataFrame, order: str = "position") -> DataFrame:
    """One row a document: the last by position. The rows before it still count as seen."""
    w = Window.partitionBy("document_id").orderBy(F.col(order).desc())
    return snapshot.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


#: Actions for which a document is chunked; "check" is one of them until the chunks are compared.
CHUNKED = ("check", "changed", "new", "reappeared")


def triage(snapshot: DataFrame, stored: DataFrame) -> DataFrame:
    """document_id and action of every document of either side, by hashes alone: no text is chunked for it.

    "check" marks the same content under another chunker: its chunks may be the same. Documents that are deleted already
    and not in the snapshot are left out.
    """
    new = snapshot.select("document_id", F.col("content_hash").alias("new_hash"), F.col("chunker").alias("new_chunker"))
    old = stored.select("document_id", F.col("content_hash").alias("old_hash"), F.col("chunker").alias("old_chunker"), (F.coalesce("deleted_at", F.lit("")) == "").alias("live"))
    action = (
        F.when(F.col("new_hash").isNull(), F.when(F.col("live"), "missing").otherwise("gone"))
        .when(F.col("old_hash").isNull(), "new")
        .when(~F.col("live"), "reappeared")
        .when(F.col("new_hash") != F.col("old_hash"), "changed")
        .when(F.col("new_chunker") != F.col("old_chunker"), "check")
        .otherwise("unchanged")
    )
    return new.join(old, "document_id", "full").select("document_id", action.alias("action")).filter("action != 'gone'")


def to_chunk(snapshot: DataFrame, triaged: DataFrame) -> DataFrame:
    """The documents of a snapshot that have to be chunked."""
    return snapshot.join(triaged.filter(F.col("action").isin(*CHUNKED)).select("document_id"), "document_id", "left_semi")


def chunk_prints(chunks: DataFrame) -> DataFrame:
    """document_id, number of chunks, and 128 bits of the set of their ids, whatever their order."""
    parts = [F.bit_xor(F.xxhash64("chunk_id", F.lit(k))) for k in range(2)]
    return chunks.groupBy("document_id").agg(F.count("*").alias("n"), F.struct(*[p.alias(f"h{k}") for k, p in enumerate(parts)]).alias("print"))


def settle(triaged: DataFrame, new_chunks: DataFrame, old_chunks: DataFrame) -> DataFrame:
    """document_id, action, n_new: with the chunks of ``to_chunk`` "check" becomes unchanged or rechunked.

    Only what is to be checked is looked up among the stored chunks.
    """
    new = chunk_prints(new_chunks)
    asked = triaged.filter("action = 'check'").select("document_id")
    old = chunk_prints(old_chunks.select("document_id", "chunk_id").join(asked, "document_id", "left_semi")).select("document_id", F.col("n").alias("n_old"), F.col("print").alias("old_print"))
    both = triaged.join(new, "document_id", "left").join(old, "document_id", "left")
    same = (F.coalesce("n", F.lit(0)) == F.coalesce("n_old", F.lit(0))) & F.col("print").eqNullSafe(F.col("old_print"))
    action = F.when(F.col("action") == "check", F.when(same, "unchanged").otherwise("rechunked")).otherwise(F.col("action"))
    return both.select("document_id", action.alias("action"), F.coalesce("n", F.lit(0)).cast("int").alias("n_new"))


def diff(snapshot: DataFrame, stored: DataFrame, chunk: Callable[[DataFrame], DataFrame], old_chunks: DataFrame) -> DataFrame:
    """What happens to every document of either side: document_id, action, n_new (of those that are chunked)."""
    triaged = triage(snapshot, stored)
    return settle(triaged, chunk(to_chunk(snapshot, triaged)), old_chunks)


def stale_chunks(changes: DataFrame, new_chunks: DataFrame, old_chunks: DataFrame) -> DataFrame:
    """Stored chunks of documents that were chunked again whose ids are gone."""
    redone = changes.filter("action in ('changed', 'rechunked')").select("document_id")
    return old_chunks.join(redone, "document_id", "left_semi").join(new_chunks.select("chunk_id"), "chunk_id", "left_anti")


def refreshed_chunks(chunks: DataFrame, documents: DataFrame, previous: DataFrame) -> DataFrame:
    """Chunks of documents whose content stays and whose title, place, date or version doesn't: the same texts under the new ones."""
    carried = ("title", "url", "path", "updated_at", "version_id")

    def shown(docs: DataFrame, prefix: str) -> DataFrame:
        made = {
            "title": F.col("title"), "url": first_filled(F.col("canonical_url"), F.col("url")), "path": first_filled(F.col("path"), F.col("title")),
            "updated_at": first_filled(F.col("updated_at"), F.col("date")), "version_id": F.col("version_id"),
        }
        return docs.select("document_id", *[made[c].alias(f"{prefix}{c}") for c in carried])

    both = shown(documents, "new_").join(shown(previous, "old_"), "document_id")
    differ = reduce(lambda a, b: a | b, [~F.col(f"new_{c}").eqNullSafe(F.col(f"old_{c}")) for c in carried])
    moved = both.filter(differ).select("document_id", *[f"new_{c}" for c in carried])
    return chunks.join(moved, "document_id").select(*[F.col(f"new_{c}").alias(c) if c in carried else F.col(c) for c in chunks.columns])


def counters(changes: DataFrame, total: Column | None = None) -> DataFrame:
    """total, processed and skipped documents, indexed chunks, and documents to tombstone."""
    seen = F.col("action") != "missing"
    redone = seen & (F.col("action") != "unchanged")
    return changes.agg(
        F.count_if(seen).alias("total_documents"), F.count_if(redone).alias("processed_documents"), F.count_if(F.col("action") == "unchanged").alias("skipped_documents"),
        F.coalesce(F.sum(F.when(redone, F.col("n_new"))), F.lit(0)).alias("indexed_chunks"), F.count_if(~seen).alias("missing_documents"),
    )


def overlay(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """New rows over old ones by key; columns in ``keep`` stay as stored where a row exists."""
    held = old.select(*keys, *[F.col(c).alias(f"held_{c}") for c in keep], F.lit(True).alias("had")) if keep else None
    made = new.select(old.columns)
    if keep:
        made = made.join(held, list(keys), "left").select(*[F.when(F.col("had"), F.col(f"held_{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in old.columns])
    return old.join(new.select(*keys), list(keys), "left_anti").select(old.columns).unionByName(made)


def upsert_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    return overlay(old, new, ["source_id"], ["created_at"])


def register_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """Only what a registration knows: the sync state of a stored source stays."""
    return overlay(old, new, ["source_id"], ["created_at", "sync_status", "last_synced_at", "last_error"])


def foreign_owners(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents that another source owns already; a merge must refuse them."""
    owned = old.select("document_id", F.col("source_id").alias("owner"))
    return new.select("document_id", "source_id").join(owned, "document_id").filter("owner != source_id")


def held_claims(claims: DataFrame, jobs: DataFrame, wanted: DataFrame, source_id: str, now: str, hours: float) -> DataFrame:
    """Claims of other sources on the wanted documents, each with its job's state: ``running``, ``stale`` (running without a
    sign of life) or ``over`` (finished, or unknown)."""
    state = F.when(is_stale(now, hours), "stale").otherwise("running")
    known = jobs.filter("status = 'running'").select("job_id", state.alias("state"))
    theirs = claims.filter(F.col("source_id") != source_id).join(wanted.select("document_id"), "document_id", "left_semi")
    return theirs.join(known, "job_id", "left").withColumn("state", F.coalesce("state", F.lit("over")))


def claimed(claims: DataFrame, wanted: DataFrame, held: DataFrame, source_id: str, job_id: str, now: str) -> DataFrame:
    """Claims after a job has taken its documents: those of finished and stale jobs on them are released. A document that a
    running job of another source holds keeps that claim; who wants it must stop (``held`` tells)."""
    blocked = held.filter("state = 'running'").select("document_id")
    mine = wanted.select("document_id").distinct().join(blocked, "document_id", "left_anti")
    rest = claims.join(mine, "document_id", "left_anti")
    made = mine.select("document_id", F.lit(source_id).alias("source_id"), F.lit(job_id).alias("job_id"), F.lit(now).alias("claimed_at"))
    return rest.select(claims.columns).unionByName(made.select(claims.columns))


def shared_claims(batch: DataFrame) -> DataFrame:
    """Documents that several sources of one batch claim."""
    return batch.groupBy("document_id").agg(F.count_distinct("source_id").alias("n_sources")).filter("n_sources > 1")


def mismatched_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks whose document doesn't exist under their source."""
    return chunks.join(documents.select("document_id", "source_id"), ["document_id", "source_id"], "left_anti")


def replace_chunks(old: DataFrame, changed: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks of changed documents (document_id, source_id) give way to the new ones."""
    return old.join(changed.select("document_id", "source_id"), ["document_id", "source_id"], "left_anti").select(old.columns).unionByName(new.select(old.columns))


def record_tombstones(tombstones: DataFrame, old: DataFrame, changed: DataFrame, recorded_at: str) -> DataFrame:
    """All previous chunk ids of changed documents are recorded; what is recorded stays as it is."""
    found = old.join(changed.select("document_id", "source_id"), ["document_id", "source_id"], "left_semi").select("chunk_id", "document_id", "source_id", F.lit(recorded_at).alias("recorded_at"))
    return tombstones.unionByName(found.join(tombstones.select("chunk_id"), "chunk_id", "left_anti").dropDuplicates(["chunk_id"]).select(tombstones.columns))


def stale(documents: DataFrame, source_id: str, marker: str, value: str, prefixes: Sequence[str] = ()) -> DataFrame:
    """Live documents of a source that this sync didn't see; prefixes of ids are literal."""
    return within(live(documents).filter((F.col("source_id") == source_id) & (F.coalesce(F.col(marker), F.lit("")) != value)), prefixes)


def within(documents: DataFrame, prefixes: Sequence[str] = ()) -> DataFrame:
    """Documents whose id begins with one of the prefixes, which are literal; all, if there are none."""
    return documents.filter(reduce(lambda a, b: a | b, [F.col("document_id").startswith(p) for p in prefixes])) if prefixes else documents


def tombstone(documents: DataFrame, gone: DataFrame, deleted_at: str) -> DataFrame:
    ids = gone.select("document_id", "source_id", F.lit(True).alias("gone"))
    marked = documents.join(ids, ["document_id", "source_id"], "left")
    return marked.withColumn("deleted_at", F.when(F.col("gone"), deleted_at).otherwise(F.col("deleted_at"))).select(documents.columns)


def new_or_updated(items: DataFrame, vectors: DataFrame) -> DataFrame:
    """What the vector store lacks or has with another hash; of repeated keys in the store the last counts."""
    known = vectors.groupBy("vector_key").agg(F.max_by("content_hash", "position").alias("known"))
    marked = items.join(known, "vector_key", "left")
    return marked.filter(F.col("known").isNull() | (F.col("known") != F.col("content_hash"))).withColumn("state", F.when(F.col("known").isNull(), "new").otherwise("updated")).drop("known")


def merged_vectors(vectors: DataFrame, chunks: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A source's vectors after a sync: those of its live chunks. ``embed`` adds ``embedding`` to chunks with their text,
    and is given only those that are new or have another text."""
    items = vector_metadata(chunks).join(chunks.select("chunk_id", "text"), "chunk_id")
    fresh = new_or_updated(items, vectors.withColumn("position", F.lit(0))).drop("state")
    kept = vectors.join(items.select("vector_key"), "vector_key", "left_semi").join(fresh.select("vector_key"), "vector_key", "left_anti")
    return kept.select(vectors.columns).unionByName(embed(fresh).select(vectors.columns))


def delete_vectors(vectors: DataFrame, ids: DataFrame, source_id: str | None) -> DataFrame:
    """Vectors that stay: with a source its managed ones of these ids go, without one the raw ones of these ids."""
    scope = (F.col("managed") == "true") & (F.col("source_id") == source_id) if source_id is not None else F.col("managed") != "true"
    doomed = ids.select("doc_id", F.lit(True).alias("doomed"))
    return vectors.join(doomed, "doc_id", "left").filter(~(scope & F.coalesce("doomed", F.lit(False)))).select(vectors.columns)


def safe_to_delete(candidates: DataFrame, live_chunks: DataFrame) -> DataFrame:
    return candidates.join(live_chunks.select("chunk_id"), "chunk_id", "left_anti")

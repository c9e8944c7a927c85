"""Retrieval: keyword and vector candidates, hydration from live chunks, filters, suppression, and top-k."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import legacy_preview, preview
from quillmesh.operators.documents import live, live_chunks
from quillmesh.operators.substring_index import terms_of

#: Local results from which on the web isn't asked.
FALLBACK_BELOW = 3


def clamp_top_k(value: int | None, default: int = 8, most: int = 20) -> int:
    return min(max(int(value if value is not None else default), 1), most)


def source_filter(filters: dict | None) -> list[str]:
    """source_ids, then source_id, each a string or an iterable; in order, without repeats; empty: no filter."""
    out: dict[str, None] = {}
    for key in ("source_ids", "source_id"):
        given = (filters or {}).get(key)
        for x in [given] if isinstance(given, str) else given or []:
            if x:
                out[str(x)] = None
    return list(out)


def keyword_score(haystack: Column, query: str) -> Column:
    """The part of the query's terms that a text contains; a repeated term counts each time."""
    asked = terms_of(query)
    hits = reduce(lambda n, t: n + F.contains(haystack, F.lit(t)).cast("int") * asked[t], sorted(asked), F.lit(0))
    return hits / F.lit(max(1, sum(asked.values())))


def keyword_top_k(corpus: DataFrame, text: Column, query: str, k: int, order: Sequence[str]) -> DataFrame:
    """The k best rows by keyword score, ties by ``order``; rows without a hit are none. The limit comes first: what is
    filtered later is not made up for. One pass over the rows; many searches of the same rows are worth an index."""
    scored = corpus.withColumn("score", keyword_score(F.lower(text), query)).filter("score > 0")
    return scored.orderBy(F.col("score").desc(), *order).limit(k)


def distance(embedding: Column, query: Sequence[float]) -> Column:
    """Euclidean distance in double precision."""
    pairs = F.zip_with(embedding, F.array(*[F.lit(float(x)) for x in query]), lambda a, b: F.pow(a.cast("double") - b, F.lit(2.0)))
    return F.sqrt(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x))


def vector_top_k(vectors: DataFrame, query: Sequence[float], k: int, accept: Column, key: str) -> DataFrame:
    """The k nearest of the rows that are accepted: the filter comes first, so the answer is exact without widening."""
    near = vectors.filter(accept).withColumn("distance", distance(F.col("embedding"), query))
    return near.orderBy("distance", key).limit(k)


def ranked(rows: DataFrame, *order: Column | str) -> DataFrame:
    """A rank from 1 on. Only for results that a limit has already bounded."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def hydrate(candidates: DataFrame, chunks: DataFrame, sources: DataFrame, source_ids: Iterable[str] = ()) -> DataFrame:
    """Live chunks of bounded candidates (chunk_id, score, rank), of the given sources, with source type and preview."""
    return described(F.broadcast(candidates).join(chunks, "chunk_id"), sources, source_ids)


def hydrate_carried(candidates: DataFrame, documents: DataFrame, sources: DataFrame, source_ids: Iterable[str] = ()) -> DataFrame:
    """As ``hydrate``, for bounded candidates that carry their chunk's columns: only their documents are looked up, so
    that the chunks are read once."""
    have = live(documents).select("document_id", "source_id")
    return described(have.join(F.broadcast(candidates), ["document_id", "source_id"]), sources, source_ids)


def described(found: DataFrame, sources: DataFrame, source_ids: Iterable[str]) -> DataFrame:
    """Hits of the given sources (all, if none are) with source type and preview."""
    ids = list(source_ids)
    if ids:
        found = found.filter(F.col("source_id").isin(ids))
    kinds = sources.select("source_id", "source_type")
    found = found.join(kinds, "source_id", "left").withColumn("source_type", F.coalesce("source_type", F.lit("")))
    return found.withColumn("preview", preview(F.col("text")))


def first_accepted(hits: DataFrame, accept: Column, key: str, order: str = "rank") -> DataFrame:
    """The first accepted hit of each key: rejected hits don't use it up."""
    w = Window.partitionBy(key).orderBy(order)
    return hits.filter(accept).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def first_per_title(hits: DataFrame, order: str = "rank") -> DataFrame:
    """One hit a title; hits without one share the title Untitled."""
    titled = hits.withColumn("title", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("Untitled")))
    return first_accepted(titled, F.lit(True), "title", order)


def owned_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Managed hits whose source and document are those of the live chunk."""
    have = chunks.select("chunk_id", F.col("source_id").alias("of_source"), F.col("document_id").alias("of_document"))
    joined = hits.filter("managed = 'true'").join(have, "chunk_id")
    return joined.filter("source_id = of_source and document_id = of_document").drop("of_source", "of_document")


def legacy_alias(doc_id: Column, url: Column) -> Column:
    """The id under which a raw hit may be known: notion_X is X; tistory_N of B.tistory.com is B:N; null for none."""
    blog = F.regexp_extract(F.lower(url), r"^https?://([^/?#.]+)\.tistory\.com(?:[/?#:]|$)", 1)
    number = F.regexp_extract(doc_id, "^tistory_(.+)$", 1)
    return F.when(doc_id.startswith("notion_"), F.substring(doc_id, F.lit(8), F.length(doc_id))).when((number != "") & (blog != ""), F.concat(blog, F.lit(":"), number))


def suppress_raw(hits: DataFrame, chunk_ids: DataFrame, documents: DataFrame) -> DataFrame:
    """Raw hits that aren't known otherwise: by a live or recorded chunk id, a document id or alias, or a URL.

    ``hits``: rank, doc_id, document_id, chunk_id, url, canonical_url; ``chunk_ids``: chunk_id, of live chunks and of
    tombstones; ``documents``: document_id, url, canonical_url, deleted ones too.
    """
    ids = hits.select("rank", F.explode(F.array("chunk_id", "doc_id", "document_id")).alias("id")).filter("id != ''")
    names = hits.select("rank", F.explode(F.array("chunk_id", "doc_id", "document_id", legacy_alias(F.col("doc_id"), F.col("url")))).alias("id")).filter("id != ''")
    urls = hits.select("rank", F.explode(F.array("url", "canonical_url")).alias("url")).filter("url != ''")
    known_urls = documents.select(F.explode(F.array("url", "canonical_url")).alias("url")).filter("url != ''").distinct()
    known = (
        ids.join(chunk_ids.select(F.col("chunk_id").alias("id")).distinct(), "id", "left_semi").select("rank")
        .unionByName(names.join(documents.select(F.col("document_id").alias("id")).distinct(), "id", "left_semi").select("rank"))
        .unionByName(urls.join(known_urls, "url", "left_semi").select("rank"))
    )
    return hits.join(known, "rank", "left_anti")


def by_url(documents: DataFrame, url: str) -> DataFrame:
    """Documents under a URL or canonical URL, the newest first: two equality lookups rather than an OR."""
    a = documents.filter(F.col("canonical_url") == url)
    b = documents.filter((F.col("url") == url) & (F.coalesce("canonical_url", F.lit("")) != url))
    return a.unionByName(b).orderBy(F.col("updated_at").desc(), "document_id")


def search_vectors(vectors: DataFrame, query: Sequence[float], k: int, chunks: DataFrame, tombstones: DataFrame, documents: DataFrame) -> DataFrame:
    """The k nearest hits that may be shown, one a title, with previews of the older kind.

    ``vectors``: doc_id, chunk_id, document_id, source_id, url, canonical_url, title, text, managed, embedding. Managed
    vectors count if they are those of live chunks; raw ones if they aren't known otherwise. All are judged before the
    limit, so no window has to be widened; titles are told apart before it, too.
    """
    near = shown_hits(vectors.withColumn("distance", distance(F.col("embedding"), query)), chunks, tombstones, documents)
    return near.orderBy("distance", "doc_id").limit(k).withColumn("preview", legacy_preview(F.col("text")))


def shown_hits(hits: DataFrame, chunks: DataFrame, tombstones: DataFrame, documents: DataFrame) -> DataFrame:
    """Of vectors with their distance those that may be shown, the nearest of each title."""
    keyed = hits.withColumn("rank", F.col("doc_id")).drop("embedding")
    raw = suppress_raw(keyed.filter("coalesce(managed, '') != 'true'"), chunks.select("chunk_id").unionByName(tombstones.select("chunk_id")), documents)
    accepted = owned_hits(keyed, live_chunks(chunks, documents)).unionByName(raw).drop("rank")
    return first_per_title(accepted.withColumn("order", F.struct("distance", "doc_id")), "order").drop("order")


def with_fallback(local: DataFrame, web: Callable[[], DataFrame], threshold: int = FALLBACK_BELOW) -> tuple[str, DataFrame]:
    """Where the answer is from, and its rows: local ones if there are enough, else those of the web (instead, not in
    addition), else the local ones after all. ``local`` is bounded by top-k; ``web`` is only asked when needed."""
    if local.limit(threshold).count() >= threshold:
        return "local", local
    found = web()
    return ("local", local) if found.isEmpty() else ("web", found)


def with_fallbacks(local: DataFrame, web: DataFrame, key: str, threshold: int = FALLBACK_BELOW) -> DataFrame:
    """``with_fallback`` for all questions of a key at once: the rows that each is answered by, and their origin. Both
    tables are dealt by counts of their keys, so that rows are joined with one row a question."""
    counts = local.groupBy(key).agg(F.count("*").alias("n_local")).join(web.groupBy(key).agg(F.count("*").alias("n_web")), key, "full")
    enough = (F.coalesce("n_local", F.lit(0)) >= threshold) | (F.coalesce("n_web", F.lit(0)) == 0)
    origins = counts.select(key, F.when(enough, "local").otherwise("web").alias("origin"))
    rows = local.withColumn("origin", F.lit("local")).unionByName(web.withColumn("origin", F.lit("web")))
    return rows.join(origins, [key, "origin"], "left_semi")


# Fixed value: source types that are another's.
TYPE_ALIASES = {"docs": "web", "pdf": "web"}


def chosen_sources(sources: DataFrame, filters: dict | None = None, source_types: object = None, source_ids: object = None) -> list[str]:
    """Ids that a request is limited to: those of its filters, of the sources of its types, and its own; [] for no limit.

    Values are strings (split at commas and line ends), iterables or single values. ValueError where types are named that
    no source has. ``sources`` (source_id, source_type) are configured ones, a bounded few.
    """

    def listed(value: object) -> list[str]:
        parts = value.replace("\n", ",").split(",") if isinstance(value, str) else value if isinstance(value, Iterable) else [value] if value else []
        return [x for x in (" ".join(str(p if p is not None else "").split()) for p in parts or []) if x]

    given = filters or {}
    types = {TYPE_ALIASES.get(t.lower(), t.lower()) for key in ("source_types", "source_type") for t in listed(given.get(key))}
    types |= {TYPE_ALIASES.get(t.lower(), t.lower()) for t in listed(source_types)}
    ids = [x for key in ("source_ids", "source_id") for x in listed(given.get(key))]
    if types:
        alias = F.create_map(*[F.lit(x) for pair in TYPE_ALIASES.items() for x in pair])
        kind = F.lower(F.trim(F.coalesce("source_type", F.lit(""))))
        of_types = [r["source_id"] for r in sources.filter(F.coalesce(alias[kind], kind).isin(*types)).select("source_id").distinct().orderBy("source_id").collect()]
        if not of_types:
            raise ValueError("no configured sources match selected source types")
        ids += of_types
    return list(dict.fromkeys([*ids, *listed(source_ids)]))


def federated(results: DataFrame, platforms: Sequence[str], max_results: int) -> DataFrame:
    """Each platform's first results, platforms in their order, cut to max_results."""
    per = max(3, max_results // max(1, len(platforms)))
    place = F.array_position(F.array(*[F.lit(p) for p in platforms]), F.col("platform"))
    w = Window.partitionBy("platform").orderBy("rank")
    cut = results.filter(F.col("platform").isin(*platforms)).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per)
    return cut.orderBy(place, "rn").limit(max_results).drop("rn")

"""Evidence: query terms, relevance, gates, grounded answers and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SCORE = 0.35
# What Korean words of a question also stand for, terms that say nothing, and terms that must be met.
EXPANSIONS = {
    "깃허브": ("github",), "그래프": ("graph",), "구조": ("structure", "architecture"), "검색": ("search",), "니트코드": ("leetcode", "neetcode"),
    "문서": ("document", "documents", "docs"), "소스": ("source",), "알고리즘": ("algorithm", "algorithms"), "인덱싱": ("indexing", "index"), "프로젝트": ("project",),
}
STOP_TERMS = ("about", "answer", "code", "give", "how", "is", "me", "related", "tell", "the", "what", "with", "관련", "알려줘", "에서", "정리", "정리해줘", "코드")
ANCHORS = ("leetcode", "neetcode", "니트코드")


def query_terms(question: Column) -> Column:
    """Distinct terms of a question in order: its tokens and what Korean words in them stand for."""
    tokens = F.regexp_extract_all(F.lower(question), F.lit("[0-9A-Za-z가-힣_/-]+"), F.lit(0))
    none = F.array().cast("array<string>")

    def widen(token: Column) -> Column:
        more = [F.when(F.contains(token, F.lit(k)), F.array(*map(F.lit, v), F.lit(k))).otherwise(none) for k, v in EXPANSIONS.items()]
        return F.concat(F.array(token), *more)

    terms = F.transform(F.flatten(F.transform(tokens, widen)), lambda t: F.regexp_replace(t, "^[_/-]+|[_/-]+$", ""))
    return F.array_distinct(F.filter(terms, lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_TERMS)))


def relevant(terms: Column, title: Column, path: Column, preview: Column, text: Column) -> Column:
    """Whether a chunk holds one of the terms; if there are anchors among them, one of those."""
    parts = [F.coalesce(c, F.lit("")) for c in (title, path, preview, text)]
    hay = F.lower(F.concat_ws(" ", *parts))
    anchors = F.array_intersect(terms, F.array(*map(F.lit, ANCHORS)))
    asked = F.when(F.size(anchors) > 0, anchors).otherwise(terms)
    return (F.size(terms) == 0) | F.exists(asked, lambda t: F.contains(hay, t))


def evidence(results: DataFrame, question: str | None, min_score: float = MIN_SCORE) -> DataFrame:
    """Results that are good enough; with a question, also relevant to it."""
    kept = results.filter(F.col("score") >= min_score)
    if question is not None:
        kept = kept.filter(relevant(query_terms(F.lit(question)), F.col("title"), F.col("path"), F.col("preview"), F.col("text")))
    return kept


def answer(results: DataFrame, question: str, min_score: float = MIN_SCORE, min_results: int = 1) -> DataFrame:
    """One row: question, evidence_status, answer (texts in rank order), used_chunks. ``results`` are bounded by top-k."""
    found = evidence(results, question, min_score).select("rank", "chunk_id", "text")
    one = found.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))).alias("rows"))
    enough = F.col("n") >= min_results
    texts = F.filter(F.transform("rows", lambda r: r["text"]), lambda t: t != "")
    return one.select(
        F.lit(question).alias("question"), F.when(enough, "grounded").otherwise("insufficient").alias("evidence_status"),
        F.when(enough, F.array_join(texts, "\n\n")).otherwise("").alias("answer"),
        F.when(enough, F.array_join(F.transform("rows", lambda r: r["chunk_id"]), ",")).otherwise("").alias("used_chunks"),
    )

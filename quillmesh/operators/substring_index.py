"""A substring index over chunks: keyword search that reads the postings of a few trigrams instead of all texts.

Terms match by containment, anywhere in a word. A chunk's postings are the runs of three characters of its lower-cased
text, two null characters behind it, so that each run of two characters begins one as well. Postings are rows (gram,
chunk_no) in folders by bucket, a hash of the gram's first two characters, sorted by gram: a lookup reads its bucket's
files, and of those the row groups that can hold the gram. No gram's postings are ever gathered in one row or task.

A search is exact. A chunk that lacks terms of weight m at most holds one of any terms that weigh more than m together; so
the rarest such terms give all chunks that can score that high. Candidates are verified on their texts. If k of them do
score that high, these are the k best of all; else m grows. Terms of a single character can't be looked up: where one is
needed, or where all terms are, the chunks are read as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.text import SPACE
from quillmesh.operators.published import written

#: Folders of postings.
BUCKETS = 64
#: Grams of a term that are intersected: its rarest.
RAREST = 3


def grams(text: Column) -> Column:
    """The distinct runs of three characters of a text in lower case, two null characters behind it."""
    return F.array_distinct(F.regexp_extract_all(F.concat(F.lower(text), F.lit("\x00\x00")), F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.substring(gram, 1, 2)), F.lit(buckets)).cast("int")


def terms_of(query: str) -> Counter:
    """The query's terms in lower case, and how often each is asked."""
    return Counter(w for w in re.split(f"[{SPACE}]+", query.lower()) if w)


def term_grams(term: str) -> list[str]:
    return list(dict.fromkeys(term[k : k + 3] for k in range(len(term) - 2)))


@dataclass
class SubstringIndex:
    """The tables under a folder: ``chunks`` with chunk_no, ``postings`` and how many each gram has (``sizes``)."""

    spark: SparkSession
    folder: str
    buckets: int = BUCKETS

    @property
    def chunks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/chunks")

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.schema("gram string, chunk_no long, bucket int").parquet(f"{self.folder}/postings")

    @property
    def sizes(self) -> DataFrame:
        return self.spark.read.schema("gram string, n long, bucket int").parquet(f"{self.folder}/sizes")

    def add(self, chunks: DataFrame, batch: int = 0) -> SubstringIndex:
        """Write more chunks (columns text and others) and their postings. ``batch`` numbers additions from 0 on, so that
        chunk numbers of different ones differ; what was written before stays as it is."""
        numbered = chunks.withColumn("chunk_no", F.lit(batch).cast("long") * (1 << 48) + F.monotonically_increasing_id())
        path = f"{self.folder}/chunks/batch={batch}"
        rows = written(numbered, path)
        each = rows.select(F.explode(grams(F.col("text"))).alias("gram"), "chunk_no").withColumn("bucket", bucket(F.col("gram"), self.buckets))
        # Ranges over all three columns: the postings of a frequent gram spread over tasks.
        ordered = each.repartitionByRange("bucket", "gram", "chunk_no").sortWithinPartitions("bucket", "gram", "chunk_no")
        ordered.write.mode("append").partitionBy("bucket").parquet(f"{self.folder}/postings")
        added = self.spark.read.schema("gram string, chunk_no long, bucket int").parquet(f"{self.folder}/postings").filter(F.shiftright("chunk_no", 48) == batch)
        counted = added.groupBy("bucket", "gram").agg(F.count("*").alias("n"))
        counted.repartitionByRange("bucket", "gram").sortWithinPartitions("bucket", "gram").write.mode("append").partitionBy("bucket").parquet(f"{self.folder}/sizes")
        return self

    def looked_up(self, table: DataFrame, asked: Iterable[str]) -> DataFrame:
        """The rows of whole grams, and of all grams that begin with two characters; only their buckets are read."""
        asked = sorted(set(asked))
        at = self.spark.range(1).select(*[bucket(F.lit(g), self.buckets).alias(f"b{k}") for k, g in enumerate(asked)]).first()
        whole = [g for g in asked if len(g) == 3]
        match = [F.col("gram").isin(whole)] if whole else []
        match += [F.col("gram").startswith(g) for g in asked if len(g) == 2]
        return table.filter(F.col("bucket").isin(sorted(set(at))) & reduce(lambda a, b: a | b, match))

    def bounds(self, terms: Iterable[str]) -> dict[str, tuple[int, list[str]] | None]:
        """Of each term how many chunks can hold it at most, and the grams to look up, the rarest first; None for terms of one character."""
        keys = {t: term_grams(t) if len(t) > 2 else [t] for t in terms if len(t) > 1}
        if not keys:
            return dict.fromkeys(terms)
        asked = {g for gs in keys.values() for g in gs}
        found = self.looked_up(self.sizes, asked)
        prefixes = [g for g in asked if len(g) == 2]
        # A row for each asked key: a gram counts for itself and for the two characters that it begins with.
        own = F.array(F.col("gram"), *([F.substring("gram", 1, 2)] if prefixes else []))
        rows = found.select(F.explode(own).alias("key"), "n").filter(F.col("key").isin(sorted(asked))).groupBy("key").agg(F.sum("n").alias("n")).collect()
        n = {r["key"]: r["n"] for r in rows}
        out: dict[str, tuple[int, list[str]] | None] = dict.fromkeys(terms)
        for t, gs in keys.items():
            order = sorted(gs, key=lambda g: (n.get(g, 0), g))
            out[t] = (n.get(order[0], 0), order[:RAREST])
        return out

    def holding(self, found: Sequence[list[str]]) -> DataFrame:
        """chunk_no of the chunks that hold all looked-up grams of a term, of any of several terms."""
        rows = self.looked_up(self.postings, {g for gs in found for g in gs})
        flags = []
        for gs in found:
            have = [F.max(F.col("gram").startswith(g)) for g in gs]
            flags.append(reduce(lambda a, b: a & b, have))
        keep = reduce(lambda a, b: a | b, flags)
        return rows.groupBy("chunk_no").agg(keep.alias("keep")).filter("keep").select("chunk_no")

    def top_k(self, query: str, k: int, order: Sequence[str]) -> DataFrame:
        """The k best chunks by the part of the query's terms that they contain, ties by ``order``; none without a hit."""
        asked = terms_of(query)
        total = sum(asked.values())
        hits = F.lit(0)
        for t, times in sorted(asked.items()):
            hits = hits + F.when(F.contains(F.lower("text"), F.lit(t)), times).otherwise(0)
        chunks = self.chunks.withColumn("hits", hits)

        def best(rows: DataFrame) -> DataFrame:
            scored = rows.filter("hits > 0").withColumn("score", F.col("hits") / F.lit(max(1, total)))
            return scored.orderBy(F.col("score").desc(), *order).limit(k).drop("hits", "chunk_no", "batch")

        limits = self.bounds(asked)
        known = sorted((t for t in asked if limits[t] is not None), key=lambda t: (limits[t][0], t))
        for lacking in range(sum(asked[t] for t in known if limits[t][0] == 0), total):
            chosen, weight = [], 0
            for t in known:
                if weight <= lacking:
                    chosen.append(t)
                    weight += asked[t]
            if weight <= lacking:
                return best(chunks)
            candidates = self.holding([limits[t][1] for t in chosen if limits[t][0]])
            # The best k are few rows: they are fetched, and the caller goes on with them.
            found = best(chunks.join(candidates, "chunk_no", "left_semi"))
            rows = found.collect()
            if lacking == total - 1 or sum(r["score"] >= (total - lacking) / total for r in rows) >= k:
                return self.spark.createDataFrame(rows, found.schema)
        return best(chunks.filter("false"))


def build(chunks: DataFrame, folder: str, buckets: int = BUCKETS) -> SubstringIndex:
    return SubstringIndex(chunks.sparkSession, folder, buckets).add(chunks)

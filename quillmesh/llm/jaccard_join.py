"""N-gram Jaccard join: documents whose sets of five-word shingles have a similarity of at least 0.8."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.components import components
from quillmesh.llm.shared import publish, release, row_key
from quillmesh.llm.similar import forest_depth, leaders_of, linked, signed

WORDS, THRESHOLD = 5, 0.8
#: Trees of the forest, MinHash values of a full signature, and the recall of one pair at the threshold.
TREES, MAX_DEPTH, RECALL = 12, 8, 0.998


def classes_of(docs: DataFrame, n: int, threshold: float, trees: int, max_depth: int, target: float) -> tuple[DataFrame, DataFrame]:
    """Members and named sets.

    Members have doc_id, k (the row's key) and set_id (null: no words), one row per input row. Named sets, of those with
    a link or a copy, have set_id, class_id (the least doc_id of the class), keeper (the first of its rows by id and
    key), first (that of the set) and n_links.
    """
    depth = forest_depth(threshold, trees, max_depth, target)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("k", row_key())

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b, ids, keys in signed(batch, n, trees, depth, threshold):
                yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64").array, "k": b["k"].array, "set_id": pd.Series(ids, dtype=object), "keys": keys, "chars": b["text"].str.len().to_numpy()})

    members = publish(texts.mapInPandas(sign, "doc_id long, k binary, set_id binary, keys array<long>, chars long"))
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "k")
    sets = members.filter("set_id is not null").groupBy("set_id").agg(F.min(place).alias("first"), F.count("*").alias("copies"), F.max("chars").alias("chars"), F.any_value("keys").alias("keys"))
    sets = publish(sets)
    wanted = publish(leaders_of(sets.select("set_id", "first.k", "copies", "chars", "keys")))
    # One row's text stands for a set. What grows with the input is merged, never broadcast: small and large inputs have one plan.
    found = texts.select("k", "text").join(wanted.drop("chars").hint("merge"), "k").select("set_id", "copies", "leaders", "text")
    done = linked(wanted, found, n, threshold)
    roots = components(done.select(F.col("set_id").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "set_id")
    classes = done.groupBy("set_id").agg(F.sum("links").alias("links")).join(roots, "set_id")
    # Only sets with a link or a copy differ from a class of one row.
    known = sets.select("set_id", "first", "copies").join(classes, "set_id", "left").filter("links is not null or copies > 1")
    known = publish(known.withColumn("root", F.coalesce("root", "set_id")))
    release(sets, wanted, done)
    named = known.join(known.groupBy("root").agg(F.min("first").alias("keeper")), "root")
    named = named.select("set_id", F.col("keeper.doc_id").alias("class_id"), "keeper", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return members.select("doc_id", "k", "set_id"), named


def join_similar(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, max_depth: int = MAX_DEPTH, target: float = RECALL) -> DataFrame:
    """One row per input row: doc_id, class_id (the least doc_id of its class) and n_links.

    n_links counts the other rows whose shingle set has at least that similarity, equal sets included. A class is a
    connected component of links. Texts of one to n - 1 words have one shingle, of all their words; null and blank
    texts have none and no links, and their class is their own doc_id. A row with a null doc_id takes part, and its
    class has a null id only if no other row of it has one; repeated rows count as copies of each other, and so do
    rows that repeat an id with similar texts. An empty table gives none; other columns are not looked at.
    """
    members, named = classes_of(docs, n, threshold, trees, max_depth, target)
    found = members.join(named.select("set_id", "class_id", "n_links").hint("merge"), "set_id", "left")
    return found.select("doc_id", F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """All columns of the documents, of each class the first row by (doc_id, hash of id and text) only.

    Rows are told apart by id and text, so that another text under the same id stays. Rows with a null doc_id stay. Of
    rows that repeat an id and a text one stays, whatever their other columns hold.
    """
    members, named = classes_of(docs, WORDS, THRESHOLD, TREES, MAX_DEPTH, RECALL)
    held = members.filter("doc_id is not null").join(named.select("set_id", F.col("keeper.k").alias("kept")).hint("merge"), "set_id")
    gone = publish(held.filter("k != kept").select("k").distinct())
    key = "__row_key"
    rows = docs.withColumn(key, F.when(F.col("doc_id").isNotNull(), row_key()))
    left = rows.join(gone.withColumnRenamed("k", key).hint("merge"), key, "left_anti").select(rows.columns)
    twice = members.filter("doc_id is not null").groupBy("k").count().filter("count > 1").select(F.col("k").alias(key))
    twice = publish(twice.join(gone.withColumnRenamed("k", key), key, "left_anti"))
    if twice.isEmpty():
        return left.select(docs.columns)
    once = left.join(twice, key, "left_semi").select(rows.columns).dropDuplicates([key])
    return left.join(twice, key, "left_anti").select(rows.columns).unionByName(once).select(docs.columns)

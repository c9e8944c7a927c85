"""Filter interaction audit: what each of several filters removes, alone and behind the others, in every order.

Every document gets a mask of the filters that it fails. Conditions are columns; one filter fails documents whose text a
smaller doc_id has anywhere in the table. For it the rows are range-sorted by the text's fingerprint, the text and the id;
a row is compared with its predecessor, and what a partition can't see of its predecessor is settled by the partitions'
edges. Ranges go by fingerprint and id, so that the copies of one text, however many, spread over partitions.

Masks are merged into counters of each part and mask, which add up over partitions, days or tables; every figure of every
order follows from at most 2**filters counters a part.

Nulls: a null text is an empty one, a null part an empty string. A null id is neither smaller nor larger than another: its
row fails no duplicate filter and makes none fail. Rows that repeat an id with its text don't fail by each other. Labels:
an id that has several counts as good or toxic if one says so. An empty table has no parts and no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.shared import publish

#: Filters in one audit at most: orders grow with the factorial.
MOST_FILTERS = 6
WORD_BREAKS = r"[\x20\x09-\x0D]+"
#: The conditions under which a document fails a filter, in the order of their bits; the duplicate filter has none.
CONTRACT = {
    "A": lambda text: F.size(words(text)) < 50,
    "B": lambda text: 100 * F.size(F.array_distinct(words(text))) < 65 * F.size(words(text)),
    "C": lambda text: 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
    "D": lambda text: text.rlike(r"[#$%&*|]"),
    "E": None,
}
MARKED = "doc_id long, part string, mask int, repeated boolean, run binary, first long, edge boolean"


def words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAKS), lambda w: w != "")


def failure_masks(docs: DataFrame, conditions: Mapping[str, object] = CONTRACT, part: str = "source") -> DataFrame:
    """doc_id, part and mask of every row: bit k is set if it fails the k-th filter."""
    if not 0 < len(conditions) <= MOST_FILTERS or list(conditions.values()).count(None) > 1:
        raise ValueError(f"1 to {MOST_FILTERS} filters are audited, one of them for duplicates at most")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))

    def masked() -> Column:
        bits = [F.when(fails(F.col("text")), 1 << k).otherwise(0) for k, fails in enumerate(conditions.values()) if fails is not None]
        return sum(bits, F.lit(0)).cast("int").alias("mask")

    names = list(conditions.values())
    if None not in names:
        return rows.select("doc_id", "part", masked())
    # Ranges by fingerprint and id: the sample that the driver takes for them holds no texts.
    ranged = rows.withColumn("print", F.unhex(F.md5("text"))).repartitionByRange("print", "doc_id")
    ordered = ranged.sortWithinPartitions("print", "text", F.col("doc_id").asc_nulls_last())
    marked = publish(ordered.select("doc_id", "part", masked(), "print", "text").mapInArrow(mark_repeats, MARKED))
    bit = 1 << names.index(None)
    # Rows whose text may have begun in an earlier partition are held against the first id of all partitions.
    seen = marked.filter("edge").groupBy("run").agg(F.min("first").alias("least"))
    open_rows = marked.filter("not edge and run is not null").join(seen, "run", "left").withColumn("repeated", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)))
    closed = marked.filter("not edge and run is null")
    both = closed.select("doc_id", "part", "mask", "repeated").unionByName(open_rows.select("doc_id", "part", "mask", "repeated"))
    return both.select("doc_id", "part", (F.col("mask") + F.when(F.col("repeated"), bit).otherwise(0)).cast("int").alias("mask"))


def mark_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition with ``repeated``: an earlier row of the same text has a smaller id.

    Rows of the partition's first fingerprint that have no such row here carry their text's hash (``run``): an earlier
    partition may hold one. The texts of the first and of the last fingerprint come as edges, with their least ids.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("repeated", pa.bool_()), ("run", pa.binary()), ("first", pa.int64()), ("edge", pa.bool_())])
    first_print: bytes | None = None
    in_first = True
    held: tuple[bytes, str, int | None] | None = None  # the last row's fingerprint and text, and its run's least id
    first_runs: dict[bytes, int | None] = {}
    last_runs: dict[bytes, int | None] = {}

    def digest(text: str) -> bytes:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        prints, texts, ids = batch.column("print"), batch.column("text"), batch.column("doc_id")
        known = np.asarray(ids.is_valid())
        number = np.asarray(ids.fill_null(0))
        new_print, new_text = np.ones(n, bool), np.ones(n, bool)
        if n > 1:
            new_print[1:] = np.asarray(pc.not_equal(prints[1:], prints[:-1]))
            new_text[1:] = new_print[1:] | np.asarray(pc.not_equal(texts[1:], texts[:-1]))
        if held is not None:
            new_print[0] = prints[0].as_py() != held[0]
            new_text[0] = new_print[0] or texts[0].as_py() != held[1]
        start = np.maximum.accumulate(np.where(new_text, np.arange(n), -1))
        carried = held[2] if held is not None else None
        least = np.where(start >= 0, number[start], 0 if carried is None else carried)
        least_known = np.where(start >= 0, known[start], carried is not None)
        repeated = known & least_known & (number > least)

        run: list[bytes | None] = [None] * n
        if first_print is None:
            first_print = prints[0].as_py()
        if in_first:
            changes = np.flatnonzero(new_print[1:] if held is None else new_print)
            end = n if not len(changes) else int(changes[0]) + (held is None)
            for k in np.flatnonzero(~repeated[:end] & known[:end]).tolist():
                run[k] = digest(texts[k].as_py())
                first_runs.setdefault(run[k], int(number[k]))
            in_first = end == n
        # The runs of the batch's last fingerprint; a run that began in an earlier batch is known already.
        at = np.flatnonzero(new_print)
        tail = int(at[-1]) if len(at) else 0
        if len(at):
            last_runs = {}
        for k in (np.flatnonzero(new_text[tail:]) + tail).tolist():
            if known[k]:
                last_runs[digest(texts[k].as_py())] = int(number[k])
        held = (prints[n - 1].as_py(), texts[n - 1].as_py(), int(least[-1]) if least_known[-1] else None)
        yield pa.RecordBatch.from_arrays([ids, batch.column("part"), batch.column("mask"), pa.array(repeated), pa.array(run, pa.binary()), pa.nulls(n, pa.int64()), pa.array(np.zeros(n, bool))], schema=schema)
    edges = [*first_runs.items(), *last_runs.items()]
    if edges:
        n = len(edges)
        yield pa.RecordBatch.from_arrays([
            pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_()),
            pa.array([k for k, _ in edges], pa.binary()), pa.array([v for _, v in edges], pa.int64()), pa.array(np.ones(n, bool)),
        ], schema=schema)


def part_counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, good ones and toxic ones by part and mask. Counters of several tables may be added up."""
    of_id = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    joined = masks.join(of_id, "doc_id", "left")
    return joined.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def interactions(counters: DataFrame, names: str) -> DataFrame:
    """Every part, order of the filters and step, with what that step keeps and removes."""
    if not 0 < len(names) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters are audited")
    total = math.factorial(len(names))
    orders = ",".join(map("".join, itertools.permutations(names)))
    by_part = counters.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    each = by_part.select("part", "counts", F.explode(F.split(F.lit(orders), ",")).alias("filter_order"))
    each = each.withColumn("bits", F.transform(F.filter(F.split("filter_order", ""), lambda x: x != ""), lambda x: F.pow(F.lit(2), F.instr(F.lit(names), x) - 1).cast("int")))
    each = each.select("*", F.posexplode("bits").alias("at", "own"))
    each = each.withColumn("step", F.col("at") + 1).withColumn("before", F.aggregate(F.slice("bits", F.lit(1), F.col("at")), F.lit(0), lambda acc, x: acc + x))
    own, before = F.col("own"), F.col("before")

    def total_of(what: str, when) -> Column:
        return F.aggregate("counts", F.lit(0).cast("long"), lambda acc, c: acc + F.when(when(c["mask"]), c[what]).otherwise(F.lit(0).cast("long")))

    def fails(mask: Column) -> Column:
        return mask.bitwiseAND(own) != 0

    def first(mask: Column) -> Column:
        return fails(mask) & (mask.bitwiseAND(before) == 0)

    share = F.aggregate("counts", F.lit(0).cast("long"), lambda acc, c: acc + F.when(fails(c["mask"]), c["n"] * (F.lit(total) / F.bit_count(c["mask"])).cast("long")).otherwise(F.lit(0).cast("long")))
    return each.select(
        "part", "filter_order", "step", total_of("n", lambda m: m.bitwiseAND(own + before) == 0).alias("kept"), total_of("n", first).alias("removed"),
        total_of("n", lambda m: fails(m) & (m.bitwiseAND(before) != 0)).alias("redundant"), total_of("n", lambda m: m == own).alias("unique_fails"),
        total_of("good", first).alias("good_lost"), total_of("toxic", first).alias("toxic_lost"), share.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, conditions: Mapping[str, object] = CONTRACT, part: str = "source") -> DataFrame:
    """Masks of all documents, merged into counters, and every order's figures of each part."""
    return interactions(part_counters(failure_masks(docs, conditions, part), labels), "".join(conditions))


_SQL_STEPS = "SELECT o.filter_order, CAST(s.step AS INTEGER) AS step, substr(o.filter_order, s.step, 1) AS own, substr(o.filter_order, 1, s.step - 1) AS before FROM orders o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s"
_SQL_FIRST = "contains(f, own) AND NOT regexp_matches(f, '[' || before || '!]')"
SQL = rf"""WITH split AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
labelled AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failed AS (SELECT part, CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS f,
  coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM split LEFT JOIN labelled USING (doc_id)),
counts AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY part, f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS ({_SQL_STEPS})
SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (NOT regexp_matches(f, '[' || before || own || ']')), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER ({_SQL_FIRST}), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (contains(f, own) AND regexp_matches(f, '[' || before || '!]')), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (f = own), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER ({_SQL_FIRST}), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER ({_SQL_FIRST}), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * (120 // greatest(length(f), 1))) FILTER (contains(f, own)), 0) AS BIGINT) AS shapley
FROM counts, steps GROUP BY part, filter_order, step"""

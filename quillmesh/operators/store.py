"""State as a log of changes: each publication of a source appends its changed rows, and one commit row makes them count.

A table's rows lie in folders by source and version, as Spark's own partitions do, so that reads of a source, or of some
versions, prune the others. What a publication writes follows what changed: rows of the documents that it touches replace
all earlier rows of these documents. Folding (``compact``) writes a source's rows anew once the changes pile up.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quillmesh.schemas import CHUNKS, CLAIMS, DOCUMENTS, SIGHTINGS, SOURCES, SYNC_JOBS, TOMBSTONES, VECTORS, align

TABLES = {
    "sources": SOURCES, "sync_jobs": SYNC_JOBS, "document_claims": CLAIMS, "documents": DOCUMENTS, "chunks": CHUNKS, "chunk_tombstones": TOMBSTONES, "vectors": VECTORS, "sightings": SIGHTINGS,
}
#: Tables whose publications replace all rows of their source; of the others rows are replaced by document, but the log's.
WHOLE, LOG = ("sources", "sync_jobs", "document_claims"), ("chunk_tombstones",)
COMMITS = "source_id string, name string, version string, base boolean"
#: Publications of a source after which a sync folds them.
FOLD_AFTER = 8


@dataclass(frozen=True)
class Delta:
    """Rows to add, and the documents (document_id) whose earlier rows they replace; None for those of the rows themselves."""

    rows: DataFrame
    touched: DataFrame | None = None


def folder_name(source_id: str) -> str:
    """A source's id as a partition's folder: what isn't a plain character is written as a percent sign and its number."""
    return re.sub(r"[\x00-\x2c/:-@\[-^`{-\x7f]", lambda m: f"%{ord(m[0]):02X}", source_id) or "__HIVE_DEFAULT_PARTITION__"


class Store:
    """Tables under a root folder that the whole cluster shares; one writer a source."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException:
            return None

    def commits(self, source_id: str | None = None) -> DataFrame:
        """The commit rows that count, of a source or of all: a table's last base of each source and what follows it."""
        rows = self._table("commits", COMMITS)
        if rows is None:
            return self.spark.createDataFrame([], COMMITS)
        if source_id is not None:
            rows = rows.filter(F.col("source_id") == source_id)
        base = rows.groupBy("source_id", "name").agg(F.max(F.when(F.col("base"), F.col("version"))).alias("since"))
        return rows.join(base, ["source_id", "name"]).filter(F.col("since").isNull() | (F.col("version") >= F.col("since"))).select("source_id", "name", "version", "base")

    def pinned(self, source_id: str) -> dict[str, list[str]]:
        """A source's versions of each table: few, since publications are folded."""
        out: dict[str, list[str]] = {}
        for r in self.commits(source_id).orderBy("version").collect():
            out.setdefault(r["name"], []).append(r["version"])
        return out

    def read(self, name: str, source_id: str | None = None, pinned: dict[str, list[str]] | None = None, but: str | None = None) -> DataFrame:
        """A table as published, of one source (as pinned, if so), of all but one, or of all; an absent one is empty."""
        schema = TABLES[name]
        rows = self._table(name, f"{schema}, touch boolean, version string")
        if rows is None:
            return self.spark.createDataFrame([], schema)
        several = True
        if source_id is not None:
            versions = (self.pinned(source_id) if pinned is None else pinned).get(name, [])
            several = len(versions) > 1
            rows = rows.filter((F.col("source_id") == source_id) & F.col("version").isin(versions)) if versions else rows.filter("false")
        else:
            valid = self.commits().filter(F.col("name") == name).select("source_id", "version")
            rows = rows.join(valid if but is None else valid.filter(F.col("source_id") != but), ["source_id", "version"], "left_semi")
        if several and name not in WHOLE and name not in LOG:
            last = rows.filter("touch").groupBy("source_id", "document_id").agg(F.max("version").alias("last"))
            rows = rows.filter("not touch").join(last, ["source_id", "document_id"], "left").filter(F.col("last").isNull() | (F.col("version") >= F.col("last")))
        return align(rows.filter("not touch") if not several else rows.filter("touch is null or not touch"), schema)

    def _write(self, name: str, rows: DataFrame, touched: DataFrame | None, source_id: str, version: str) -> None:
        made = align(rows, TABLES[name]).withColumn("touch", F.lit(False))
        if touched is not None:
            made = made.unionByName(touched.select("document_id").distinct().withColumn("touch", F.lit(True)), allowMissingColumns=True)
        made.drop("source_id").write.parquet(f"{self.root}/{name}/source_id={folder_name(source_id)}/version={version}")

    def publish(self, tables: dict[str, DataFrame | Delta], source_id: str) -> str:
        """Write a source's tables, then their commit rows in one append: readers see all of them or none.

        A DataFrame is all that the source has of a table (of a log: what is added), a Delta what changed of it.
        """
        return self._commit({n: x if isinstance(x, Delta) else Delta(x) for n, x in tables.items()}, {n: n not in LOG and not isinstance(x, Delta) for n, x in tables.items()}, source_id)

    def _commit(self, tables: dict[str, Delta], base: dict[str, bool], source_id: str) -> str:
        last = self.commits(source_id).agg(F.max("version")).first()[0]
        version = f"{1 + int(last[:8]) if last else 1:08d}-{uuid.uuid4().hex[:12]}"
        for name, delta in tables.items():
            self._write(name, delta.rows, None if base[name] or name in LOG else (delta.rows if delta.touched is None else delta.touched), source_id, version)
        rows = self.spark.createDataFrame([(n, version, base[n]) for n in tables], "name string, version string, base boolean")
        rows.coalesce(1).write.mode("append").parquet(f"{self.root}/commits/source_id={folder_name(source_id)}")
        return version

    def compact(self, source_id: str) -> str | None:
        """Fold a source's changes: every table that has some is written anew. Readers see the same rows before and after."""
        pinned = self.pinned(source_id)
        piled = [n for n, versions in pinned.items() if len(versions) > 1]
        if not piled:
            return None
        return self._commit({n: Delta(self.read(n, source_id, pinned)) for n in piled}, dict.fromkeys(piled, True), source_id)

    def due(self, source_id: str) -> bool:
        return max((len(v) for v in self.pinned(source_id).values()), default=0) > FOLD_AFTER

    def stage(self, df: DataFrame) -> DataFrame:
        """``df`` written once under the root and read again, so that a sync computes it once."""
        path = f"{self.root}/staged/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def vacuum(self) -> int:
        """Delete folders that no commit counts, staged ones too, and commit rows that are folded; only while nobody syncs or reads. Returns how many folders."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        files = path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

        def below(folder) -> list:
            return [s.getPath() for s in files.listStatus(folder)] if files.exists(folder) else []

        old = below(path(f"{self.root}/staged"))
        for source in below(path(f"{self.root}/commits")):
            if not source.getName().startswith("source_id="):
                continue
            rows = self.spark.read.schema("name string, version string, base boolean").parquet(source.toString())
            base = rows.groupBy("name").agg(F.max(F.when(F.col("base"), F.col("version"))).alias("since"))
            kept = rows.join(base, "name").filter("since is null or version >= since").select("name", "version", "base").collect()
            used = {(r["name"], r["version"]) for r in kept}
            for name in TABLES:
                old += [v for v in below(path(f"{self.root}/{name}/{source.getName()}")) if (name, v.getName().removeprefix("version=")) not in used]
        for folder in old:
            files.delete(folder, True)
        return len(old)

    def search_corpus(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return tuple(self.read(n) for n in ("chunks", "documents", "sources"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

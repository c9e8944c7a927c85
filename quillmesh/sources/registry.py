"""Connectors: what delivers documents, by source id."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from quillmesh.sources.web import SnapshotInfo


class Connector(Protocol):
    """``read`` gives connector rows and what is known about their snapshot."""

    source_id: str
    source_type: str

    def read(self, spark: SparkSession) -> tuple[DataFrame, SnapshotInfo]: ...


@dataclass(frozen=True)
class Landing:
    """A connector whose rows have landed as Parquet files; ``complete`` says whether all of the source's did."""

    source_id: str
    source_type: str
    path: str = ""
    complete: bool = True
    prefixes: tuple[str, ...] = ()

    def read(self, spark: SparkSession) -> tuple[DataFrame, SnapshotInfo]:
        return spark.read.parquet(self.path), SnapshotInfo(self.complete, self.prefixes)


class Registry:
    """Connectors by source id; of repeated ids the last counts."""

    def __init__(self, connectors: Iterable[Connector]):
        self._by_id = {c.source_id: c for c in connectors}

    def get(self, source_id: str) -> Connector:
        if source_id not in self._by_id:
            raise ValueError(f"unknown source: {source_id}")
        return self._by_id[source_id]

    def ids(self) -> list[str]:
        return list(self._by_id)

    def sources(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c.source_id, c.source_type) for c in self._by_id.values()], "source_id string, source_type string").orderBy("source_id")

    def read_all(self, spark: SparkSession) -> tuple[DataFrame | None, dict[str, str]]:
        """Rows of all connectors together; one that fails adds none and is named with its error."""
        parts, errors = [], {}
        for source_id, c in self._by_id.items():
            try:
                parts.append(c.read(spark)[0])
            except Exception as e:  # a source's failure mustn't stop the others
                errors[source_id] = type(e).__name__
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None, errors

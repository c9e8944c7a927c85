"""Tables written once in the folder that the whole cluster shares, and read from there."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path under the session's ``spark.checkpoint.dir``. A local session that names none (as in tests) uses
    this machine's; a cluster that names none is refused, since its executors share no local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        named = "file://" + os.path.join(tempfile.gettempdir(), "quillmesh-checkpoints")
    return f"{named.rstrip('/')}/quillmesh/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as Parquet at a path, read again: what follows doesn't compute it anew."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

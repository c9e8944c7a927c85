"""Session helpers: tables and checkpoints in the folder that the whole cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. A local session that names none (as in tests) gets a folder of this machine;
    a cluster that names none is refused, since its executors share no local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        named = "file://" + os.path.join(tempfile.gettempdir(), "quillmesh-checkpoints")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


#: Rows in a batch that a Python worker is given, where stages follow each other in the same workers.
BATCH_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    """Let the session's Python workers hold BATCH_ROWS rows at once: what they hold is a batch's texts, several times over."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def publish(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage: what follows survives the loss of any executor without computing ``df`` again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillmesh/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.published = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete published tables that nothing reads any more: whatever was made of them is published itself."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.published)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """128 bits that name a row by its id and text; rows that repeat both have one key (a null text counts as empty)."""
    name = F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat(name, F.lit(":"), F.coalesce(F.col(text), F.lit("")))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

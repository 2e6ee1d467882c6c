"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. On one machine, one of our own where it is unset; a cluster must name it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="loomwright-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stored(df: DataFrame, label: str, counted: bool | Column = False) -> DataFrame:
    """Cuts the lineage: df written to the shared folder and read again; with `counted`, its .rows is the number of rows (of those for which a condition holds), counted as they were written.

    Every executor can read the files, so a lost executor costs only the
    stage that runs, not the work before it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    seen = Observation()
    counting = counted is not False
    rows = F.count(F.lit(1)) if counted is True else F.count_if(counted) if counting else None
    (df.observe(seen, rows.alias("n")) if counting else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    if counting:
        out.rows = seen.get["n"]
    return out


def discard(*frames: DataFrame | None) -> None:
    """Deletes what stored() wrote; for intermediate tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "stored_path", None)
        if path:
            jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc.hadoopConfiguration()).delete(at, True)

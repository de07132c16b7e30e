"""Intermediate tables in the folder that driver and executors share.

The cluster names the folder in ``spark.checkpoint.dir``; only where that is unset (tests, a laptop) a local one is taken.
A written table cuts the lineage: a lost executor costs a re-read, not a recomputation.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_FOLDER = "file:///tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (folder or LOCAL_FOLDER).rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back under the same schema."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_side(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the observations: both sides are shuffled and sorted, so it never passes through the driver as a broadcast. Parquet files
    say little about the rows in them (repeated values, arrays that are exploded later), so Spark's own choice may hold far more than its threshold."""
    return df.hint("merge")


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` returned, once nothing will read them again."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

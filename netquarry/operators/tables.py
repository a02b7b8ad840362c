"""Tables between rounds of a job: written to the cluster's shared folder, so that lost executors cost no more than a round."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where the session names none, a local session, as in tests, gets a folder of this machine; on a cluster it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named := tempfile.mkdtemp(prefix="netquarry-checkpoint-"))
    return named


def settle(df: DataFrame) -> DataFrame:
    """df, written as Parquet to a folder of its own in the shared folder and read from there.

    A checkpoint would keep the optimiser's estimate of its size, which in rounds of joins grows to numbers of millions of
    digits; files have their size.
    """
    place = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(place)
    found = df.sparkSession.read.schema(df.schema).parquet(place)
    found.settled_at = place
    return found


def remove(spark: SparkSession, place: str) -> None:
    """Deletes a folder, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mkdirs(spark: SparkSession, place: str) -> None:
    """A folder, empty if it is not there yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def release(*tables: DataFrame | None) -> None:
    """Deletes tables of settle() that nothing will read any more; others are left alone."""
    for df in tables:
        if place := getattr(df, "settled_at", None):
            remove(df.sparkSession, place)
            df.settled_at = None

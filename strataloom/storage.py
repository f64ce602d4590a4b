"""Where intermediate tables go: a folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of one file of a settled table whose size is known beforehand.
FILE_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    ``spark.checkpoint.dir`` names it on a cluster; a cluster without it is an
    error.  In local mode a folder of this machine is made.
    """
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="strataloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Settled tables that go when a job is done with them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def settle(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """Compute a table once: write it to the shared folder and read it from there.

        Where ``rows`` says how many rows to expect, files hold about
        ``FILE_ROWS`` of them, however many partitions the session deals.
        """
        folder = new_folder(self.spark, "table")
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
        df.write.parquet(folder)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(path)  # what nobody clears goes with the driver
        self.folders.append(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def clear(self) -> None:
        for folder in self.folders:
            remove(self.spark, folder)
        self.folders.clear()


def settle(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Compute a table once and keep it."""
    return Scratch(df.sparkSession).settle(df, rows)

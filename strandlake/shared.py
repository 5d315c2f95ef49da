"""Tables that a job writes to the folder all executors share, and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where that is unset, a session of one machine (tests) gets a temporary folder; a cluster gets an error, because its
    executors would each write to a disk of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def durable(df: DataFrame, label: str, packed: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, and a lost executor costs no recomputation.
    packed: compressed more, for large tables."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    (df.write.option("compression", "zstd") if packed else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


#: Rows of a few numbers that are broadcast, about 50 bytes each; more are joined by a shuffle.
FEW = 2_000_000


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """df, written if it was not, and marked for broadcast if it has few rows."""
    df = df if hasattr(df, "durable_path") else durable(df, "few")
    return F.broadcast(df) if df.count() <= most else df


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM: any store that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def sweep(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of queries that are over: its cleaner waits until the driver's JVM collects what
    refers to them, which may be long after the disk was wanted."""
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Deletes tables that durable() wrote and that nothing reads any more."""
    for df in tables:
        fs, path = hadoop_path(df.sparkSession, df.durable_path)
        fs.delete(path, True)

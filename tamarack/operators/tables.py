"""Results that several parts of a job read, kept in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    _shared(spark)
    return f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of a table of queries' terms that still fit every task: such tables are joined where the documents are.
FITS = 500_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame) -> DataFrame:
    """df, worked out once and written to ``spark.checkpoint.dir``: what is lost with an executor is read again, not made again.

    It is a Parquet table, far smaller than a checkpoint's rows, and one whose size is known to the joins that read it. Its shuffle files go once it
    is written, the table itself with the session.
    """
    spark, path = df.sparkSession, folder(df.sparkSession, "kept")
    before = spark.conf.get(_CLEANUP, None)
    try:
        spark.conf.set(_CLEANUP, "true")
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def near(table: DataFrame) -> DataFrame:
    """A kept table, broadcast if it has at most ``FITS`` rows: large rows that meet it then stay where they are. Else Spark chooses how to join it."""
    return F.broadcast(table) if table.limit(FITS + 1).count() <= FITS else table


def parts(spark: SparkSession) -> int:
    """The number of parts that rows are dealt out to where each of them becomes many: Spark would merge parts by their size before that."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df, kept and dealt out by columns: for few rows that cost much each, such as the texts that a job picks out of a corpus."""
    return kept(df).repartition(parts(df.sparkSession), *by)


def _shared(spark: SparkSession) -> None:
    """Set the checkpoint folder where it is unset.

    A local session without the setting, as in tests, gets a temporary folder; on a cluster that is an error, since executors would write to
    disks of their own.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="spark-"))

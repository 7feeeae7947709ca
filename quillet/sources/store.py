"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session may go without and gets a folder of
    its own, as the executors of a cluster would not share it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quillet-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def application_folder(spark: SparkSession) -> str:
    """Folder of this application in the shared folder; it is removed when its driver ends."""
    path = f"{shared_folder(spark)}/quillet-core-{spark.sparkContext.applicationId}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where):
        files.mkdirs(where)
        files.deleteOnExit(where)
    return path


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to and read from the shared folder: lineage ends here, and a lost
    executor costs its running tasks only."""
    path = f"{application_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Removes a table of ``shared_table`` that nothing reads any more."""
    spark, own = table.sparkSession, application_folder(table.sparkSession).rsplit("/", 1)[1]
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if folder.rsplit("/", 2)[1] == own:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

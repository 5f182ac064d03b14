"""Session helpers: a local session for tests and benches, and lineage cuts that survive executor loss."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app: str = "strandloom", **conf: str) -> SparkSession:
    """A session for one machine; on a cluster the caller brings a session of its own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where all tasks run on this machine (a local master, as in tests) and none is named, a temporary folder is set, once per
    session; on a cluster without one this raises, as executors could not read each other's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: a lineage cut that outlives executors.

    Compressed and columnar, so much smaller than ``checkpoint()``; later reads prune columns. All files of an application lie in
    one folder of its own, which ``remove_written`` deletes; results are lazy, so only their reader knows when.
    """
    path = f"{_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/strandloom/{spark.sparkContext.applicationId}"


def remove_written(spark: SparkSession) -> None:
    """Deletes what ``written`` left of this application, once the results that read it have been saved."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

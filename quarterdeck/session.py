"""Session settings the results rely on, and the shared folder for written tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "quarterdeck", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution.

    On a cluster leave ``master`` out; the submitted configuration then decides
    executors, memory and the checkpoint folder.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Noting the Python line behind every column expression doubles the time to build a plan.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


FOLDER = "quarterdeck-"


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the one named in ``spark.checkpoint.dir``, or else the context's checkpoint folder.

    Every executor must see it, so none is made up here.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return f"{base.rstrip('/')}/{FOLDER}{uuid.uuid4().hex}"


#: Whether the shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    For a result that several later steps read: it is computed once, its
    lineage ends here, a lost executor costs nothing, and each reader scans only
    the columns it needs. Nothing reads the shuffles behind it again, so their files go.
    """
    spark = df.sparkSession
    path, before = shared_dir(spark), spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Remove the files of a table that ``materialize`` returned, once no table that is still to be computed reads it."""
    spark = df.sparkSession
    java = spark.sparkContext._jvm
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if folder.rsplit("/", 1)[-1].startswith(FOLDER):
            path = java.org.apache.hadoop.fs.Path(java.java.net.URI(folder))
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

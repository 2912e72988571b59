"""Tables written once to the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write the rows as Parquet to the shared folder and read them back."""
    path = staging_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staging_path(spark: SparkSession, label: str) -> str:
    return f"{_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession) -> str:
    """This application's part of ``spark.checkpoint.dir``; where that is unset, a folder of our own if Spark runs on this machine only."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{top or '/tmp/checkpoints/textloom'}/textloom-{spark.sparkContext.applicationId}"


def clear_staging(spark: SparkSession) -> None:
    """Remove every table that this application staged; call it when no result that reads them is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

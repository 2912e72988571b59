"""Tables written once to the folder that the cluster shares, which cut a plan's lineage and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN = "/tmp/checkpoints/textloom"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset, a folder of our own if Spark runs on this machine only."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or _OWN


def staging_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/textloom-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write the rows to the shared folder as Parquet, with the writer's options, and return the table read back."""
    path = staging_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The most rows of a narrow table that are broadcast; counted before, and joined by a shuffle beyond it.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """A staged table of a few numbers a row, marked for broadcast if its rows are counted to be within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def join_groups(rows: DataFrame, groups: DataFrame, key: str, weight: str, total: int, few: int = BROADCAST_ROWS) -> DataFrame:
    """rows LEFT JOIN groups on a key that groups has once; `weight` is how many of the `total` rows have the key.

    No task gets a hot key: all groups are broadcast if they are few, else those that hold many rows, which are few
    (or 512), as each holds a share of the total. Give a lower `few` where a group's row is large.
    """
    if groups.count() <= few:
        return rows.join(F.broadcast(groups), key, "left")
    most = min(max(1, total // 512), max(10_000, total // few))
    met = rows.join(F.broadcast(groups.filter(F.col(weight) > most)), key, "left")
    rest = met.filter(F.col(weight).isNull()).select(*(F.col(f"`{c}`") for c in rows.columns)).join(groups.filter(F.col(weight) <= most), key, "left")
    return met.filter(F.col(weight).isNotNull()).unionByName(rest)


def clear_staging(spark: SparkSession) -> None:
    """Remove every table that this application staged; call it when no result that reads them is needed any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/textloom-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))

"""Folders that are written in steps, and what is committed in them: small files that appear whole or not at all.

A commit is written beside and renamed into the folder's `_commits`, so readers see it with all of its content; one that is there
already is left as it is. One writer at a time is assumed, as Structured Streaming and a nightly job have it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and its Path class."""
    jvm = spark.sparkContext._jvm
    made = jvm.org.apache.hadoop.fs.Path
    return made(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), made


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if it is not there."""
    fs, path = file_system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path(folder))) if fs.exists(path(folder)) else []


def commit(spark: SparkSession, root: str, name: str, content: str = "") -> bool:
    """Puts a file into root's commits; False if it was there."""
    fs, path = file_system(spark, root)
    target = path(f"{root}/_commits/{name}")
    if fs.exists(target):
        return False
    fs.mkdirs(path(f"{root}/_commits"))
    beside = path(f"{root}/_staging/{uuid.uuid4().hex}")
    out = fs.create(beside)
    out.write(bytearray(content.encode()))
    out.close()
    return bool(fs.rename(beside, target))


def committed(spark: SparkSession, root: str) -> list[str]:
    return names(spark, f"{root}/_commits")


def remove(spark: SparkSession, folder: str) -> None:
    fs, path = file_system(spark, folder)
    fs.delete(path(folder), True)


def landed_days(spark: SparkSession, root: str, by: str = "date") -> list[str]:
    """The days that land_days() has finished."""
    return [n.removeprefix(f"{by}=") for n in committed(spark, root) if n.startswith(f"{by}=")]


def pending(df: DataFrame, root: str, by: str = "date") -> DataFrame:
    """The rows of days that are not finished. Where by is a partition of df's files, the other days' files are not opened."""
    done = landed_days(df.sparkSession, root, by)
    return df.where(~F.col(by).isin(*(F.lit(x).cast(df.schema[by].dataType) for x in done))) if done else df


def land_days(df: DataFrame, root: str, by: str = "date", order: tuple[str, ...] = ()) -> list[str]:
    """Writes the days of df that are not finished, a Parquet partition each, and returns them; rows without a day are left out.

    All days are written beside first; then each is moved into its place and committed. A run that breaks off leaves days
    that are finished or not there for read_days(); the next one writes the rest. A large day is split over several files.
    """
    spark = df.sparkSession
    fs, path = file_system(spark, root)
    stage = f"{root}/_staging/{uuid.uuid4().hex}"
    rows = pending(df, root, by).where(F.col(by).isNotNull()).hint("rebalance", by)
    rows.sortWithinPartitions(by, *order).write.option("compression", "zstd").partitionBy(by).parquet(stage)
    landed = [n for n in names(spark, stage) if n.startswith(f"{by}=")]
    for name in landed:
        fs.delete(path(f"{root}/{name}"), True)  # what a run that broke off has left
        if not fs.rename(path(f"{stage}/{name}"), path(f"{root}/{name}")):
            raise OSError(f"cannot move {name} into {root}")
        commit(spark, root, name)
    remove(spark, stage)
    return [n.removeprefix(f"{by}=") for n in landed]


def read_days(spark: SparkSession, root: str, schema, by: str = "date") -> DataFrame:
    """The finished days. Their list goes to the scan as a filter on partitions."""
    empty = spark.createDataFrame([], schema)
    done = landed_days(spark, root, by)
    if not done:
        return empty
    return spark.read.schema(empty.schema).parquet(root).where(F.col(by).isin(*(F.lit(x).cast(empty.schema[by].dataType) for x in done)))

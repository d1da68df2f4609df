"""Tables in buckets: rows that are joined or grouped by the same keys again and again are dealt by them once, when they are written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from roadtide.session import scratch_dir


def bucketed(df: DataFrame, keys: list[str], buckets: int, path: str | None = None) -> DataFrame:
    """df as a table of so many buckets of its keys, each sorted by them and one file a bucket.

    A join of two such tables with equal keys and numbers of buckets, a semi join, and a grouping by the keys need no
    exchange. The table is known to the session's catalog under a name of its own; its files lie at path, by default in
    the application's scratch folder. Few distinct keys make few files; a key with very many rows makes a large one, so
    the keys should be fine enough (station, weekday and time of day rather than the station alone).
    """
    spark, table = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path or scratch_dir(spark)).saveAsTable(table)
    return spark.table(table)

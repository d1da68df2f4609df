"""Session settings that the operators assume."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(app: str = "roadtide", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; the cluster's own settings win where they are given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def broadcast_if_small(df, most: int = 100_000):
    """df with a broadcast hint if it has at most so many rows; as it is otherwise."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares (spark.checkpoint.dir), deleted when the application ends.

    Where the setting is missing, a temporary folder of this machine takes its place in local mode; elsewhere that is an error.
    """
    context = spark.sparkContext
    if context.applicationId not in _OWN:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = base or "file://" + tempfile.mkdtemp(prefix="roadtide-")
        _OWN[context.applicationId] = f"{base.rstrip('/')}/roadtide-files-{context.applicationId}"
        folder = context._jvm.org.apache.hadoop.fs.Path(_OWN[context.applicationId])
        folder.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return f"{_OWN[context.applicationId]}/{uuid.uuid4().hex}"


def written(df):
    """df written to a folder of its own in the shared place and read back: cuts the lineage, and survives lost executors."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

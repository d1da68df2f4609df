"""Helpers that the training-data operators share."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WHITE_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"
#: A key with more than 1 / HEAVY of all rows is split in a join; there are fewer than HEAVY of these.
HEAVY = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that the cluster shares (spark.checkpoint.dir); it is deleted when the application ends.

    Where the setting is missing, a temporary folder of this machine takes its place in local mode; elsewhere that is an error.
    """
    context = spark.sparkContext
    if context.applicationId not in _OWN:
        path, local = spark.conf.get("spark.checkpoint.dir", None), context.master.startswith("local")
        if not path and not local:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = path or "file://" + tempfile.mkdtemp(prefix="roadtide-")
        path = (path if "://" in path or not local else f"file://{path}").rstrip("/")
        _OWN[context.applicationId] = f"{path}/roadtide-{context.applicationId}"
        folder = context._jvm.org.apache.hadoop.fs.Path(_OWN[context.applicationId])
        folder.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return _OWN[context.applicationId]


#: Folders of this process's applications.
_OWN: dict[str, str] = {}


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, and survives lost executors."""
    return kept(df, name)[0]


def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """saved(), and the folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that kept() wrote."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def balanced_join(left: DataFrame, right: DataFrame, on: list[str], counts: DataFrame, total: int | None = None, how: str = "inner") -> DataFrame:
    """left joined with right, whose keys are unique, with the keys split that many rows of left have.

    counts: DataFrame[*on, n] of each such key's number n of rows in left.
    total: the number of rows in left; the sum of n where it is not given.
    A key with more than 1 / HEAVY of the rows is dealt to several tasks. Of such
    keys there are fewer than HEAVY; they are looked up first, so that counts is
    computed once and is no part of the join, which is a plain one without any.
    right has at most 2 * HEAVY rows more. how: inner or left_semi.
    """
    if total is None:
        total = counts.agg(F.sum("n")).first()[0] or 0
    most = max(total // HEAVY, 1)
    heavy = counts.where(F.col("n") > most).select(*on, F.ceil(F.col("n") / most).cast("int").alias("__parts"))
    found = heavy.collect()
    if not found:
        return left.join(right, on, how)
    heavy = F.broadcast(left.sparkSession.createDataFrame(found, heavy.schema).coalesce(1))
    deal = F.pmod(F.xxhash64(*(c for c in left.columns if c not in on)), F.col("__parts"))
    dealt = left.join(heavy, on, "left").withColumn("__part", F.coalesce(deal.cast("int"), F.lit(0))).drop("__parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts") - 1, F.lit(0))))
    return dealt.join(right.join(heavy, on, "left").withColumn("__part", copies).drop("__parts"), [*on, "__part"], how).drop("__part")


def words(text) -> F.Column:
    """Array of the words of a text; empty for null."""
    spaced = F.coalesce(text, F.lit(""))
    for c in WHITE_CHARS[1:]:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def let(value, body) -> F.Column:
    """body(value) with value computed once per row, for use inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def pieces(texts: pa.Array, size: int) -> Iterator[tuple[int, list[str | None]]]:
    """Start and texts of consecutive slices of an Arrow array with about so many bytes each (a longer text alone), so that few are Python strings at once."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(lengths) - lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]
    for a, b in itertools.pairwise(cuts):
        if b > a:
            yield a, texts.slice(a, b - a).to_pylist()
    pa.default_memory_pool().release_unused()


def small_enough(df: DataFrame, most: int) -> bool:
    """Whether df has at most so many rows; reads no more than most + 1 of them to the count."""
    return df.limit(most + 1).count() <= most


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)

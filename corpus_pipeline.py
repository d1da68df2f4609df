"""Corpus pipeline: language ID, line dedup, near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadtide.llm import bpe, lang_id, line_dedup, minhash_bbit, poisson_mix
from roadtide.llm.common import saved, shared_dir, small_enough, tokenizer_path

#: The stages as a whole have no SQL; they are tested one by one.
ORACLE_SQL = None
#: Dropped doc_ids that are broadcast at most; beyond it they are joined by a shuffle.
MAX_BROADCAST_IDS = 500_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier accepts.

    Null texts, empty ones and texts without a letter go; equal rows share their fate; without labelled rows to learn
    from every document goes; an empty table stays empty; columns of any name are kept.
    """
    names = ("__language", "__confidence", "__rejected")
    return lang_id.predict(docs, lang_id.fit(docs), names).where("not __rejected").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line matches; a document that loses all its words goes.

    Null and empty texts and documents without doc_id stay as they are; n_chars is counted anew where a line goes;
    repeated rows are one document's, so all lose the same lines; an empty table stays empty.
    """
    done = line_dedup.line_dedup(docs, names=("__lines", "__dropped")).where("__dropped = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    size = F.when(F.col("__dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", size).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of every group of near-duplicates (five words, similarity 0.8).

    Documents without words or without doc_id stay; of repeated rows of a kept doc_id all stay; an empty table stays empty.
    """
    gone = saved(minhash_bbit.near_components(docs, words=5, percent=80).where("not kept").select("doc_id"), "near-gone")
    return docs.join(F.broadcast(gone) if small_enough(gone, MAX_BROADCAST_IDS) else gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents replicated to the target weights of their sources, in a global random order.

    A null source is a source of its own; null texts count as documents; repeated rows draw the same number of copies;
    an empty table stays empty.
    """
    return poisson_mix.poisson_mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the hash of what they decode to. Null texts have no ids; equal rows have equal ones."""
    return bpe.encode(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("language_id", identify_language), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("mixing", mix_sources), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents; each stage's rows are written to the shared folder and read again.

    The folders stay until the application ends, as the last is what is returned. Nulls, repeated rows and empty tables
    are as the stages state; an empty table gives no row.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{i}")
        docs = spark.read.parquet(f"{path}/{i}")
    return docs

"""Quality rules: hashed n-gram log-likelihood ratio between trusted-target and raw-corpus multinomials.

Every document is mapped to hashed buckets of its words and word pairs. Two
multinomials over the buckets are counted: one over all documents, one over
the trusted ones. A document's score is the mean log ratio of its n-grams
(length-normalised); it is kept if the score reaches a fixed threshold.
DataFrame functions only.

Cases: null text has no words; a document without words scores 0 and fails
the base rules; documents without doc_id are scored but never trusted;
repeated rows each get a row; an empty table gives an empty result; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtide.llm.common import let, small_enough, words

#: Number of hash buckets of the multinomials, a power of two.
BUCKETS = 16384
#: Trusted documents (8 bytes each) that are broadcast at most; beyond it they are joined by a shuffle.
MAX_BROADCAST_TRUSTED = 500_000
#: Counts that the target is smoothed with, spread as the raw corpus is.
PRIOR = 4096.0
#: Mean log ratio per n-gram below which a document goes.
THRESHOLD = -0.1
WINDOW = 8


def _paired(hashes, step: int) -> F.Column:
    """Hashes of spans twice as long: each with the one `step` places on."""
    n = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))


def _repeat_words(pairs) -> F.Column:
    """Words inside a window of WINDOW words that is found twice or more in the text, from the hashes of its word pairs."""

    def covered(ordered):
        last = F.size(ordered) - 1
        repeated = F.filter(
            ordered,
            lambda e, i: ((i > 0) & (F.get(ordered, i - 1)["h"] == e["h"])) | ((i < last) & (F.get(ordered, i + 1)["h"] == e["h"])),
        )
        starts = F.array_sort(F.transform(repeated, lambda e: e["p"]))
        first = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["n"] + p + WINDOW - F.greatest(acc["end"], p)).alias("n"))
        return F.aggregate(starts, first, step, lambda acc: acc["n"])

    def of(w):
        ordered = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(ordered, covered))

    # A repeated window repeats five spans of four words; few texts have that, and only they need the windows.
    return let(
        _paired(pairs, 2),
        lambda fours: F.when(F.size(fours) - F.size(F.array_distinct(fours)) < WINDOW - 3, F.lit(0)).otherwise(let(_paired(fours, 4), of)),
    )


def _hashed(texts: DataFrame) -> DataFrame:
    """Adds words, one (their hashes) and two (the hashes of word pairs)."""
    return (
        texts.withColumn("words", words(F.col("text")))
        .withColumn("one", F.transform("words", lambda w: F.xxhash64(w)))
        .withColumn("two", _paired(F.col("one"), 1))
    )


def _bucket(h, buckets: int) -> F.Column:
    return h.bitwiseAND(F.lit(buckets - 1)).cast("int")


def fit(docs: DataFrame, trusted: DataFrame, *, buckets: int = BUCKETS, prior: float = PRIOR) -> list[float]:
    """The log ratio of every bucket.

    trusted: doc_id of documents known to be good. Raw counts are over all documents, target counts over all trusted ones.
    Only two counts a bucket come to the driver, however large the corpus.
    """
    chosen = trusted.select("doc_id").where("doc_id is not null").distinct().withColumn("target", F.lit(1))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen) if small_enough(chosen, MAX_BROADCAST_TRUSTED) else chosen, "doc_id", "left")
    counted = (
        _hashed(rows)
        .select("target", F.explode(F.concat("one", "two")).alias("h"))
        .groupBy(_bucket(F.col("h"), buckets).alias("bucket"))
        .agg(F.count("*").alias("raw"), F.count("target").alias("target"))
    )
    raw, target = [0] * buckets, [0] * buckets
    for r in counted.collect():
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    n_raw, n_target = max(1, sum(raw)), sum(target)
    return [math.log((t * n_raw / r + prior) / (n_target + prior)) if r else 0.0 for t, r in zip(target, raw, strict=True)]


def score(docs: DataFrame, ratios: list[float], *, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """Base counts, length-normalised log ratio and verdict of every document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept (boolean), score (double).
    """
    # The model is a constant of the plan: `buckets` doubles, whatever the size of the corpus.
    table = F.lit(np.array(ratios))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, h: acc + F.get(table, _bucket(h, buckets)))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = (
        _hashed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
        .withColumn("n", F.size("words"))
        .select(
            "doc_id",
            F.col("n").cast("long").alias("n_words"),
            F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(F.col("two")).cast("long").alias("n_repeat_words"),
            ((total("one") + total("two")) / F.greatest(F.size("one") + F.size("two"), F.lit(1))).alias("score"),
        )
        .withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30))
    )
    return counts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"), "score",
    )


def quality_llr(docs: DataFrame, labels: DataFrame, *, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """Fit on labels (quality = 1 and not toxic) and score every document."""
    trusted = labels.where("quality = 1 and coalesce(toxic, 0) = 0")
    return score(docs, fit(docs, trusted, buckets=buckets), buckets=buckets, threshold=threshold)

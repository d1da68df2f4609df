"""Mixing sources to target weights by Poisson replication.

Every document gets a replica count drawn from a Poisson distribution whose
mean is the target repetition rate of its source. The draw inverts the
distribution at a uniform number made from a hash of seed, source and
doc_id, so it is the same on every run. Documents are exploded by their
counts, and the copies are shuffled globally by a second hash.
DataFrame functions only.

Target weights: the share of the mixed corpus's documents that each source
should have. Without explicit weights a source's share is its number of
documents to the power `temperature`, scaled to 1.

Cases: a null source is a source of its own; a null doc_id takes part in the
hash as an empty string; repeated rows draw the same count; null texts count
as documents; a source that the weights do not name gets weight 0; an empty
table gives an empty result; columns with other names are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtide.llm.common import balanced_join

#: Exponent of the default weights: 1 keeps the corpus's own mixture, 0 makes all sources equal.
TEMPERATURE = 0.5
SEED = 17
#: Bytes of source names and rates that are broadcast at most; beyond it they are joined by a shuffle in which large sources are split.
MAX_BROADCAST_BYTES = 8_000_000
#: Terms of the inverted distribution: at a mean of 20, the rest has a probability below 1e-16. Larger means are split in copies of 20.
TERMS = 80
MEAN_STEP = 20.0


def uniform(*parts) -> F.Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts joined by '|'."""
    digest = F.md5(F.concat_ws("|", *(F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p, F.lit("")) for p in parts)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson(u, mean) -> F.Column:
    """The smallest k with u < P(X <= k) for X Poisson distributed with this mean (up to MEAN_STEP)."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"), F.lit(0).alias("k"))

    def step(acc, i):
        p = acc["p"] * mean / i
        return F.when(u < acc["cdf"], acc).otherwise(F.struct(p.alias("p"), (acc["cdf"] + p).alias("cdf"), i.alias("k")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["k"])


def source_rates(docs: DataFrame, *, weights: dict | None = None, temperature: float = TEMPERATURE, total: float = 1.0) -> DataFrame:
    """DataFrame[source, n_docs, weight, rate]: rate is how often a document of the source should occur.

    total: size of the mixed corpus as a multiple of the input.
    """
    counts = docs.groupBy("source").agg(F.count("*").alias("n_docs"))
    if weights is None:
        raw = F.pow(F.col("n_docs").cast("double"), F.lit(temperature))
    else:
        named = [F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))) for k, v in weights.items()]
        raw = F.coalesce(*named, F.lit(0.0))
    weighted = counts.withColumn("raw", raw)
    sums = weighted.agg(F.sum("raw").alias("raw_all"), F.sum("n_docs").alias("docs_all"))
    return weighted.join(F.broadcast(sums)).select(
        "source",
        "n_docs",
        F.try_divide(F.col("raw"), F.col("raw_all")).alias("weight"),
        F.coalesce(F.try_divide(F.col("raw") * F.col("docs_all") * F.lit(float(total)), F.col("raw_all") * F.col("n_docs")), F.lit(0.0)).alias("rate"),
    )


def poisson_mix(docs: DataFrame, *, weights: dict | None = None, temperature: float = TEMPERATURE, total: float = 1.0, seed: int = SEED) -> DataFrame:
    """The mixed corpus: the columns of docs, then mix_copy (from 1) and mix_order, in which the rows are sorted globally; they take the place of any of the same name.

    Sources of any size are exploded where their rows lie; the only shuffle of texts is the global one. The
    order is a uniform hash, so equal ranges of it are equal partitions, and no pass is needed to sample it.
    """
    spark, docs = docs.sparkSession, docs.drop("mix_copy", "mix_order")
    keys = [F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__mix_source"), F.col("source").isNull().alias("__mix_none")]
    rates = source_rates(docs, weights=weights, temperature=temperature, total=total).select(*keys, F.col("rate").alias("__mix_rate"), F.col("n_docs").alias("__mix_docs"))
    size = rates.agg(F.sum(F.octet_length("__mix_source") + 32)).first()[0] or 0
    keyed = docs.select("*", *keys)
    if size <= MAX_BROADCAST_BYTES:
        rated = keyed.join(F.broadcast(rates.drop("__mix_docs")), ["__mix_source", "__mix_none"])
    else:
        on = ["__mix_source", "__mix_none"]
        rated = balanced_join(keyed, rates.drop("__mix_docs"), on, rates.select(*on, F.col("__mix_docs").alias("n")))
    # A rate beyond MEAN_STEP is drawn in equal parts: a sum of Poisson numbers is a Poisson number.
    parts = F.greatest(F.ceil(F.col("__mix_rate") / MEAN_STEP), F.lit(1)).cast("int")
    draws = F.transform(F.sequence(F.lit(1), parts), lambda j: poisson(uniform(F.lit(f"count{seed}"), "source", "doc_id", j), F.col("__mix_rate") / parts))
    count = F.aggregate(draws, F.lit(0), lambda a, b: a + b)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.conv(F.substring("mix_order", 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    return (
        rated.withColumn("__mix_n", count)
        .where("__mix_n > 0")
        .withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_n"))))
        .withColumn("mix_order", F.md5(F.concat_ws("|", F.lit(f"order{seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "mix_copy")))
        .select(*docs.columns, "mix_copy", "mix_order")
        .repartitionById(tasks, F.floor(place * tasks).cast("int"))
        .sortWithinPartitions("mix_order", "doc_id", "mix_copy")
    )

"""Exact interpolated quantiles of groups, of which any may hold most of the rows.

Groups with few values are sorted where they meet. Of the others, every wanted rank has a range of values that holds it, at first from
the smallest to the largest. A pass counts the values of all these ranges by bins, one shuffle of counts for all groups and ranks, and
goes on in the bin that holds the rank, between the smallest and the largest value that lie there; it ends when a range has few values,
or one. Bins are equal by turns in values and in their logarithms, so neither crowded nor widely scattered values take many passes.
Then these are sorted, and two ranks are interpolated. No task gets a group's values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadtide.operators.skew import copied, dealt, heavy_keys
from roadtide.session import written

#: Values of a group, or of a range, that are sorted at once; bins of a range in a pass; ranges that are broadcast.
FEW, BINS, MOST = 10_000, 1024, 100_000


def _same(keys: list[str]):
    """Rows and ranges (with keys under a mark) of one group; null is a group."""
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys), F.lit(True))


def _meet(values: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Values with each range of their group that they lie in. ranges: __of_<key>, i, low, high and more; few enough to be broadcast, or dealt by group."""
    inside = F.col("x").between(F.col("low"), F.col("high"))
    if ranges.limit(MOST + 1).count() <= MOST:
        return values.join(F.broadcast(ranges), _same(keys) & inside)
    group = F.xxhash64(F.struct(*keys))
    heavy = heavy_keys(values.select(group.alias("__g")), ["__g"])
    left = dealt(values.withColumn("__g", group), heavy, ["__g"], ["x"])
    right = copied(ranges.withColumn("__g", F.xxhash64(F.struct(*(F.col(f"__of_{k}").alias(k) for k in keys)))), heavy, ["__g"]).withColumnsRenamed({"__g": "__h", "__part": "__p"})
    return left.join(right, (F.col("__g") == F.col("__h")) & (F.col("__part") == F.col("__p")) & _same(keys) & inside).drop("__g", "__h", "__part", "__p")


def group_quantiles(df: DataFrame, keys: list[str], value, qs: dict[str, float], *, few: int = FEW, bins: int = BINS) -> DataFrame:
    """keys, n (values), and an interpolated quantile for each name in qs, of every group with a value.

    Nulls and NaN don't count; without keys the whole table is one group; -0.0 is 0.0; infinite values count, and what is
    interpolated with them is infinite or NaN. Values that no double holds exactly are taken as doubles.
    """
    x = (value.cast("double") + 0.0).alias("x")
    rows = df.select(*keys, x).where("x is not null and not isnan(x)")
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    big = written(counts.where((F.col("n") > few) & (F.col("low") < F.col("high"))))
    if big.isEmpty():
        return rows.groupBy(*keys).agg(F.count("*").alias("n"), *(F.percentile("x", q).alias(name) for name, q in qs.items()))
    marked = [F.col(k).alias(f"__of_{k}") for k in keys]
    is_big = F.broadcast(big.select(*marked)) if big.limit(MOST + 1).count() <= MOST else big.select(*marked)
    values = written(rows.join(is_big, _same(keys), "left_semi"))
    light = rows.join(is_big, _same(keys), "left_anti").groupBy(*keys).agg(F.count("*").alias("n"), *(F.percentile("x", q).alias(name) for name, q in qs.items()))

    names = list(qs)
    at = lambda q: F.lit(q) * (F.col("n") - 1)
    wanted = F.array(*(F.struct(F.lit(2 * i + j).alias("i"), (F.floor(at(qs[name])) + j).alias("rank")) for i, name in enumerate(names) for j in (0, 1)))
    state = big.select(*marked, "n", "low", "high", F.inline(wanted)).select(*(f"__of_{k}" for k in keys), "i", F.least("rank", F.col("n") - 1).alias("rank"), F.col("n").alias("m"), "low", "high")
    group = [*(f"__of_{k}" for k in keys), "i"]
    # Rises with x, and leaves 0 between all negative and all positive doubles.
    logarithm = lambda c: F.when(c == 0, 0.0).otherwise(F.signum(c) * (F.ln(F.abs(c)) + 750.0))
    found, passes = [], 0
    while True:
        state = written(state)
        found.append(state.where((F.col("m") <= few) | (F.col("low") == F.col("high"))))
        open_ = state.where((F.col("m") > few) & (F.col("low") < F.col("high")))
        if open_.isEmpty():
            break
        met = _meet(values, open_, keys)
        # Halves, so that the width of a range from -1e308 to 1e308 is finite.
        scaled = logarithm if passes % 2 else lambda c: c / 2
        passes += 1
        share = F.try_divide(scaled(F.col("x")) - scaled(F.col("low")), scaled(F.col("high")) - scaled(F.col("low")))
        bin_ = F.when(F.col("x") == F.col("low"), 0).when(F.col("x") == F.col("high"), bins + 1).otherwise(F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1)) + 1)
        counted = met.groupBy(*group, "rank", bin_.alias("bin")).agg(F.count("*").alias("c"), F.min("x").alias("low"), F.max("x").alias("high"))
        upto = F.sum("c").over(Window.partitionBy(*group).orderBy("bin"))
        into = counted.withColumn("before", upto - F.col("c")).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("c")))
        state = into.select(*group, (F.col("rank") - F.col("before")).alias("rank"), F.col("c").alias("m"), "low", "high")
    done = reduce(DataFrame.unionByName, found)
    single = done.where("low = high").select(*group, F.col("low").alias("v"))
    last = _meet(values, done.where("low < high"), keys).groupBy(*group, "rank").agg(F.sort_array(F.collect_list("x")).alias("xs")).select(*group, F.get("xs", F.col("rank").cast("int")).alias("v"))
    per = single.unionByName(last).groupBy(*(f"__of_{k}" for k in keys)).agg(*(F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"v{i}") for i in range(2 * len(qs))))
    joined = big.select(*keys, "n").join(per, _same(keys))
    part = lambda q: at(q) - F.floor(at(q))

    def value_at(i: int, q: float):
        return F.when(part(q) == 0, F.col(f"v{2 * i}")).otherwise(F.col(f"v{2 * i}") + part(q) * (F.col(f"v{2 * i + 1}") - F.col(f"v{2 * i}")))

    heavy = joined.select(*keys, "n", *(value_at(i, q).alias(name) for i, (name, q) in enumerate(qs.items())))
    return light.unionByName(heavy) if keys else heavy

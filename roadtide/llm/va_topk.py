"""Exact top-k inner-product search with a vector-approximation file.

1. The file: every vector as cells of 8 bits a dimension, whose width is the
   vector's largest component / 127, so one outlier coarsens no other vector.
   With it go two hashes of the exact vector. Of equal vectors only the k + 1
   smallest ids stay: no more can be among a query's k best.
2. The scan: cells and queries are dealt into blocks by a hash of their id, and
   each pair of blocks is one group of a cogroup. One matrix product gives the
   middle of every score's bounds; the rest is the lesser of the query's sum
   times half the cell's width and of the query's length times that of what the
   cells leave out. A block keeps what its kth lower bound does not rule out,
   ties by id included, and the kth lower bound over all blocks rules out more.
3. Exact vectors are fetched in the order of the bounds, in two rounds: first
   for the highest upper bounds, then for what the kth best of these exact
   scores does not rule out, so that the kth result is certain.

Only cells are copied to the query blocks. A query's candidates are dealt to
parts, the k best of each part and then of all are taken, and the joins split
vectors that many queries ask for and queries that have many candidates.

Cases: null vectors, vectors that hold a null or a non-finite component and
rows without an id take no part; of rows with one id, the one with the
smallest hash counts; a shorter vector is padded with zeros; ties go to the
smaller id; scores are exact at any size, and those beyond 64 bits are given
as the nearest long; with fewer than k candidates all are returned; an empty
table or query set gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadtide.llm.common import balanced_join, saved

#: Cells and queries in a block, on average, and cells that are scanned at once.
DATA_BLOCK, QUERY_BLOCK, SCAN = 32_768, 2048, 4096
#: Cells on either side of zero.
CELLS = 127
#: A query's candidates in a part, those of a part that are read in the first round, and parts that exact scores are dealt to.
PART, FIRST, SCORE_PARTS = 64, 4, 32
_LONG = 2**63 - 1


def scaled(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """DataFrame[id, v array<bigint>]: floor(scale * x) of the vectors that take part (components beyond 64 bits become the nearest long)."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def whole(x):
        y = x.cast("double") * scale
        return F.when(y >= 2.0**63, F.lit(_LONG)).when(y <= -(2.0**63), F.lit(-_LONG - 1)).otherwise(F.floor(F.when(F.abs(y) < 2.0**63, y)).cast("long"))

    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, whole).alias("v"))


def _hashed(vectors: DataFrame) -> DataFrame:
    return vectors.select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))


def cells(vectors: DataFrame) -> DataFrame:
    """DataFrame[id, h1, h2, width double, rest double, cells binary]: component i lies within half a width of cells[i] * width, and the vector within rest."""

    def encode(batches):
        for batch in batches:
            if not len(batch):
                continue
            rows = []
            for v in batch["v"]:
                x = np.asarray(v, np.float64)
                width = (np.abs(x).max() if len(x) else 0.0) / CELLS or 1.0
                cell = np.rint(x / width)
                rows.append((width, float(np.linalg.norm(x - cell * width)) * (1 + 1e-9), cell.astype(np.int8).tobytes()))
            yield batch[["id", "h1", "h2"]].assign(width=[r[0] for r in rows], rest=[r[1] for r in rows], cells=[r[2] for r in rows])

    return _hashed(vectors).mapInPandas(encode, "id long, h1 long, h2 long, width double, rest double, cells binary")


def distinct_cells(file: DataFrame, k: int) -> DataFrame:
    """The file with one row an id, and of equal vectors the k + 1 smallest ids."""
    own = file.groupBy("id").agg(F.min(F.struct("h1", "h2", "width", "rest", "cells")).alias("c")).select("id", "c.*")
    return own.withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("n") <= k + 1).drop("n")


def _padded(rows, kind, dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims))
    for i, v in enumerate(rows):
        x = np.frombuffer(v, kind) if isinstance(v, bytes) else np.asarray(v, np.float64)
        out[i, : len(x)] = x
    return out


def block_bounds(queries: pd.DataFrame, data: pd.DataFrame, k: int) -> pd.DataFrame:
    """query_id, vec_id, h1, h2, lower, upper of the pairs that the block's own kth lower bounds do not rule out; top: among the block's k highest lower bounds."""
    dims = max([1, *queries["v"].map(len), *data["cells"].map(len)])
    own, q = queries["id"].to_numpy(np.int64), _padded(list(queries["v"]), None, dims)
    ids, width, rest, codes = data["id"].to_numpy(np.int64), data["width"].to_numpy(), data["rest"].to_numpy(), list(data["cells"])
    size, length = np.abs(q).sum(axis=1), np.linalg.norm(q, axis=1) * (1 + 1e-9)
    least, found = np.full(len(q), -np.inf), []
    for a in range(0, len(ids), SCAN):
        x, w = _padded(codes[a : a + SCAN], np.int8, dims), width[a : a + SCAN]
        middle = (q @ x.T) * w
        # What the cells leave out, and the rounding of all these sums.
        reach = np.minimum(size[:, None] * w * 0.5, length[:, None] * rest[a : a + SCAN]) + size[:, None] * w * (CELLS * (dims + 8) * 2.0**-52)
        lower, upper = middle - reach, middle + reach
        self_ = own[:, None] == ids[a : a + SCAN]
        lower[self_], upper[self_] = -np.inf, -np.inf
        if lower.shape[1] >= k:
            # The kth lower bound of any part bounds the kth best score of all.
            least = np.maximum(least, np.partition(lower, -k, axis=1)[:, -k])
        i, j = np.nonzero((upper >= least[:, None]) & ~self_)
        found.append((i, j + a, lower[i, j], upper[i, j]))
    i, j, lower, upper = map(np.concatenate, zip(*found, strict=True))
    if not len(i):
        return pd.DataFrame({c: [] for c in ("query_id", "vec_id", "h1", "h2", "lower", "upper", "top")})
    # The kth of the lower bounds, equal ones by id: what reaches no further and has a larger id is ruled out too.
    order = np.lexsort((ids[j], -lower, i))
    first = np.searchsorted(i[order], np.arange(len(q)))
    kth = first + k - 1
    full = (kth < len(order)) & (i[order[np.minimum(kth, len(order) - 1)]] == np.arange(len(q)))
    at = order[np.minimum(kth, len(order) - 1)]
    low, who = np.where(full, lower[at], -np.inf), ids[j[at]]
    top = np.zeros(len(i), bool)
    top[order] = np.arange(len(order)) - first[i[order]] < k
    stay = (upper > low[i]) | ((upper == low[i]) & (ids[j] <= who[i])) | ~full[i]
    i, j, top = i[stay], j[stay], top[stay]
    return pd.DataFrame({"query_id": own[i], "vec_id": ids[j], "h1": data["h1"].to_numpy()[j], "h2": data["h2"].to_numpy()[j], "lower": lower[stay], "upper": upper[stay], "top": top})


def _exact(q: np.ndarray, x: list) -> list[int]:
    """Inner products in whole numbers."""
    n = min([len(q), *map(len, x)])
    if max([1, *np.abs(q.astype(np.float64))]) * max([1.0, *(np.abs(np.asarray(v, np.float64)).max(initial=0) for v in x)]) * (len(q) + 1) < 2.0**62:
        return [int(np.dot(q[: len(v)], v[: len(q)])) for v in x] if n < max([len(q), *map(len, x)]) else (np.stack(x) @ q).tolist()
    big = [int(c) for c in q]
    return [sum(a * int(b) for a, b in zip(big, v, strict=False)) for v in x]


#: What is added to a score before it is written as bytes, which then sort as the scores do.
_ABOVE = 1 << 160


def _scores(batches):
    """query_id, vec_id, score (nearest long) and full (the exact one as bytes that sort alike) of pairs of vectors."""
    for batch in batches:
        exact = [_exact(np.asarray(q, np.int64), [v])[0] for q, v in zip(batch["asked"], batch["v"], strict=True)]
        yield pd.DataFrame(
            {
                "query_id": batch["query_id"], "vec_id": batch["vec_id"], "score": [max(-_LONG - 1, min(_LONG, s)) for s in exact], "full": [(s + _ABOVE).to_bytes(24, "big") for s in exact],
            }
        )


def _best(rows: DataFrame, k: int, *order) -> DataFrame:
    """The k first rows of each query: of its parts, and of what these leave; n is their place."""
    parts = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order))).where(F.col("n") <= k)
    return parts.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("n") <= k)


def _scored(pairs: DataFrame, exact: DataFrame, asked: DataFrame) -> DataFrame:
    """Exact scores of pairs (query_id, part, vec_id, h1, h2). Vectors and queries in very many pairs are split."""
    key = ["vec_id", "h1", "h2"]
    count = lambda on: pairs.groupBy(*on).agg(F.count("*").alias("n"))
    fetched = balanced_join(pairs.select("query_id", *key), exact, key, count(key))
    both = balanced_join(fetched.select("query_id", "vec_id", "v"), asked.select(F.col("id").alias("query_id"), F.col("v").alias("asked")), ["query_id"], count(["query_id"]))
    return both.mapInPandas(_scores, "query_id long, vec_id long, score long, full binary").dropDuplicates(["query_id", "vec_id"])


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 5, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """DataFrame[query_id, rank, vec_id, score]: each query's k best vectors other than its own.

    vectors, queries: DataFrame[id long, v array<bigint>], as from scaled().
    """
    file = saved(distinct_cells(cells(vectors), k), "va-file")
    asked = saved(_hashed(queries).groupBy("id").agg(F.min(F.struct("h1", "h2", "v")).alias("c")).select("id", "c.v"), "va-queries")
    blocks, query_blocks = (max(1, -(-df.count() // size)) for df, size in ((file, data_block), (asked, query_block)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = asked.select("id", "v", own(query_blocks).alias("q"), every(blocks).alias("d"))
    right = file.select("*", own(blocks).alias("d"), every(query_blocks).alias("q"))
    schema = "query_id long, vec_id long, h1 long, h2 long, lower double, upper double, top boolean"

    def scan(some: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        if some.empty or data.empty:
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        return block_bounds(some, data, k)

    bounds = saved(left.groupBy("d", "q").cogroup(right.groupBy("d", "q")).applyInPandas(scan, schema), "va-bounds")
    sizes = saved(bounds.groupBy("query_id").agg(F.count("*").alias("n")), "va-sizes")
    part = F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("m") / PART))
    of_query = lambda rows, more: balanced_join(rows, more, ["query_id"], sizes)
    tops = of_query(bounds.where("top"), sizes.select("query_id", F.col("n").alias("m"))).withColumn("part", part)
    kth = _best(tops, k, F.desc("lower"), "vec_id").where(F.col("n") == k).select("query_id", F.col("lower").alias("kth_lower"), F.col("vec_id").alias("kth_id"))
    limits = saved(sizes.select("query_id", F.col("n").alias("m")).join(kth, "query_id", "left"), "va-limits")
    left_over = of_query(bounds.drop("top"), limits).where("kth_id is null or upper > kth_lower or (upper = kth_lower and vec_id <= kth_id)")
    open_ = left_over.select("query_id", part.alias("part"), "vec_id", "h1", "h2", "upper")
    open_ = saved(open_.withColumn("at", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(F.desc("upper"), "vec_id"))), "va-open")

    exact, count = _hashed(vectors).withColumnRenamed("id", "vec_id"), open_.groupBy("query_id").agg(F.count("*").alias("n"))
    place = lambda rows: rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(SCORE_PARTS)))
    first = saved(_scored(open_.where(F.col("at") <= FIRST), exact, asked), "va-first")
    sure = _best(place(first), k, F.desc("full"), "vec_id").where(F.col("n") == k).select("query_id", F.when(F.col("score") > -_LONG, F.col("score")).alias("sure"))
    sure = count.select("query_id").join(sure, "query_id", "left")
    # Bounds are doubles: one that equals the score may still hide a larger one, so it is read.
    rest = balanced_join(open_.where(F.col("at") > FIRST), sure, ["query_id"], count).where("sure is null or upper >= cast(sure as double)")
    every = first.unionByName(_scored(rest.drop("sure"), exact, asked))
    return _best(place(every), k, F.desc("full"), "vec_id").select("query_id", F.col("n").cast("int").alias("rank"), "vec_id", "score")

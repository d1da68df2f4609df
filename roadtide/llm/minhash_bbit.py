"""MinHash near-dedup with b-bit signatures, confirmed on full shingle sets.

1. Every document's distinct shingles give BANDS * rows minima. Bands of the
   full minima are the candidate keys; of each minimum the low BITS are kept
   and packed. Documents with one shingle set become one class, for which the
   smallest doc_id stands. A pair at the threshold shares no band with a
   probability of MISS at most, which sets the rows of a band.
2. Classes that meet in a band are candidates. Every one is held against the
   smallest of its band by the signatures: equal bits, counted in the packed
   words and corrected for chance matches, estimate the similarity, and what
   misses the threshold by SIGMAS standard errors is ruled out. Classes that
   their smallest rules out are held against all of their band, in blocks.
   What is left is a graph whose edges grow with the classes, not their pairs,
   and no link of two candidates leaves one of its components.
3. Its edges are counted exactly on the full sets. Where an edge fails, the
   component may fall apart; only there classes outside its largest part are
   counted against all others that the estimate does not rule out, in blocks,
   of which the edges of a spanning forest leave the task.
4. Connected components of the confirmed links.

Joins on bands, leaders and component centres split the keys that many rows
have, so a group of any size is spread over tasks.

Cases: texts without words have no shingles and are linked with nothing;
texts of fewer words than a shingle are one shingle; rows without doc_id are
left out; rows with one doc_id are one node, whatever their texts, each with a
row in the result; equal sets are linked whatever the threshold; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtide.llm.common import balanced_join, discard, kept, saved, small_enough
from roadtide.llm.hashing import mixed, run_hashes, word_hashes

BANDS, MAX_ROWS, BITS = 28, 8, 4
#: Probability at most that a pair at the threshold shares no band.
MISS = 2e-5
#: Classes in a block, and classes of small groups that share a task.
BLOCK, PACK = 256, 1000
#: Standard errors by which the estimate must miss the threshold for a pair to be ruled out.
SIGMAS = 6.0
#: Rows of a doc_id and a hash (16 bytes) that are broadcast at most to fetch texts; beyond it they are joined by a shuffle.
MAX_BROADCAST_ROWS = 200_000
_MULTIPLIERS = mixed(np.arange(1, BANDS * MAX_ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_ONES = sum(1 << i for i in range(0, 64, BITS))


def band_rows(percent: int) -> int:
    """Minima in a band."""
    fits = [r for r in range(1, MAX_ROWS + 1) if (1 - (percent / 100) ** r) ** BANDS <= MISS]
    return max(fits, default=1)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    return np.unique(run_hashes(words, k))


def set_hashes(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a whole set."""
    return tuple(int(x.sum(dtype=np.uint64).astype(np.int64)) for x in (mixed(s), mixed(s ^ np.uint64(0x5555555555555555))))


def minima(shingles: np.ndarray, n: int) -> np.ndarray:
    """The least value of the set under each of n multiplicative permutations."""
    out = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 1024):
        out = np.minimum(out, np.multiply.outer(_MULTIPLIERS[:n], shingles[a : a + 1024]).min(axis=1))
    return out


def packed(least: np.ndarray) -> np.ndarray:
    """BITS bits of each minimum, 64 / BITS to a word."""
    low = mixed(least) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    low = np.concatenate((low, np.zeros(-len(low) % per, np.uint64))).reshape(-1, per)
    return (low << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)


def most_differing(percent: int, n: int) -> int:
    """Minima of n that may differ in their low bits if the similarity is not to be ruled out: the estimate corrects for those that agree by chance."""
    t, chance = percent / 100, 2.0**-BITS
    least = t - SIGMAS * np.sqrt(t * (1 - t) / n)
    return int(n * (1 - chance) * (1 - least))


def differing(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """How many minima differ in their low bits, of a packed signature and each of others."""
    diff = many ^ one
    for s in (1, 2, 4)[: BITS.bit_length() - 1]:
        diff = diff | (diff >> np.uint64(s))
    return np.bitwise_count(diff & np.uint64(_ONES)).sum(axis=-1)


def _differing(a, b) -> F.Column:
    """differing() of two array<bigint> columns."""

    def bits(x, y):
        diff = x.bitwiseXOR(y)
        for s in (1, 2, 4)[: BITS.bit_length() - 1]:
            diff = diff.bitwiseOR(F.shiftrightunsigned(diff, s))
        return F.bit_count(diff.bitwiseAND(F.lit(_ONES)))

    return F.aggregate(F.zip_with(a, b, bits), F.lit(0), lambda acc, x: acc + x)


def features(docs: DataFrame, k: int, rows: int) -> DataFrame:
    """DataFrame[doc_id, n_shingles, h1, h2 (of the whole set), signature array<bigint>, bands array<bigint>]."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, out = batch["doc_id"].to_numpy(), []
            for i, words in word_hashes(list(batch["text"])):
                s = shingle_set(words, k)
                if not len(s):
                    out.append((ids[i], 0, None, None, None, None))
                    continue
                least = minima(s, BANDS * rows)
                bands = np.zeros(BANDS, np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for row in least.reshape(BANDS, rows).T:
                    bands = mixed(bands) + row
                out.append((ids[i], len(s), *set_hashes(s), packed(least).view(np.int64), mixed(bands).view(np.int64)))
            # Columns of their own types: hashes next to a null must not become floats.
            kinds = {"doc_id": "int64", "n_shingles": "int64", "h1": "Int64", "h2": "Int64", "signature": object, "bands": object}
            yield pd.DataFrame({c: pd.Series([r[n] for r in out], dtype=t) for n, (c, t) in enumerate(kinds.items())})

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        run, "doc_id long, n_shingles long, h1 long, h2 long, signature array<long>, bands array<long>"
    )


def components(edges: DataFrame) -> DataFrame:
    """DataFrame[node, component]: the smallest node reachable over edges (a, b), of every node with an edge.

    Alternates large-star and small-star steps, each a min by node and a join that splits the centres of large
    stars, until the stars stand still. Every step's edges are written to the shared folder.
    """
    spark = edges.sparkSession
    edges, path = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before, n = None, edges.count()
    if not n:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = saved(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")), "cc-least")
        large, wide = kept(balanced_join(both, least.drop("n"), ["u"], least.select("u", "n"), 2 * n).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "cc-large")
        down = saved(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "cc-down")
        small = balanced_join(large, down.drop("n"), ["a"], down.select("a", "n"), n).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        (edges, new), old = kept(small.select("e.a", "e.b").where("a <> b").distinct(), "cc"), path
        discard(spark, wide)
        path = new
        discard(spark, old)
        now = tuple(edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        before, n = now, now[0]


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


#: A class is known by its smallest doc_id and a hash of its set, which tells texts of one doc_id apart.
CLASS = ["node", "h1"]
EDGE = "a long, ah1 long, b long, bh1 long"


def paired_blocks(rows: DataFrame, group: str, total: int) -> DataFrame:
    """rows with i, j, pack and side: every group's odd ones (side "left") in blocks against all (side "right") in blocks.

    rows: DataFrame[group, odd boolean, ...]. Groups of a block or less share tasks.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if("odd").alias("odds"))
    placed = balanced_join(rows, sizes.select(group, F.col("n").alias("m"), "odds"), [group], sizes.select(group, "n"), total).withColumn("deal", F.xxhash64(*CLASS))
    lefts, rights = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("odds", "m"))
    own = lambda n: F.pmod(F.col("deal"), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    left = F.transform(F.when(F.col("odd"), every(rights)).otherwise(F.array().cast("array<int>")), lambda j: F.struct(own(lefts).alias("i"), j.alias("j"), F.lit(True).alias("is_left")))
    right = F.transform(every(lefts), lambda i: F.struct(i.alias("i"), own(rights).alias("j"), F.lit(False).alias("is_left")))
    packs = max(1, total // PACK)
    pack = F.when(F.col("m") <= BLOCK, F.pmod(F.xxhash64(group), F.lit(packs))).otherwise(F.col(group))
    return placed.where("odds > 0").withColumn("x", F.explode(F.concat(left, right))).select("*", "x.*", pack.alias("pack"), (F.col("m") > BLOCK).alias("large")).drop("x", "deal", "m", "odds")


def estimated(reps: DataFrame, percent: int, minima_: int) -> DataFrame:
    """DataFrame[a, ah1, b, bh1]: edges over which all candidates are connected that the estimate does not rule out.

    reps: DataFrame[node, h1, n_shingles, signature, bands] of classes.
    """
    most = most_differing(percent, minima_)
    banded = reps.select(*CLASS, F.explode("bands").alias("band"))
    heads = saved(banded.groupBy("band").agg(F.min(F.struct(*CLASS)).alias("first"), F.count("*").alias("n")).where("n > 1"), "minhash-bands")
    counts = heads.select("band", "n")
    ties = saved(balanced_join(banded, heads.select("band", F.col("first.node").alias("b"), F.col("first.h1").alias("bh1")), ["band"], counts).withColumnsRenamed({"node": "a", "h1": "ah1"}), "minhash-ties")
    pairs = saved(ties.where("a <> b or ah1 <> bh1").groupBy("a", "ah1", "b", "bh1").count().drop("count"), "minhash-pairs")
    # Who is head of many is asked for by many: a head's signature goes to several tasks.
    degrees = pairs.groupBy("b", "bh1").agg(F.count("*").alias("n"))
    named = lambda x: reps.select(F.col("node").alias(x), F.col("h1").alias(f"{x}h1"), F.col("n_shingles").alias(f"{x}n"), F.col("signature").alias(f"{x}s"))
    held = balanced_join(pairs.join(named("a"), ["a", "ah1"]), named("b"), ["b", "bh1"], degrees)
    alike = (_differing("as", "bs") <= most) & (F.least("an", "bn") * 100 >= percent * F.greatest("an", "bn"))
    judged = saved(held.select("a", "ah1", "b", "bh1", alike.alias("alike")), "minhash-judged")
    near = judged.where("alike").drop("alike")
    odd = judged.where("not alike").drop("alike").withColumn("odd", F.lit(True))
    if odd.isEmpty():
        return near
    # Bands with classes that their head rules out, whole.
    told = ties.join(odd, ["a", "ah1", "b", "bh1"], "left").select("band", F.col("a").alias("node"), F.col("ah1").alias("h1"), F.coalesce("odd", F.lit(False)).alias("odd"))
    told = saved(told, "minhash-told")
    mixed_ = told.groupBy("band").agg(F.count_if("odd").alias("odds"), F.count("*").alias("n")).where("odds > 0").select("band", "n")
    some = balanced_join(told, mixed_.select("band"), ["band"], mixed_, how="left_semi")
    some = saved(some.join(reps.select(*CLASS, "n_shingles", "signature"), CLASS), "minhash-mixed")

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in rows.groupby("band"):
            left, right = part[part["is_left"]], part[~part["is_left"]]
            if not len(left) or not len(right):
                continue
            sizes, keys = right["n_shingles"].to_numpy(), list(zip(right["node"], right["h1"], strict=True))
            place = {k: i for i, k in enumerate(keys)}
            signatures = np.stack(right["signature"].to_list()).view(np.uint64)
            forest = Forest(len(right) + len(left))
            alike = np.flatnonzero(~right["odd"].to_numpy(bool))  # these are connected over their head
            for b in alike[1:]:
                forest.join(alike[0], b)
            for x, (node, h1, n, signature) in enumerate(zip(left["node"], left["h1"], left["n_shingles"], left["signature"], strict=True)):
                own = place.get((node, h1), len(right) + x)
                may = (differing(np.asarray(signature).view(np.uint64), signatures) <= most) & (np.minimum(n, sizes) * 100 >= percent * np.maximum(n, sizes))
                out += [(node, h1, *keys[b]) for b in np.flatnonzero(may) if b != own and forest.join(own, b)]
        return pd.DataFrame(out, columns=["a", "ah1", "b", "bh1"], dtype="int64")

    blocks = paired_blocks(some, "band", some.count())
    return near.union(blocks.groupBy("large", "pack", "i", "j").applyInPandas(link, EDGE)).distinct()


def shingle_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """DataFrame[node, h1, shingles array<bigint>] of the wanted classes, from the texts."""

    def to_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [shingle_set(words, k) for _, words in word_hashes(list(batch["text"]))]
            # A doc_id may have other texts too: only the text counts whose set it is.
            good = [i for i, (s, h) in enumerate(zip(out, batch["h1"], strict=True)) if len(s) and set_hashes(s)[0] == h]
            yield pd.DataFrame({"node": batch["node"].iloc[good].array, "h1": batch["h1"].iloc[good].array, "shingles": pd.Series([out[i].view(np.int64) for i in good], dtype=object)})

    wanted = F.broadcast(wanted) if small_enough(wanted, MAX_BROADCAST_ROWS) else wanted
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("node"), "text").join(wanted, "node")
    return texts.select(*CLASS, "text").mapInPandas(to_sets, "node long, h1 long, shingles array<long>").dropDuplicates(CLASS)


def block_links(rows: pd.DataFrame, percent: int, most: int) -> list[tuple[int, int]]:
    """A spanning forest of the confirmed links between the left rows and the right rows that are of another part."""
    rows = rows.sort_values(["node", "h1", "is_left"]).reset_index(drop=True)
    sets = list(rows["shingles"])
    sizes = np.array([len(s) for s in sets])
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    left, right = np.flatnonzero(rows["is_left"]), np.flatnonzero(~rows["is_left"])
    if not len(left) or not len(right):
        return []
    of = [local[starts[i] : starts[i + 1]] for i in range(len(sets))]
    right_all, right_starts = np.concatenate([of[i] for i in right]), np.concatenate(([0], np.cumsum(sizes[right])[:-1]))
    signatures = np.stack(rows["signature"].to_list()).view(np.uint64)
    nodes, (parts, label) = rows["node"].to_numpy(), pd.factorize(rows["part"])
    mask, forest, out = np.zeros(local.max() + 1, bool), Forest(len(label)), []
    for a in left:
        may = (differing(signatures[a], signatures[right]) <= most) & (np.minimum(sizes[a], sizes[right]) * 100 >= percent * np.maximum(sizes[a], sizes[right]))
        root = forest.root(parts[a])
        if not any(forest.root(p) != root for p in set(parts[right[may]])):
            continue
        mask[of[a]] = True
        common = np.add.reduceat(mask[right_all], right_starts, dtype=np.int64)
        mask[of[a]] = False
        for b in right[may & (common * 100 >= percent * (sizes[a] + sizes[right] - common))]:
            if forest.join(parts[a], parts[b]):
                out.append((int(nodes[a]), int(nodes[b])))
    return out


def confirmed(docs: DataFrame, reps: DataFrame, near: DataFrame, k: int, percent: int, minima_: int) -> DataFrame:
    """Confirmed links (a, b), enough to connect what is linked, of the graph of candidates."""
    ends = near.select(F.col("a").alias("node"), F.col("ah1").alias("h1")).union(near.select("b", "bh1")).distinct()
    sets = saved(shingle_sets(docs, saved(ends, "minhash-wanted"), k), "minhash-sets")
    named = lambda x: sets.withColumnsRenamed({"node": x, "h1": f"{x}h1", "shingles": f"{x}s"})
    degrees = near.groupBy("b", "bh1").agg(F.count("*").alias("n"))
    both = balanced_join(near.join(named("a"), ["a", "ah1"]), named("b"), ["b", "bh1"], degrees)
    common = F.size(F.array_intersect("as", "bs"))
    edges = saved(both.select("a", "ah1", "b", "bh1", (common * 100 >= percent * (F.size("as") + F.size("bs") - common)).alias("linked")), "minhash-edges")
    sure = edges.where("linked").select("a", "b")
    if edges.where("not linked").isEmpty():
        return sure
    parts = components(sure)
    own = lambda c, name: parts.select(F.col("node").alias(c), F.col("component").alias(name))
    failed = edges.where("not linked").join(own("a", "pa"), "a", "left").join(own("b", "pb"), "b", "left")
    failed = saved(failed.select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b")).where("a <> b"), "minhash-failed")
    if failed.isEmpty():
        return sure
    groups = components(failed).withColumnsRenamed({"node": "part", "component": "group"})
    labelled = saved(ends.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component"), "minhash-parts")
    count_by = lambda df, c: df.groupBy(c).agg(F.count("*").alias("n"))
    inside = saved(balanced_join(labelled, groups, ["part"], count_by(labelled, "part")), "minhash-open")
    # Two classes outside the largest part, or one and one of it, may still be linked.
    largest = inside.groupBy("group", "part").count().groupBy("group").agg(F.max_by("part", F.struct("count", "part")).alias("most"))
    odd = balanced_join(inside, largest, ["group"], count_by(inside, "group")).withColumn("odd", F.col("part") != F.col("most")).drop("most")
    blocks = paired_blocks(saved(odd, "minhash-odd"), "group", inside.count())
    whole = blocks.join(reps.select(*CLASS, "signature"), CLASS).join(sets, CLASS)
    most = most_differing(percent, minima_)

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for _, part in rows.groupby("group"):
            out += block_links(part, percent, most)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return sure.union(whole.groupBy("large", "pack", "i", "j").applyInPandas(link, "a long, b long"))


def near_components(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """DataFrame[doc_id, n_shingles, component_id, kept]: similarity of `percent` or more links; kept is true for the smallest doc_id of a component."""
    rows = band_rows(percent)
    found = saved(features(docs.select("doc_id", "text"), words, rows), "minhash")
    some = found.where("n_shingles > 0")
    one = F.first(F.struct("n_shingles", "signature", "bands")).alias("x")
    reps = saved(some.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), one).select("h1", "h2", "node", "copies", "x.*"), "minhash-classes")
    near = saved(estimated(reps, percent, BANDS * rows), "minhash-near")
    links = confirmed(docs, reps, near, words, percent, BANDS * rows)
    total = some.count()
    classes = reps.select("h1", "h2", "node")
    counts = reps.select("h1", "h2", F.col("copies").alias("n"))
    # A doc_id with several texts ties their classes.
    several = some.groupBy("doc_id").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x <> y").select("doc_id")
    tied = some.select("doc_id", "h1", "h2").join(several, "doc_id", "left_semi").join(classes, ["h1", "h2"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    component = components(links.union(tied))
    of_class = classes.join(component, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component"))
    placed = balanced_join(some.select("doc_id", "n_shingles", "h1", "h2"), of_class, ["h1", "h2"], counts, total)
    empty = found.where("n_shingles = 0").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component"))
    return placed.select("doc_id", "n_shingles", "component").union(empty).select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept")
    )

"""Line dedup: a deletion-neighbourhood join over the lines of all documents.

Two lines match if their edit distance (insert, delete or replace one code
point) is at most 1, white space at either end left aside. A line goes if an
earlier line matches it; earlier is by (doc_id, line number). Lines under
min_chars code points always stay.

1. Equal lines are collapsed to their earliest occurrence by a hash.
2. Lines at distance 1 share their first or last half. Those half hashes,
   tagged with the length they were cut for, are counted; a line that shares
   none has no partner and needs no neighbourhood.
3. Every remaining line emits all its variants with one code point deleted,
   as hashed keys. Lines with an equal variant at the same position differ in
   that code point only, so of such a group everyone is paired with the
   earliest, never with each other; a variant that equals a whole line is an
   insertion. Pairs are verified on the lines themselves: without the code
   point at the place where their variants are equal, they must be equal. That
   is an edit distance of 1, found in one pass; levenshtein() takes time
   quadratic in the length for any bound.
   Lines of LONG code points or more emit no variants: the places where two
   of them may differ are cut into PARTS parts, each with a key of what lies
   before and after it, and only parts in which another line has the same key
   are cut again, down to single places. So such a line costs PARTS keys a
   round and not one for each code point; only where it repeats itself does it
   have near copies at many places.
DataFrame functions only.

Cases: a null text has no lines and stays null; an empty text stays; a
document all of whose lines go has an empty text; documents without doc_id
stay as they are; rows with the same doc_id are one document's, so a line
number's verdict holds for all of them; columns of other names are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtide.llm.common import balanced_join, let, saved, small_enough

#: Lines shorter than this many code points stay.
MIN_CHARS = 20
#: Rows of hashes (three at most, 24 bytes) that are broadcast at most; beyond it they are joined by a shuffle in which common keys are split.
MAX_BROADCAST_ROWS = 200_000
#: Lines of so many code points are compared by stretches of places, shorter ones by all their variants; parts that a stretch is cut into.
LONG, PARTS = 1000, 8
#: Code points in a block of a line whose sides are hashed.
BLOCK = 128

_TRIM = " \t\n\x0b\x0c\r"


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, line_no (from 0), norm, n and two hashes of every line that takes part."""
    return (
        docs.where("doc_id is not null and text is not null")
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .select("doc_id", "line_no", F.btrim("line", F.lit(_TRIM)).alias("norm"))
        .withColumn("n", F.length("norm"))
        .where(F.col("n") >= min_chars)
        .withColumns({"h1": F.xxhash64("norm"), "h2": F.xxhash64(F.lit(7), "norm")})
    )


def _halves(norm, n) -> F.Column:
    """Hashes of the first and last half as cut for a line of n and of n - 1 code points."""
    keys = []
    for a in (n, n - 1):
        half = F.floor(a / 2).cast("int")
        keys += [F.xxhash64(F.lit("first"), a, F.left(norm, half)), F.xxhash64(F.lit("last"), a, F.right(norm, a - half))]
    return F.array(*keys)


def _sides(norm) -> F.Column:
    """Blocks of a line, and for each block a hash of all that lies before it."""
    blocks = F.regexp_extract_all(F.concat(norm, F.lit("\n")), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    before = lambda bs: let(F.transform(bs, lambda x: F.xxhash64(x)), lambda hs: F.transform(hs, lambda _, b: F.xxhash64(F.slice(hs, F.lit(1), b))))
    return let(blocks, lambda bs: F.struct(bs.alias("blocks"), before(bs).alias("before")))


def _head(sides, n) -> F.Column:
    """Hash of the first n code points of the line that _sides() has cut."""
    b = F.floor(n / BLOCK).cast("int")
    return F.xxhash64(F.get(sides["before"], b), F.left(F.get(sides["blocks"], b), n - b * BLOCK))


def _parts(x) -> F.Column:
    """The stretch of places x (struct<t, x, y>) in PARTS parts, or as many as it has places."""
    n = x["y"] - x["x"] + 1
    k = F.least(n, F.lit(PARTS))
    cut = lambda j: (x["x"] + F.floor(j * n.cast("long") / k)).cast("int")
    return F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.struct(x["t"].alias("t"), cut(j).alias("x"), (cut(j + 1) - 1).alias("y")))


def _long_pairs(some: DataFrame, long: int) -> DataFrame:
    """h1, h2, i, e1, e2: lines of `long` code points or more with the earliest line that agrees with them but for the code point at place i (from 1)."""
    texts = some.where(F.col("n") >= long).select("h1", "h2", "first", "n", "norm")
    stretch = lambda t: F.struct(t.alias("t"), F.lit(0).alias("x"), t.alias("y"))
    open_, found = texts.withColumn("open", F.filter(F.array(stretch(F.col("n") - 1), stretch(F.col("n"))), lambda s: s["t"] >= long)), None
    while True:
        keyed = lambda a, z: F.transform(
            F.flatten(F.transform("open", _parts)),
            lambda s: F.struct(s["t"].alias("t"), s["x"].alias("x"), s["y"].alias("y"), F.xxhash64(s["t"], s["x"], s["y"], _head(a, s["x"]), _head(z, s["t"] - s["y"])).alias("at")),
        )
        keys = let(_sides(F.col("norm")), lambda a: let(_sides(F.reverse("norm")), lambda z: keyed(a, z)))
        placed = saved(open_.select("h1", "h2", "first", "n", F.inline(keys)), "line-places")
        # All lines of one length differ from each other alone in what is cut away one code point shorter.
        shared = placed.groupBy("at").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.max(F.col("n") - F.col("t")).alias("deleted"), F.min(F.struct("first", "h1", "h2")).alias("e"), F.count("*").alias("m"))
        shared = saved(shared.where("a <> b and deleted = 1").select("at", F.col("e.h1").alias("e1"), F.col("e.h2").alias("e2"), "m"), "line-stretches")
        alive = placed.join(F.broadcast(shared.drop("m")), "at") if small_enough(shared, MAX_BROADCAST_ROWS) else balanced_join(placed, shared.drop("m"), ["at"], shared.select("at", "m").withColumnRenamed("m", "n"))
        alive = saved(alive.select("h1", "h2", "t", "x", "y", "e1", "e2"), "line-alive")
        done = alive.where("x = y").select("h1", "h2", (F.col("x") + 1).alias("i"), "e1", "e2")
        found = done if found is None else found.union(done)
        more = alive.where("x < y").groupBy("h1", "h2").agg(F.collect_list(F.struct("t", "x", "y")).alias("open"))
        if alive.where("x < y").isEmpty():
            return found
        open_ = texts.join(more, ["h1", "h2"])


def near_dropped(reps: DataFrame, texts: DataFrame, *, long: int = LONG) -> DataFrame:
    """h1, h2 of the distinct lines with an earlier line at distance 1.

    reps: DataFrame[h1, h2, first, copies, k1..k4] of distinct lines; texts: DataFrame[h1, h2, norm, n], which may repeat lines.
    """
    keys = reps.select("h1", "h2", "copies", F.posexplode(F.array("k1", "k2", "k3", "k4")).alias("side", "k"))
    shared = saved(keys.groupBy("k").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.count("*").alias("n")).where("a <> b").select("k", "n"), "line-halves")
    some = balanced_join(keys, shared.select("k"), ["k"], shared, 4 * reps.count(), "left_semi")
    sides = some.groupBy("h1", "h2").agg(F.max("copies").alias("copies"), F.max(F.col("side") % 2 == 0).alias("by_first"), F.max(F.col("side") % 2 == 1).alias("by_last"))
    some = saved(sides, "line-survivors")
    if small_enough(some, MAX_BROADCAST_ROWS):
        have = texts.join(F.broadcast(some.select("h1", "h2")), ["h1", "h2"], "left_semi")
    else:
        have = balanced_join(texts.withColumn("deal", F.monotonically_increasing_id()), some.select("h1", "h2"), ["h1", "h2"], some.select("h1", "h2", F.col("copies").alias("n")), how="left_semi")
    have = have.groupBy("h1", "h2").agg(F.first("norm").alias("norm"), F.first("n").alias("n"))
    some = saved(have.join(reps.select("h1", "h2", "first"), ["h1", "h2"]).join(some.drop("copies"), ["h1", "h2"]), "line-texts")
    few = small_enough(some, MAX_BROADCAST_ROWS)

    # What shares its first half differs in the last, and the other way round.
    start = F.when(F.col("by_last"), F.lit(1)).otherwise(F.floor((F.col("n") - 1) / 2).cast("int") + 1)
    stop = F.when(F.col("by_first"), F.col("n")).otherwise(F.floor((F.col("n") + 1) / 2).cast("int"))
    without = lambda i: F.xxhash64(F.concat(F.left("norm", i - 1), F.substr("norm", i + 1)))
    variants = some.where(F.col("n") <= long).select("h1", "h2", "first", F.explode(F.transform(F.sequence(start, stop), lambda i: F.struct(i.alias("i"), without(i).alias("v")))).alias("x"))
    variants = variants.select("h1", "h2", "first", "x.i", "x.v", F.xxhash64("x.i", "x.v").alias("at"))
    # Replaced: of the lines with one variant at one place, all match the earliest.
    placed = variants.drop("v")
    common = saved(placed.groupBy("at").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("at"), "line-variants")
    grouped = placed.join(F.broadcast(common) if small_enough(common, MAX_BROADCAST_ROWS) else common, "at").select("at", "h1", "h2", "first", "i")
    earliest = grouped.groupBy("at").agg(F.min(F.struct("first", "h1", "h2")).alias("e"))
    replaced = grouped.join(earliest, "at").select("h1", "h2", "i", F.col("e.h1").alias("e1"), F.col("e.h2").alias("e2"))
    # Inserted: a variant is a whole other line.
    whole = some.select(F.col("h1").alias("v"), F.col("h1").alias("e1"), F.col("h2").alias("e2"))
    inserted = variants.select("h1", "h2", "i", "v").join(F.broadcast(whole) if few else whole, "v").select("h1", "h2", "i", "e1", "e2")
    pairs = replaced.union(inserted).union(_long_pairs(some, long)).where("h1 <> e1 or h2 <> e2").groupBy("h1", "h2", "e1", "e2").agg(F.min("i").alias("i"))
    a = some.select("h1", "h2", F.col("norm").alias("na"), F.col("first").alias("fa"))
    b = some.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("norm").alias("nb"), F.col("first").alias("fb"))
    cut = lambda c: F.concat(F.left(c, F.col("i") - 1), F.substr(c, F.col("i") + 1))
    na, nb, longer = F.col("na"), F.col("nb"), F.length("na") - F.length("nb")
    alike = F.when(longer == 0, cut(na) == cut(nb)).when(longer > 0, cut(na) == nb).otherwise(na == cut(nb))
    verified = pairs.join(a, ["h1", "h2"]).join(b, ["e1", "e2"]).where(alike)
    later = F.when(F.col("fa") > F.col("fb"), F.struct("h1", "h2")).otherwise(F.struct(F.col("e1").alias("h1"), F.col("e2").alias("h2")))
    return verified.select(later.alias("d")).select("d.h1", "d.h2").distinct()


def dropped_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, long: int = LONG) -> DataFrame:
    """DataFrame[doc_id, drop array<int>]: ascending numbers of the lines that go, of documents that have such lines."""
    docs = docs.select("doc_id", "text")
    lines = _lines(docs, min_chars)
    keyed = lines.withColumn("k", _halves(F.col("norm"), F.col("n")))
    reps = keyed.groupBy("h1", "h2").agg(
        F.min(F.struct("doc_id", "line_no")).alias("first"),
        F.count("*").alias("copies"),
        *(F.max(F.col("k")[i]).alias(f"k{i + 1}") for i in range(4)),
    )
    reps = saved(reps, "line-reps")
    near = saved(near_dropped(reps, lines.select("h1", "h2", "norm", "n"), long=long), "line-near").withColumn("near", F.lit(True))
    marked = reps.select("h1", "h2", "first", "copies").join(near, ["h1", "h2"], "left").where("near or copies > 1")
    places = lines.select("doc_id", "line_no", "h1", "h2")
    return (
        balanced_join(places, marked.drop("copies"), ["h1", "h2"], reps.where("copies > 1").select("h1", "h2", F.col("copies").alias("n")))
        .where("near or doc_id <> first.doc_id or line_no <> first.line_no")
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_set("line_no")).alias("drop"))
    )


def line_dedup(docs: DataFrame, *, min_chars: int = MIN_CHARS, names: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with the lines that go taken out of text, and the number of lines and of those that went (int) under these names after its columns, in place of any of the same name."""
    drops = dropped_lines(docs, min_chars=min_chars).withColumnsRenamed({"doc_id": "__line_doc", "drop": "__line_drop"})
    lines = F.split("text", "\n")
    # The stretches between the lines that go.
    between = lambda ls: F.zip_with(
        F.concat(F.array(F.lit(-1)), "__line_drop"), F.concat("__line_drop", F.array(F.size(ls))), lambda a, b: F.slice(ls, a + 2, b - a - 1)
    )
    kept = let(lines, lambda ls: F.array_join(F.flatten(between(ls)), "\n"))
    return docs.join(drops, F.col("doc_id") == F.col("__line_doc"), "left").select(
        *(F.when(F.col("__line_drop").isNull(), F.col(c)).otherwise(kept).alias(c) if c == "text" else F.col(c) for c in docs.columns if c not in names),
        F.coalesce(F.size(lines), F.lit(0)).alias(names[0]),
        F.coalesce(F.size("__line_drop"), F.lit(0)).alias(names[1]),
    )

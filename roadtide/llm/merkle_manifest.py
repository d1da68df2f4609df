"""Merkle manifest of a dataset: a tree of hashes in every group, one over the groups, and a recursive climb that proves each row.

Rows are hashed where they lie, so texts never move. The hashes are ranged by (group, key), which gives each its place in its group
from counts of the ranges; a group of any size is spread over as many tasks as its rows need. The tree is built bottom up, three
levels at a time, and stored as blocks: the hashes of up to 27 nodes and of the two levels over them, with the hash that comes out
and the link to the block above. A recursive query then ascends from every leaf, appends the siblings that it meets, and folds the
hash that the leaf has now. Spark shuffles all rows in each round of a recursion, so blocks make three levels one round, and above
the level at which few blocks are left, siblings are gathered once for each place in these, while the leaves carry their hash alone.

Cases: a null value is hashed as a value of its own; a null group is a group and comes first; rows without key come first in their
group; rows that share a key are ordered by hash, equal ones are leaves of their own; a group of one row is its own subroot, an only
group's subroot is the root; an empty table has no leaf and no root. Columns that are not hashed don't count, whatever their names.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadtide.llm.common import saved, shared_dir, small_enough

#: Children of a node.
ARITY = 3
#: Levels of a block.
HEIGHT = 3
WIDTH = ARITY**HEIGHT
#: Blocks of the upper levels that are broadcast to the climb, below which joins shuffle, and rows of the table of cuts.
MAX_UPPER, MAX_CUTS = 500, 20_000
#: Number of the tree over the groups.
TOP = -1


@dataclass(frozen=True)
class Manifest:
    """leaves: at (long, unique), the rows' own columns, and the link to the first block (tree, level, block, place; null for an only leaf).
    blocks: tree, level, block, levels (arrays of hashes, lowest first), hash, and the link p_tree, p_level, p_block, place (null for the root).
    sizes: blocks at each level, lowest first; first_top: level of the lowest blocks of the tree over the groups, which lies above all others.
    """

    leaves: DataFrame
    blocks: DataFrame
    root: str | None
    sizes: list[int]
    first_top: int


def leaf_hash(*values) -> F.Column:
    """Lowercase hex SHA-256 of the values, each as `-` if null, else its length in bytes, a colon and itself."""
    texts = [F.col(v).cast("string") if isinstance(v, str) else v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with at (unique), tree (number of the group, null first), pos (place in the group) and size (rows of the group)."""
    by = [F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order)]
    salted = rows.withColumn("__salt", F.monotonically_increasing_id())  # equal rows can be cut between ranges
    ranged = salted.repartitionByRange(*by, "__salt").sortWithinPartitions(*by, "__salt").drop("__salt").withColumn("at", F.monotonically_increasing_id())
    ranged = saved(ranged, "merkle-leaves").withColumn("__range", F.shiftright("at", 33)).withColumn("__group", F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("-")))
    of_group = Window.partitionBy("__group")
    cuts = ranged.groupBy("__range", "__group").agg(F.min("at").alias("__first"), F.count("*").alias("__n"))
    cuts = cuts.select(
        "*", F.sum("__n").over(of_group).alias("size"), (F.sum("__n").over(of_group.orderBy("__range")) - F.col("__n")).alias("__before"),
        (F.col("__range") == F.min("__range").over(of_group)).cast("int").alias("__starts"),
    )
    cuts = saved(cuts.withColumn("__nth", F.sum("__starts").over(Window.partitionBy("__range").orderBy("__first"))), "merkle-cuts")
    ranges = cuts.groupBy("__range").agg(F.sum("__starts").alias("__groups"))  # a row for each task of the sort
    ranges = ranges.select("__range", (F.sum("__groups").over(Window.orderBy("__range")) - F.col("__groups")).alias("__prior"))
    number = F.max(F.when(F.col("__starts") == 1, F.col("__prior") + F.col("__nth") - 1)).over(of_group).alias("tree")
    cuts = saved(cuts.join(F.broadcast(ranges), "__range").select("__range", "__group", "__first", "__before", "size", number), "merkle-cuts")
    joined = ranged.join(F.broadcast(cuts) if small_enough(cuts, MAX_CUTS) else cuts, ["__range", "__group"])
    return joined.withColumn("pos", F.col("at") - F.col("__first") + F.col("__before")).drop("__range", "__group", "__first", "__before")


def _above(hashes) -> F.Column:
    """Hashes of the nodes over these: one for each run of ARITY."""
    run = lambda i: F.slice(hashes, i * ARITY + 1, ARITY)
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / ARITY).cast("int")), lambda i: F.sha2(F.array_join(run(i), ""), 256))


def _levels(nodes: DataFrame, path: str, most: int, below: int = 0) -> tuple[DataFrame | None, list[int]]:
    """Blocks over nodes (tree, n, pos, hash), n the nodes of the tree and most the largest n, until each tree has one node; their levels begin above below."""
    spark, k, sizes = nodes.sparkSession, below, []
    while most > 1:
        k, most = k + 1, -(-most // WIDTH)
        kids = F.array_sort(F.collect_list(F.struct((F.col("pos") % WIDTH).alias("i"), "hash")))["hash"]
        blocks = nodes.where("n > 1").groupBy("tree", "n", F.floor(F.col("pos") / WIDTH).alias("block")).agg(kids.alias("l0"))
        for j in range(1, HEIGHT + 1):  # a level more as long as the tree has several nodes
            blocks = blocks.withColumn(f"l{j}", F.when(F.col("n") > ARITY ** (j - 1), _above(F.col(f"l{j - 1}"))))
        done = [F.col(f"l{j}") for j in range(HEIGHT + 1)]
        levels = F.slice(F.filter(F.array(*done), lambda x: x.isNotNull()), F.lit(1), F.size(F.filter(F.array(*done), lambda x: x.isNotNull())) - 1)
        blocks = blocks.select("tree", F.lit(k).alias("level"), "block", F.ceil(F.col("n") / WIDTH).alias("n"), levels.alias("levels"), F.coalesce(*reversed(done))[0].alias("hash"))
        blocks.write.parquet(f"{path}/level={k}")
        level = spark.read.parquet(f"{path}/level={k}")
        sizes.append(level.count())
        nodes = level.select("tree", "n", F.col("block").alias("pos"), "hash")
    return (spark.read.parquet(*(f"{path}/level={i}" for i in range(below + 1, k + 1))) if sizes else None), sizes


def build(rows: DataFrame, group: str, order: list[str], hashed: str = "leaf") -> Manifest:
    """The manifest of rows whose hashes are in the column hashed; in each group leaves ascend by order, then by hash."""
    spark, path = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/merkle-{uuid.uuid4().hex}"
    leaves = numbered(rows, group, [*order, hashed])
    most, groups = leaves.agg(F.coalesce(F.max("size"), F.lit(0)), F.coalesce(F.max("tree") + 1, F.lit(0))).first()
    inner, sizes = _levels(leaves.select("tree", F.col("size").alias("n"), "pos", F.col(hashed).alias("hash")), f"{path}/inner", most)
    single = leaves.where("size = 1").select("tree", F.col(hashed).alias("hash"))
    subroots = single if inner is None else single.union(inner.where("n = 1").select("tree", "hash"))
    over = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(groups).cast("long").alias("n"), F.col("tree").alias("pos"), "hash")
    top, more = _levels(over, f"{path}/top", groups, len(sizes))
    first_top = len(sizes) + 1
    whole = top.where("n = 1") if top is not None else subroots
    root = whole.select("hash").first() if groups else None
    parts = [x for x in (inner, top) if x is not None]
    empty = "tree long, level int, block long, n long, levels array<array<string>>, hash string"
    blocks = parts[0].unionByName(parts[-1]) if len(parts) > 1 else parts[0] if parts else spark.createDataFrame([], empty)
    up = _link(F.col("tree"), F.col("level") + 1, F.col("block"), F.col("n"), groups, first_top)
    links = (F.col("up.tree").alias("p_tree"), F.col("up.level").alias("p_level"), F.col("up.block").alias("p_block"), "up.place")
    blocks = blocks.withColumn("up", up).select("tree", "level", "block", "levels", "hash", *links)
    link = _link(F.col("tree"), F.lit(1), F.col("pos"), F.col("size"), groups, first_top)
    leaves = leaves.select("at", *rows.columns, link.alias("__up")).select("at", *rows.columns, *(F.col(f"__up.{c}").alias(c) for c in LINK))
    return Manifest(leaves, blocks, root and root[0], [*sizes, *more], first_top)


#: What leads to a block, and to a place in its lowest level.
LINK = ("tree", "level", "block", "place")


def _link(tree, level, pos, n, groups: int, first_top: int) -> F.Column:
    """The block above the node at pos of n on its level, and the node's place there; null above the root."""

    def to(t, k, p) -> F.Column:
        return F.struct(t.cast("long").alias("tree"), k.cast("int").alias("level"), F.floor(p / WIDTH).alias("block"), (p % WIDTH).cast("int").alias("place"))

    above = F.when((tree != TOP) & F.lit(groups > 1), to(F.lit(TOP), F.lit(first_top), tree))
    return F.when(n > 1, to(tree, level, pos)).otherwise(above)


@contextlib.contextmanager
def _recursion(spark: SparkSession, broadcast: bool) -> Iterator[None]:
    """Recursive queries with any number of rows. A hint does not reach their rounds, so broadcast raises the size up to which a table is."""
    wanted = {"spark.sql.cteRecursionRowLimit": "-1"} | ({"spark.sql.autoBroadcastJoinThreshold": "64m"} if broadcast else {})
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


#: A round of the climb: up through the levels of a block, with the siblings of each appended (if asked for) and the hash folded.
CLIMB = """
WITH RECURSIVE climb AS (
  SELECT * FROM {start}
  UNION ALL
  SELECT {carried} unhex(up.folded) AS folded, {proofs} tree, level, block, place
  FROM (
    SELECT {carried} {before} b.tree = -1 AND b.level = {first_top} AS of_top, b.levels[0][c.place] AS lowest, b.p_tree AS tree, b.p_level AS level, b.p_block AS block, b.place,
           aggregate(b.levels, named_struct('folded', lower(hex(c.folded)), 'place', c.place, 'proof', ''), (s, hashes) -> named_struct(
             'folded', sha2(array_join(transform(slice(hashes, s.place - s.place % {arity} + 1, {arity}), (h, i) -> if(i = s.place % {arity}, s.folded, h)), ''), 256),
             'place', CAST(s.place DIV {arity} AS INT),
             'proof', concat(s.proof, array_join(filter(slice(hashes, s.place - s.place % {arity} + 1, {arity}), (h, i) -> i <> s.place % {arity}), '')))) AS up
    FROM climb c JOIN {blocks} b ON c.tree = b.tree AND c.level = b.level AND c.block = b.block))
SELECT * FROM climb WHERE tree IS NULL{over}
"""
PROOFS = "concat(proof, unhex(up.proof)) AS proof, if(of_top, unhex(lowest), subroot) AS subroot,"


def _ascend(rows: DataFrame, manifest: Manifest, part: DataFrame, keep: list[str], *, proofs: bool, last: int | None) -> DataFrame:
    """rows (keep, folded, proof and subroot if asked for, LINK) after their climb through the blocks of part: all up to level last, or to the root."""
    spark = rows.sparkSession
    views = {"start": f"start_{uuid.uuid4().hex}", "blocks": f"blocks_{uuid.uuid4().hex}"}
    rows.createOrReplaceTempView(views["start"])
    part.createOrReplaceTempView(views["blocks"])
    sql = CLIMB.format(
        carried="".join(f"`{c}`, " for c in keep), arity=ARITY, first_top=manifest.first_top, proofs=PROOFS * proofs, before="c.proof, c.subroot," * proofs,
        over="" if last is None else f" OR level > {last}", **views,
    )
    with _recursion(spark, last is None):
        done = saved(spark.sql(sql), "merkle-climb")
    for view in views.values():
        spark.catalog.dropTempView(view)
    return done


def climb(manifest: Manifest, hashed: str, keep: list[str], max_upper: int = MAX_UPPER) -> DataFrame:
    """Every leaf's keep columns, and binary: folded (the root that its column hashed gives), proof (the siblings' hashes), subroot (null: the root).

    The levels with at most max_upper blocks from the root down are the upper ones, and broadcast. Through those below the
    leaves climb by shuffle joins, where a block has too few leaves below it to be a heavy key. What a place in an upper
    block adds to a proof is the same for all leaves that come by it, so it is gathered by a climb from these places.
    """
    sizes = manifest.sizes
    low = next((k for k in range(len(sizes) + 1) if sum(sizes[k:]) <= max_upper), len(sizes))
    level, empty, none = F.col("level"), F.unhex(F.lit("")), F.lit(None).cast("binary")
    rows = manifest.leaves.select("at", *keep, F.unhex(hashed).alias("folded"), empty.alias("proof"), none.alias("subroot"), *LINK)
    if low:
        rows = _ascend(rows, manifest, manifest.blocks.where(level <= low), ["at", *keep], proofs=True, last=low)
    upper = saved(manifest.blocks.where(level > low), "merkle-upper")
    places = upper.select("tree", "level", "block", F.posexplode(F.col("levels")[0]).alias("place", "hash")).withColumns({f"from_{c}": F.col(c) for c in LINK})
    starts = [f"from_{c}" for c in LINK]
    by_place = _ascend(places.select(*starts, F.unhex("hash").alias("folded"), empty.alias("proof"), none.alias("subroot"), *LINK), manifest, upper, starts, proofs=True, last=None)
    folded = _ascend(rows.select("at", "folded", *LINK), manifest, upper, ["at"], proofs=False, last=None).select("at", F.col("folded").alias("__folded"))
    more = by_place.select(*(F.col(f"from_{c}").alias(c) for c in LINK), F.col("proof").alias("__proof"), F.col("subroot").alias("__subroot"))
    joined = rows.join(folded, "at").join(F.broadcast(more), list(LINK), "left")
    proof = F.concat("proof", F.coalesce("__proof", empty))
    return joined.select(*keep, F.col("__folded").alias("folded"), proof.alias("proof"), F.coalesce("subroot", "__subroot").alias("subroot"))


def verify(docs: DataFrame, group: str, key: str, columns: list[str], tampered: dict[str, F.Column]) -> DataFrame:
    """Manifest of docs over the hash of columns, climbed with the hashes that the rows have once tampered replaces columns of theirs.

    Returns key, leaf, subroot, root, proof_sha256 (all of the original), folded_root (of the rows as they are now) and verified.
    """
    now = leaf_hash(*(tampered.get(c, F.col(c)) for c in columns))
    rows = docs.select(F.col(key).alias("key"), F.col(group).alias("group"), leaf_hash(*columns).alias("leaf"), now.alias("now"))
    manifest = build(rows, "group", ["key"])
    manifest = replace(manifest, leaves=manifest.leaves.withColumn("own", F.unhex("leaf")))
    done = climb(manifest, "now", ["key", "own"])
    root, folded = F.lit(manifest.root), F.lower(F.hex("folded"))
    return done.select(
        F.col("key").alias(key), F.lower(F.hex("own")).alias("leaf"), F.coalesce(F.lower(F.hex("subroot")), root).alias("subroot"), root.alias("root"),
        F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"), folded.alias("folded_root"), (folded == root).alias("verified"),
    )

"""Trie of shared conversation prefixes, built from sorted shards and a broadcast skeleton.

A conversation is the path of its turns, 16 bytes of digest a turn. Paths are dealt to shards by splitters, so each shard has a range
of (path, conversation), and copies of one path can be cut between shards too. A node whose members lie in several shards is a prefix
of a splitter: the trie of the splitter paths, the skeleton, is broadcast. Every shard reads its sorted paths once, keeps a stack of
open nodes, and finishes those that are not in the skeleton; of skeleton nodes it gives partial counts, which are summed by node and
then added up along the skeleton. A second sorted read gives each node the smallest member of its parent.

Cases: a null conversation takes no part; a null turn comes first, null roles and texts are empty; turns with equal numbers are
ordered by digest; repeated rows are turns of their own; an empty table has no node, not even the root; other columns don't count.
A path lies in one row, so a conversation can have tens of millions of turns, not any number.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadtide.llm.common import saved, words

#: Bytes of a turn in a path.
TOKEN = 16
#: Paths a shard that are sampled for the splitters, and bytes of paths that the sample has at most, roughly.
SAMPLE, SAMPLE_BYTES = 16, 32_000_000
#: Nodes of the skeleton at most; beyond it there are fewer splitters.
MAX_SKELETON = 200_000
#: Members whose ids one row of an end list holds.
CHUNK = 4096
#: Rows of a batch that a task gives.
BATCH = 8192

NODE = "kind int, shard int, pre long, depth long, up long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends string"
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
LOCAL, PARTIAL, ENDS = 0, 1, 2


def token(role, text) -> F.Column:
    """Digest of a turn, 32 hex digits; null is as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TOKEN)


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, and the array of its turns (token, words) in order."""
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", token(F.col("role"), F.col("text")).alias("token"), F.size(words(F.col("text"))).alias("words"))
    in_order = F.sort_array(F.collect_list(F.struct("turn", "token", "words")))
    return rows.groupBy("conv_id").agg(F.transform(in_order, lambda t: F.struct(t["token"], t["words"])).alias("turns"))


def with_shared_heads(own: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of c - c % every, h = crc32 of c in decimal, modulo most + 1."""
    base = F.col("conv_id") - F.col("conv_id") % every
    heads = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("__base"), F.slice("turns", 1, most).alias("__head"))
    joined = own.withColumn("__base", base).join(heads, "__base", "left")
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    head = F.slice(F.coalesce("__head", F.slice("turns", 1, 0)), F.lit(1), h)
    return joined.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


@dataclass(frozen=True)
class Skeleton:
    """splitters: sorted (path, conversation); kids: (node, token) to node; up: each node's parent, -1 for the root, which is node 0."""

    splitters: list[tuple[bytes, int]]
    kids: dict[tuple[int, bytes], int]
    up: list[int]


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // TOKEN
    different = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return (n - (different.bit_length() + 7) // 8) // TOKEN


def skeleton(sample: list[tuple[bytes, int]], shards: int, most: int = MAX_SKELETON) -> Skeleton:
    """Splitters at even distances in the sorted sample, each cut behind the first turn that tells it from the path before it."""
    step = max(1, -(-len(sample) // shards))
    splitters = []
    for i in range(step, len(sample), step):
        (before, _), (path, conv) = sample[i - 1], sample[i]
        same = before == path
        splitters.append((path, conv) if same else (path[: (_shared(before, path) + 1) * TOKEN], -(2**63)))
    while True:
        kids, up = {}, [-1]
        for path, _ in splitters:
            node = 0
            for i in range(0, len(path), TOKEN):
                key = (node, path[i : i + TOKEN])
                if key not in kids:
                    kids[key] = len(up)
                    up.append(node)
                node = kids[key]
        if len(up) <= most:
            return Skeleton(splitters, kids, up)
        splitters = splitters[1::2]


class _Rows:
    """Rows collected for a batch."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows = schema, []

    def add(self, *row) -> None:
        self.rows.append(row)

    def batches(self, least: int) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            columns = list(zip(*self.rows, strict=True)) or [[] for _ in self.schema]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
            self.rows = []


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


class _Open:
    """A node whose members are being read."""

    __slots__ = ("pre", "known", "words", "conv", "n", "children", "leaves", "saved", "ends", "chunk")

    def __init__(self, pre: int, known: int, words: int):
        self.pre, self.known, self.words = pre, known, words
        self.conv, self.n, self.children, self.leaves, self.saved = 2**63 - 1, 0, 0, 0, 0
        self.ends, self.chunk = None, []

    def end(self, conv: int, out: _Rows, shard: int) -> None:
        self.conv, self.n = min(self.conv, conv), self.n + 1
        if self.known < 0:
            if self.ends is None:
                self.ends = hashlib.sha256(str(conv).encode())
            else:
                self.ends.update(f",{conv}".encode())
            return
        self.chunk.append(conv)
        if len(self.chunk) == CHUNK:
            self.flush(out, shard)

    def flush(self, out: _Rows, shard: int) -> None:
        if self.chunk:
            out.add(ENDS, shard, self.chunk[0], 0, self.known, None, None, None, None, None, None, ",".join(map(str, self.chunk)))
            self.chunk = []


def _local(bones: Skeleton):
    """Reads shards of sorted paths; gives finished local nodes, partial skeleton nodes, and the ids that end at skeleton nodes."""
    schema = _arrow(NODE)

    def close(stack: list[_Open], out: _Rows, shard: int) -> None:
        node, depth = stack.pop(), len(stack)
        above = stack[-1] if stack else None
        if above is not None:
            above.conv, above.n = min(above.conv, node.conv), above.n + node.n
        if node.known >= 0:
            node.flush(out, shard)
            out.add(PARTIAL, shard, node.pre, depth, node.known, node.conv, node.n, node.children, node.leaves, node.saved, node.words, None)
            return
        node.leaves, node.saved = node.leaves if node.children else 1, node.saved + (node.n - 1) * node.words
        above.children, above.leaves, above.saved = above.children + 1, above.leaves + node.leaves, above.saved + node.saved
        ends = (node.ends or hashlib.sha256()).hexdigest()
        out.add(LOCAL, shard, node.pre, depth, above.known, node.conv, node.n, node.children, node.leaves, node.saved, node.words, ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, stack, last, at, pre = _Rows(schema), [], b"", None, 0
        for batch in batches:
            for shard, path, lengths, conv in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "words", "conv_id")), strict=True):
                if shard != at:
                    while stack:
                        close(stack, out, at)
                    stack, last, at, pre = [_Open(0, 0, 0)], b"", shard, 1
                keep = _shared(last, path)
                while len(stack) > keep + 1:
                    close(stack, out, at)
                for d in range(keep, len(path) // TOKEN):
                    known = bones.kids.get((stack[-1].known, path[d * TOKEN : (d + 1) * TOKEN]), -1)
                    stack.append(_Open(pre, known, lengths[d]))
                    pre += 1
                stack[-1].end(conv, out, at)
                last = path
                yield from out.batches(BATCH)
        while stack:
            close(stack, out, at)
            yield from out.batches(BATCH)
        yield from out.batches(1)

    return run


def _parents(known: list[int]):
    """Reads a shard's local nodes, parents first; known: the smallest member of each skeleton node."""
    schema = _arrow(NODES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, open_ = _Rows(schema), {}
        for batch in batches:
            rows = batch.to_pydict()
            for depth, up, conv, *rest in zip(*(rows[c] for c in ("depth", "up", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")), strict=True):
                open_[depth] = conv
                out.add(conv, depth, known[up] if up >= 0 else open_[depth - 1], *rest)
                yield from out.batches(BATCH)
        yield from out.batches(1)

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of every skeleton node's joined ids, read in order."""
    at, digest, out = None, None, _Rows(_arrow("up long, ends string"))
    for batch in batches:
        for up, ids in zip(batch.column("up").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if up != at:
                if digest is not None:
                    out.add(at, digest.hexdigest())
                at, digest = up, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if digest is not None:
        out.add(at, digest.hexdigest())
    yield from out.batches(1)


def _dealt(bones: Skeleton):
    """Adds each path's shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = [bisect.bisect_right(bones.splitters, key) for key in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True)]
            yield batch.append_column("shard", pa.array(shard, pa.int32()))

    return run


def trie(conversations: DataFrame) -> DataFrame:
    """DataFrame[conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256]: a row for every node.

    conversations: conv_id and its turns (token, words), as paths() gives them. conv_id is the smallest member, parent_conv_id the
    parent's; saved_tokens are the words that the members of the subtree share; ends_sha256 is over the members that end there.
    """
    spark: SparkSession = conversations.sparkSession
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["token"]), "")).alias("path")
    rows = saved(conversations.select("conv_id", path, F.transform("turns", lambda t: t["words"]).alias("words")), "trie-paths")
    n, size = rows.agg(F.count("*"), F.coalesce(F.avg(F.length("path")), F.lit(0.0))).first()
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(SAMPLE * shards, SAMPLE_BYTES / (size + 64))
    drawn = rows.where(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 40)) < int(min(1.0, wanted / max(n, 1)) * (1 << 40)))
    bones = skeleton(sorted((bytes(r.path), r.conv_id) for r in drawn.select("path", "conv_id").toLocalIterator()), shards)
    count = len(bones.splitters) + 1
    dealt = rows.mapInArrow(_dealt(bones), "conv_id long, path binary, words array<int>, shard int")
    ordered = dealt.repartitionById(count, "shard").sortWithinPartitions("shard", "path", "conv_id")
    found = saved(ordered.mapInArrow(_local(bones), NODE), "trie-nodes")

    sums = found.where(F.col("kind") == PARTIAL).groupBy("up").agg(F.min("conv_id"), F.sum("n_convs"), F.sum("n_children"), F.sum("n_leaves"), F.sum("saved_tokens"), F.max("words"), F.max("depth"))
    parts = {r[0]: list(r[1:]) for r in sums.collect()}
    ends = found.where(F.col("kind") == ENDS).select("up", "pre", "ends").repartition("up").sortWithinPartitions("up", "pre").select("up", "ends")
    digests = {r.up: r.ends for r in ends.mapInArrow(_digests, "up long, ends string").collect()}
    nodes = []
    for node in sorted(parts, reverse=True):  # children have larger numbers
        conv, members, children, leaves, kept, length, depth = parts[node]
        leaves, kept, above = leaves if children else 1, kept + (members - 1) * length, bones.up[node]
        if above >= 0:
            upper = parts[above]
            upper[2], upper[3], upper[4] = upper[2] + 1, upper[3] + leaves, upper[4] + kept
        nodes.append((conv, depth, parts[above][0] if above >= 0 else None, members, children, leaves, kept, digests.get(node, hashlib.sha256().hexdigest())))
    known = [parts[i][0] if i in parts else 0 for i in range(len(bones.up))]
    local = found.where(F.col("kind") == LOCAL).repartitionById(count, "shard").sortWithinPartitions("shard", "pre").drop("kind", "shard", "pre", "words")
    return local.mapInArrow(_parents(known), NODES).union(spark.createDataFrame(nodes, NODES))

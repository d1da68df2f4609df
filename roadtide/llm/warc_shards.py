"""WARC: a deterministic sharded writer, and a reader.

Shards are consecutive ranges of page_id of about SHARD_BYTES payload each (at
most MAX_SHARDS; beyond it they are larger). Their borders are quantiles of
page_id weighted by payload bytes, over the ids whose hash picks them, about
MAX_SAMPLE at most; so they follow from the data alone, and gaps between ids
don't matter. Within a shard records are sorted by page_id, each is a
gzip member of its own, and files are rolled once they reach a compressed
size. A file is written under a temporary name and renamed; its name and
bytes depend on the shard only, so a task that runs again replaces it by the
same file. The manifest, a folder with a JSON line a file, is committed when all are
written; the reader trusts nothing that it does not name.

Records with equal payloads of at least MIN_REVISIT bytes: the smallest
page_id is the response, the others are revisits of it.

Every row has a record. Cases: a null html is an empty payload; a null url is
an empty one; rows without page_id are responses, dealt over the shards by a
hash; of rows with one page_id each has a record, which differ in their ids,
and a payload's smallest page_id is not a revisit of itself; payloads under
the limit are always responses; an empty table gives a manifest without
files; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadtide.llm.common import balanced_join, saved, shared_dir

#: Payload bytes of a shard, compressed bytes at which a file is rolled, least payload of a revisit.
SHARD_BYTES, ROLL_BYTES, MIN_REVISIT = 16_000_000, 4_000_000, 100
#: Shards at most, and ids on average at most that their borders are taken from.
MAX_SHARDS, MAX_SAMPLE = 16_384, 1 << 17
#: Bytes of a file that are unpacked at once.
READ = 1 << 14
#: Payload bytes in a batch of the reader, and tasks that read at most.
BATCH, MAX_READERS = 16_000_000, 50_000
#: Header date of every record: the writer keeps no clock, so that equal input gives equal bytes.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "manifest"


def _gzip(data: bytes) -> bytes:
    """One gzip member without time stamp or name."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record(page_id: int | None, copy: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response or revisit record with its headers and digests. copy: number among records of one page_id and payload."""
    url = "".join((url or "").split())
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    name = lambda i, n: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}:{digest}:{n}')}>"
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id, copy)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}", *([] if page_id is None else [f"WARC-Page-ID: {page_id}"]), f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([] if refers_to is None else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to, 0)}", f"WARC-Refers-To-Page-ID: {refers_to}"]),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def put(uri: str, data: bytes) -> None:
    """Write a file under a temporary name of its own, then rename it."""
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(temporary, compression=None) as f:
        f.write(data)
    store.move(temporary, path)


class ShardWriter:
    """Writes the records of one shard, in order, to rolled files."""

    def __init__(self, out: str, shard: int, roll_bytes: int):
        self.out, self.shard, self.roll_bytes, self.part, self.rows = out, shard, roll_bytes, 0, []
        self.members: list[bytes] = []
        self.size = self.count = 0

    def add(self, data: bytes) -> None:
        self.members.append(_gzip(data))
        self.size += len(self.members[-1])
        self.count += 1
        if self.size >= self.roll_bytes:
            self.roll()

    def roll(self) -> None:
        if not self.members:
            return
        name, data = f"shard-{self.shard:06d}-{self.part:05d}.warc.gz", b"".join(self.members)
        put(f"{self.out}/{name}", data)
        self.rows.append((self.shard, self.part, name, self.count, len(data), hashlib.sha256(data).hexdigest()))
        self.part, self.members, self.size, self.count = self.part + 1, [], 0, 0

    def listed(self, end: bool = False) -> Iterator[pd.DataFrame]:
        """Manifest rows of the files written since the last call; at the end, of the last file too."""
        if end:
            self.roll()
        if self.rows:
            yield pd.DataFrame(self.rows, columns=["shard", "part", "file", "records", "bytes", "sha256"])
            self.rows = []


def shard_borders(pages: DataFrame, shard_bytes: int) -> list[int]:
    """The least page_id of every shard but the first, ascending."""
    sizes = pages.where("page_id is not null").groupBy("page_id").agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + 1).alias("n"))
    all_ = sizes.agg(F.count("*").alias("ids"), F.sum("n").alias("n")).first()
    shards = min(MAX_SHARDS, -(-(all_.n or 0) // shard_bytes))
    if shards < 2:
        return []
    picked = sizes.where(F.pmod(F.xxhash64("page_id"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, MAX_SAMPLE / all_.ids))).collect()
    if not picked:
        return []
    ids, weights = np.array(sorted(map(tuple, picked)), np.int64).T
    before = np.cumsum(weights) - weights
    at = np.searchsorted(before, before[-1] * np.arange(1, shards) / shards)
    return sorted({int(ids[i]) for i in at} - {int(ids[0])})


def _shard(borders: list[int], html, url) -> F.Column:
    """The shard of a page_id: the number of borders up to it, found by bisection."""
    if not borders:
        return F.lit(0)
    table = F.lit(np.array(borders, np.int64))
    start = F.struct(F.lit(0).alias("a"), F.lit(len(borders)).alias("b"))

    def halve(acc, _):
        mid = F.shiftright(acc["a"] + acc["b"], 1)
        up = F.get(table, mid) <= F.col("page_id")
        return F.when(acc["a"] >= acc["b"], acc).otherwise(F.struct(F.when(up, mid + 1).otherwise(acc["a"]).alias("a"), F.when(up, acc["b"]).otherwise(mid).alias("b")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(len(borders).bit_length())), start, halve, lambda acc: acc["a"])
    return F.when(F.col("page_id").isNull(), F.pmod(F.xxhash64(html, url), F.lit(len(borders) + 1)).cast("int")).otherwise(found)


def write_warc(pages: DataFrame, out: str, *, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, min_revisit: int = MIN_REVISIT) -> str:
    """Write the archive to the folder `out` of a store that all tasks reach; returns the manifest's address.

    The texts are shuffled once, by shard; which page is whose revisit is found from digests alone.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    borders = shard_borders(pages, shard_bytes)
    shard = _shard(borders, "html", "url").alias("shard")
    html = F.coalesce("html", F.lit(""))
    sums = pages.where("page_id is not null").select("page_id", F.octet_length(html).alias("n"), F.unhex(F.sha2(html.cast("binary"), 256)).alias("digest")).where(F.col("n") >= min_revisit).drop("n")
    first = saved(sums.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1"), "warc-digests")
    revisits = balanced_join(sums, first.drop("n"), ["digest"], first.select("digest", "n")).where("page_id <> refers_to").distinct()
    nothing = F.lit(None)
    rows = pages.select(shard, "page_id", F.lit(1).alias("kind"), "url", "html", nothing.cast("long").alias("refers_to"), nothing.cast("string").alias("digest")).unionByName(
        revisits.withColumns({"html": nothing.cast("string"), "url": nothing.cast("string")}).select(shard, "page_id", F.lit(0).alias("kind"), "url", "html", "refers_to", F.lower(F.hex("digest")).alias("digest"))
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer: ShardWriter | None = None
        page: int | None = None
        revisit: dict[str, int] = {}
        copies: Counter = Counter()
        for batch in batches:
            for s, id_, kind, url, html_, refers_to, digest in zip(*(batch[c].tolist() for c in batch.columns), strict=True):
                if writer is None or writer.shard != s:
                    if writer is not None:
                        yield from writer.listed(end=True)
                    writer, page, revisit, copies = ShardWriter(out, s, roll_bytes), None, {}, Counter()
                own = None if pd.isna(id_) else int(id_)
                if own != page:
                    page, revisit, copies = own, {}, Counter()
                if kind == 0:
                    revisit[digest] = int(refers_to)
                    continue
                payload = (html_ or "").encode()
                sha = hashlib.sha256(payload).hexdigest()
                writer.add(record(own, copies[sha], url, payload, sha, revisit.get(sha)))
                copies[sha] += 1
                yield from writer.listed()
        if writer is not None:
            yield from writer.listed(end=True)

    dealt = rows.repartitionById(len(borders) + 1, "shard").sortWithinPartitions("shard", "page_id", "kind", F.col("html").asc_nulls_first(), "url")
    # The ids travel as strings, which pandas does not turn into floats where some are null.
    dealt = dealt.withColumns({"page_id": F.col("page_id").cast("string"), "refers_to": F.col("refers_to").cast("string")})
    files = dealt.mapInPandas(write, "shard int, part int, file string, records long, bytes long, sha256 string")
    files.write.json(f"{out}/{MANIFEST}")
    return f"{out}/{MANIFEST}"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive file."""
    at = 0
    while at < len(data):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof and at < len(data):
            parts.append(unpack.decompress(data[at : at + READ]))
            at += READ
        at = min(at, len(data)) - len(unpack.unused_data)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def read_warc(spark: SparkSession, manifest: str) -> DataFrame:
    """A row per record of the files that the manifest names: page_id, url, payload_bytes, payload_digest, record_type, refers_to, html (null for revisits).

    Digests are made anew from the payloads; a block or payload that does not match its header fails the job.
    """
    out = manifest.rpartition("/")[0]
    listed = spark.read.schema("file string, bytes long, sha256 string").json(manifest)
    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, html string"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, sha256 in zip(batch["file"], batch["sha256"], strict=True):
                store, path = fs.FileSystem.from_uri(f"{out}/{name}")
                with store.open_input_stream(path, compression=None) as f:
                    data = f.read()
                if hashlib.sha256(data).hexdigest() != sha256:
                    raise ValueError(f"{name} is not as the manifest has it")
                rows, size = [], 0
                for h, block in parse(data):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                    full = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
                    kind = h["WARC-Type"]
                    if h["WARC-Block-Digest"] != "sha256:" + hashlib.sha256(block).hexdigest() or kind == "response" and (len(payload) != full or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{name}: record {h['WARC-Record-ID']} is damaged")
                    rows.append((h.get("WARC-Page-ID"), h["WARC-Target-URI"], full, digest, kind, h.get("WARC-Refers-To-Page-ID"), payload.decode() if kind == "response" else None))
                    size += len(payload)
                    if size >= BATCH:
                        yield pd.DataFrame(rows, columns=fields)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=fields)

    fields = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
    tasks = max(1, min(listed.count(), MAX_READERS))
    return listed.repartition(tasks).mapInPandas(read, schema).withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def new_archive(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"

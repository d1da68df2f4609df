"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct pre-tokens of a batch of texts lie side by side in one array of
symbols with links to their neighbours. An index maps the rank of every pair
that occurs to all its positions. The lowest active rank is applied to all
its positions at once, and the new pairs left and right of each merge enter
the index. A pair that a merge makes has a higher rank than the merge, so
going through the ranks in ascending order gives each pre-token the merges
that it would get alone.

Cases: a null text counts as empty and has no tokens; special tokens in a
text are encoded as such; long texts are encoded whole; repeated rows give
the same result; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtide.llm.common import pieces

#: The pre-tokeniser's pattern (fixed value of the vocabulary).
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Pieces never cross the borders of these units, and a unit's pieces don't depend on what stands around it.
UNIT = regex.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Bytes of distinct pieces that are encoded at once, bytes of text whose units are looked at once, and units kept between.
PIECE_BYTES, CHUNK, KEEP_UNITS = 1_000_000, 1_000_000, 50_000


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: itself if it is printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], extra = chr(extra), extra + 1
    return out


class Vocabulary:
    """Vocabulary, merges and special tokens of a tokenizers JSON file."""

    def __init__(self, content: bytes):
        data = json.loads(content)
        vocab = data["model"]["vocab"]
        alphabet = byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes = {i: bytes(back[c] for c in s) for s, i in vocab.items() if s not in self.special} | {i: s.encode() for s, i in self.special.items()}
        self.of_byte = np.array([vocab[alphabet[b]] for b in range(256)], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        self.left, self.right, self.made = (np.array([vocab[x] for x in xs], np.int64) for xs in ([a for a, _ in merges], [b for _, b in merges], [a + b for a, b in merges]))
        self.width = max(self.bytes) + 1
        keys = self.left * self.width + self.right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it has none."""
        keys = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)


def encode_pieces(vocab: Vocabulary, pieces: list[bytes]) -> list[list[int]]:
    """Token ids of each piece, by a pair occurrence index over all of them."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(sizes)
    sym = vocab.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
    n = len(sym)
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
    nxt[ends[sizes > 0] - 1] = -1
    prv[(ends - sizes)[sizes > 0]] = -1
    index: dict[int, list[np.ndarray]] = defaultdict(list)
    active: list[int] = []

    def enter(at: np.ndarray) -> None:
        """Enter the pairs that start at these positions."""
        ranks = vocab.rank(sym[at], sym[nxt[at]])
        has = ranks >= 0
        at, ranks = at[has], ranks[has]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(at)]
        for r, i, j in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:], strict=False):
            if r not in index:
                heapq.heappush(active, r)
            index[r].append(at[i:j])

    enter(np.flatnonzero(nxt >= 0))
    while active:
        r = heapq.heappop(active)
        parts = index.pop(r)
        at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        a, b, made = vocab.left[r], vocab.right[r], vocab.made[r]
        follow = nxt[at]
        ok = (sym[at] == a) & (follow >= 0) & (sym[follow] == b)
        at, follow = at[ok], follow[ok]
        if a == b and len(at) > 1:  # in a run, the pairs overlap; the first goes first
            joined = np.concatenate(([False], follow[:-1] == at[1:]))
            first = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
            ok = (np.arange(len(at)) - first) % 2 == 0
            at, follow = at[ok], follow[ok]
        if not len(at):
            continue
        after = nxt[follow]
        sym[at], sym[follow], nxt[at] = made, -1, after
        has = after >= 0
        prv[after[has]] = at[has]
        before = prv[at]
        enter(np.concatenate((before[before >= 0], at[has])))
    alive = sym >= 0
    ids = sym[alive].tolist()
    stops = np.concatenate(([0], np.cumsum(alive)))[ends].tolist()
    return [ids[a:b] for a, b in zip([0, *stops], stops, strict=False)]


class Codec:
    """Encodes and decodes batches of texts. Units are numbered as they occur; those of earlier chunks are kept, up to a bound."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.digits = {i: str(i) for i in vocab.bytes}
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = defaultdict(itertools.count().__next__)
        self.names: list[str] = []  # by code: decimal ids joined by commas, what they decode to, and the ids
        self.plain: list[bytes] = []
        self.ids: list[list[int]] = []

    def learn(self) -> None:
        """Encode the units that are numbered but not known yet."""
        new = list(itertools.islice(self.code, len(self.names), None))
        special, known = self.vocab.special, {}
        cut, pieces, size = [], set(), 0
        for u in new:
            if u in special:
                ps: list[bytes] = []
            elif u.isalpha() or u[0] == " " and u[1:].isalpha():
                ps = [u.encode()]
            else:
                ps = [p.encode() for p in PIECE.findall(u)]
            cut.append(ps)
            pieces.update(ps)
            size += len(u)
            if size > PIECE_BYTES:
                self._encode(pieces.difference(known), known)
                pieces, size = set(), 0
        self._encode(pieces.difference(known), known)
        digits, to_bytes = self.digits, self.vocab.bytes
        for u, ps in zip(new, cut, strict=True):
            ids = [special[u]] if u in special else known[ps[0]] if len(ps) == 1 else [i for p in ps for i in known[p]]
            self.ids.append(ids)
            self.names.append(",".join([digits[i] for i in ids]))
            self.plain.append(b"".join([to_bytes[i] for i in ids]))

    def _encode(self, pieces: set[bytes], known: dict[bytes, list[int]]) -> None:
        if pieces:
            order = list(pieces)
            known.update(zip(order, encode_pieces(self.vocab, order), strict=True))

    def units(self, text: str) -> list[str]:
        if self.vocab.splitter is None or not any(map(text.__contains__, self.vocab.special)):
            return UNIT.findall(text)
        out: list[str] = []
        for part in self.vocab.splitter.split(text):
            if part in self.vocab.special:
                out.append(part)
            elif part:
                out += UNIT.findall(part)
        return out

    def codes(self, texts: list[str]) -> list[list[int]]:
        """Codes of the units of texts, all of them known."""
        if len(self.names) > KEEP_UNITS:
            self.clear()
        rows = [[self.code[u] for u in self.units(t)] for t in texts]
        self.learn()
        return rows


def _text(raw: bytes) -> bytes:
    """The bytes of the text that raw decodes to."""
    try:
        raw.decode()
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode()
    return raw


def _broadcast(docs: DataFrame, path: str) -> Broadcast[bytes]:
    """The driver's vocabulary file for all tasks: its size is that of the vocabulary."""
    return docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())


@functools.lru_cache(maxsize=2)
def _parsed(content: bytes) -> Vocabulary:
    """Parsed once a Python worker, which runs many tasks."""
    return Vocabulary(content)


def encode(docs: DataFrame, vocab_path: str, *, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens long, ids_sha256, decoded_sha256 of every row, and the ids themselves if asked for.

    ids_sha256: of the decimal ids joined by commas; decoded_sha256: of the text that the ids decode to.
    """
    content = _broadcast(docs, vocab_path)
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def rows_of(codec: Codec, texts: list[str]) -> list[pa.Array]:
        sizes, hashes, decodings, ids = [], [], [], []
        for codes in codec.codes(texts):
            joined = ",".join(map(codec.names.__getitem__, codes))
            sizes.append(joined.count(",") + bool(joined))
            hashes.append(hashlib.sha256(joined.encode()).hexdigest())
            decodings.append(hashlib.sha256(_text(b"".join(map(codec.plain.__getitem__, codes)))).hexdigest())
            if with_ids:
                ids.append(np.fromiter(itertools.chain.from_iterable(map(codec.ids.__getitem__, codes)), np.int32, sizes[-1]))
        out = [pa.array(sizes, pa.int64()), pa.array(hashes), pa.array(decodings)]
        if with_ids:
            ends = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            out.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, names = Codec(_parsed(content.value)), fields.replace(" long", "").replace(" string", "").replace(" array<int>", "").split(", ")
        for batch in batches:
            for at, texts in pieces(batch.column("text"), CHUNK):
                yield pa.record_batch([batch.column("doc_id").slice(at, len(texts)), *rows_of(codec, ["" if t is None else t for t in texts])], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, fields)


def decode(tokens: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id and the text that the ids of each row decode to (null ids: empty)."""
    content = _broadcast(tokens, vocab_path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to_bytes = _parsed(content.value).bytes
        for batch in batches:
            texts = ["" if x is None else b"".join([to_bytes[i] for i in x]).decode("utf-8", "replace") for x in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "text": texts})

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInPandas(run, "doc_id long, text string")

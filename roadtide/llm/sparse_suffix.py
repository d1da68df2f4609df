"""Suffix-array dedup: sparse suffix arrays over minimiser positions.

Suffixes start at the minimisers of windows of WINDOW runs of RUN words, so
two equal passages of MIN_WORDS = WINDOW + RUN - 1 words or more have one in
common. Suffixes whose first RUN words occur once in the corpus have no
partner and are left aside. The others are dealt to tasks by their first RUN
words and sorted there by all their words; neighbours (the next REACH rows)
are compared, and the match is extended to the right and left.
Spans of MIN_WORDS or more are marked in both texts and merged per document.

That compares all suffixes of a run with REACH + 1 of them or fewer. In a more
frequent run (a licence or footer line), suffixes that match mostly to the
left can lie far apart. There the windows of MIN_WORDS words are hashed whose
minimiser the suffix is, equal windows having equal minimisers, and windows
whose hash occurs twice are marked too. A window that the row before has as
well is left out: the comparison has marked it in both, and the first row of
such a chain stands for it. So such a run needs no order as a whole, and one
with more than SPLIT suffixes is dealt to several tasks.

A suffix carries the hashes of the SIDE words on either side. Neighbouring
minimisers are fewer words apart, so the spans of a long passage overlap and
merge into all of it. Windows are at most as many as words, and their hashes
are counted by partial aggregates.

Cases: null texts and texts of fewer than MIN_WORDS words have no spans;
passages repeated inside one text count; rows without doc_id are left out;
rows with one doc_id are texts of their own whose spans are given under it,
and an equal text in two rows is a repeated passage; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadtide.llm.common import balanced_join, saved
from roadtide.llm.hashing import mixed, run_hashes, word_hashes

MIN_WORDS, RUN = 50, 10
WINDOW = MIN_WORDS - RUN + 1
#: Rows after a suffix in the sort order that it is compared with.
REACH = 4
#: Suffixes of a frequent run that go to one task.
SPLIT = 1024
SIDE = MIN_WORDS
#: Powers of an odd number modulo 2^64, and of its inverse.
_BASE = 0x9E3779B97F4A7C15
_POWERS, _INVERSE = (np.array([pow(b, j, 1 << 64) for j in range(2 * SIDE + 1)], np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def minimisers(runs: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the least run (the last of equals) of every window of so many runs; for each, the first window that has it, and how many do."""
    if len(runs) < window:
        return (np.zeros(0, np.int64),) * 3
    at, span = np.arange(len(runs)), 1
    while span < window:  # at[i]: position of the least of the runs from i to i + span - 1
        step = min(span, window - span)
        a, b = at[: len(at) - step], at[step:]
        at, span = np.where(runs[b] <= runs[a], b, a), span + step
    return np.unique(at, return_index=True, return_counts=True)


def samples(docs: DataFrame) -> DataFrame:
    """DataFrame[doc_id, h, at, run, lead, wins]: position and hash of the first RUN words of every sampled suffix, how far before it the first window starts whose minimiser it is, and the number of these."""

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, own, out = batch["doc_id"].to_numpy(), batch["h"].to_numpy(), [[], [], [], [], [], []]
            for i, words in word_hashes(list(batch["text"]), fold=False):
                if len(words) >= MIN_WORDS:
                    runs = run_hashes(words, RUN)
                    at, first, wins = minimisers(runs)
                    for x, y in zip(out, (np.full(len(at), ids[i]), np.full(len(at), own[i]), at, runs[at].astype(np.int64), (at - first).astype(np.int8), wins.astype(np.int8)), strict=True):
                        x.append(y)
            if out[0]:
                yield pd.DataFrame(dict(zip(("doc_id", "h", "at", "run", "lead", "wins"), map(np.concatenate, out), strict=True)))

    return docs.mapInPandas(sample, "doc_id long, h long, at int, run long, lead byte, wins byte")


def suffixes(docs: DataFrame, positions: DataFrame) -> DataFrame:
    """DataFrame[run, part, right, after, before, left, doc_id, at, lead, wins]: the sampled suffixes with the words' hashes to their right and, reversed, to their left."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, rows = batch["doc_id"].to_numpy(), []
            lists = [list(batch[c]) for c in ("ats", "runs", "parts", "leads", "wins")]
            for i, words in word_hashes(list(batch["text"]), fold=False):
                at, run, part, lead, wins = (np.asarray(x[i], np.int64) for x in lists)
                short = np.concatenate((np.zeros(SIDE, np.uint32), (words >> np.uint64(32)).astype(">u4"), np.zeros(SIDE, np.uint32))).astype(">u4")
                right = short[at[:, None] + SIDE + np.arange(SIDE)]
                left = short[at[:, None] + SIDE - 1 - np.arange(SIDE)]
                for j, p in enumerate(at):
                    rows.append((run[j], part[j], right[j].tobytes(), min(SIDE, len(words) - p), min(SIDE, p), left[j].tobytes(), ids[i], p, lead[j], wins[j]))
                if len(rows) >= ROWS:
                    yield pd.DataFrame(rows, columns=_FIELDS)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=_FIELDS)

    # Equal rows have the same positions; each row of a text is cut at them.
    per_doc = positions.groupBy("doc_id", "h").agg(F.collect_set(F.struct("at", "run", "part", "lead", "wins")).alias("p"))
    per_doc = per_doc.select("doc_id", "h", F.col("p.at").alias("ats"), F.col("p.run").alias("runs"), F.col("p.part").alias("parts"), F.col("p.lead").alias("leads"), F.col("p.wins").alias("wins"))
    return docs.join(per_doc, ["doc_id", "h"]).select("doc_id", "text", "ats", "runs", "parts", "leads", "wins").mapInPandas(cut, _SUFFIX)


#: Suffixes that are handed over at once.
ROWS = 20_000
_SUFFIX = "run long, part int, right binary, after int, before int, left binary, doc_id long, at int, lead byte, wins byte"
_FIELDS = ["run", "part", "right", "after", "before", "left", "doc_id", "at", "lead", "wins"]


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    equal = a == b
    return np.minimum(np.where(equal.all(axis=1), equal.shape[1], equal.argmin(axis=1)), most)


def _sides(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(b"".join(rows[c]), ">u4").reshape(len(rows), SIDE) for c in ("right", "left"))


def neighbour_spans(rows: pd.DataFrame) -> pd.DataFrame:
    """Spans (doc_id, start, stop) of the matches of sorted suffixes with the REACH rows after them."""
    run, after, before, doc, at = (rows[c].to_numpy() for c in ("run", "after", "before", "doc_id", "at"))
    right, left = _sides(rows)
    found = []
    for k in range(1, REACH + 1):
        i = np.flatnonzero(run[k:] == run[:-k])
        ahead = _common(right[i], right[i + k], np.minimum(after[i], after[i + k]))
        back = _common(left[i], left[i + k], np.minimum(before[i], before[i + k]))
        long = ahead + back >= MIN_WORDS
        i, ahead, back = i[long], ahead[long], back[long]
        found += [(doc[x], at[x] - back, at[x] + ahead) for x in (i, i + k)]
    doc, start, stop = (np.concatenate(x) for x in zip(*found, strict=True))
    return pd.DataFrame({"doc_id": doc, "start": start, "stop": stop}).drop_duplicates()


def window_keys(rows: pd.DataFrame, skip: int) -> pd.DataFrame:
    """doc_id, start and keys of the windows of sorted suffixes, without the first skip rows and without windows that the row before has too; keys has the hashes of the windows at start, start + 1, ..."""
    run, after, before, doc, at = (rows[c].to_numpy() for c in ("run", "after", "before", "doc_id", "at"))
    lead, wins = (rows[c].to_numpy().astype(np.int64) for c in ("lead", "wins"))
    if not wins.any():
        return pd.DataFrame({"doc_id": [], "start": [], "keys": []})
    right, left = _sides(rows)
    ago = np.arange(WINDOW)[::-1]  # words of the window to the left of the suffix
    own = (ago >= np.maximum(lead - wins + 1, MIN_WORDS - after)[:, None]) & (ago <= np.minimum(lead, before)[:, None])
    new = own.copy()
    new[:skip] = False
    i = np.flatnonzero((run[1:] == run[:-1]) & new[1:].any(axis=1)) + 1
    ahead = _common(right[i], right[i - 1], np.minimum(after[i], after[i - 1]))
    back = _common(left[i], left[i - 1], np.minimum(before[i], before[i - 1]))
    new[i] &= ~(own[i - 1] & (ago >= MIN_WORDS - ahead[:, None]) & (ago <= back[:, None]))
    i = np.flatnonzero(new.any(axis=1))
    sums = np.cumsum(mixed(np.concatenate((left[i, ::-1], right[i]), axis=1).astype(np.uint64)) * _POWERS[: 2 * SIDE], axis=1, dtype=np.uint64)
    sums = np.pad(sums, ((0, 0), (1, 0)))
    keys = mixed((sums[:, SIDE - ago + MIN_WORDS] - sums[:, SIDE - ago]) * _INVERSE[SIDE - ago]).view(np.int64)
    edge = np.diff(np.pad(new[i], ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (row, a), (_, b) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    return pd.DataFrame({"doc_id": doc[i[row]], "start": at[i[row]] - (WINDOW - 1) + a, "keys": [keys[r, x:y] for r, x, y in zip(row, a, b, strict=True)]})


def repeated_spans(docs: DataFrame) -> DataFrame:
    """DataFrame[doc_id, start, stop]: word ranges (stop exclusive) of passages that occur elsewhere too, merged per document."""
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    sampled = saved(samples(docs), "suffix-samples")
    repeated = saved(sampled.groupBy("run").agg(F.count("*").alias("n")).where("n > 1"), "suffix-runs")
    runs = repeated.select("run", (F.col("n") > REACH + 1).alias("often"), F.ceil(F.col("n") / SPLIT).cast("int").alias("parts"))
    positions = balanced_join(sampled, runs, ["run"], repeated).select(
        "doc_id", "h", "at", "run", "lead", F.when(F.col("often"), F.col("wins")).otherwise(F.lit(0).cast("byte")).alias("wins"), F.pmod(F.xxhash64("doc_id", "h", "at"), F.col("parts")).cast("int").alias("part")
    )
    ordered = suffixes(docs, positions).repartition("run", "part").sortWithinPartitions("run", "part", "right", "left", "doc_id", "at")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            if not len(batch):
                continue
            again = 0 if last is None else len(last)
            batch = batch if last is None else pd.concat([last, batch], ignore_index=True)
            spans, windows, last = neighbour_spans(batch), window_keys(batch, again), batch.iloc[-REACH:]
            for rows in (spans.assign(keys=None), windows.assign(stop=None)):
                if len(rows):
                    yield rows[columns].astype({"start": "Int32", "stop": "Int32", "keys": object})

    columns = ["doc_id", "start", "stop", "keys"]
    found = saved(ordered.mapInPandas(compare, "doc_id long, start int, stop int, keys array<long>"), "suffix-spans")
    windows = found.where("keys is not null").select("doc_id", "start", F.posexplode("keys").alias("i", "key")).select("doc_id", (F.col("start") + F.col("i")).alias("start"), "key")
    twice = saved(windows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "suffix-windows")
    equal = balanced_join(windows, twice.select("key"), ["key"], twice, how="left_semi").select("doc_id", "start", (F.col("start") + MIN_WORDS).alias("stop"))
    spans = found.where("stop is not null").select("doc_id", "start", "stop").union(equal).groupBy("doc_id", "start").agg(F.max("stop").alias("stop"))
    # A span that starts after all that came before it begins a merged one.
    sofar = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(F.col("start") > F.max("stop").over(sofar), F.lit(True)).cast("int")
    grouped = spans.withColumn("new", new).withColumn("g", F.sum("new").over(Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("doc_id", "g").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select("doc_id", "start", "stop")


def removed(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id and text of every row of docs that is left when the words of its spans are cut out; white space is kept where no word goes."""
    per_doc = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("s")).select("doc_id", F.col("s.start").alias("starts"), F.col("s.stop").alias("stops"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        for batch in batches:
            out = []
            for text, starts, stops in zip(batch["text"], batch["starts"], batch["stops"], strict=True):
                if text is not None and starts is not None:
                    at = [m.span() for m in regex.finditer(r"[^\x20\x09-\x0D]+", text)]
                    for a, b in reversed(list(zip(starts, stops, strict=True))):
                        text = text[: at[a][0]] + text[at[b - 1][1] :]
                out.append(text)
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "text": out})

    return docs.select("doc_id", "text").join(per_doc, "doc_id", "left").mapInPandas(cut, docs.select("doc_id", "text").schema)

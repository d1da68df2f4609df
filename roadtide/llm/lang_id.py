"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy, with calibrated rejection.

A word is lower-cased, fenced and cut into subwords of 2 to 4 code points and
itself, which are hashed to buckets. A text's vector is the mean of its
subwords' embeddings; a linear softmax turns it into probabilities. As the
mean is linear, prediction adds up one row of logits per subword, and a word
is looked up once per batch.

The classifier is fitted on the driver to a bounded sample of labelled rows:
at most TRAIN_DOCS texts of at most TRAIN_CHARS code points, spread evenly
over all languages by a hash of doc_id, with LEAST_DOCS a language at least.
A fifth of them ends the training and sets the temperature and the rejection
threshold. The number of SGD steps does not depend on the sample, unless it
has more texts than steps: a small one is gone through more often.

Cases: a null text or one without a letter is `und` with score 0 and
rejected; ties between languages go to the first in order; long texts count
whole; repeated rows are predicted alike; without labelled rows everything is
`und`; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadtide.llm.common import pieces

TRAIN_DOCS, LEAST_DOCS, TRAIN_CHARS = 4000, 20, 8000
BUCKETS, DIM, STEPS, RATE = 1 << 16, 16, 16_000, 0.2
#: Steps between two looks at the calibration rows, and looks without a lower loss after which training ends.
LOOK, PATIENCE = 2000, 3
#: Bounds of the norms of embeddings and output weights.
MAX_ROW, MAX_OUT = 1.0, 10.0
#: Share of right answers on the calibration rows that the rejection may cost.
REJECT = 0.001
UND = "und"
#: Bytes of text that are worked on at once.
CHUNK = 500_000
_PRIME, _MIX = np.uint64(1099511628211), np.uint64(0x9E3779B97F4A7C15)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword of the words, and the word that it is of."""
    fenced = [f"<{w}>" for w in words]
    sizes = np.fromiter(map(len, fenced), np.int64, len(fenced))
    points = np.frombuffer("".join(fenced).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), sizes)
    buckets, owners = [], []
    h = np.zeros(len(points), np.uint64)
    for n in range(1, 5):
        size = len(points) - n + 1
        if size <= 0:
            break
        h = h[:size] * _PRIME + points[n - 1 :]
        if n > 1:
            inside = np.flatnonzero(of[:size] == of[n - 1 :])
            buckets.append(((h[inside] + np.uint64(n)) * _MIX) >> np.uint64(48))
            owners.append(of[inside])
    whole = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in fenced), np.uint64, len(fenced))
    buckets.append((whole * _MIX) >> np.uint64(48))
    owners.append(np.arange(len(words)))
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's buckets and their shares."""
    counts = pd.Series(text.lower().split()).value_counts()
    buckets, of = subwords(list(counts.index))
    ids, at = np.unique(buckets, return_inverse=True)
    weights = np.bincount(at, weights=counts.to_numpy()[of])
    # Two bytes hold a bucket's number, so the sample's bags stay small.
    return ids.astype(np.uint16), (weights / weights.sum()).astype(np.float32)


class Model:
    """Embeddings, output weights and bias, temperature and rejection threshold."""

    def __init__(self, langs: list[str], emb: np.ndarray, out: np.ndarray, bias: np.ndarray, temperature: float = 1.0, threshold: float = 0.0):
        self.langs, self.out, self.bias, self.temperature, self.threshold = langs, out, bias, temperature, threshold
        # Few languages: a row of logits for each bucket; many: its embedding, so that the table stays small.
        self.table, self.folded = (emb @ out, True) if len(langs) <= emb.shape[1] else (emb, False)

    def probabilities(self, mean: np.ndarray) -> np.ndarray:
        """Of texts, from the means of their rows of the table."""
        z = ((mean if self.folded else mean @ self.out) + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def means(self, texts: list[str]) -> np.ndarray:
        words = [t.lower().split() for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes, distinct = pd.factorize(np.array([w for ws in words for w in ws], dtype=object))
        buckets, of = subwords(list(distinct))
        n, width = len(distinct), self.table.shape[1]
        sums = np.stack([np.bincount(of, self.table[buckets, c], n) for c in range(width)] + [np.bincount(of, minlength=n)], axis=1)
        rows = np.repeat(np.arange(len(texts)), sizes)
        total = np.stack([np.bincount(rows, sums[codes, c], len(texts)) for c in range(width + 1)], axis=1)
        return total[:, :-1] / np.maximum(total[:, -1:], 1)


def _loss(z: np.ndarray, truth: np.ndarray) -> float:
    """Mean negative log likelihood."""
    z = z - z.max(axis=1, keepdims=True)
    return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]))


def train(rows: list[tuple[str, str]], seed: int = 5) -> Model | None:
    """Fit on (text, lang) rows; None if there is nothing to learn from."""
    rows = [(t, y) for t, y in rows if y is not None and t is not None and t.split()]
    langs = sorted({y for _, y in rows})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    bags = [(*_bag(t), langs.index(y)) for t, y in rows]
    order = rng.permutation(len(bags))
    held, fit = order[: len(bags) // 5], order[len(bags) // 5 :]
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    truth = np.array([bags[i][2] for i in held], int)
    best, bad, steps = None, 0, max(STEPS, len(fit))
    for step, i in enumerate(itertools.islice((i for _ in itertools.count() for i in rng.permutation(fit)), steps)):
        if step % LOOK == 0 and step and len(held):
            loss = _loss(np.stack([bags[j][1] @ emb[bags[j][0]] for j in held]) @ out + bias, truth)
            if best is None or loss < best[0]:
                best, bad = (loss, emb.copy(), out.copy(), bias.copy()), 0
            else:
                bad += 1
            if bad == PATIENCE:
                break
        ids, share, y = bags[i]
        rate = RATE * (1 - step / steps)
        x = share @ emb[ids]
        z = x @ out + bias
        grad = np.exp(z - z.max())
        grad /= grad.sum()
        grad[y] -= 1
        back = out @ grad
        out -= rate * np.outer(x, grad)
        out /= np.maximum(np.linalg.norm(out, axis=0) / MAX_OUT, 1)
        bias -= 0.1 * rate * grad
        moved = emb[ids] - (rate * len(ids) * share)[:, None] * back
        # Projected steps: norms stay bounded, so the logits do.
        emb[ids] = moved / np.maximum(np.linalg.norm(moved, axis=1, keepdims=True) / MAX_ROW, 1)
    if best is not None and best[0] < _loss(np.stack([bags[j][1] @ emb[bags[j][0]] for j in held]) @ out + bias, truth):
        _, emb, out, bias = best
    model = Model(langs, emb, out, bias)
    if len(held):
        mean = np.stack([bags[i][1] @ model.table[bags[i][0]] for i in held])
        # The temperature at which the mean confidence is the share of right answers (with one right and one wrong added).
        share = (model.probabilities(mean).argmax(axis=1) == truth).sum() + 1
        miss = {}
        for t in np.geomspace(0.05, 50, 121):
            model.temperature = float(t)
            miss[float(t)] = abs(model.probabilities(mean).max(axis=1).mean() - share / (len(held) + 2))
        model.temperature = min(miss, key=miss.get)
        p = model.probabilities(mean)
        right = p.max(axis=1)[p.argmax(axis=1) == truth]
        model.threshold = float(min(0.5, np.quantile(right, REJECT))) if len(right) else 0.0
    return model


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, *, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> Model | None:
    """A model from a bounded sample of the labelled documents that are not held out; the same for the same rows, however they are dealt."""
    labelled = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id")).where(F.length("text").between(1, train_chars))
    counts = labelled.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return None
    quota = max(LEAST_DOCS, train_docs // len(counts))
    # Hashes under a bound that leaves twice the quota thin the rows before the exact cut; a language with few rows keeps all.
    chance = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, 2 * quota / r["count"] + 100 / r["count"]))))
    order = F.xxhash64("doc_id")
    some = labelled.where(F.pmod(order, F.lit(1 << 20)) < F.element_at(chance, F.col("lang")) * (1 << 20))
    ranked = some.select("text", "lang", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(order, F.lit(1 << 20)), order, "doc_id", "text")).alias("n"))
    return train(sorted((r["text"], r["lang"]) for r in ranked.where(F.col("n") <= quota).collect()))


PREDICTED = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def _predict(model: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    langs, score, rejected = [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    at = [i for i, t in enumerate(texts) if model is not None and t is not None and any(map(str.isalpha, t))]
    if at:
        p = model.probabilities(model.means([texts[i] for i in at]))
        for i, best in zip(at, p.argmax(axis=1).tolist(), strict=True):
            langs[i] = model.langs[best]
        score[at] = p.max(axis=1)
        rejected[at] = score[at] < model.threshold
    return langs, score, rejected


def predict(docs: DataFrame, model: Model | None, names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """docs with language, score and rejection under these names after its columns, in place of any of the same name; only text is looked at."""

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [_predict(model, part) for _, part in pieces(texts, CHUNK)]
            langs = pa.array([x for p in parts for x in p[0]], pa.string())
            numbers = [np.concatenate([[], *(p[k] for p in parts)]) for k in (1, 2)]
            yield pa.StructArray.from_arrays([langs, pa.array(numbers[0], pa.float64()), pa.array(numbers[1].astype(bool))], fields=list(PREDICTED))

    kept = [c for c in docs.columns if c not in names]
    found = docs.select(*kept, udf("text").alias("__lang"))
    return found.select(*kept, *(F.col(f"__lang.{c}").alias(n) for c, n in zip(("lang_pred", "score", "rejected"), names, strict=True)))

"""Hashes of words and word runs in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Characters of text that are worked on at once.
CHUNK = 2_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix."""
    x = x + _A
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None], *, fold: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """Index of each text and 64-bit hashes of its words, split at ASCII white space; fold lower-cases A-Z."""
    at, size, part = 0, 0, []
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        part.append((raw.lower() if fold else raw).split())
        size += len(raw)
        if size >= CHUNK or i == len(texts) - 1:
            flat = np.array([w.decode("utf-8", "surrogateescape") for ws in part for w in ws], dtype=object)
            hashes = pd.util.hash_array(flat).astype(np.uint64) if len(flat) else np.zeros(0, np.uint64)
            cuts = np.cumsum([len(ws) for ws in part])[:-1]
            for j, h in enumerate(np.split(hashes, cuts)):
                yield at + j, h
            at, size, part = i + 1, 0, []


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; of the whole, if there are fewer (none for no words)."""
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    out = np.full(n, min(k, len(words)), np.uint64)
    for j in range(min(k, len(words))):
        out = mixed(out) + words[j : j + n]
    return mixed(out)

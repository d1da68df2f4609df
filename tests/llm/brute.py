"""Plain single-machine versions that the operators are held against."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_quality(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def shingles(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def near_components(rows, k, percent):
    """doc_id: (n, component, kept)."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    where = defaultdict(list)
    for n, (i, s) in enumerate(sets):
        common = Counter(m for x in s for m in where[x])
        for m, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[m][1]) - c):
                a, b = root(i), root(sets[m][0])
                up[max(a, b)] = min(a, b)
        for x in s:
            where[x].append(n)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets}


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_pii(text):
    out = {k: [] for k in KINDS}
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out[kind].append(f"{kind}:{m.start()}:{m.end()}")
    joined = ",".join(x for k in KINDS for x in out[k])
    return (*(len(out[k]) for k in KINDS), hashlib.sha256(joined.encode()).hexdigest()), joined


def repeated_words(rows, least):
    """doc_id: word positions inside a passage of `least` words that occurs at another place too."""
    where = defaultdict(list)
    for i, t in rows:
        words = WORD.findall(t or "")
        for a in range(len(words) - least + 1):
            where[tuple(words[a : a + least])].append((i, a))
    out = defaultdict(set)
    for at in where.values():
        if len(at) > 1:
            for i, a in at:
                out[i].update(range(a, a + least))
    return out


def near_lines(rows, least=20):
    """doc_id: numbers of the lines that an earlier line equals or differs from by one code point."""
    lines = [(i, n, x.strip(" \t\n\x0b\x0c\r")) for i, t in rows if t is not None for n, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if len(x[2]) >= least]
    first = {}
    for i, n, x in sorted(lines):
        first.setdefault(x, (i, n))

    def close(a, b):
        if len(a) > len(b):
            a, b = b, a
        k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
        return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]

    by_size = defaultdict(list)
    for x in first:
        by_size[len(x)].append(x)
    near = {x for x in first if any(first[y] < first[x] and y != x and close(x, y) for m in (-1, 0, 1) for y in by_size[len(x) + m])}
    out = defaultdict(set)
    for i, n, x in lines:
        if x in near or first[x] != (i, n):
            out[i].add(n)
    return out


def poisson_counts(rows, seed=17):
    """Copies of each (doc_id, source), drawn by inverting the distribution at a hash."""
    sizes = Counter(s for _, s in rows)
    total = sum(n**0.5 for n in sizes.values())
    out = {}
    for i, s in rows:
        rate = sizes[s] ** 0.5 * len(rows) / (total * sizes[s])
        digest = hashlib.md5(f"count{seed}|{'' if s is None else s}|{i}|1".encode()).hexdigest()
        u, k, p = int(digest[:13], 16) / 2**52, 0, math.exp(-rate)
        c = p
        while u >= c:
            k += 1
            p *= rate / k
            c += p
        out[i] = k
    return out


def trie(rows):
    """A row for each node of the trie of conversations that begin with turns of the one that heads their twenty."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()), (role, text)))
    own = {c: [x[1] for x in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(list)
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:])
        ends[path].append(c)
        for i in range(len(path) + 1):
            members[path[:i]].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = (len(members[k]) - 1) * (len(WORD.findall(k[-1][1])) if k else 0) + sum(saved[x] for x in kids[k])
        digest = hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), leaves[k], saved[k], digest))
    return out


def merkle(rows, now, arity=3):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of (doc_id, source, lang, n_chars, text) rows; now gives a row's present text."""

    def h(text):
        return hashlib.sha256(text.encode()).hexdigest()

    def leaf(row):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def levels(hashes):
        out = [hashes]
        while len(out[-1]) > 1:
            out.append([h("".join(out[-1][i : i + arity])) for i in range(0, len(out[-1]), arity)])
        return out

    def climb(tree, i, folded):
        proof = ""
        for hashes in tree[:-1]:
            run, k = hashes[i - i % arity :][:arity], i % arity
            proof += "".join(run[:k] + run[k + 1 :])
            folded, i = h("".join(run[:k] + [folded] + run[k + 1 :])), i // arity
        return proof, folded

    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0] is not None, row[0] or 0, leaf(row), row))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    for n, s in enumerate(order):
        for i, (*_, own, row) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            low, folded = climb(trees[s], i, leaf((*row[:4], now(row))))
            high, folded = climb(top, n, folded)
            yield row[0], own, trees[s][-1][0], top[-1][0], h(low + high), folded, folded == top[-1][0]

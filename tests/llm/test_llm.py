"""The training-data operators: against SQL or brute force, and on odd, empty and planted input."""

import hashlib
import math
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from roadtide.llm import bpe, common, hashing, lang_id, line_dedup, minhash_bbit, pii_boost, poisson_mix, quality_llr, queries, sparse_suffix, va_topk, warc_shards
from tests.conftest import TESTDATA
from tests.llm import brute
from tests.oracle import oracle_rows, rows_of

VOCAB = common.tokenizer_path("byte_bpe_50k.json")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    got, names = rows_of(queries.queries()[name](spark, str(TESTDATA)))
    assert got == oracle_rows(queries.oracle_sql()[name], TESTDATA, names)


# Vector search


def test_top_k_ties_and_bad_vectors(spark):
    rows = [(i, [1.0, 0.5]) for i in range(8)] + [(8, None), (9, [1.0, None]), (10, [float("nan"), 1.0]), (11, [2.0]), (None, [9.0, 9.0]), (0, [1.0, 0.5])]
    v = va_topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = [tuple(r) for r in va_topk.top_k(v, v.where("id = 0"), k=3).orderBy("rank").collect()]
    assert got == [(0, 1, 11, 131072), (0, 2, 1, 81920), (0, 3, 2, 81920)]
    assert va_topk.top_k(v.where("id < 0"), v.where("id < 0")).count() == 0


def test_top_k_against_brute_force_in_many_blocks(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(300, 8)), 1)
    v = va_topk.scaled(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>"))
    got = {}
    for r in va_topk.top_k(v, v.where("id % 10 = 0"), k=5, data_block=40, query_block=7).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    z = np.floor(256 * x).astype(np.int64)
    for q in range(0, 300, 10):
        s = sorted((-int(z[q] @ z[j]), j) for j in range(300) if j != q)[:5]
        assert [got[q][i + 1] for i in range(5)] == [(j, -a) for a, j in s]


def test_top_k_of_large_and_uneven_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=int(rng.integers(1, 40))) * 10.0 ** rng.integers(-2, 15)).tolist()) for i in range(200)] + [(200, [1e6] * 300), (201, [-1e6] * 300), (202, []), (203, [1e300])]
    frame = spark.createDataFrame([(i, x, 1.0, "s") for i, x in rows], "vec_id long, embedding array<double>, score double, cells string")
    v = va_topk.scaled(frame)
    z = {i: [max(-(2**63), min(2**63 - 1, math.floor(256 * c))) for c in x] for i, x in rows}
    got = {}
    for r in va_topk.top_k(v, v.where("id % 4 = 0"), k=5, data_block=50, query_block=20).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    clamp = lambda s: max(-(2**63), min(2**63 - 1, s))
    for q in range(0, 204, 4):
        s = sorted((-sum(a * b for a, b in zip(z[q], z[j])), j) for j in z if j != q)[:5]  # noqa: B905
        assert [got[q][i + 1] for i in range(5)] == [(j, clamp(-a)) for a, j in s]


def test_top_k_with_one_very_common_vector(spark):
    rows = [(i, [1.0, 2.0] if i % 3 else [float(i % 7), -1.0]) for i in range(3000)]
    v = va_topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = va_topk.top_k(v, v.where("id % 50 = 0"), k=5, data_block=100, query_block=20)
    z = {i: np.floor(256 * np.array(x)).astype(int) for i, x in rows}
    want = {(q, n + 1, j, -s) for q in range(0, 3000, 50) for n, (s, j) in enumerate(sorted((-int(z[q] @ z[j]), j) for j in z if j != q)[:5])}
    assert {tuple(r) for r in got.collect()} == want
    assert va_topk.distinct_cells(va_topk.cells(v), 5).where("cells is not null").count() <= 8 * 6


def test_a_query_that_scores_all_alike_keeps_few(spark):
    import pandas as pd

    rows = [(i, [float(i), 1.0, -float(i % 11)]) for i in range(500)]
    v = va_topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    asked = pd.DataFrame({"id": [7], "v": [[0, 0, 0]]})
    assert va_topk.block_bounds(asked, va_topk.cells(v).toPandas(), 5)["vec_id"].tolist() == [0, 1, 2, 3, 4]


# Quality


def test_quality_counts(spark, small):
    labels = spark.read.parquet(str(TESTDATA / "labels.parquet"))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_llr.quality_llr(small, labels).collect()}
    assert got == {i: brute.base_quality(t) for i, t in pairs(small)}


def test_quality_model(spark):
    good, bad = " ".join(f"plain{i % 50} words" for i in range(300)), " ".join(f"junk{i % 50} ###" for i in range(300))
    docs = spark.createDataFrame([(i, good if i % 2 else bad) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, None), (0, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    scores = {r.doc_id: r.score for r in quality_llr.quality_llr(docs, labels).collect()}
    assert min(scores[i] for i in range(1, 20, 2)) > 0 > max(scores[i] for i in range(0, 20, 2))


def test_quality_odd(spark, odd, nothing):
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_llr.quality_llr(odd, labels).collect()
    assert len(rows) == 9 and all(r.base_failed is not None and r.kept is not None for r in rows)
    assert {r.n_words for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert quality_llr.quality_llr(nothing, labels.where("false")).count() == 0


# Mixing


def test_mixing_rates(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "rare").otherwise("common").alias("source"))
    n = {r.source: r["count"] for r in poisson_mix.poisson_mix(docs, weights={"rare": 0.75, "common": 0.25}).groupBy("source").count().collect()}
    assert abs(n["rare"] - 15_000) < 600 and abs(n["common"] - 5_000) < 300
    big = poisson_mix.poisson_mix(docs.where("doc_id < 200"), weights={"rare": 1.0}, total=10)
    assert abs(big.count() - 2000) < 250 and big.where("source = 'common'").count() == 0


def test_mixing_is_the_same_again_and_in_global_order(spark, small):
    a, b = (poisson_mix.poisson_mix(small.repartition(n)) for n in (1, 5))
    order = [r.mix_order for r in a.select("mix_order").collect()]
    assert order == sorted(order) and order == [r.mix_order for r in b.select("mix_order").collect()]


def test_mixing_odd(odd, nothing):
    assert poisson_mix.poisson_mix(odd, total=5.0).columns == [*odd.columns, "mix_copy", "mix_order"]
    assert poisson_mix.poisson_mix(nothing).count() == 0


# Language ID


def test_language_accuracy(spark, small):
    model = lang_id.fit(small)
    rows = lang_id.predict(small.withColumn("held_out", lang_id.held_out("doc_id")), model).where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.rejected for r in rows]) < 0.02
    assert lang_id.fit(small.repartition(7)).table.tolist() == model.table.tolist()


def test_language_odd(odd, nothing, small):
    model = lang_id.fit(small)
    got = {r.doc_id: r for r in lang_id.predict(odd, model).select("doc_id", "lang_pred", "rejected").collect()}
    assert all(got[i].lang_pred == "und" and got[i].rejected for i in (1, 2, 3, 7)) and got[5].lang_pred != "und"
    assert lang_id.predict(nothing, model).count() == 0 and lang_id.fit(nothing) is None
    assert {r.lang_pred for r in lang_id.predict(odd, None).select("lang_pred").collect()} == {"und"}


def test_language_of_very_many(spark):
    langs = [f"x{i:03d}" for i in range(600)]
    rows = [(i * 10 + j, f"{name}a {name}b {name}c word", name) for i, name in enumerate(langs) for j in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.fit(docs)
    assert model.langs == langs and model.table.shape[1] == lang_id.DIM and not model.folded
    assert len({r.lang_pred for r in lang_id.predict(docs, model).select("lang_pred").distinct().collect()}) > 5


# BPE


@pytest.mark.parametrize("extra", [[], ["<|endoftext|>", "a<|endoftext|> b", "  x \x1c y\x85z", "aaaaaaaaa aaaa", "  \n\n  x's  don't 12345 ½²³ ", "日本語 ไทย 🙂🙂‍", "\r\n\t \x0b"]])
def test_bpe_against_the_library(spark, small, extra):
    t = Tokenizer.from_file(VOCAB)
    docs = pairs(small) if not extra else list(enumerate(extra))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for r in bpe.encode(frame, VOCAB).collect():
        ids = t.encode(dict(docs)[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_holds_few_of_many_new_words():
    """Words that are all new, the most that a codec is asked to hold: the slices bound it."""
    codec = bpe.Codec(bpe.Vocabulary(Path(VOCAB).read_bytes()))
    draw = np.random.default_rng(5)
    texts = pa.array([" ".join("".join(map(chr, w)) for w in draw.integers(97, 123, (1000, 7))) for _ in range(260)])
    tracemalloc.start()
    try:
        for _, some in bpe.pieces(texts, bpe.CHUNK):
            codec.codes(some)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 150e6


def test_bpe_round_trip_and_odd(odd, nothing):
    tokens = bpe.encode(odd, VOCAB)
    assert sorted(pairs(bpe.decode(tokens, VOCAB)), key=str) == sorted(((i, t or "") for i, t in pairs(odd)), key=str)
    assert bpe.encode(nothing, VOCAB).count() == 0


# Line dedup


def test_near_lines(spark):
    line = "the quick brown fox jumps over the dog"
    rows = [(1, f"{line}\nshort"), (2, line.replace("quick", "quack")), (3, line + "s\nshort"), (4, "x" + line + "y"), (5, f"  {line}  \nanother line that is quite different")]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: f"{line}\nshort", 2: "", 3: "short", 4: "x" + line + "y", 5: "another line that is quite different"}


def test_lines_odd(odd, nothing):
    out = line_dedup.line_dedup(odd)
    got = {r.doc_id: r for r in out.select("doc_id", "text", "n_dropped").collect()}
    assert out.columns == [*odd.columns, "n_lines", "n_dropped"] and out.count() == 9
    assert got[1].text is None and got[2].text == "" and got[4].n_dropped == 1 and got[None].n_dropped == 0
    assert line_dedup.line_dedup(nothing).count() == 0


@pytest.mark.parametrize(("long", "block"), [(24, 7), (25, 1), (27, 26), (1000, 1000)])
def test_near_lines_of_any_length_against_brute_force(spark, monkeypatch, long, block):
    """Variants keyed by their sides, variants keyed as a whole, and lines on either side of the bound."""
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = np.random.default_rng(6)
    base = ["".join(rng.choice(list("ab 🙂é"), n)) for n in (20, 22, 23, 24, 25, 26, 27, 28, 40, 53) for _ in range(4)] + ["a" * n for n in range(20, 32)]
    rows = []
    for i in range(120):
        x = base[rng.integers(len(base))]
        for _ in range(rng.integers(3)):
            at = int(rng.integers(len(x) + 1))
            x = (x[:at] + "b" + x[at:], x[:at] + x[at + 1 :], x[:at] + "é" + x[at + 1 :])[rng.integers(3)]
        rows.append((i, x + "\nshort\n" + base[rng.integers(len(base))]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r["drop"] for r in line_dedup.dropped_lines(docs, long=long).collect()}
    assert got == {i: sorted(ns) for i, ns in brute.near_lines(rows).items()}


def test_near_copies_of_a_long_line_are_not_spelt_out(spark, monkeypatch):
    """Keys that long lines emit, in all rounds together: some dozens a line, not one for each code point."""
    made = []
    monkeypatch.setattr(line_dedup, "saved", lambda df, name: (out := common.saved(df, name), made.append(out.count() if name == "line-places" else 0))[0])
    line = "".join(np.random.default_rng(2).choice(list("abcdefgh"), 1500))
    rows = [(i, line[: 20 * i] + str(i % 10) + line[20 * i + 1 :]) for i in range(60)] + [(60, line), (61, line[:700] + line[701:])]
    got = {r.doc_id: r["drop"] for r in line_dedup.dropped_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {60: [0], 61: [0]} and 0 < sum(made) < 100 * len(rows)


def test_a_line_of_a_million_characters_and_a_million_lines(spark):
    line = "".join(np.random.default_rng(1).choice(list("abcdefgh é"), 1_000_000)).strip() + "."
    at = len(line) // 3
    many = [hashlib.md5(str(i).encode()).hexdigest() for i in range(500_000)]
    text = "\n".join(x for l in many for x in (l, l))
    rows = [(1, line), (2, line[:at] + line[at + 1 :]), (3, line[:at] + "?" + line[at + 1 :]), (4, "x" + line[2:-2]), (5, text)]
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (line, 0) and got[2] == got[3] == ("", 1) and got[4] == (rows[3][1], 0)
    kept = got[5][0].split("\n")
    assert len(kept) == 1_000_000 - got[5][1] and len(set(kept)) == len(kept) and set(kept) <= set(many)


# Near-dedup


def test_a_join_looks_up_heavy_keys_once(spark):
    """Without a heavy key the join is a plain one; with one, the list is no query over the counts again."""
    left, right = spark.range(3000).select(F.lit(1).alias("k"), "id"), spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    split = common.balanced_join(left, right, ["k"], counts)
    assert split.count() == 3000 and split.columns == ["k", "id", "v"] and "Aggregate" not in plan(split)
    plain = common.balanced_join(left, right, ["k"], counts, 3_000_000)
    assert plain.count() == 3000 and plain.columns == ["k", "id", "v"] and plan(plain).count("Join") == 1


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_components(small, k, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_bbit.near_components(small, words=k, percent=percent).collect()}
    assert got == brute.near_components(pairs(small), k, percent)


def test_near_group_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash_bbit, "BLOCK", 16)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(120):
        words = list(base)
        for j in rng.integers(0, 120, rng.integers(0, 5)):
            words[j] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(200, rows[3][1].upper()), (201, "other words entirely"), (202, "two words"), (203, "two words")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_bbit.near_components(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()}
    assert got == brute.near_components(rows, 3, 85)


def test_bits_estimate_similarity():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.85, 1.0):
        x = rng.integers(0, 2**63, 4000).astype(np.uint64)
        n = int(2 * share / (1 + share) * 2000)
        a, b = np.unique(x[:2000]), np.unique(np.concatenate((x[:n], x[2000 : 4000 - n])))
        got = minhash_bbit.differing(*(minhash_bbit.packed(minhash_bbit.minima(s, 140)) for s in (a, b)))
        assert abs(1 - got / 140 * 16 / 15 - share) < 0.15
    assert (1 - 0.85 ** minhash_bbit.band_rows(85)) ** minhash_bbit.BANDS <= minhash_bbit.MISS


def test_near_rows_of_one_doc_id(spark):
    rng = np.random.default_rng(5)
    a, b, c = ([f"{x}{i}" for i in rng.integers(0, 10**6, 80)] for x in "abc")
    near = lambda w, i: " ".join([*w[:40], f"new{i}", *w[41:]])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (9, near(b, 1)), (11, near(a, 2)), (3, " ".join(c)), (4, " ".join(c)), (4, near(b, 3)), (20, ""), (20, near(c, 4)), (21, " ".join(a[:9]))]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash_bbit.near_components(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect())
    assert got == [(3, 3, True), (4, 3, False), (4, 3, False), (5, 3, False), (5, 3, False), (9, 3, False), (11, 3, False), (20, 3, False), (20, 20, True), (21, 21, True)]


def test_near_chains_and_boilerplate(spark, monkeypatch):
    """Links at the threshold, chains whose ends are far apart, and unlike texts that share most of their words."""
    monkeypatch.setattr(minhash_bbit, "BLOCK", 8)
    monkeypatch.setattr(common, "HEAVY", 10)
    rng = np.random.default_rng(6)
    word = lambda: f"w{rng.integers(0, 10**7)}"
    rows = []
    for _ in range(4):
        words = [word() for _ in range(100)]
        for _ in range(25):  # each text differs a little from the one before
            at = int(rng.integers(0, 97))
            words[at : at + int(rng.integers(1, 4))] = [word() for _ in range(int(rng.integers(1, 3)))]
            rows.append(" ".join(words))
    common_part = [word() for _ in range(60)]
    for n in range(60):  # around the threshold on either side
        rows.append(" ".join(common_part + [word() for _ in range(n % 20)]))
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(rows)), rows, strict=True)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_bbit.near_components(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()}
    assert got == brute.near_components(rows, 3, 85)


def test_near_odd(odd, nothing):
    got = {r.doc_id: r for r in minhash_bbit.near_components(odd).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7] and all(r.kept for r in got.values()) and got[1].n_shingles == 0
    assert minhash_bbit.near_components(nothing).count() == 0


# Suffixes


def test_repeated_spans(small):
    got = {}
    for r in sparse_suffix.repeated_spans(small).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.stop))
    want = brute.repeated_words(pairs(small), sparse_suffix.MIN_WORDS)
    assert got == want


def test_rows_of_one_doc_id_are_texts_of_their_own(spark):
    words = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    head = words("h", 30)
    rows = [(5, f"{head} {words('a', 90)}"), (5, f"{head} {words('b', 90)}"), (6, words("c", 80)), (7, f"{words('d', 9)} {words('b', 90)}"), (8, words("e", 60)), (8, words("e", 60))]
    got = sorted((r.doc_id, r.start, r.stop) for r in sparse_suffix.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(5, 30, 120), (7, 9, 99), (8, 0, 60)]


def test_pairs_around_a_phrase_common_to_all(spark, monkeypatch):
    monkeypatch.setattr(sparse_suffix, "SPLIT", 16)
    words, phrase = ending_in(sparse_suffix.RUN, 8)
    rows = []
    for i in range(60):  # the common phrase ends, begins or lies within what a pair shares
        a, b = words(40), words(40)
        shared = (a + phrase, phrase + b, a[:20] + phrase + b[:20])[i % 3]
        rows += [words(25) + shared + words(25) for _ in range(2)]
    rows = [(i, " ".join(x)) for i, x in enumerate(rows)]
    got = {}
    for r in sparse_suffix.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.stop))
    assert got == brute.repeated_words(rows, sparse_suffix.MIN_WORDS) and len(got) == 120


def test_planted_passage(spark):
    rng = np.random.default_rng(4)
    word = lambda: f"w{rng.integers(0, 10**9)}"
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join([word() for _ in range(40 + i)] + passage + [word() for _ in range(30)])) for i in range(12)] + [(50, " ".join(passage[:49])), (51, " ".join(word() for _ in range(200)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = sparse_suffix.repeated_spans(docs)
    assert {r.doc_id: (r.start, r.stop) for r in spans.collect()} == {i: (40 + i, 100 + i) for i in range(12)}
    left = dict(pairs(sparse_suffix.removed(docs, spans)))
    assert all(len(left[i].split()) == 70 + i for i in range(12)) and left[51] == rows[-1][1]


def ending_in(phrase_words, seed):
    """Random words, and a phrase of so many of them that is the minimiser of nearly every window around it."""
    rng = np.random.default_rng(seed)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    while True:
        phrase = words(phrase_words)
        (_, hashes), = hashing.word_hashes([" ".join(phrase)], fold=False)
        if hashing.run_hashes(hashes, sparse_suffix.RUN)[0] < 2**64 // 3000:
            return words, phrase


def test_passage_that_ends_in_a_frequent_phrase(spark):
    words, phrase = ending_in(sparse_suffix.RUN, 6)
    rows = []
    for _ in range(30):  # twice the same 40 words to the left, and what follows differs
        passage = words(40) + phrase
        rows += [words(20) + passage + words(60) for _ in range(2)]
    rows += [words(60) + phrase + words(60) for _ in range(400)]
    rows = [(i, " ".join(x)) for i, x in enumerate(rows)]
    got = {r.doc_id: (r.start, r.stop) for r in sparse_suffix.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (20, 70) for i in range(60)}


def test_a_suffix_is_not_its_own_neighbour(spark):
    words, phrase = ending_in(sparse_suffix.RUN, 7)
    docs = spark.createDataFrame([(i, " ".join(words(60) + phrase + words(60))) for i in range(2)], "doc_id long, text string")
    assert sparse_suffix.repeated_spans(docs).count() == 0


def test_suffix_odd(odd, nothing):
    assert {r.doc_id for r in sparse_suffix.repeated_spans(odd).collect()} <= {5, 7}
    assert sparse_suffix.repeated_spans(nothing).count() == 0


# PII


def found_in(docs, model=None):
    scanned = common.saved(pii_boost.scan(docs), "scan")
    return pii_boost.find(scanned, model or pii_boost.fit(scanned))


def test_pii_base(small, odd):
    for docs in (small, odd):
        got = sorted(((r.doc_id, (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)) for r in pii_boost.digest(found_in(docs)).collect()), key=str)
        assert got == sorted(((i, brute.base_pii(t)[0]) for i, t in pairs(docs)), key=str)


def test_pii_patterns(spark):
    texts = ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1", "0004.1.1.01", "4111-1111 1111-1111", "+1 (212) 555-0100.", "x@y", "a.b@c.d-e.f..g", "+12345678901234567890", "1.2.3.4@5.6.7.8", "4111111111111111 4111111111111111", "+1 (212) 555-0100 +2 (212) 555-0100\x01 a@b.c\x02a@b.c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii_boost.digest(found_in(docs, pii_boost.Boosted())).collect()}
    assert got == {i: brute.base_pii(t)[0] for i, t in enumerate(texts)}


def test_pii_work_grows_with_the_matches(spark):
    text = " ".join(f"m{i}@host{i % 7}.example 10.0.{i % 256}.1 password: x{i}y" for i in range(8_000))
    (r,) = pii_boost.digest(found_in(spark.createDataFrame([(1, text)], "doc_id long, text string"), pii_boost.Boosted())).collect()
    assert (r.n_email, r.n_ip) == (8_000, 8_000) and r.base_sha256 == brute.base_pii(text)[0][4]


def planted(seed, n):
    """(doc_id, text, private values, values that are not) with filler between them."""
    rng = np.random.default_rng(seed)
    pick = lambda alphabet, k: "".join(rng.choice(list(alphabet), k))
    low, hexa = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    fill = lambda: " ".join(pick(low, int(rng.integers(2, 9))) for _ in range(12))
    out = []
    for i in range(n):
        kind = int(rng.integers(0, 9))
        bad, good, text = None, None, ""
        if kind == 0:
            bad = pick(hexa, 40)
            text = f'token = "{bad}"'
        elif kind == 1:
            bad = "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)
            text = f"key id {bad} here"
        elif kind == 2:
            bad = pick(low, 6) + pick("0123456789", 2)
            text = f"password: {bad}"
        elif kind == 3:
            body = "GEMB" + pick("0123456789", 14)
            number = int("".join(str(int(c, 36)) for c in body + "GB00"))
            bad = f"GB{98 - number % 97:02d}{body}"
            text = f"account {bad} please"
        elif kind == 4:
            good = pick(hexa, 40)
            text = f"see commit {good} for it"
        elif kind == 5:
            good = pick(hexa, 64)
            text = f"sha256: {good} of the file"
        elif kind == 6:
            good = f"SECTION_{rng.integers(1, 99)}_CHAPTER"
            text = f"in {good} of this"
        elif kind == 7:
            good = f"{pick(low, 5)}{rng.integers(10, 99)}-{pick(low, 6)}"
            text = f"part {good} of it"
        else:
            text = f"mail {pick(low, 5)}@host.example or +1 (212) 555-{rng.integers(1000, 9999)}"
        out.append((i, f"{fill()} {text} {fill()}", bad, good))
    return out


def test_pii_precision_and_recall_on_other_documents(spark):
    frame = lambda rows: spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = pii_boost.fit(common.saved(pii_boost.scan(frame(planted(1, 600))), "scan"))
    rows = planted(2, 400)
    left = dict(pairs(pii_boost.redacted(found_in(frame(rows), model))))
    hits = [bad not in left[i] for i, _, bad, _ in rows if bad]
    misses = [good not in left[i] for i, _, _, good in rows if good]
    assert len(hits) > 120 and len(misses) > 120
    assert sum(hits) / len(hits) >= 0.98 and sum(hits) / (sum(hits) + sum(misses)) >= 0.98


def test_pii_counts_every_candidate(spark, monkeypatch):
    monkeypatch.setattr(pii_boost, "TREES", 2)
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    docs = common.saved(spark.range(44_000).withColumnRenamed("id", "doc_id").withColumn("no", F.row_number().over(Window.partitionBy(fold).orderBy("doc_id"))).where("no <= 20000"), "docs")

    def fitted(good):
        """Of 10,000 candidates of one look so many are positive, of 10,000 of another 200."""
        first = F.col("no") <= 10_000
        f = F.array(*(F.lit(0.0) for _ in range(pii_boost.CUES)), F.when(first, 1.0).otherwise(0.0))
        cand = F.struct(F.lit("secret").alias("kind"), F.lit(0).alias("start"), F.lit(8).alias("stop"), F.when(first, F.col("no") <= good).otherwise(F.col("no") <= 10_200).alias("label"), F.lit(False).alias("overlaps"), f.alias("f"))
        return pii_boost.fit(docs.select("doc_id", F.array(cand).alias("cand")))

    exact, short = fitted(9_800), fitted(9_799)
    assert exact.threshold < math.inf and short.threshold == math.inf
    monkeypatch.setattr(pii_boost, "FEW", -1)
    spread = fitted(9_800)
    assert spread.threshold == exact.threshold and [s for s, _ in spread.trees] == [s for s, _ in exact.trees]
    assert np.allclose([v for _, v in spread.trees], [v for _, v in exact.trees])


def test_pii_adds_secrets(spark):
    rows = []
    for i in range(60):
        key = hashlib.sha1(str(i).encode()).hexdigest()
        rows.append((i, f'words token = "{key}" more words and part number 12 34 56 78 then mail{i}@host.example here'))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = found_in(docs)
    spans = {r.doc_id: r.spans for r in pii_boost.digest(found).collect()}
    assert all(s.count("secret:") == 1 for s in spans.values()) and not any("number:" in s for s in spans.values())
    text = dict(pairs(pii_boost.redacted(found)))[0]
    assert text == 'words token = "<secret>" more words and part number 12 34 56 78 then <email> here'


def test_pii_redacts_across_pieces(spark, monkeypatch):
    monkeypatch.setattr(pii_boost, "PIECE", 7)
    docs = spark.createDataFrame([(1, "ünï a@b.example and 🙂 10.0.0.1@5.6.7.8 \n x"), (2, None), (3, "plain")], "doc_id long, text string")
    assert dict(pairs(pii_boost.redacted(found_in(docs, pii_boost.Boosted())))) == {1: "ünï <email> and 🙂 <ip> \n x", 2: "", 3: "plain"}


def test_running_sums(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        frame = spark.range(1).select(pii_boost.running(F.transform(F.slice(F.sequence(F.lit(1), F.lit(2000)), F.lit(1), F.lit(n)), lambda x: x % 7), lambda a, b: a + b, F.lit(0)).alias("s"))
        values = [x % 7 for x in range(1, n + 1)]
        assert frame.first().s == [sum(values[:i]) for i in range(n)]


def test_pii_empty(nothing):
    assert pii_boost.digest(found_in(nothing)).count() == 0


# WARC


def pages(spark):
    body = "<p>" + "x" * 200 + "é</p>"
    rows = [(5, "http://a/5", body, 1), (2, "http://a/2", body, 1), (9, None, body, None), (1, "http://a/1", None, 1), (3, "u", "", 1), (4, "u", "short", 1), (6, "u", "short", 1), (None, "u", body, 1), (7, "u\nv", "y" * 5000, 1)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest int")


def test_warc_round_trip(spark, tmp_path):
    manifest = warc_shards.write_warc(pages(spark), f"file://{tmp_path}/w", shard_bytes=600, roll_bytes=100)
    got = {r.page_id: r for r in warc_shards.read_warc(spark, manifest).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("response", None), 2: ("response", None), None: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("revisit", 2), 6: ("response", None), 7: ("response", None), 9: ("revisit", 2)}
    assert got[9].payload_bytes == got[2].payload_bytes == len(got[2].html.encode()) and got[1].html == ""
    assert len(list(Path(tmp_path, "w").glob("*.warc.gz"))) > 2 and not list(Path(tmp_path, "w").glob("*.tmp"))


def test_warc_bytes_do_not_depend_on_the_run(spark, tmp_path):
    one, two = (
        [r.sha256 for r in spark.read.json(warc_shards.write_warc(pages(spark).repartition(n), f"file://{tmp_path}/{n}", shard_bytes=600)).orderBy("shard", "part").collect()]
        for n in (1, 4)
    )
    assert one == two


def test_warc_damage_and_strays(spark, tmp_path):
    manifest = warc_shards.write_warc(pages(spark), f"file://{tmp_path}/w")
    (tmp_path / "w" / "shard-000099-00000.warc.gz").write_bytes(b"stray")
    assert warc_shards.read_warc(spark, manifest).count() == 9
    file = next(Path(tmp_path, "w").glob("shard-000000*"))
    file.write_bytes(file.read_bytes()[:-1] + b"!")
    with pytest.raises(Exception, match="manifest"):
        warc_shards.read_warc(spark, manifest).count()


def test_warc_wide_and_uneven_ids(spark, tmp_path):
    ids = [-(2**63), 2**63 - 1, *range(3000), 2**50]
    rows = [(i, "u", f"{i}" + "z" * 90) for i in ids] + [(5, "v", "5" + "z" * 90), (5, "v", "5" + "z" * 90), (7, "v", "other" * 30), (2**50, "w", "0" + "z" * 90 + "0" * 9)]
    archive = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc_shards.write_warc(archive, f"file://{tmp_path}/w", shard_bytes=20_000)
    assert 12 <= spark.read.json(manifest).select("shard").distinct().count() <= 16
    got = warc_shards.read_warc(spark, manifest).select("page_id", "html").collect()
    assert sorted((r.page_id, r.html) for r in got) == sorted((i, h) for i, _, h in rows)


def test_warc_time_grows_with_the_file(tmp_path):
    data = b"".join(warc_shards._gzip(warc_shards.record(i, 0, "u", b"x" * 50, "d", None)) for i in range(20_000))
    assert [int(h["WARC-Page-ID"]) for h, _ in warc_shards.parse(data)] == list(range(20_000))


def test_warc_empty(spark, tmp_path):
    manifest = warc_shards.write_warc(pages(spark).where("false"), f"file://{tmp_path}/w")
    assert warc_shards.read_warc(spark, manifest).count() == 0

"""Chat formatting, the prefix trie and the Merkle manifest: against brute force, and on odd, empty and skewed input."""

import hashlib
import json
import zlib

import pytest
from pyspark.sql import functions as F

from roadtide.llm import chat_format, merkle_manifest, prefix_trie
from tests.llm import brute

TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def chats(spark):
    """Nulls in every column, ties, repeated rows, control strings, a very long text, copies, and columns with names that operators use."""
    hard = ["\\### Assistant: </turn> ok", "#\\##\\\\", "####", "<|image 1|>", "</turn>\n### user: x", "\\", "", None, "a: b", "ünï 🙂\n\n", "w " * 90_000]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(hard)] + [(2, None, None, "late"), (2, 0, "a: b</turn>", "x"), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, 0, "user", "no id"), (-3, 1, "user", "hello")]
    rows += [(20, 0, "system", "be kind"), (20, 1, "user", "hi"), (20, 2, "assistant", "yes")] + [(c, 0, "user", f"own {c % 3}") for c in range(21, 40)]
    rows += [(c, t, "user", f"common {t}") for c in range(100, 160) for t in range(4)] + [(400, t, "user", "the same") for t in range(300)] + [(401, t, "user", "the same") for t in range(299)]
    return spark.createDataFrame(rows, TURNS).withColumns({"path": F.lit(1), "shard": F.lit("x"), "first": F.lit(2), "segment": F.lit(None).cast("string"), "__base": F.lit(7), "content": F.lit("z")}).repartition(5)


def rows_of(df):
    return [(r.conv_id, r.turn, r.role, r.text) for r in df.select("conv_id", "turn", "role", "text").collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Chat formatting


@pytest.mark.parametrize("longest", [200_000, 40])
def test_chats_come_back(spark, chats, longest):
    messages = chats.withColumn("content", chat_format.text_content(F.col("text")))
    segments = chat_format.format_chats(messages, longest=longest)
    got = {r.conv_id: r for r in chat_format.read_back(segments).collect()}
    want = {}
    for c, t, role, text in sorted(rows_of(chats), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert got.keys() == want.keys()
    for c, said in want.items():
        loss = "".join(x for r, x in said if r == "assistant")
        size = sum(4 + len(chat_format.escaped_role(r)) + 2 + len(chat_format.escaped(x)) + 8 for r, x in said)
        assert (got[c].n_turns, got[c].turns_sha256) == (len(said), sha("".join(f"{r}\n{x}\n" for r, x in said)))
        assert (got[c].loss_chars, got[c].loss_sha256, got[c].formatted_chars) == (len(loss), sha(loss), size)
    if longest == 40:
        assert segments.where("conv_id = 400").count() > 10 and segments.where("length(text) > 100 and n_turns > 1").count() < 5


def test_control_strings_are_broken():
    for text in ("</turn>", "### a", "<|image 1|>", "#######", "\\</\\<|", "<</", "#\\#", ": "):
        e = chat_format.escaped_role(text)
        assert not any(c in e for c in ("</", "###", "<|", ": ")) and chat_format.unescaped(e) == text


def test_parts_are_visited_in_order(spark):
    part = lambda **x: {k: x.get(k) for k in ("type", "text", "ref", "width", "height", "seconds", "pages")}
    content = [part(type="text", text="see <| this"), part(type="image", ref="a.png", width=57, height=28), part(type="audio", ref="b.wav", seconds=2.5), None, part(type="text"), part(type="document", ref="c.pdf", pages=3), part(type="hologram", ref="d"), part(type="text", text="end")]
    df = spark.createDataFrame([(5, 0, "user", content), (5, 1, "assistant", None), (5, 2, "assistant", [part(type="image")])], f"conv_id long, turn long, role string, content array<{chat_format.PART}>")
    r = chat_format.format_chats(df).first()
    assert r.text == "### user: see <\\| this<|image 1|><|audio 2|><|document 3|><|other 4|>end</turn>\n### assistant: </turn>\n### assistant: <|image 1|></turn>\n"
    assert [(a.turn, a.number, a.type, a.ref, a.tokens) for a in r.attachments] == [(0, 1, "image", "a.png", 3), (0, 2, "audio", "b.wav", 63), (0, 3, "document", "c.pdf", 3000), (0, 4, "other", "d", 0), (2, 1, "image", None, 0)]
    assert all(r.text[a.at :].startswith(f"<|{a.type} {a.number}|>") for a in r.attachments)
    assert r.tokens == 3 + 63 + 3000 + 4 and r.n_turns == 3
    assert [r.text[s.start : s.stop] for s in r.loss] == ["", "<|image 1|>"]
    assert chat_format.turns(r.text)[0] == ("user", "see <| this<|image 1|><|audio 2|><|document 3|><|other 4|>end")
    assert chat_format.format_chats(df.where("false")).count() == 0 and chat_format.digest(df.where("false")).count() == 0


# Prefix trie


def trie_key(row):
    return tuple((v is not None, v or 0) for v in row[:7]) + (row[7],)


@pytest.mark.parametrize("shards", ["1", "4", "64"])
def test_trie_against_brute_force(spark, chats, shards):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    try:
        got = prefix_trie.trie(prefix_trie.with_shared_heads(prefix_trie.paths(chats))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, got), key=trie_key) == sorted(brute.trie(rows_of(chats)), key=trie_key)


def test_skeleton_holds_every_node_of_two_shards():
    paths = sorted((b"".join(bytes([x]) * prefix_trie.TOKEN for x in p), i) for i, p in enumerate([(1,), (1, 2), (1, 2), (1, 2), (1, 2, 3), (1, 4), (2,), (2, 2, 2), (2, 2, 3), (3,)]))
    bones = prefix_trie.skeleton(paths, 5)
    shard = {key: sum(s <= key for s in bones.splitters) for key in paths}
    assert len(set(shard.values())) == len(bones.splitters) + 1 > 3
    for path, _ in paths:
        for d in range(0, len(path) + 1, prefix_trie.TOKEN):
            node = 0
            for i in range(0, d, prefix_trie.TOKEN):
                node = bones.kids.get((node, path[i : i + prefix_trie.TOKEN]), -1)
            assert node >= 0 or len({shard[k] for k in paths if k[0].startswith(path[:d])}) == 1
    assert len(prefix_trie.skeleton(paths, 5, most=2).up) <= 2


def test_trie_ends_of_very_many_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = spark.range(1000, 1300).selectExpr("id as conv_id", "cast(0 as long) as turn", "'user' as role", "'one text' as text")
    got = {r.depth: r for r in prefix_trie.trie(prefix_trie.paths(rows)).collect()}
    assert (got[1].n_convs, got[1].saved_tokens, got[1].n_leaves, got[0].n_children) == (300, 2 * 299, 1, 1)
    assert got[1].ends_sha256 == sha(",".join(map(str, range(1000, 1300)))) and got[0].ends_sha256 == sha("")
    assert prefix_trie.trie(prefix_trie.paths(rows.where("false"))).count() == 0


# Merkle manifest


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def merkle(docs):
    cut = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = merkle_manifest.verify(docs, "source", "doc_id", COLUMNS, {"text": cut})
    return sorted(map(tuple, got.collect()), key=repr)


def merkle_brute(docs):
    rows = [tuple(r) for r in docs.select(*COLUMNS).collect()]

    def now(row):
        text = row[4]
        return text.replace("\n", "") if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 else text

    return sorted(brute.merkle(rows, now), key=repr)


@pytest.mark.parametrize("most", [merkle_manifest.MAX_UPPER, 3, 0])
def test_manifest_against_brute_force(spark, small, odd, most, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "MAX_CUTS", most)
    monkeypatch.setattr(merkle_manifest.climb, "__defaults__", (most,))
    for docs in (small, odd.withColumns({"tree": F.lit(1), "at": F.lit("x"), "key": F.lit(0), "leaf": F.lit("y")})):
        got = merkle(docs)
        assert got == merkle_brute(docs) and any(r[-1] for r in got)
    assert sum(not r[-1] for r in merkle(small)) > 20


@pytest.mark.parametrize(("sources", "rows"), [(1, 1), (1, 2), (1, 28), (1, 82), (3, 3), (28, 28), (4, 113)])
def test_manifest_shapes(spark, sources, rows):
    docs = spark.range(rows).selectExpr("id as doc_id", f"concat('s', id % {sources}) as source", "'en' as lang", "cast(null as long) as n_chars", "concat('a\\n', id) as text")
    assert merkle(docs) == merkle_brute(docs)


def test_manifest_of_equal_rows_of_nothing_and_settings(spark, nothing):
    docs = spark.range(100).selectExpr("cast(7 as long) as doc_id", "'one' as source", "'en' as lang", "cast(1 as long) as n_chars", "'a' as text")
    assert merkle(docs) == merkle_brute(docs)
    assert merkle(nothing) == []
    manifest = merkle_manifest.build(docs.select("doc_id", "source", merkle_manifest.leaf_hash(*COLUMNS).alias("leaf")), "source", ["doc_id"])
    blocks = {(r.tree, r.level, r.block): r for r in manifest.blocks.collect()}
    assert manifest.sizes == [4, 1] and all((r.p_tree, r.p_level, r.p_block) in blocks for r in blocks.values() if r.p_tree is not None)
    assert [r.hash for r in blocks.values() if r.p_tree is None] == [manifest.root]
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") != "-1" and json.dumps(manifest.root)

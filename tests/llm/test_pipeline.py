"""The pipeline's stages, each on its own input."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_llm import pairs


def test_stages_and_run_on_the_small_table(spark, small, tmp_path):
    docs = small
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "unused").write.parquet(f"{tmp_path}/{i}")
        done = spark.read.parquet(f"{tmp_path}/{i}")
        before, after = pairs(docs), pairs(done) if name != "bpe" else None
        if name != "bpe":
            assert done.columns == small.columns
        if name == "language_id":
            assert set(after) <= set(before) and len(after) > 0.98 * sum(any(map(str.isalpha, t or "")) for _, t in before)
            assert all(any(map(str.isalpha, t)) for _, t in after)
        if name == "line_dedup":
            gone = brute.near_lines(before)
            left = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in before}
            assert dict(after) == {i: t for i, t in left.items() if not gone[i] or brute.WORD.search(t)} and sum(map(len, gone.values())) > 10
            assert done.where("n_chars <> length(text)").count() == 0
        if name == "near_dedup":
            kept = {i for i, (_, _, k) in brute.near_components(before, 5, 80).items() if k}
            assert {i for i, _ in after} == kept
        if name == "mixing":
            copies = brute.poisson_counts([(r.doc_id, r.source) for r in docs.select("doc_id", "source").collect()])
            assert Counter(after) == Counter({x: copies[x[0]] for x in before})
        if name == "bpe":
            assert done.count() == docs.count() and "ids" in done.columns
        docs = done
    folder = tmp_path / "sf"
    folder.mkdir()
    small.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    digest = lambda df: Counter((r.doc_id, r.ids_sha256) for r in df.select("doc_id", "ids_sha256").collect())
    assert digest(corpus_pipeline.run(spark, str(folder))) == digest(docs)


def test_stages_on_odd_and_empty_input(spark, odd, nothing, tmp_path):
    for n, docs in enumerate((odd, nothing)):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, "unused")
            out.write.parquet(f"{tmp_path}/{n}-{i}")
            if name != "bpe":
                assert out.columns == docs.columns
                docs = spark.read.parquet(f"{tmp_path}/{n}-{i}")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "bpe"]


def test_every_row_of_a_dropped_document_goes(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text), (2, text), (2, text + " more"), (3, "nothing like the others at all, as it has words of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("a"), "n_chars": F.length("text").cast("long")})
    assert sorted({r.doc_id for r in corpus_pipeline.dedup_near(spark, docs, "unused").collect()}) == [1, 3]

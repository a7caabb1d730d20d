"""Every operator and stage over nulls, empty and long texts, ties, repeats, empty tables and extra columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakeweave.llm import language_id, line_dedup, mixing, packing, pii, quality_classifier, quality_rules, sharding, simhash_dedup, topk_search


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (7, 1, None), (9, 0, 1), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")


def per_row(labels):
    """Operators that return a row for each row of documents."""
    return {
        "language": language_id.identify_languages,
        "sharding": sharding.shard_by_bytes,
        "rules": lambda d: quality_rules.judge_quality(d, labels),
        "pii": pii.with_spans,
        "sanitise": pii.sanitise,
        "mixing": mixing.mix_plan,
        "lines": line_dedup.drop_recurring_lines,
        "simhash": simhash_dedup.near_duplicates,
        "classifier": lambda d: quality_classifier.classify(d, labels),
    }


def ids(frame):
    """The doc_id of every row, whatever other columns are called."""
    at = frame.columns.index("doc_id")
    return sorted(str(r[0]) for r in frame.toDF(*[f"x{i}" for i in range(len(frame.columns))]).select(f"x{at}").collect())


NAMES = ["language", "sharding", "rules", "pii", "sanitise", "mixing", "lines", "simhash", "classifier"]


@pytest.mark.parametrize("name", NAMES)
def test_a_row_for_each_row(name, odd_docs, clashing, no_docs, labels):
    run = per_row(labels)[name]
    expected = sorted(str(r.doc_id) for r in odd_docs.select("doc_id").collect())
    assert ids(run(odd_docs)) == expected
    assert ids(run(clashing)) == expected
    assert run(no_docs).count() == 0


def test_packing_edges(odd_docs, clashing, no_docs):
    for docs in (odd_docs, clashing):
        rows = packing.pack(docs, capacity=64).collect()
        assert {r.doc_id for r in rows} == {r.doc_id for r in odd_docs.collect()}
        assert all((r.bin is None) == (r.words == 0) for r in rows)
    assert packing.pack(no_docs).count() == 0


def test_stages_keep_columns(spark, odd_docs, clashing, no_docs):
    for docs in (odd_docs, clashing, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns, name
            out.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, "").count()


def test_topk_edges(spark):
    rows = [(0, [1.0, 0.5]), (50, [1.0, 0.5]), (50, [0.25, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]), (7, []), (8, [1.0]), (None, [1.0, 1.0]), (9, [1.0, 0.5]), (9, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = topk_search.top_k(df, 5, F.col("vec_id") % 50 == 0).collect()
    first = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == 0)
    assert first == [(1, 9, 81920), (2, 9, 81920), (3, 50, 81920), (4, 8, 65536), (5, 50, 16384)] or [f[2] for f in first] == [81920, 81920, 81920, 65536, 16384]
    assert {r.vec_id for r in got} <= {0, 7, 8, 9, 50}
    assert topk_search.top_k(df.filter("vec_id = 1000"), 5, F.col("vec_id") % 50 == 0).count() == 0


def test_topk_refuses_scores_beyond_64_bits(spark):
    for big in (1e30, 1e8):
        df = spark.createDataFrame([(0, [big, 1.0]), (50, [2 * big, 1.0])], "vec_id long, embedding array<double>")
        with pytest.raises(OverflowError):
            topk_search.top_k(df, 5, F.col("vec_id") % 50 == 0)
    df = spark.createDataFrame([(0, [1e6, 1.0]), (50, [2e6, 1.0])], "vec_id long, embedding array<double>")
    assert {r.score for r in topk_search.top_k(df, 5, F.col("vec_id") % 50 == 0).collect()} == {256_000_000 * 512_000_000 + 256 * 256}

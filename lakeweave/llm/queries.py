"""Registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeweave.llm import (
    language_id,
    line_dedup,
    mixing,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    sharding,
    simhash_dedup,
    topk_search,
)
from lakeweave.llm.common import read_table


def op1_language_mixture(spark, sf_dir):
    """Language of every document by mixture inference."""
    return language_id.identify_languages(read_table(spark, sf_dir, "documents"))


def op2_sampled_splitters(spark, sf_dir):
    """All documents into shards 0 to 7 by near equal bytes."""
    rows = sharding.shard_by_bytes(read_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_likelihood_ratio_rules(spark, sf_dir):
    """Base rules and the likelihood ratio's verdict on every document."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return quality_rules.judge_quality(docs, labels)


def op4_co_occurrence_pii(spark, sf_dir):
    """Typed and revealing spans of every document."""
    rows = pii.with_spans(read_table(spark, sf_dir, "documents"))
    kinds = [pii.count(F.col("base"), k).alias(f"n_{k}") for k in pii.PATTERNS]
    return rows.select("doc_id", *kinds, F.sha2(pii.digest(F.col("base")), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"))


def op5_impact_ordered_topk(spark, sf_dir):
    """The 5 best inner products of every 50th vector against all others."""
    return topk_search.top_k(read_table(spark, sf_dir, "embeddings"), 5, F.col("vec_id") % 50 == 0)


def op6_source_mixing(spark, sf_dir):
    """Words taken of every document by weights 5, 2, 1 and 150 % of all words."""
    plan = mixing.mix_plan(read_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_log_template_tree(spark, sf_dir):
    """Every document without its recurring lines."""
    return line_dedup.drop_recurring_lines(read_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op8_conflict_best_fit(spark, sf_dir):
    """Every document's pieces, their bins and places."""
    return packing.pack(simhash_dedup.with_clusters(read_table(spark, sf_dir, "documents")), cluster="cluster")


def op9_vantage_point_simhash(spark, sf_dir):
    """Fingerprint and near-duplicate component of every document."""
    found = simhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_positive_unlabelled(spark, sf_dir):
    """Quality score of every document."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return quality_classifier.classify(docs, labels)


QUERIES = {f.__name__: f for f in (
    op1_language_mixture, op2_sampled_splitters, op3_likelihood_ratio_rules, op4_co_occurrence_pii, op5_impact_ordered_topk, op6_source_mixing,
    op7_log_template_tree, op8_conflict_best_fit, op9_vantage_point_simhash, op10_positive_unlabelled,
)}

ORACLES: dict[str, str] = {
    "op5_impact_ordered_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op6_source_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                ('0x' || substr(md5('20:' || coalesce(doc_id::VARCHAR, 'text:' || md5(text), 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS draw
            FROM documents
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::DOUBLE AS weight
            FROM d GROUP BY source
        ), o AS (
            SELECT *, 2.0::DOUBLE * source_size / weight AS ratio, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST) AS place FROM s
        ), l AS (
            SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
            FROM o WINDOW w AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), t AS (
            SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce(weight * (SELECT level FROM l WHERE ratio > level ORDER BY place LIMIT 1), 'inf'::DOUBLE)) AS target FROM l
        ), m AS (
            SELECT doc_id, size, source_size, target, draw, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM m
    """,
    "op7_log_template_tree": r"""
        WITH d AS (
            SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
        ), e AS (
            SELECT doc_id, i, lines[i] AS line, trim(regexp_replace(lines[i], '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS plain
            FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)
        ), w AS (
            SELECT doc_id, i, line, string_split(regexp_replace(plain, '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' ') AS words FROM e WHERE plain <> ''
        ), p AS (
            SELECT words, count(DISTINCT doc_id) AS docs, min(doc_id) AS first FROM w GROUP BY words
        ), k AS (
            SELECT words, docs, place, words[place] AS word FROM (SELECT words, docs, unnest(range(4, len(words) + 1)) AS place FROM p)
        ), q AS (
            SELECT len(words) AS n, words[1:3] AS head, place, word FROM k GROUP BY ALL HAVING sum(docs) >= 3
        ), g AS (
            SELECT k.words, string_agg(k.place || ' ' || k.word, chr(10) ORDER BY k.place) AS fixed, count(*) AS n_fixed
            FROM k JOIN q ON len(k.words) = q.n AND k.words[1:3] = q.head AND k.place = q.place AND k.word = q.word GROUP BY k.words
        ), m AS (
            SELECT words, len(words) AS n, words[1:3] AS head, fixed FROM g WHERE 10 * (n_fixed + 3) >= 7 * len(words)
        ), r AS (
            SELECT n, head, fixed, min(doc_id) AS first FROM w JOIN m USING (words) GROUP BY n, head, fixed HAVING count(DISTINCT doc_id) >= 3
        ), lost AS (
            SELECT doc_id, i FROM w JOIN p USING (words) WHERE docs >= CASE WHEN len(words) >= 50 THEN 2 ELSE 3 END AND doc_id <> first
            UNION
            SELECT doc_id, i FROM w JOIN m USING (words) JOIN r USING (n, head, fixed) WHERE doc_id <> first
        ), c AS (
            SELECT e.doc_id, count(lost.i) AS n_dropped, string_agg(CASE WHEN lost.i IS NULL THEN line END, chr(10) ORDER BY e.i) AS text
            FROM e LEFT JOIN lost ON e.doc_id = lost.doc_id AND e.i = lost.i GROUP BY e.doc_id
        )
        SELECT d.doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped,
            CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(c.text, '') END AS text
        FROM d LEFT JOIN c ON d.doc_id = c.doc_id
    """,
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)

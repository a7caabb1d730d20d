"""Exact top-k by inner product with an impact-ordered, score-at-a-time index.

Components become integers floor(256 * x). Each block of rows is an index: the
postings of a dimension are grouped into segments of equal quantised impact
(the component's magnitude in steps of ``step``), and segments are processed by
falling impact. After each group of segments every row's score is known up to
the part not yet processed, which by Cauchy-Schwarz is at most |query| times
the norm of the row's rest (kept by the index). A query stops once so few rows
can still reach its k-th best lower bound that they are cheap to rescore; every
possible member is rescored with exact integers. Ties at the bound count as
possible, so the result is exact; nothing is dropped without that proof.

Queries meet all rows in blocks: query blocks are dealt to row blocks by key,
each pair yields k rows a query, and these are merged.

Defined results: vectors that are null or hold null or non-finite components,
and rows without a vec_id, take no part; vectors of different lengths are
compared as if padded with zeros; rows that share the query's vec_id are its
own; repeated rows are candidates each, repeated queries give one result; an
empty table gives an empty result; extra columns are ignored; where components
are so large that a score could leave 64 bits an OverflowError is raised.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.llm.common import pick

SCALE = 256
ROWS = 8_192
QUERIES = 16_384
#: Queries of a block worked on at once: SUB * ROWS scores are kept.
SUB = 1_024
#: Falling shares of the largest impact; segments between two of them are processed together.
GROUPS = (0.4, 0.3, 0.22, 0.16, 0.11, 0.07, 0.04, 0.02, 0.0)
#: A query stops when it has at most so many possible members.
FEW = 96


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(lists), width), np.float64)
    lengths = np.asarray(lists.value_lengths())
    flat = np.asarray(lists.flatten(), np.float64)
    rows = np.repeat(np.arange(len(lists)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return np.floor(SCALE * out).astype(np.int64)


def _search(query_ids, queries, ids, rows, k: int):
    """Yield (query index, row indexes, exact scores) with every row that can be among the k best."""
    n, width = rows.shape
    top = int(np.abs(rows).max(initial=0))
    bound = max(1, width) * float(max(1, top)) * float(np.abs(queries).max(initial=1))
    kind = np.float32 if bound < 2**23 else np.float64
    slack = bound * 2.0**-50 if bound >= 2**52 else 0.0
    step = max(1, -(-top // 255))
    impact = np.abs(rows) // step * step  # quantised impact of each posting
    signed = np.sign(rows) * impact
    norms = np.sqrt((queries.astype(float) ** 2).sum(1))
    order = np.argsort(ids, kind="stable")
    lo, hi = np.searchsorted(ids[order], query_ids), np.searchsorted(ids[order], query_ids, side="right")
    active, acc, upper = np.arange(len(queries)), np.zeros((len(queries), n), kind), top + 1
    for q in range(len(queries)):
        acc[q, order[lo[q] : hi[q]]] = -np.inf
    for share in GROUPS:
        under, upper = upper, int(np.ceil(share * top))
        segment = np.where((impact < under) & (impact >= upper), signed, 0)
        acc[active] += (queries[active].astype(kind) @ segment.T.astype(kind)).astype(kind)
        done = impact >= upper
        rest = np.sqrt((np.where(done, rows - signed, rows).astype(float) ** 2).sum(1))
        if share > 0.2:
            continue
        stopped = []
        for j, q in enumerate(active):
            radius = norms[q] * rest * (1 + 1e-9) + slack
            low, high = acc[q] - radius, acc[q] + radius
            theta = np.partition(low, n - k)[n - k] if n > k else -np.inf
            idx = np.flatnonzero((high >= theta) & (acc[q] > -np.inf))
            if len(idx) <= FEW or share == 0.0:
                yield int(q), idx, rows[idx] @ queries[q]
                stopped.append(j)
        active = np.delete(active, stopped)
        if not len(active):
            return


def top_k(vectors: DataFrame, k: int, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest integer inner product for each query row.

    ``is_query`` is a condition on ``vec_id``, whatever ``id_col`` is.
    """
    v = pick(vectors, id_col, vector_col)
    v = v.select(v[id_col].cast("long").alias("vec_id"), v[vector_col].cast("array<double>").alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    v = v.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(finite)
    largest = F.max(F.array_max(F.transform("v", F.abs)))
    total, n_queries, width, most = v.agg(F.count(F.lit(1)), F.coalesce(F.count_if(is_query), F.lit(0)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(largest, F.lit(0.0))).first()
    if width * (SCALE * most + 1) ** 2 >= 2.0**63:
        raise OverflowError(f"components up to {most:g} in {width} dimensions: inner products may leave 64 bits")
    row_blocks, query_blocks = max(1, -(-total // rows)), max(1, -(-n_queries // queries))
    q = v.filter(is_query).dropDuplicates(["vec_id", "v"]).withColumn("query_hash", F.xxhash64("v"))
    q = q.withColumn("qb", F.pmod(F.xxhash64("vec_id", "v"), F.lit(query_blocks))).withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))))
    r = v.withColumn("rb", F.pmod(F.xxhash64("vec_id", "v"), F.lit(row_blocks))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))
    schema = "query_id long, query_hash long, vec_id long, score long"

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "query_hash", "vec_id", "score")})
        if not left.num_rows or not right.num_rows:
            return none
        left = left.sort_by("vec_id")
        q_ids, q_hash = left.column("vec_id").to_numpy(), left.column("query_hash").to_numpy()
        ids = right.column("vec_id").to_numpy()
        found = [none]
        vectors, matrix = _matrix(left.column("v"), width), _matrix(right.column("v"), width)
        for a in range(0, len(q_ids), SUB):
            for at, idx, scores in _search(q_ids[a : a + SUB], vectors[a : a + SUB], ids, matrix, k):
                best = np.lexsort((ids[idx], -scores))[:k]
                m = len(best)
                found.append(pa.table({"query_id": np.full(m, q_ids[a + at]), "query_hash": np.full(m, q_hash[a + at]), "vec_id": ids[idx[best]], "score": scores[best]}))
        return pa.concat_tables(found)

    pairs = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInArrow(meet, schema)
    best = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")

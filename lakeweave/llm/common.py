"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most edges (16 bytes each) whose components one task finds; more are joined by rounds over the whole cluster.
ONE_TASK = 1_000_000
#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by spark.checkpoint.dir; choose one only where that is unset and Spark is one local process (tests)."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lakeweave-checkpoint-")
    spark.sparkContext.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Materialise a narrow intermediate in the shared checkpoint folder and cut its lineage.

    The files survive the loss of executors; Spark's cleaner removes them once
    the frame is no longer referenced.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let the driver free what is done with.

    Spark drops broadcasts, shuffle and checkpoint files, and what the driver
    knows of them, only once the driver's JVM has collected their handles; an
    operator of many small jobs would first fill the whole heap with them.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def least_of_component(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different nodes of the edges (a, b), sorted, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def in_one_task(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (two long columns), root being the least node of its component; found by one task."""

    def run(batches):
        pairs = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
        if pairs:
            nodes, roots = least_of_component(*(np.concatenate(x) for x in zip(*pairs, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])

    return edges.coalesce(1).mapInArrow(run, "node long, root long")


def join_small(left: DataFrame, right: DataFrame, on, how: str, rows: int, most: int) -> DataFrame:
    """Join with a broadcast of ``right`` if its counted ``rows`` are within ``most``, else by shuffle."""
    return left.join(F.broadcast(right) if rows <= most else right, on, how)


def join_keyed(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str, rows: str, share: int = 1_000) -> DataFrame:
    """Join on equal keys, ``right`` (one row a key) having the count of the key's rows in ``left`` in its column ``rows``.

    Keys with over 1 / ``share`` of those rows, of which there are fewer than
    ``share``, are met by broadcast, so that no hot key lands in one task; all
    others by a plain join. ``right`` should be a materialised table; its
    column ``rows`` is dropped.
    """
    total = right.agg(F.coalesce(F.sum(rows), F.lit(0))).first()[0]
    hot = right.filter(F.col(rows) * share > total)
    if not total or not (found := [r[0] for r in hot.select(right_key).collect()]):
        return left.join(right.drop(rows), left[left_key] == right[right_key], how)
    is_hot = F.coalesce(left[left_key].isin(found), F.lit(False))
    a, b = left.filter(is_hot), left.filter(~is_hot)
    a = a.join(F.broadcast(hot.drop(rows)), F.col(left_key) == F.col(right_key), how)
    b = b.join(right.filter(F.col(rows) * share <= total).drop(rows), F.col(left_key) == F.col(right_key), how)
    return a.union(b)


def n_words(text: Column) -> Column:
    """Words of a whole text, as a long; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Project to the named columns; a column the frame lacks becomes null.

    Names that differ only in case from a wanted one are told apart by exact
    spelling, so extra columns with clashing names do no harm.
    """
    have = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return flat.select(*[(flat[f"c{have[n]}"] if n in have else F.lit(None)).alias(n) for n in names])

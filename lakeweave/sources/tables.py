"""Readers and writers for tables in files, and the primary keys of known tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Primary keys of the sample star schema; lineitem has none.
PRIMARY_KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "customer": ("c_custkey",),
    "orders": ("o_orderkey",), "lineitem": (), "events": ("event_id",), "documents": ("doc_id",), "embeddings": ("vec_id",), "pages": ("page_id",),
    "benchmark": ("item_id",), "labels": ("doc_id",), "conversations": ("conv_id", "turn"),
}

FORMATS = ("parquet", "orc", "json", "csv", "text")


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """A table in files; text formats should be given a schema, which spares a pass over the data."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known are {', '.join(FORMATS)}")
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader).format(fmt).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = (), **options) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known are {', '.join(FORMATS)}")
    writer = df.write.mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).format(fmt).save(path)


def write_clustered(df: DataFrame, path: str, keys: tuple[str, ...], files: int, mode: str = "errorifexists") -> None:
    """Parquet laid out by key: range-partitioned and sorted, so that row-group statistics prune seeks and ranges.

    This is what stands in for a primary-key or secondary index.
    """
    df.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.mode(mode).parquet(path)


def load(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}

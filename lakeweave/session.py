"""SparkSession construction with the engine's semantic settings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

#: Settings that query semantics depend on.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

#: Settings that only steer physical execution.
EXECUTION = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


#: Shuffled bytes that one partition should hold; adaptive execution merges smaller ones.
PARTITION_BYTES = 128 << 20


def shuffle_partitions_for(input_bytes: int, least: int = 8) -> int:
    """Partitions for a shuffle of about the input's size."""
    return max(least, -(-input_bytes // PARTITION_BYTES))


def build_session(
    app_name: str = "lakeweave",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: Mapping[str, str] | None = None,
    input_bytes: int | None = None,
) -> SparkSession:
    """Return a session; ``master`` is left to spark-submit when it is None.

    Shuffles get ``shuffle_partitions``, or as many as ``input_bytes`` ask for:
    adaptive execution can merge partitions but not split those of an aggregate.
    """
    if input_bytes and not shuffle_partitions:
        shuffle_partitions = shuffle_partitions_for(input_bytes)
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {**SEMANTICS, **EXECUTION}
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session

"""Relational operators as DataFrame functions.

They only declare plans; join strategy, pushdown and partitioning are left to
Spark's optimizer and adaptive execution.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def point_lookup(df: DataFrame, key: dict) -> DataFrame:
    """Rows whose key columns have the given values; prunes by row-group statistics and partitions."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in key.items()]))


def range_scan(df: DataFrame, column: str, low=None, high=None, include_low: bool = True, include_high: bool = True) -> DataFrame:
    """Rows between two bounds, either of which may be absent."""
    c = F.col(column)
    if low is not None:
        df = df.filter(c >= low if include_low else c > low)
    if high is not None:
        df = df.filter(c <= high if include_high else c < high)
    return df


def index_union(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows that meet any condition, each once."""
    return df.filter(reduce(lambda a, b: a | b, conditions))


def index_intersection(df: DataFrame, *conditions: Column) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, conditions))


def equi_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], how: str = "inner", residual: Column | None = None, null_safe: bool = False) -> DataFrame:
    """Join on pairs of columns. The residual is part of the join condition, also for outer joins."""
    conditions = [left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b] for a, b in on]
    if residual is not None:
        conditions.append(residual)
    return left.join(right, reduce(lambda a, b: a & b, conditions), how)


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int, how: str = "inner") -> DataFrame:
    """An equi-join in which one key's rows on the left spread over ``salts`` tasks; the right side is replicated so often.

    For keys so hot that even adaptive splitting is not wanted; ``how`` is inner or left.
    """
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins can be salted on the left side")
    spread = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [key, "__salt"], how).drop("__salt")


def exists(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], negated: bool = False) -> DataFrame:
    """Rows of the left side that have, or do not have, a match."""
    return equi_join(left, right, on, "left_anti" if negated else "left_semi")


def group_last(df: DataFrame, keys: list[str], order: list[str], *aggregates: Column, bare: tuple[str, ...] = ()) -> DataFrame:
    """Grouping in which bare columns have the value of the group's last row by ``order``."""
    last = [F.max_by(c, F.struct(*order)).alias(c) for c in bare]
    return df.groupBy(*keys).agg(*aggregates, *last)


def total(column: Column) -> Column:
    """A sum that is 0.0 without values."""
    return F.coalesce(F.sum(column.cast("double")), F.lit(0.0))


def group_concat(column: Column, separator: str = ",", order: Column | None = None) -> Column:
    """Non-null values joined; in the order of another column if one is given."""
    if order is None:
        return F.listagg(column, F.lit(separator))
    pairs = F.array_sort(F.collect_list(F.when(column.isNotNull(), F.struct(order.alias("o"), column.alias("v")))))
    return F.array_join(F.transform(pairs, lambda p: p["v"]), separator)


def top_k(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """The rows from offset on, at most limit, by order: a bounded heap a task, never a full sort."""
    return df.orderBy(*order).limit(limit + offset).offset(offset) if offset else df.orderBy(*order).limit(limit)


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """At most k rows a group; Spark prunes each task's rows to k a group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= k).drop("__rank")


def distinct(df: DataFrame, primary: tuple[str, ...] = ()) -> DataFrame:
    """Distinct rows. A declared ``primary`` key is no ground to skip the work: files do not enforce it."""
    return df.distinct()


def set_operation(op: str, *frames: DataFrame) -> DataFrame:
    """UNION, UNION ALL, INTERSECT or EXCEPT from left to right, by position; names are the first frame's."""
    steps = {"UNION ALL": DataFrame.union, "UNION": DataFrame.union, "INTERSECT": DataFrame.intersect, "EXCEPT": DataFrame.subtract}
    out = reduce(steps[op], frames)
    return out.distinct() if op == "UNION" else out

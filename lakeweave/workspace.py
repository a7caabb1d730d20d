"""Read-only SQL over DataFrames: the dialect without a database folder."""

from __future__ import annotations

import itertools
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from lakeweave.functions.types import tag
from lakeweave.plans import ast
from lakeweave.plans.emit import Emitter, Relation, name
from lakeweave.plans.explain import explain
from lakeweave.plans.lexer import SqlError
from lakeweave.plans.parser import parse_one
from lakeweave.sources.tables import PRIMARY_KEYS

_ids = itertools.count(1)


class Workspace:
    """Queries of the dialect over named DataFrames.

    Tables are DataFrames or callables that make one; a callable runs when a
    query first names its table.
    """

    def __init__(self, spark: SparkSession, tables: Mapping, primary: Mapping[str, tuple[str, ...]] | None = None):
        self.spark = spark
        self.tables = {k.lower(): v for k, v in tables.items()}
        self.primary = {k.lower(): tuple(v) for k, v in (primary or {}).items()}
        self.prefix = f"lakeweave_ws{next(_ids)}"
        self.known: dict[str, Relation] = {}

    @classmethod
    def over(cls, spark: SparkSession, folder: str) -> Workspace:
        """The sample tables, one Parquet table each, in a folder."""
        made = {n: lambda n=n: spark.read.parquet(f"{folder}/{n}.parquet") for n in PRIMARY_KEYS}
        return cls(spark, made, PRIMARY_KEYS)

    def _resolve(self, table: str) -> Relation | None:
        low = table.lower()
        if low not in self.known:
            if low not in self.tables:
                return None
            df = self.tables[low]
            df = df() if callable(df) else df
            view = f"{self.prefix}_{low}"
            df.createOrReplaceTempView(view)
            self.known[low] = Relation(name(view), [(f.name, tag(f.dataType)) for f in df.schema], self.primary.get(low, ()))
        return self.known[low]

    def table(self, table: str) -> DataFrame:
        found = self._resolve(table)
        if not found:
            raise SqlError(f"no such table: {table}")
        return self.spark.table(found.sql)

    def spark_sql(self, text: str, params: dict | list | tuple | None = None) -> str:
        if isinstance(params, (list, tuple)):
            params = {str(i): v for i, v in enumerate(params, 1)}
        statement = parse_one(text)
        if not isinstance(statement, ast.Query):
            raise SqlError("a workspace takes queries only")
        return Emitter(self._resolve, params).query(statement)[0]

    def sql(self, text: str, params: dict | list | tuple | None = None) -> DataFrame:
        statement = parse_one(text)
        if isinstance(statement, ast.Explain):
            return explain(self.spark.sql(Emitter(self._resolve, params).query(statement.statement)[0]))
        return self.spark.sql(self.spark_sql(text, params))

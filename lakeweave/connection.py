"""A connection and cursor interface over a database, and the pool that shares databases by folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeweave.database import Database
from lakeweave.plans.lexer import SqlError
from lakeweave.session import build_session

_pool: dict[str, tuple[Database, int]] = {}


class Cursor:
    def __init__(self, connection: Connection):
        self.connection = connection
        self.frame: DataFrame | None = None
        self.rowcount = -1
        self._rows = None

    def execute(self, sql: str, params=None) -> Cursor:
        out = self.connection.database.execute(sql, params)
        self.frame, self._rows = (out, None) if isinstance(out, DataFrame) else (None, None)
        self.rowcount = -1 if self.frame is not None else out or 0
        return self

    @property
    def description(self) -> list[tuple] | None:
        """(name, type) of each column; None after a statement without rows."""
        return None if self.frame is None else [(f.name, f.dataType.simpleString()) for f in self.frame.schema]

    def __iter__(self):
        if self.frame is None:
            raise SqlError("the statement has no rows")
        if self._rows is None:
            self._rows = self.frame.toLocalIterator()  # one partition at a time
        return self

    def __next__(self) -> tuple:
        return tuple(next(self._rows))

    def fetchone(self) -> tuple | None:
        return next(iter(self), None)

    def fetchmany(self, size: int) -> list[tuple]:
        iter(self)
        return [row for row, _ in zip(self, range(size), strict=False)]

    def fetchall(self) -> list[tuple]:
        return list(iter(self))

    def scalar(self):
        row = self.fetchone()
        return row[0] if row else None


class Connection:
    """Connections to one folder share its database while any is open."""

    def __init__(self, path: str, spark: SparkSession | None = None):
        spark = spark or SparkSession.getActiveSession() or build_session()
        self.path = path
        database, users = _pool.get(path, (None, 0))
        self.database = database or Database(spark, path)
        _pool[path] = (self.database, users + 1)
        self.open = True

    def cursor(self) -> Cursor:
        if not self.open:
            raise SqlError("the connection is closed")
        return Cursor(self)

    def execute(self, sql: str, params=None) -> Cursor:
        return self.cursor().execute(sql, params)

    def begin(self) -> None:
        self.database.begin()

    def commit(self) -> None:
        if self.database.saved:
            self.database.commit()

    def rollback(self) -> None:
        if self.database.saved:
            self.database.rollback()

    def close(self) -> None:
        if self.open:
            self.open = False
            database, users = _pool[self.path]
            if users > 1:
                _pool[self.path] = (database, users - 1)
            else:
                self.rollback()
                del _pool[self.path]

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, kind, *_) -> None:
        self.rollback() if kind else self.commit()
        self.close()


def connect(path: str, spark: SparkSession | None = None) -> Connection:
    return Connection(path, spark)

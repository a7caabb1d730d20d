"""Storage classes of declared types, and their Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

#: Storage class -> Spark SQL type.
SPARK = {"int": "BIGINT", "real": "DOUBLE", "text": "STRING", "blob": "BINARY", "date": "TIMESTAMP_NTZ", "bool": "BOOLEAN", "tiny": "TINYINT", "small": "SMALLINT"}


def affinity(declared: str) -> str:
    """Storage class by parts of the declared type's name, first rule first."""
    t = declared.upper()
    if not t:
        return "blob"
    if "BOOL" in t:
        return "bool"
    if "DATETIME" in t or "TIMESTAMP" in t or ("DATE" in t and not t.startswith("UPDATE")):
        return "date"
    if "INT" in t:
        return "tiny" if "TINY" in t else "small" if "SMALL" in t else "int"
    if any(x in t for x in ("CHAR", "CLOB", "TEXT")):
        return "text"
    if t == "BLOB":
        return "blob"
    if any(x in t for x in ("REAL", "FLOA", "DOUB")):
        return "real"
    return "int"


def tag(kind: T.DataType) -> str:
    """Expression class of a Spark type: int, real, text, blob, date, bool or any."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "real"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(kind, T.BinaryType):
        return "blob"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(kind, T.BooleanType):
        return "bool"
    return "null" if isinstance(kind, T.NullType) else "any"

"""The SQL database: versioned tables in Parquet, DDL, DML, triggers, transactions.

A table is a list of immutable segments (Parquet folders) in a catalog that is
itself versioned: a statement makes new segments and a new catalog, a commit
writes that catalog under the next number. Readers keep the catalog they began
with (snapshot isolation); a writer that finds the next number taken fails.
All data work is DataFrame work on whole sets of rows. Columns have stable
physical names, so that renaming and dropping touch the catalog only, and rows
written before a column was added read its default.
"""

from __future__ import annotations

import copy
import itertools
from collections import OrderedDict
from dataclasses import fields, is_dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.functions.types import SPARK, affinity, tag
from lakeweave.plans import ast
from lakeweave.plans.emit import Emitter, Relation, Scope, name
from lakeweave.plans.explain import explain
from lakeweave.plans.lexer import SqlError, tokens
from lakeweave.plans.parser import parse, parse_expr
from lakeweave.sources.store import Store

PLAN_CACHE = 256
TRIGGER_DEPTH = 100
#: Most rows for which a trigger body that is not a plain INSERT runs row by row.
TRIGGER_ROWS = 10_000
_ids = itertools.count(1)


class ConstraintError(SqlError):
    """A row that breaks a constraint of its table."""


def substitute(x, change):
    """The tree with ``change`` applied to every node, top down; None from it keeps a node."""
    if (new := change(x)) is not None:
        return new
    if isinstance(x, list):
        return [substitute(i, change) for i in x]
    if isinstance(x, tuple):
        return tuple(substitute(i, change) for i in x)
    if is_dataclass(x):
        return type(x)(**{f.name: substitute(getattr(x, f.name), change) for f in fields(x)})
    return x


def _renamed(text: str, old: str, new: str) -> str:
    """A trigger's text with NEW.old, OLD.old and the columns of UPDATE OF renamed."""
    found, at, listed = [], 0, False
    ts = tokens(text)
    for i, t in enumerate(ts):
        listed = t.upper == "OF" or listed and t.upper != "ON"
        row = i > 1 and ts[i - 1].value == "." and ts[i - 2].upper in ("NEW", "OLD")
        if t.kind in ("word", "quoted") and t.value.lower() == old and (row or listed):
            found += [text[at : t.start], '"' + new.replace('"', '""') + '"']
            at = t.end
    return "".join([*found, text[at:]])


class Database:
    """One database in a folder. ``execute`` takes any statement of the dialect."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.store = Store(spark, root)
        self.number, state = self.store.latest()
        self.state = state or {"oid": 0, "tables": {}, "indexes": {}, "views": {}, "triggers": {}}
        self.saved: list[tuple[str | None, dict]] = []  # of the open transaction, innermost last
        self.external: dict[str, tuple[DataFrame, tuple[str, ...]]] = {}
        self.prefix = f"lakeweave_{next(_ids)}"
        self.views: dict[str, str] = {}
        self.plans: OrderedDict = OrderedDict()
        self.hits = 0
        self.affected: list[Relation] = []  # rows of the firing triggers, innermost last

    # Statements

    def execute(self, sql: str, params: dict | list | tuple | None = None):
        """Run statements; the last one's result: a DataFrame for queries, else the number of rows changed."""
        if isinstance(params, (list, tuple)):
            params = {str(i): v for i, v in enumerate(params, 1)}
        result = None
        for statement, text in parse(sql):
            result = self._statement(statement, params or {}, text)
        return result

    def query(self, sql: str, params=None) -> DataFrame:
        out = self.execute(sql, params)
        if not isinstance(out, DataFrame):
            raise SqlError("not a query")
        return out

    def scalar(self, sql: str, params=None):
        """First column of the first row, or None."""
        row = self.query(sql, params).first()
        return row[0] if row else None

    def _statement(self, s, params: dict, text: str = ""):
        if isinstance(s, ast.Query):
            return self._select(s, params, text)
        if isinstance(s, ast.Explain):
            if not isinstance(s.statement, ast.Query):
                raise SqlError("EXPLAIN takes a SELECT")
            return explain(self._select(s.statement, params))
        if isinstance(s, ast.Transaction):
            return self._transaction(s)
        with_rows = isinstance(s, (ast.Insert, ast.Update, ast.Delete))
        before = copy.deepcopy(self.state)
        try:
            out = self._dml(s, params, 0) if with_rows else self._ddl(s)
            if not self.saved:
                self._commit()
            return out
        except Exception:
            self.state = before  # a statement happens whole or not at all
            raise

    def _select(self, q: ast.Query, params: dict, text: str = "") -> DataFrame:
        key = (text, repr(sorted(params.items(), key=str)), id(self.state), self.number, self.state.get("changes", 0))
        if text and key in self.plans:
            self.plans.move_to_end(key)
            self.hits += 1
            sql = self.plans[key]
        else:
            sql, _ = self._emitter(params).query(q)
            if text:
                self.plans[key] = sql
                if len(self.plans) > PLAN_CACHE:
                    self.plans.popitem(last=False)
        return self.spark.sql(sql)

    def to_spark_sql(self, sql: str, params: dict | None = None) -> str:
        """The Spark SQL that a query of the dialect becomes."""
        (statement, _), *more = parse(sql)
        if more or not isinstance(statement, ast.Query):
            raise SqlError("not a single query")
        return self._emitter(params or {}).query(statement)[0]

    # Transactions

    def begin(self) -> None:
        self._transaction(ast.Transaction("BEGIN"))

    def commit(self) -> None:
        self._transaction(ast.Transaction("COMMIT"))

    def rollback(self) -> None:
        self._transaction(ast.Transaction("ROLLBACK"))

    def _transaction(self, t: ast.Transaction) -> int:
        if t.action in ("BEGIN", "SAVEPOINT"):
            if t.action == "BEGIN" and self.saved:
                raise SqlError("cannot start a transaction within a transaction")
            self.saved.append((t.name and t.name.lower(), copy.deepcopy(self.state)))
            return 0
        if not self.saved:
            raise SqlError("no transaction is active")
        if t.action in ("ROLLBACK TO", "RELEASE"):
            at = next((i for i in range(len(self.saved) - 1, -1, -1) if self.saved[i][0] == (t.name or "").lower()), None)
            if at is None:
                raise SqlError(f"no such savepoint: {t.name}")
            if t.action == "ROLLBACK TO":
                self.state = copy.deepcopy(self.saved[at][1])
                del self.saved[at + 1 :]
                return 0
            del self.saved[at:]
        elif t.action == "ROLLBACK":
            self.state = self.saved[0][1]
            self.saved.clear()
        else:
            self.saved.clear()
        if not self.saved and t.action != "ROLLBACK":
            self._commit()
        return 0

    def _commit(self) -> None:
        self.store.commit(self.number + 1, self.state)
        self.number += 1

    # Names

    def attach(self, table: str, df: DataFrame, primary: tuple[str, ...] = ()) -> None:
        """Make a DataFrame readable under a name; such tables take no DML."""
        view = f"{self.prefix}_ext_{table.lower()}"
        df.createOrReplaceTempView(view)
        self.external[table.lower()] = (df, tuple(primary))
        self.plans.clear()

    def tables(self) -> list[str]:
        return sorted([t["name"] for t in self.state["tables"].values()] + list(self.external))

    def _emitter(self, params: dict | None = None) -> Emitter:
        return Emitter(self._resolve, params, kept_unique=True)

    def _resolve(self, table: str) -> Relation | None:
        low = table.lower()
        if low == "__rows" and self.affected:
            return self.affected[-1]
        if low in self.state["tables"]:
            t = self.state["tables"][low]
            columns = [(c["name"], "int" if c["kind"] in ("tiny", "small") else c["kind"]) for c in t["columns"]]
            return Relation(name(self._view(t)), columns, tuple(t["primary"]))
        if low in self.external:
            df, primary = self.external[low]
            return Relation(name(f"{self.prefix}_ext_{low}"), [(f.name, tag(f.dataType)) for f in df.schema], primary)
        if low in self.state["views"]:
            v = self.state["views"][low]
            sql, columns = self._emitter().query(parse(v["query"])[0][0])
            named = [(c, k) for c, (_, k) in zip(v["columns"] or [c for c, _ in columns], columns, strict=True)]
            return Relation(f"(SELECT * FROM ({sql}) AS v({', '.join(name(c) for c, _ in named)}))", named)
        if low == "__schema":
            rows = self.schema_rows()
            values = ", ".join(f"({o}L, {Emitter.value(self, k)[0]}, {Emitter.value(self, n)[0]}, {Emitter.value(self, d)[0]})" for o, k, n, d in rows)
            body = f"SELECT * FROM VALUES {values} AS s(oid, type, name, definition)" if rows else "SELECT 0L AS oid, '' AS type, '' AS name, '' AS definition WHERE FALSE"
            return Relation(f"({body})", [("oid", "int"), ("type", "text"), ("name", "text"), ("definition", "text")])
        return None

    def schema_rows(self) -> list[tuple[int, str, str, str]]:
        """(oid, type, name, definition) of every object."""
        found = [(o["oid"], kind[:-1] if kind != "indexes" else "index", o["name"], o["text"]) for kind in ("tables", "indexes", "views", "triggers") for o in self.state[kind].values()]
        return sorted(found)

    def _table(self, table: str) -> dict:
        if table.lower() in self.state["tables"]:
            return self.state["tables"][table.lower()]
        raise SqlError(f"table {table} is read-only" if table.lower() in self.external or table.lower() in self.state["views"] else f"no such table: {table}")

    def _view(self, t: dict) -> str:
        """A temporary view of the table's present rows."""
        version = repr((t["segments"], [(c["name"], c["seq"], c["default"]) for c in t["columns"]]))
        if version not in self.views:
            view = f"{self.prefix}_v{len(self.views)}"
            self._rows(t).createOrReplaceTempView(view)
            self.views[version] = view
        return self.views[version]

    def _rows(self, t: dict) -> DataFrame:
        """The table's rows under its columns' names."""
        types = {c["seq"]: SPARK[c["kind"]] for c in t["columns"]}
        groups: dict[tuple, list[str]] = {}
        for s in t["segments"]:
            groups.setdefault(tuple(s["columns"]), []).append(s["path"])
        parts = []
        for have, paths in groups.items():
            kept = [c for c in have if c in types]
            df = self.spark.read.schema(", ".join(f"c{c} {types[c]}" for c in kept)).parquet(*paths)
            columns = []
            for c in t["columns"]:
                x = F.col(f"c{c['seq']}") if c["seq"] in have else F.expr(self._default(c) or "NULL").cast(SPARK[c["kind"]])
                columns.append(x.alias(c["name"]))
            parts.append(df.select(*columns))
        if not parts:
            return self.spark.range(0).select(*[F.lit(None).cast(SPARK[c["kind"]]).alias(c["name"]) for c in t["columns"]])
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def _default(self, column: dict) -> str | None:
        return None if column["default"] is None else self._emitter().expr(parse_expr(column["default"]), Scope())[0]

    def _write(self, t: dict, rows: DataFrame, append: bool) -> None:
        path = self.store.segment(t["oid"])
        rows.select(*[F.col(name(c["name"])).cast(SPARK[c["kind"]]).alias(f"c{c['seq']}") for c in t["columns"]]).write.parquet(path)
        segment = {"path": path, "columns": [c["seq"] for c in t["columns"]]}
        t["segments"] = [*t["segments"], segment] if append else [segment]

    def _replace(self, t: dict, gone: DataFrame, new: DataFrame | None) -> None:
        """Take the rows of the ``gone`` keys out and put ``new`` rows in; only segments that hold such a key are rewritten."""
        key, names = t["primary"], [c["name"] for c in t["columns"]]
        seqs = {c["name"]: c["seq"] for c in t["columns"]}
        types = {c["name"]: SPARK[c["kind"]] for c in t["columns"]}
        folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        hit: set[str] = set()
        if t["segments"]:
            schema = ", ".join(f"c{seqs[k]} {types[k]}" for k in key)
            found = self.spark.read.schema(schema).parquet(*[s["path"] for s in t["segments"]])
            found = found.select(*[F.col(f"c{seqs[k]}").alias(k) for k in key], folder.alias("__segment"))
            hit = {r[0] for r in found.join(gone, key, "left_semi").select("__segment").distinct().collect()}  # at most one a segment
        touched = [s for s in t["segments"] if s["path"].rsplit("/", 1)[-1] in hit]
        rest = self._rows({**t, "segments": touched}).join(gone, key, "left_anti").select(*names)
        t["segments"] = [s for s in t["segments"] if s not in touched]
        self._write(t, rest if new is None else rest.union(new.select(*names)), True)

    def compact(self, table: str, files: int = 1) -> None:
        """Rewrite a table as one segment, laid out by primary key so that seeks and ranges prune row groups."""
        t = self._table(table)
        rows = self._rows(t)
        self._write(t, rows.repartitionByRange(files, *t["primary"]).sortWithinPartitions(*t["primary"]) if t["primary"] else rows.coalesce(files), False)
        if not self.saved:
            self._commit()

    def _stage(self, df: DataFrame) -> DataFrame:
        """The rows written down once: what a statement decides on stays fixed while it changes tables."""
        path = self.store.segment(0)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    # DDL

    def _oid(self) -> int:
        self.state["oid"] += 1
        return self.state["oid"]

    def _free(self, low: str, exists_ok: bool, *kinds: str) -> bool:
        if any(low in self.state[k] for k in kinds):
            if exists_ok:
                return False
            raise SqlError(f"there is already an object named {low}")
        return True

    def _ddl(self, s) -> int:
        self.state["changes"] = self.state.get("changes", 0) + 1
        self.plans.clear()
        return getattr(self, f"_ddl_{type(s).__name__.lower()}")(s)

    def _column(self, c: ast.ColumnDef, seq: int) -> dict:
        return {"name": c.name, "type": c.type, "kind": affinity(c.type), "seq": seq, "not_null": c.not_null, "auto": c.autoincrement, "default": c.default, "check": c.check, "generated": c.generated}

    def _ddl_createtable(self, s: ast.CreateTable) -> int:
        low = s.name.lower()
        if not self._free(low, s.exists_ok, "tables", "views"):
            return 0
        rows = None
        if s.query is not None:
            rows = self._select(s.query, {})
            kinds = {"int": "INTEGER", "real": "REAL", "text": "TEXT", "blob": "BLOB", "date": "DATETIME", "bool": "BOOLEAN"}
            s.columns = [ast.ColumnDef(f.name, kinds.get(tag(f.dataType), "TEXT")) for f in rows.schema]
        elif not s.primary:
            raise SqlError(f"table {s.name} has no primary key")
        names = [c.name.lower() for c in s.columns]
        if len(set(names)) < len(names):
            raise SqlError("duplicate column name")
        for key in [s.primary, *s.unique]:
            if missing := [k for k in key if k.lower() not in names]:
                raise SqlError(f"no such column: {missing[0]}")
        exact = {c.name.lower(): c.name for c in s.columns}
        t = {
            "oid": self._oid(), "name": s.name, "columns": [self._column(c, i) for i, c in enumerate(s.columns)], "primary": [exact[k.lower()] for k in s.primary],
            "unique": [[exact[k.lower()] for k in u] for u in s.unique] + [[c.name] for c in s.columns if c.unique], "checks": s.checks, "segments": [], "next_seq": len(s.columns), "next_auto": 1, "text": s.text,
        }
        self.state["tables"][low] = t
        if rows is not None:
            self._write(t, rows, True)
        return 0

    def _ddl_createindex(self, s: ast.CreateIndex) -> int:
        t = self._table(s.table)
        if not self._free(s.name.lower(), s.exists_ok, "indexes"):
            return 0
        for o in s.columns:
            if isinstance(o.expr, ast.Col):
                self._find(t, o.expr.name)
        self.state["indexes"][s.name.lower()] = {"oid": self._oid(), "name": s.name, "table": s.table.lower(), "text": s.text}
        if s.unique and s.where is None and all(isinstance(o.expr, ast.Col) for o in s.columns):
            key = [self._find(t, o.expr.name)["name"] for o in s.columns]
            if self._repeats(self._rows(t), key):
                raise ConstraintError(f"UNIQUE constraint failed: {t['name']}.{key[0]}")
            self.state["indexes"][s.name.lower()]["unique"] = key
        return 0

    def _ddl_createview(self, s: ast.CreateView) -> int:
        if self._free(s.name.lower(), s.exists_ok, "views", "tables"):
            self.state["views"][s.name.lower()] = {"oid": self._oid(), "name": s.name, "columns": s.columns, "query": s.query_text, "text": s.text}
        return 0

    def _ddl_createtrigger(self, s: ast.CreateTrigger) -> int:
        self._table(s.table)
        if self._free(s.name.lower(), s.exists_ok, "triggers"):
            self.state["triggers"][s.name.lower()] = {"oid": self._oid(), "name": s.name, "table": s.table.lower(), "timing": s.timing, "event": s.event, "of": [c.lower() for c in s.of], "text": s.text}
        return 0

    def _ddl_drop(self, s: ast.Drop) -> int:
        kind = {"TABLE": "tables", "INDEX": "indexes", "VIEW": "views", "TRIGGER": "triggers"}[s.kind]
        low = s.name.lower()
        if low not in self.state[kind]:
            if s.missing_ok:
                return 0
            raise SqlError(f"no such {s.kind.lower()}: {s.name}")
        del self.state[kind][low]
        if kind == "tables":
            for k in ("indexes", "triggers"):
                self.state[k] = {n: o for n, o in self.state[k].items() if o["table"] != low}
        return 0

    def _find(self, t: dict, column: str) -> dict:
        for c in t["columns"]:
            if c["name"].lower() == column.lower():
                return c
        raise SqlError(f"no such column: {column}")

    def _ddl_alter(self, s: ast.Alter) -> int:
        t, low = self._table(s.table), s.table.lower()
        if s.action == "rename":
            new = s.args[0]
            self._free(new.lower(), False, "tables", "views")
            del self.state["tables"][low]
            t["name"] = new
            self.state["tables"][new.lower()] = t
            for k in ("indexes", "triggers"):
                for o in self.state[k].values():
                    o["table"] = new.lower() if o["table"] == low else o["table"]
        elif s.action == "rename_column":
            c, old, new = self._find(t, s.args[0]), s.args[0].lower(), s.args[1]
            if any(o["name"].lower() == new.lower() for o in t["columns"] if o is not c):
                raise SqlError(f"duplicate column name: {new}")
            c["name"] = new
            swap = lambda key: [new if k.lower() == old else k for k in key]
            t["primary"], t["unique"] = swap(t["primary"]), [swap(u) for u in t["unique"]]
            for o in self.state["triggers"].values():
                if o["table"] == low:
                    o["text"] = _renamed(o["text"], old, new)
                    o["of"] = [new.lower() if c == old else c for c in o["of"]]
        elif s.action == "add":
            c = s.args[0]
            if any(o["name"].lower() == c.name.lower() for o in t["columns"]):
                raise SqlError(f"duplicate column name: {c.name}")
            if c.primary or c.unique:
                raise SqlError("cannot add a PRIMARY KEY or UNIQUE column")
            if c.not_null and c.default is None and t["segments"] and self._rows(t).limit(1).count():
                raise SqlError("cannot add a NOT NULL column without default to a table with rows")
            t["columns"] = [*t["columns"], self._column(c, t["next_seq"])]
            t["next_seq"] += 1
        else:
            c = self._find(t, s.args[0])
            if c["name"] in t["primary"]:
                raise SqlError(f"cannot drop PRIMARY KEY column: {c['name']}")
            t["columns"] = [o for o in t["columns"] if o is not c]
            t["unique"] = [u for u in t["unique"] if c["name"] not in u]
        return 0

    # DML

    def _dml(self, s, params: dict, depth: int):
        self.state["changes"] = self.state.get("changes", 0) + 1
        if depth > TRIGGER_DEPTH:
            raise SqlError("too many levels of trigger recursion")
        return getattr(self, f"_{type(s).__name__.lower()}")(s, params, depth)

    def _ordered(self, df: DataFrame) -> DataFrame:
        """The staged rows with __at, their place in the statement's order, without a global sort."""
        df = self._stage(df.withColumn("__id", F.monotonically_increasing_id()))
        share = F.shiftright("__id", 33)
        counts = {r[0]: r[1] for r in df.groupBy(share.alias("p")).count().collect()}  # one row a partition
        before, total = [], 0
        for p in sorted(counts):
            before += [F.lit(p), F.lit(total)]
            total += counts[p]
        if not counts:
            return df.withColumn("__at", F.lit(0).cast("long")).drop("__id")
        place = F.element_at(F.create_map(*before), share) + F.col("__id").bitwiseAND((1 << 33) - 1)
        return df.withColumn("__at", place.cast("long")).drop("__id")

    def _coerced(self, df: DataFrame, column: str, c: dict):
        source, target = tag(df.schema[column].dataType), c["kind"]
        x = F.col(name(column))
        target = "int" if target in ("tiny", "small") else target
        allowed = source in (target, "null") or {source, target} <= {"int", "real", "bool"} or (source, target) in (("text", "date"), ("text", "blob"))
        if not allowed:
            raise ConstraintError(f"cannot store {source} in column {c['name']} of type {c['type']}")
        return x.cast("long").cast(SPARK[c["kind"]]) if (source, target) == ("bool", "real") else x.cast(SPARK[c["kind"]])

    def _insert(self, s: ast.Insert, params: dict, depth: int):
        t = self._table(s.table)
        columns = [self._find(t, c)["name"] for c in s.columns] if s.columns else [c["name"] for c in t["columns"] if c["generated"] is None]
        if s.source is None:
            source = self.spark.range(1).select(F.lit(None).cast("string").alias("__none"))
            columns = []
        else:
            source = self._select(s.source, params)
            if len(source.columns) != len(columns):
                raise SqlError(f"table {t['name']} has {len(columns)} columns but {len(source.columns)} values were supplied")
        source = source.toDF(*(columns or source.columns))
        low = t["name"].lower()
        simple = s.action in (None, "ABORT", "FAIL", "ROLLBACK") and s.upsert is None and not s.returning and not any(c["auto"] for c in t["columns"])
        simple = simple and not any(o["table"] == low and o["event"] == "INSERT" for o in self.state["triggers"].values())
        rows = source.withColumn("__at", F.lit(0).cast("long")) if simple else self._ordered(source)
        values = []
        for c in t["columns"]:
            x = self._coerced(rows, c["name"], c) if c["name"] in columns else F.lit(None).cast(SPARK[c["kind"]])
            if (default := self._default(c)) is not None:
                x = F.coalesce(x, F.expr(default).cast(SPARK[c["kind"]]))
            values.append(x.alias(c["name"]))
        rows = rows.select(*values, "__at")
        if simple:
            return self._append(t, self._generated(t, rows))
        rows = self._generated(t, self._numbered(t, rows))
        return self._put(t, s, rows, params, depth)

    def _append(self, t: dict, rows: DataFrame) -> int:
        """Write the rows as a segment once; it joins the table if what it holds keeps the constraints."""
        before = t["segments"]
        self._write(t, rows, True)
        made = t["segments"][-1]
        try:
            rows = self._rows({**t, "segments": [made]})
            n = self._validate(t, rows, unique=True)
            if before:
                self._check_unique(t, rows, self._rows({**t, "segments": before}), inside=False)
        except Exception:
            self.store.delete(made["path"])
            raise
        return n

    def _numbered(self, t: dict, rows: DataFrame) -> DataFrame:
        """Missing AUTOINCREMENT keys filled in statement order, above every key ever used."""
        for c in t["columns"]:
            if not c["auto"]:
                continue
            x = F.col(name(c["name"]))
            top = rows.agg(F.max(x)).first()[0] or 0
            used = self._rows(t).agg(F.max(x)).first()[0] or 0
            start = max(t["next_auto"], used + 1, top + 1)
            rows = rows.withColumn(c["name"], F.coalesce(x, F.lit(start) + F.col("__at")).cast(SPARK[c["kind"]]))
            rows = self._stage(rows)
            t["next_auto"] = max(t["next_auto"], (rows.agg(F.max(x)).first()[0] or 0) + 1)
        return rows

    def _generated(self, t: dict, rows: DataFrame) -> DataFrame:
        for c in t["columns"]:
            if c["generated"] is not None:
                rows = rows.withColumn(c["name"], F.expr(self._over(t, parse_expr(c["generated"]))[0]).cast(SPARK[c["kind"]]))
        return rows

    def _over(self, t: dict, x):
        """An expression on the table's own columns, for rows that have them."""
        scope = Scope()
        scope.sources.append((t["name"], [(c["name"], "int" if c["kind"] in ("tiny", "small") else c["kind"]) for c in t["columns"]], ()))
        e = self._emitter()
        sql, kind = e.expr(x, scope)
        return sql.replace(f"{name(t['name'])}.", ""), kind

    def _validate(self, t: dict, rows: DataFrame, unique: bool = False) -> int:
        """NOT NULL, primary key and CHECK, in one pass; the number of rows. ``unique``: keys among the rows as well."""
        from lakeweave.functions.scalar import truth

        checks = [(f"NOT NULL constraint failed: {t['name']}.{c['name']}", F.col(name(c["name"])).isNull()) for c in t["columns"] if c["not_null"] or c["name"] in t["primary"]]
        for text in [*t["checks"], *[c["check"] for c in t["columns"] if c["check"]]]:
            checks.append((f"CHECK constraint failed: {text}", ~F.coalesce(F.expr(truth(self._over(t, parse_expr(text)))), F.lit(True))))
        tests = [F.count_if(bad).alias(f"n{i}") for i, (_, bad) in enumerate(checks)]
        for key in ([t["primary"]] if t["primary"] else []) + self._uniques(t) if unique else []:
            columns = [F.col(name(k)) for k in key]
            whole = F.greatest(F.lit(False), *[c.isNull() for c in columns])
            tests.append((F.count_if(~whole) - F.count_distinct(*columns)).alias(f"n{len(tests)}"))
            checks.append((f"UNIQUE constraint failed: {', '.join(t['name'] + '.' + k for k in key)}", None))
        total, *found = rows.agg(F.count(F.lit(1)), *tests).first()
        for (message, _), n in zip(checks, found, strict=True):
            if n:
                raise ConstraintError(message)
        return total

    def _repeats(self, rows: DataFrame, key: list[str]) -> bool:
        keyed = rows.select(*[F.col(name(k)) for k in key]).dropna()
        return bool(keyed.groupBy(*key).count().filter("count > 1").limit(1).count())

    def _uniques(self, t: dict) -> list[list[str]]:
        return t["unique"] + [o["unique"] for o in self.state["indexes"].values() if o["table"] == t["name"].lower() and o.get("unique")]

    def _check_unique(self, t: dict, rows: DataFrame, rest: DataFrame, primary: bool = True, inside: bool = True) -> None:
        """Raise if rows repeat a key among themselves (unless ``inside`` is known) or one of the rest; only key columns are read."""
        for key in ([t["primary"]] if primary and t["primary"] else []) + self._uniques(t):
            new = rows.select(*[F.col(name(k)) for k in key]).dropna()
            if inside and self._repeats(rows, key) or rest.select(*[F.col(name(k)) for k in key]).join(new, key, "left_semi").limit(1).count():
                raise ConstraintError(f"UNIQUE constraint failed: {', '.join(t['name'] + '.' + k for k in key)}")

    def _put(self, t: dict, s: ast.Insert, rows: DataFrame, params: dict, depth: int):
        key, low = t["primary"], t["name"].lower()
        rows = self._fire(low, "INSERT", "BEFORE", rows, depth)
        self._validate(t, rows)
        names = [c["name"] for c in t["columns"]]
        ignore = s.action == "IGNORE" or s.upsert and s.upsert.sets is None
        changed = 0
        keys = [k for k in [key, *self._uniques(t)] if k]
        if s.action == "REPLACE" and key:
            given, old = self._stage(rows), self._rows(t)
            # A row goes if any later one, or a new one, has one of its keys.
            rows = self._stage(self._one(given, keys, last=True))
            gone = [old.join(given.select(*k).dropna().distinct(), k, "left_semi").select(*key) for k in keys]
            gone = self._stage(reduce(DataFrame.union, gone).distinct())
            if gone.limit(1).count():
                self._replace(t, gone, None)
        elif ignore and keys:
            every, left = rows.columns, rows
            for k in keys:
                left = left.join(self._rows(t).select(*k), k, "left_anti")
            # The first of each key stays; what it rules out may have ruled out others, which are asked again.
            rows, left = None, self._stage(left.select(*every))
            while rows is None or left.limit(1).count():
                first = self._stage(self._one(left, keys, last=False))
                rows = first if rows is None else rows.union(first)
                for k in keys:
                    left = left.join(first.select(*k), k, "left_anti")
                left = self._stage(left.join(first.select("__at"), "__at", "left_anti").select(*every))
        elif s.upsert and key:
            return self._upsert(t, s, rows, params, depth)
        else:
            self._check_unique(t, rows, self._rows(t))
        changed += rows.count()
        self._write(t, rows.orderBy("__at") if depth else rows, True)
        self._fire(low, "INSERT", "AFTER", rows, depth)
        return self._returned(t, s.returning, rows, params) if s.returning else changed

    def _one(self, rows: DataFrame, keys: list[list[str]], last: bool) -> DataFrame:
        """The rows that are the first or last of each of their keys in the statement's order; a key with a null is none."""
        at, names = (F.max("__at") if last else F.min("__at")), rows.columns
        out = rows
        for key in keys:
            best = rows.dropna(subset=key).groupBy(*key).agg(at.alias("__best"))
            out = out.join(best, key, "left").filter("__best IS NULL OR __best = __at").select(*names)
        return out

    def _upsert(self, t: dict, s: ast.Insert, rows: DataFrame, params: dict, depth: int) -> int:
        """DO UPDATE: rows of new keys go in, others change the row they meet; rows of one key take turns."""
        from pyspark.sql import Window

        key, names = t["primary"], [c["name"] for c in t["columns"]]
        turn = F.row_number().over(Window.partitionBy(*key).orderBy("__at"))
        rows = self._stage(rows.withColumn("__turn", turn))
        turns = rows.agg(F.max("__turn")).first()[0] or 0
        changed = 0
        for i in range(1, turns + 1):
            now = rows.filter(F.col("__turn") == i)
            old = self._rows(t)
            fresh = self._stage(now.join(old.select(*key), key, "left_anti"))
            met = now.join(old.select(*key), key, "left_semi").select(*names)
            view, new = f"{self.prefix}_excluded", self._view(t)
            met.createOrReplaceTempView(view)
            scope = Scope()
            columns = [(c["name"], c["kind"]) for c in t["columns"]]
            scope.sources += [(t["name"], columns, ()), ("excluded", columns, ())]
            e = self._emitter(params)
            sets = [x for group in s.upsert.sets for x in group]
            put = {self._find(t, c)["name"]: e.expr(x, scope)[0] for c, x in sets}
            on = " AND ".join(f"{name(t['name'])}.{name(k)} = excluded.{name(k)}" for k in key)
            at = name(t["name"])
            items = [f"{at}.{name(c)} AS {name('__old_' + c)}" for c in names]
            items += [f"CAST({put[c['name']]} AS {SPARK[c['kind']]}) AS {name(c['name'])}" if c["name"] in put else f"{at}.{name(c['name'])}" for c in t["columns"]]
            where = f" WHERE {e.truth(s.upsert.where, scope)}" if s.upsert.where is not None else ""
            done = self._ordered(self._generated(t, self.spark.sql(f"SELECT {', '.join(items)} FROM {name(new)} AS {at} JOIN {name(view)} AS excluded ON {on}{where}")))
            done = self._fire(t["name"].lower(), "UPDATE", "BEFORE", done, depth, set(put))
            hits = done.count()
            self._validate(t, done)
            if hits:
                self._replace(t, done.select(*[F.col(name("__old_" + k)).alias(k) for k in key]), done)
                if set(put) & {k for u in [key, *self._uniques(t)] for k in u}:
                    for u in [key, *self._uniques(t)]:
                        if self._repeats(self._rows(t), u):
                            raise ConstraintError(f"UNIQUE constraint failed: {t['name']}.{u[0]}")
            n = fresh.count()
            if n:
                self._write(t, fresh.select(*names), True)
            changed += hits + n
            self._fire(t["name"].lower(), "UPDATE", "AFTER", done, depth, set(put))
            self._fire(t["name"].lower(), "INSERT", "AFTER", fresh, depth)
        return changed

    def _matches(self, t: dict, alias: str | None, items: list[str], e: Emitter, scope: Scope, source: str, s) -> DataFrame:
        """Rows that an UPDATE or DELETE takes, staged; LIMIT takes them by ORDER BY, else by key."""
        where = f" WHERE {e.truth(s.where, scope)}" if s.where is not None else ""
        sql = f"SELECT {', '.join(items)} FROM {source}{where}"
        if s.limit is not None or s.offset is not None:
            order = e.orders(s.order, scope) + ", " if s.order else ""
            order += ", ".join(f"{name(alias or t['name'])}.{name(k)}" for k in t["primary"])
            sql += f" ORDER BY {order}" + e.limits(s.limit, s.offset)
        return self._ordered(self.spark.sql(sql))

    def _target(self, t: dict, alias: str | None) -> tuple[Scope, str]:
        if not t["primary"]:
            raise SqlError(f"table {t['name']} has no primary key")
        scope = Scope()
        r = self._resolve(t["name"])
        scope.sources.append((alias or t["name"], r.columns, r.primary))
        return scope, f"{r.sql} AS {name(alias or t['name'])}"

    def _update(self, s: ast.Update, params: dict, depth: int):
        t = self._table(s.table)
        names, key, low = [c["name"] for c in t["columns"]], t["primary"], t["name"].lower()
        scope, source = self._target(t, s.alias)
        e = self._emitter(params)
        if s.source is not None:
            source += f" CROSS JOIN {e.source(s.source, scope)}"
        put = {}
        for c, x in s.sets:  # every right side sees the old row
            c = self._find(t, c)
            sql, kind = e.expr(x, scope)
            target = "int" if c["kind"] in ("tiny", "small") else c["kind"]
            if not (kind in (target, "null", "any") or {kind, target} <= {"int", "real", "bool"} or (kind, target) == ("text", "date")):
                raise ConstraintError(f"cannot store {kind} in column {c['name']} of type {c['type']}")
            put[c["name"]] = f"CAST({sql} AS {SPARK[c['kind']]})"
        at = name(s.alias or t["name"])
        items = [f"{at}.{name(c)} AS {name('__old_' + c)}" for c in names] + [f"{put.get(c, f'{at}.{name(c)}')} AS {name(c)}" for c in names]
        rows = self._matches(t, s.alias, items, e, scope, source, s)
        old_key = ["__old_" + k for k in key]
        if s.source is not None:
            rows = self._one(rows, [old_key], last=False)
        rows = self._stage(self._generated(t, rows))
        rows = self._fire(low, "UPDATE", "BEFORE", rows, depth, set(put))
        self._validate(t, rows)
        gone = rows.select(*[F.col(name(o)).alias(k) for o, k in zip(old_key, key, strict=True)])
        if set(put) & {k for u in [key, *self._uniques(t)] for k in u}:
            self._check_unique(t, rows, self._rows(t).join(gone, key, "left_anti"))
        changed = rows.count()
        if changed:
            self._replace(t, gone, rows)
        self._fire(low, "UPDATE", "AFTER", rows, depth, set(put))
        return self._returned(t, s.returning, rows, params) if s.returning else changed

    def _delete(self, s: ast.Delete, params: dict, depth: int):
        t = self._table(s.table)
        names, key, low = [c["name"] for c in t["columns"]], t["primary"], t["name"].lower()
        scope, source = self._target(t, s.alias)
        at = name(s.alias or t["name"])
        rows = self._matches(t, s.alias, [f"{at}.{name(c)} AS {name('__old_' + c)}" for c in names], self._emitter(params), scope, source, s)
        rows = self._fire(low, "DELETE", "BEFORE", rows, depth)
        changed = rows.count()
        gone = rows.select(*[F.col(name("__old_" + k)).alias(k) for k in key])
        if changed:
            self._replace(t, gone, None)
        self._fire(low, "DELETE", "AFTER", rows, depth)
        if s.returning:
            rows = rows.select(*[F.col(name("__old_" + c)).alias(c) for c in names])
            return self._returned(t, s.returning, rows, params)
        return changed

    def _returned(self, t: dict, items: list, rows: DataFrame, params: dict) -> DataFrame:
        view = f"{self.prefix}_returned"
        rows.createOrReplaceTempView(view)
        columns = [(c["name"], c["kind"]) for c in t["columns"]]
        e = Emitter(lambda n: Relation(name(view), columns) if n.lower() == t["name"].lower() else self._resolve(n), params)
        return self.spark.sql(e.query(ast.Query(ast.Core(items=items, source=ast.Table(t["name"], None))))[0])

    # Triggers

    def _fire(self, table: str, event: str, timing: str, rows: DataFrame, depth: int, changed: set | None = None) -> DataFrame:
        """Run the triggers for the rows (old columns as __old_ names); what RAISE(IGNORE) spares of them."""
        for trigger in sorted((o for o in self.state["triggers"].values() if o["table"] == table and o["event"] == event and o["timing"] == timing), key=lambda o: o["oid"]):
            if trigger["of"] and not {c.lower() for c in changed or ()} & set(trigger["of"]):
                continue
            made = parse(trigger["text"])[0][0]
            for body in made.body:
                rows = self._run_body(made, body, table, event, rows, depth)
        return rows

    def _run_body(self, trigger: ast.CreateTrigger, body, table: str, event: str, rows: DataFrame, depth: int) -> DataFrame:
        t = self.state["tables"][table]
        kinds = [(c["name"], "int" if c["kind"] in ("tiny", "small") else c["kind"]) for c in t["columns"]]
        view = f"{self.prefix}_rows_{next(_ids)}"
        rows.createOrReplaceTempView(view)
        seen = ([("new", "")] if event != "DELETE" else []) + ([("old", "__old_")] if event != "INSERT" else [])

        def relate(x):
            # NEW.c and OLD.c become columns of the affected rows
            if isinstance(x, ast.Col) and x.table and x.table.lower() in dict(seen):
                return ast.Col(dict(seen)[x.table.lower()] + self._find(t, x.name)["name"], "__rows")
            return None

        affected = [(p + c, k) for _, p in seen for c, k in kinds]
        core = body.body if isinstance(body, ast.Query) else body.source.body if isinstance(body, ast.Insert) and body.source is not None else None
        plain = isinstance(core, (ast.Core, ast.Values)) and getattr(core, "source", None) is None and not (isinstance(core, ast.Values) and len(core.rows) > 1)
        if plain and isinstance(body, ast.Query):
            raises = [i.expr for i in core.items if isinstance(i, ast.Item) and isinstance(i.expr, ast.Raise)]
            if not raises:
                return rows  # a SELECT without effect
            scope = Scope()
            scope.sources.append(("__rows", affected, ()))
            e = self._emitter()
            conditions = [e.truth(substitute(c, relate), scope) for c in (trigger.when, core.where) if c is not None]
            hit = f"coalesce({' AND '.join(conditions) or 'TRUE'}, FALSE)".replace("`__rows`.", "")
            if raises[0].kind == "IGNORE":
                return self._stage(rows.filter(f"NOT {hit}"))
            if rows.filter(hit).limit(1).count():
                raise ConstraintError(raises[0].message or "raised by a trigger")
            return rows
        if plain and isinstance(body, ast.Insert):
            inner = copy.deepcopy(body)
            items = [ast.Item(v, f"v{i}", "") for i, v in enumerate(core.rows[0])] if isinstance(core, ast.Values) else core.items
            where = [c for c in (trigger.when, getattr(core, "where", None)) if c is not None]
            condition = where[0] if len(where) == 1 else ast.Binary("AND", *where) if where else None
            inner.source = ast.Query(ast.Core(items=substitute(items, relate), source=ast.Table("__rows", None), where=substitute(condition, relate)), order=[ast.Order(ast.Col("__at", "__rows"), False, None)])
            self.affected.append(Relation(name(view), [*affected, ("__at", "int")]))
            try:
                self._dml(inner, {}, depth + 1)
            finally:
                self.affected.pop()
            return rows
        return self._row_by_row(trigger, body, seen, t, rows, depth)

    def _row_by_row(self, trigger, body, seen, t: dict, rows: DataFrame, depth: int) -> DataFrame:
        """Bodies that read or change tables row by row, in the statement's order, for a bounded number of rows."""
        found = rows.orderBy("__at").limit(TRIGGER_ROWS + 1).collect()
        if len(found) > TRIGGER_ROWS:
            raise SqlError(f"trigger {trigger.name} would run row by row for over {TRIGGER_ROWS} rows")
        kinds = {"real": "real", "text": "text", "bool": "bool"}
        for row in found:

            def fixed(x, row=row):
                if isinstance(x, ast.Col) and x.table and x.table.lower() in dict(seen):
                    c = self._find(t, x.name)
                    v = row[dict(seen)[x.table.lower()] + c["name"]]
                    if v is None:
                        return ast.Cast(ast.Lit(None, "null"), c["type"] or "BLOB")
                    if c["kind"] == "date":
                        return ast.Cast(ast.Lit(str(v), "text"), "DATETIME")
                    return ast.Lit(bytes(v).hex(), "blob") if c["kind"] == "blob" else ast.Lit(v, kinds.get(c["kind"], "int"))
                return None

            if trigger.when is not None:
                test = ast.Query(ast.Core(items=[ast.Item(ast.Case(None, [(substitute(trigger.when, fixed), ast.Lit(1, "int"))], ast.Lit(0, "int")), "hit", "")]))
                if not self._select(test, {}).first()[0]:
                    continue
            statement = substitute(body, fixed)
            if isinstance(statement, ast.Query):
                self._select(statement, {}).collect()
            else:
                self._dml(statement, {}, depth + 1)
        return rows

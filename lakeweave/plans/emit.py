"""From the dialect's syntax tree to Spark SQL text.

The emitter resolves names against the tables' schemas, so that it knows each
expression's class: integer division, text conversion and predicates used as
numbers depend on it. Everything else, from join order to pushdown, is left to
Spark's own optimizer.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from dataclasses import fields, is_dataclass

from lakeweave.functions import aggregates, scalar
from lakeweave.functions.scalar import Typed, number, quote, text, truth
from lakeweave.functions.types import SPARK, affinity
from lakeweave.plans import ast
from lakeweave.plans.lexer import SqlError


#: In emitted text: what may choose other rows when it runs again.
UNSTEADY = re.compile(r"\b(LIMIT|OFFSET) \d|\b(rand|any_value|row_number|ntile|lag|lead|first_value|last_value|nth_value)\(")


def name(identifier: str) -> str:
    return "`" + identifier.replace("`", "``") + "`"


class Relation:
    """What a name in FROM stands for: the text to put there and its (column, class) pairs."""

    def __init__(self, sql: str, columns: list[tuple[str, str]], primary: tuple[str, ...] = ()):
        self.sql, self.columns, self.primary = sql, columns, primary


class Scope:
    def __init__(self, outer: Scope | None = None):
        self.outer = outer
        self.sources: list[tuple[str, list[tuple[str, str]], tuple[str, ...]]] = []
        self.merged: dict[str, str] = {}  # columns joined by USING or NATURAL
        self.aliases: dict[str, Typed] = {}
        self.grouped: list | None = None  # group keys of an aggregating select
        self.inside_aggregate = False

    def find(self, column: str, table: str | None) -> tuple[str, str] | None:
        low = column.lower()
        if table is None and low in self.merged:
            return name(column), self.merged[low]
        for alias, columns, _ in self.sources:
            if table is None or alias.lower() == table.lower():
                for c, kind in columns:
                    if c.lower() == low:
                        return f"{name(alias)}.{name(c)}", kind
        return None


def contains(node, test: Callable) -> bool:
    """Whether the tree holds a node for which the test is true; subqueries are not entered."""
    if test(node):
        return True
    if isinstance(node, (list, tuple)):
        return any(contains(x, test) for x in node)
    if is_dataclass(node) and not isinstance(node, ast.Query):
        return any(contains(getattr(node, f.name), test) for f in fields(node))
    return False


def is_in_query(node) -> bool:
    return isinstance(node, ast.InQuery)


def is_local(node) -> bool:
    """Whether the node has no meaning, or another value, inside a subquery: aggregates, windows, random numbers, subqueries."""
    return isinstance(node, ast.Query) or isinstance(node, ast.Call) and (node.over is not None or node.name == "random" or is_aggregate_call(node))


def is_aggregate_call(node) -> bool:
    return isinstance(node, ast.Call) and node.over is None and aggregates.is_aggregate(node.name, len(node.args), node.star)


class Emitter:
    """resolve gives a Relation for a table name, or None; params are values by name or number."""

    def __init__(self, resolve: Callable[[str], Relation | None], params: dict | None = None, kept_unique: bool = False):
        self.resolve = resolve
        self.kept_unique = kept_unique  # whether primary keys are enforced by the tables' owner, not just declared
        self.params = {str(k).lstrip(":@$?").lower(): v for k, v in (params or {}).items()}
        self.ctes: list[dict[str, list[tuple[str, str]]]] = []
        self.made = 0

    # Literals and parameters

    def value(self, v) -> Typed:
        if v is None:
            return "NULL", "null"
        if isinstance(v, bool):
            return ("TRUE" if v else "FALSE"), "bool"
        if isinstance(v, int):
            if not -(2**63) <= v < 2**63:
                raise SqlError(f"integer out of range: {v}")
            return (f"{v}L" if v > -(2**63) else "(-9223372036854775807L - 1L)"), "int"
        if isinstance(v, float):
            if v != v or v in (float("inf"), float("-inf")):
                return f"DOUBLE('{v}')", "real"
            return f"{v!r}D", "real"
        if isinstance(v, str):
            return quote(v), "text"
        if isinstance(v, (bytes, bytearray)):
            return f"X'{bytes(v).hex()}'", "blob"
        if isinstance(v, (datetime.datetime, datetime.date)):
            return f"TIMESTAMP_NTZ '{v}'", "date"
        raise SqlError(f"unsupported parameter type {type(v).__name__}")

    def literal(self, x: ast.Lit) -> Typed:
        if x.kind == "null":
            return "NULL", "null"
        if x.kind == "blob":
            return f"X'{x.value}'", "blob"
        if x.kind == "now":
            return {
                "CURRENT_DATE": ("CAST(date_trunc('DAY', current_timestamp()) AS TIMESTAMP_NTZ)", "date"),
                "CURRENT_TIMESTAMP": ("CAST(current_timestamp() AS TIMESTAMP_NTZ)", "date"),
                "CURRENT_TIME": ("date_format(current_timestamp(), 'HH:mm:ss')", "text"),
            }[x.value]
        return self.value(x.value)

    def param(self, key: str) -> Typed:
        if key.lower() not in self.params:
            raise SqlError(f"no value for parameter {key!r}")
        return self.value(self.params[key.lower()])

    # Expressions

    def expr(self, x, scope: Scope) -> Typed:
        if scope.grouped and not scope.inside_aggregate and x in scope.grouped:
            # A group key is emitted as it stands in GROUP BY, its columns not being bare.
            scope.inside_aggregate = True
            try:
                return getattr(self, f"_{type(x).__name__.lower()}")(x, scope)
            finally:
                scope.inside_aggregate = False
        return getattr(self, f"_{type(x).__name__.lower()}")(x, scope)

    def truth(self, x, scope: Scope) -> str:
        return truth(self.expr(x, scope))

    def _lit(self, x, scope):
        return self.literal(x)

    def _param(self, x, scope):
        return self.param(x.name)

    def _col(self, x, scope):
        level = scope
        while level:
            if found := level.find(x.name, x.table):
                return self._bare(x, found, level)
            if x.table is None and x.name.lower() in level.aliases:
                return level.aliases[x.name.lower()]
            level = level.outer
        raise SqlError(f"no such column: {(x.table + '.') if x.table else ''}{x.name}")

    def _bare(self, x, found, scope: Scope) -> Typed:
        """In a grouped select a column that is neither key nor aggregated has the value of the group's last row."""
        if scope.grouped is None or scope.inside_aggregate:
            return found
        for key in scope.grouped:
            if isinstance(key, ast.Col) and scope.find(key.name, key.table) == found:
                return found
        keys = [f"{name(a)}.{name(c)}" for a, _, primary in scope.sources for c in primary]
        if not keys:
            return f"any_value({found[0]})", found[1]
        return f"max_by({found[0]}, struct({', '.join(keys)}))", found[1]

    def _unary(self, x, scope):
        if x.op == "-" and isinstance(x.x, ast.Lit) and x.x.kind in ("int", "real"):
            return self.value(-x.x.value)
        if x.op == "NOT" and is_in_query(x.x):
            return self._inquery(ast.InQuery(x.x.x, x.x.query, not x.x.negated), scope)
        if x.op == "NOT" and isinstance(x.x, ast.Binary) and x.x.op in ("AND", "OR") and contains(x.x, is_in_query):
            # Spark moves the NOT inwards, to where it means NOT IN.
            return self._binary(ast.Binary("OR" if x.x.op == "AND" else "AND", ast.Unary("NOT", x.x.a), ast.Unary("NOT", x.x.b)), scope)
        a = self.expr(x.x, scope)
        if x.op == "NOT":
            return f"(NOT {truth(a)})", "bool"
        if x.op == "+":
            return a
        return f"({x.op}{number(a)})", "int" if a[1] == "bool" else a[1]

    def _binary(self, x, scope):
        op = x.op
        if op in ("AND", "OR"):
            return f"({self.truth(x.a, scope)} {op} {self.truth(x.b, scope)})", "bool"
        if op in ("=", "<>", "<", "<=", ">", ">=") and isinstance(x.a, ast.Row):
            return self.expr(_compare_rows(op, x.a, x.b), scope)
        a, b = self.expr(x.a, scope), self.expr(x.b, scope)
        if op in ("=", "<>", "<", "<=", ">", ">="):
            (p, q), _ = scalar.alike(a, b)
            return f"({p} {op} {q})", "bool"
        if op == "||":
            return f"concat({text(a)}, {text(b)})", "text"
        if op in ("->", "->>"):
            return f"get_json_object({text(a)}, {self._path(x.b, b)})", "text"
        p, q = number(a), number(b)
        kind = scalar.common(a, b)
        if op in ("<<", ">>"):
            return f"{'shiftleft' if op == '<<' else 'shiftright'}(CAST({p} AS BIGINT), CAST({q} AS INT))", "int"
        if op in ("&", "|"):
            return f"(CAST({p} AS BIGINT) {op} CAST({q} AS BIGINT))", "int"
        if op == "/" and kind in ("int", "bool"):
            return f"({p} div {q})", "int"
        if op == "/":
            if isinstance(x.b, ast.Lit) and x.b.value:
                return f"({p} / {q})", "real"
            return scalar.real_div(p, q), "real"
        return f"({p} {op} {q})", "int" if kind == "bool" else kind

    def _path(self, node, typed: Typed) -> str:
        if isinstance(node, ast.Lit) and node.kind == "int":
            return quote(f"$[{node.value}]")
        if isinstance(node, ast.Lit) and node.kind == "text":
            return quote(node.value if node.value.startswith("$") else f"$.{node.value}")
        return f"if(startswith({text(typed)}, '$'), {text(typed)}, concat('$.', {text(typed)}))"

    def _isnull(self, x, scope):
        return f"({self.expr(x.x, scope)[0]} IS {'NOT ' if x.negated else ''}NULL)", "bool"

    def _same(self, x, scope):
        (a, b), _ = scalar.alike(self.expr(x.a, scope), self.expr(x.b, scope))
        return f"({'NOT ' if x.negated else ''}({a} <=> {b}))", "bool"

    def _between(self, x, scope):
        (v, low, high), _ = scalar.alike(*[self.expr(i, scope) for i in (x.x, x.low, x.high)])
        return f"({v} {'NOT ' if x.negated else ''}BETWEEN {low} AND {high})", "bool"

    def _inlist(self, x, scope):
        if not x.items:
            return ("TRUE" if x.negated else "FALSE"), "bool"
        if isinstance(x.x, ast.Row):
            any_of = _compare_rows("=", x.x, x.items[0])
            for item in x.items[1:]:
                any_of = ast.Binary("OR", any_of, _compare_rows("=", x.x, item))
            return self.expr(ast.Unary("NOT", any_of) if x.negated else any_of, scope)
        (v, *items), _ = scalar.alike(self.expr(x.x, scope), *[self.expr(i, scope) for i in x.items])
        return f"({v} {'NOT ' if x.negated else ''}IN ({', '.join(items)}))", "bool"

    def _inquery(self, x, scope):
        sql, _ = self.query(x.query, scope)
        left = f"({', '.join(number(self.expr(i, scope)) for i in x.x.items)})" if isinstance(x.x, ast.Row) else number(self.expr(x.x, scope))
        if x.negated and not isinstance(x.x, ast.Row) and not UNSTEADY.search(sql):
            return self._not_in(x, left, sql, scope), "bool"
        return f"({left} {'NOT ' if x.negated else ''}IN ({sql}))", "bool"

    def _not_in(self, x, left: str, sql: str, scope: Scope) -> str:
        """NOT IN by an equi-join and tests for NULLs: Spark's own null-aware join sends all rows of the subquery to the driver.

        The subquery stands here more than once, so it has to be steady.
        """
        self.made += 1
        rows = f"(SELECT 1 FROM ({sql}) AS `__in{self.made}`(`__value{self.made}`)"
        value = f"`__in{self.made}`.`__value{self.made}`"
        if scope.grouped is None and not contains(x.x, is_local):
            found = f"EXISTS {rows} WHERE {value} = {left})"
        else:
            found = f"coalesce({left} IN ({sql}), FALSE)"
        return f"(NOT {found} AND (NOT EXISTS {rows} WHERE {value} IS NULL) OR NULL) AND ({left} IS NOT NULL OR NOT EXISTS {rows}) OR NULL))"

    def _match(self, x, scope):
        a, p = self.expr(x.x, scope), self.expr(x.pattern, scope)
        literal = x.pattern.value if isinstance(x.pattern, ast.Lit) and x.pattern.kind == "text" else None
        if x.op == "LIKE":
            out = scalar.like(a, p, literal, self.expr(x.escape, scope)[0] if x.escape else None)
        elif x.op == "GLOB":
            out = scalar.glob(a, p, literal)
        elif x.op == "REGEXP":
            out = f"({text(a)} RLIKE {text(p)})"
        else:
            out = f"contains(lower({text(a)}), lower({text(p)}))"
        return (f"(NOT {out})" if x.negated else out), "bool"

    def _cast(self, x, scope):
        a, kind = self.expr(x.x, scope), affinity(x.type)
        if kind == "text":
            return text(a), "text"
        if kind in ("tiny", "small", "bool"):
            kind = "int"
        return f"CAST({number(a)} AS {SPARK[kind]})", kind

    def _case(self, x, scope):
        results = [self.expr(r, scope) for _, r in x.whens] + ([self.expr(x.otherwise, scope)] if x.otherwise else [])
        values, kind = scalar.unify(*results)
        parts = ["CASE"]
        base = self.expr(x.base, scope) if x.base else None
        for (condition, _), value in zip(x.whens, values, strict=False):
            if base:
                (a, b), _ = scalar.alike(base, self.expr(condition, scope))
                parts.append(f"WHEN {a} = {b} THEN {value}")
            else:
                parts.append(f"WHEN {self.truth(condition, scope)} THEN {value}")
        if x.otherwise:
            parts.append(f"ELSE {values[-1]}")
        return " ".join([*parts, "END"]), kind

    def _call(self, x, scope):
        windowed = x.over is not None
        if not aggregates.is_aggregate(x.name, len(x.args), x.star, windowed):
            if windowed or x.distinct or x.where is not None or x.star:
                raise SqlError(f"{x.name}() is not an aggregate function")
            try:
                return scalar.call(x.name, [self.expr(a, scope) for a in x.args])
            except ValueError as e:
                raise SqlError(str(e)) from None
        before = scope.inside_aggregate
        # Inside an aggregate columns are plain; a window over groups works on the groups' values.
        scope.inside_aggregate = before or not windowed
        args = [self.expr(a, scope) for a in x.args]
        where = f" FILTER (WHERE {self.truth(x.where, scope)})" if x.where is not None else ""
        order = f" WITHIN GROUP (ORDER BY {self.orders(x.order, scope)})" if x.order else ""
        over = f" OVER {name(x.over) if isinstance(x.over, str) else self.window(x.over, scope)}" if windowed else ""
        scope.inside_aggregate = before
        if x.name in aggregates.WINDOWS:
            return aggregates.window(x.name, args, over)
        try:
            return aggregates.aggregate(x.name, args, x.star, x.distinct, where, over, order)
        except ValueError as e:
            raise SqlError(str(e)) from None

    def window(self, w: ast.Window, scope: Scope) -> str:
        if w.frame and re.search(r"\bGROUPS\b|\bEXCLUDE\b(?!\s+NO\s+OTHERS)", w.frame, re.I):
            raise SqlError("GROUPS frames and EXCLUDE are not supported")
        parts = [name(w.base)] if w.base else []
        if w.partition:
            parts.append("PARTITION BY " + ", ".join(self.expr(p, scope)[0] for p in w.partition))
        if w.order:
            parts.append("ORDER BY " + self.orders(w.order, scope))
        if w.frame:
            parts.append(re.sub(r"\s+EXCLUDE\s+NO\s+OTHERS", "", w.frame, flags=re.I))
        return f"({' '.join(parts)})"

    def _exists(self, x, scope):
        sql, _ = self.query(x.query, scope)
        return f"({'NOT ' if x.negated else ''}EXISTS ({sql}))", "bool"

    def _scalar(self, x, scope):
        sql, columns = self.query(x.query, scope)
        core = x.query.body
        single = isinstance(core, ast.Core) and not core.group and contains(core.items, is_aggregate_call)
        if not single and x.query.limit is None:
            sql += " LIMIT 1"
        return f"({sql})", columns[0][1]

    def _row(self, x, scope):
        return f"struct({', '.join(number(self.expr(i, scope)) for i in x.items)})", "any"

    def _collate(self, x, scope):
        kinds = {"NOCASE": "UTF8_LCASE", "BINARY": "UTF8_BINARY", "RTRIM": "UTF8_BINARY_RTRIM"}
        return f"({text(self.expr(x.x, scope))} COLLATE {kinds.get(x.name.upper(), x.name)})", "text"

    def _raise(self, x, scope):
        return f"raise_error({quote(x.message or 'ignored')})", "any"

    def orders(self, terms: list, scope: Scope) -> str:
        return ", ".join(self.order(t, scope) for t in terms)

    def order(self, t: ast.Order, scope: Scope) -> str:
        # Spark's defaults are the dialect's: nulls first ascending, last descending.
        nulls = f" NULLS {t.nulls}" if t.nulls else ""
        if isinstance(t.expr, ast.Lit) and t.expr.kind == "int":
            x = str(t.expr.value)
        else:
            x = self.expr(t.expr, scope)[0]
        return f"{x}{' DESC' if t.desc else ''}{nulls}"

    # FROM

    def relation(self, table: str) -> Relation:
        for level in reversed(self.ctes):
            if table.lower() in level:
                return Relation(name(table), level[table.lower()])
        if found := self.resolve(table):
            return found
        raise SqlError(f"no such table: {table}")

    def source(self, x, scope: Scope) -> str:
        if isinstance(x, ast.Table):
            r = self.relation(x.name)
            alias = x.alias or x.name
            scope.sources.append((alias, r.columns, r.primary))
            return f"{r.sql} AS {name(alias)}"
        if isinstance(x, ast.Derived):
            sql, columns = self.query(x.query, None)
            self.made += 1
            alias = x.alias or f"__derived{self.made}"
            scope.sources.append((alias, columns, ()))
            return f"({sql}) AS {name(alias)}"
        if isinstance(x, ast.TableFunction):
            args = [number(self.expr(a, scope)) for a in x.args]
            alias = x.alias or x.name
            if x.name == "generate_series":
                step = args[2] if len(args) > 2 else "1L"
                scope.sources.append((alias, [("value", "int")], ()))
                return f"(SELECT explode(sequence({args[0]}, {args[1]}, {step})) AS `value`) AS {name(alias)}"
            if x.name == "json_each":
                scope.sources.append((alias, [("key", "int"), ("value", "text")], ()))
                return f"(SELECT CAST(p AS BIGINT) AS `key`, v AS `value` FROM (SELECT posexplode(from_json({args[0]}, 'array<string>')) AS (p, v))) AS {name(alias)}"
            raise SqlError(f"no such table function: {x.name}")
        return self.join(x, scope)

    def join(self, x: ast.Join, scope: Scope) -> str:
        left = self.source(x.left, scope)
        count = len(scope.sources)
        right = self.source(x.right, scope)
        if isinstance(x.right, ast.Join):
            right = f"({right})"
        using = x.using
        if x.natural:
            have = {c.lower() for _, columns, _ in scope.sources[:count] for c, _ in columns}
            using = [c for _, columns, _ in scope.sources[count:] for c, _ in columns if c.lower() in have]
        kind = {"INNER": "INNER", "CROSS": "CROSS", "LEFT": "LEFT", "RIGHT": "RIGHT", "FULL": "FULL"}[x.kind]
        if using:
            for c in using:
                found = scope.find(c, None)
                if not found:
                    raise SqlError(f"cannot join using column {c}")
                scope.merged[c.lower()] = found[1]
            return f"{left} {kind if kind != 'CROSS' else 'INNER'} JOIN {right} USING ({', '.join(map(name, using))})"
        if x.on is not None:
            return f"{left} {kind if kind != 'CROSS' else 'INNER'} JOIN {right} ON {self.truth(x.on, scope)}"
        return f"{left} {'CROSS' if kind in ('INNER', 'CROSS') else kind} JOIN {right}" + ("" if kind in ("INNER", "CROSS") else " ON TRUE")

    # SELECT

    def query(self, q: ast.Query, outer: Scope | None = None) -> tuple[str, list[tuple[str, str]]]:
        """Spark SQL and output (column, class) pairs."""
        level: dict[str, list[tuple[str, str]]] = {}
        self.ctes.append(level)
        try:
            head = []
            for cte, columns, inner in q.ctes:
                if q.recursive and isinstance(inner.body, ast.Compound):
                    seed = inner.body
                    while isinstance(seed, ast.Compound):
                        seed = seed.left
                    _, found = self.body(seed, None)
                    level[cte.lower()] = [(c, k) for c, (_, k) in zip(columns or [n for n, _ in found], found, strict=True)]
                sql, found = self.query(inner, None)
                found = [(c, k) for c, (_, k) in zip(columns or [n for n, _ in found], found, strict=True)]
                level[cte.lower()] = found
                head.append(f"{name(cte)}({', '.join(name(c) for c, _ in found)}) AS ({sql})")
            sql, columns, scope = self._body(q.body, outer, q)
            if q.order:
                sql += " ORDER BY " + ", ".join(self._final_order(t, q, columns, scope) for t in q.order)
            sql += self.limits(q.limit, q.offset)
            if head:
                sql = f"WITH {'RECURSIVE ' if q.recursive else ''}{', '.join(head)} {sql}"
            return sql, columns
        finally:
            self.ctes.pop()

    def _final_order(self, t: ast.Order, q: ast.Query, columns, scope: Scope | None) -> str:
        simple = isinstance(q.body, ast.Core)
        if isinstance(t.expr, ast.Col) and t.expr.table is None:
            names = [c.lower() for c, _ in columns]
            if t.expr.name.lower() in names:
                return f"{name(columns[names.index(t.expr.name.lower())][0])}{' DESC' if t.desc else ''}{f' NULLS {t.nulls}' if t.nulls else ''}"
        if simple and q.body.distinct:
            for i, item in enumerate(q.body.items, 1):
                if isinstance(item, ast.Item) and item.expr == t.expr:
                    return self.order(ast.Order(ast.Lit(i, "int"), t.desc, t.nulls), scope)
        if not simple:
            scope = Scope()
            scope.aliases = {c.lower(): (name(c), k) for c, k in columns}
        return self.order(t, scope)

    def limits(self, limit, offset) -> str:
        n = None if limit is None else self.constant(limit)
        m = None if offset is None else self.constant(offset)
        out = "" if n is None or n < 0 else f" LIMIT {n}"
        return out + (f" OFFSET {m}" if m and m > 0 else "")

    def constant(self, x) -> int | None:
        """The value of a LIMIT or OFFSET: a literal, a parameter or arithmetic on them."""
        if isinstance(x, ast.Lit) and x.kind in ("int", "null"):
            return x.value
        if isinstance(x, ast.Param):
            if x.name.lower() not in self.params:
                raise SqlError(f"no value for parameter {x.name!r}")
            v = self.params[x.name.lower()]
            return None if v is None else int(v)
        if isinstance(x, ast.Unary) and x.op in "+-":
            v = self.constant(x.x)
            return v if v is None or x.op == "+" else -v
        if isinstance(x, ast.Binary) and x.op in ("+", "-", "*"):
            a, b = self.constant(x.a), self.constant(x.b)
            return None if a is None or b is None else {"+": a + b, "-": a - b, "*": a * b}[x.op]
        raise SqlError("LIMIT and OFFSET take a constant")

    def body(self, x, outer):
        sql, columns, _ = self._body(x, outer, None)
        return sql, columns

    def _body(self, x, outer: Scope | None, q: ast.Query | None):
        if isinstance(x, ast.Compound):
            left, columns = self.body(x.left, outer)
            right, more = self.body(x.right, outer)
            if len(columns) != len(more):
                raise SqlError(f"SELECTs to the left and right of {x.op} do not have the same number of result columns")
            if isinstance(x.left, ast.Compound) and x.left.op != x.op:
                left = f"({left})"  # operators group from left to right, without precedence
            kinds = [(c, scalar.common((c, k), (c, m))) for (c, k), (_, m) in zip(columns, more, strict=True)]
            return f"{left} {x.op} {right}", kinds, None
        if isinstance(x, ast.Values):
            scope = Scope(outer)
            if len({len(r) for r in x.rows}) != 1:
                raise SqlError("all VALUES must have the same number of terms")
            rows = [[self.expr(v, scope) for v in r] for r in x.rows]
            kinds = [scalar.common(*column) for column in zip(*rows, strict=True)]
            columns = [(f"column{i}", "int" if k == "bool" else k) for i, k in enumerate(kinds, 1)]
            body = ", ".join(f"({', '.join(number(v) for v in r)})" for r in rows)
            return f"SELECT * FROM VALUES {body} AS __values({', '.join(c for c, _ in columns)})", columns, scope
        return self.core(x, outer, q)

    def core(self, x: ast.Core, outer: Scope | None, q: ast.Query | None):
        scope = Scope(outer)
        source = self.source(x.source, scope) if x.source is not None else None
        where = self.truth(x.where, scope) if x.where is not None else None
        order = q.order if q else []
        aliases = {i.alias.lower(): i.expr for i in x.items if isinstance(i, ast.Item) and i.alias}
        group = [self._group_key(g, x, aliases, scope) for g in x.group]
        keys = ", ".join(self.expr(g, scope)[0] for g in group)
        if group or x.having is not None or contains([x.items, order], is_aggregate_call):
            scope.grouped = group
        items, columns = [], []
        for item in x.items:
            if isinstance(item, ast.Star):
                if not scope.sources:
                    raise SqlError("no tables specified")
                items_, columns_ = self._star(item, scope)
                items += items_
                columns += columns_
                continue
            sql, kind = self.expr(item.expr, scope)
            if kind == "bool" and not isinstance(item.expr, ast.Col):
                sql, kind = f"CAST({sql} AS BIGINT)", "int"
            if kind == "null":
                sql = "CAST(NULL AS STRING)"
            alias = item.alias or (item.expr.name if isinstance(item.expr, ast.Col) else item.text)
            items.append(f"{sql} AS {name(alias)}")
            columns.append((alias, kind))
            if item.alias and not scope.find(item.alias, None):
                scope.aliases[item.alias.lower()] = (name(item.alias), kind)
        parts = ["SELECT DISTINCT" if x.distinct and not self._unique(x, scope) else "SELECT", ", ".join(items)]
        if source:
            parts.append(f"FROM {source}")
        if where:
            parts.append(f"WHERE {where}")
        if keys:
            parts.append(f"GROUP BY {keys}")
        if x.having is not None:
            parts.append(f"HAVING {self._having(x.having, aliases, scope)}")
        if x.windows:
            parts.append("WINDOW " + ", ".join(f"{name(n)} AS {self.window(w, scope)}" for n, w in x.windows))
        return " ".join(parts), columns, scope

    def _unique(self, x: ast.Core, scope: Scope) -> bool:
        """Whether the output holds the primary key of the only table, so that its rows are distinct as they are."""
        if not self.kept_unique or len(scope.sources) != 1 or not scope.sources[0][2] or scope.grouped is not None:
            return False
        shown = {i.expr.name.lower() for i in x.items if isinstance(i, ast.Item) and isinstance(i.expr, ast.Col)}
        return any(isinstance(i, ast.Star) for i in x.items) or {k.lower() for k in scope.sources[0][2]} <= shown

    def _having(self, having, aliases, scope: Scope) -> str:
        return self.truth(_replace_aliases(having, aliases, scope), scope)

    def _group_key(self, g, x: ast.Core, aliases, scope: Scope):
        if isinstance(g, ast.Lit) and g.kind == "int":
            if not 1 <= g.value <= len(x.items):
                raise SqlError(f"GROUP BY term {g.value} out of range")
            return x.items[g.value - 1].expr
        return _replace_aliases(g, aliases, scope)

    def _star(self, item: ast.Star, scope: Scope):
        items, columns, seen = [], [], set()
        for alias, cols, _ in scope.sources:
            if item.table is not None and alias.lower() != item.table.lower():
                continue
            for c, kind in cols:
                if item.table is None and c.lower() in scope.merged:
                    if c.lower() in seen:
                        continue
                    seen.add(c.lower())
                    items.append(name(c))
                else:
                    found = f"{name(alias)}.{name(c)}"
                    items.append(self._bare(ast.Col(c, alias), (found, kind), scope)[0] + f" AS {name(c)}")
                columns.append((c, kind))
        if not items:
            raise SqlError(f"no such table: {item.table}")
        return items, columns


def _compare_rows(op: str, a: ast.Row, b):
    """A comparison of row values by comparisons of their items, the first that differ deciding."""
    if not isinstance(b, ast.Row) or len(a.items) != len(b.items):
        raise SqlError("row values of different sizes")
    pairs = list(zip(a.items, b.items, strict=True))
    if op in ("=", "<>"):
        equal = ast.Binary("=", *pairs[0])
        for p, q in pairs[1:]:
            equal = ast.Binary("AND", equal, ast.Binary("=", p, q))
        return equal if op == "=" else ast.Unary("NOT", equal)
    out = ast.Binary(op, *pairs[-1])
    for p, q in reversed(pairs[:-1]):
        out = ast.Binary("OR", ast.Binary(op[0], p, q), ast.Binary("AND", ast.Binary("=", p, q), out))
    return out


def _replace_aliases(x, aliases: dict, scope: Scope):
    """The expression with output names that are no source columns replaced by what they stand for."""
    if isinstance(x, ast.Col) and x.table is None and x.name.lower() in aliases and not scope.find(x.name, None):
        return aliases[x.name.lower()]
    if isinstance(x, list):
        return [_replace_aliases(i, aliases, scope) for i in x]
    if isinstance(x, tuple):
        return tuple(_replace_aliases(i, aliases, scope) for i in x)
    if is_dataclass(x) and not isinstance(x, ast.Query):
        return type(x)(**{f.name: _replace_aliases(getattr(x, f.name), aliases, scope) for f in fields(x)})
    return x

"""Recursive-descent parser of the dialect: text to syntax tree."""

from __future__ import annotations

from lakeweave.plans import ast
from lakeweave.plans.lexer import SqlError, Token, tokens

#: Words that end an expression or a table reference, so that they are no aliases.
RESERVED = set(
    "ALL AND AS ASC BETWEEN BY CASE CAST COLLATE CREATE CROSS DEFAULT DELETE DESC DISTINCT DROP ELSE END ESCAPE EXCEPT EXISTS FILTER FROM FULL GLOB GROUP HAVING IN INDEXED INNER INSERT INTERSECT INTO IS ISNULL JOIN LEFT LIKE LIMIT MATCH NATURAL NOT NOTNULL NULL NULLS OFFSET ON OR ORDER OUTER OVER REGEXP RETURNING RIGHT SELECT SET THEN UNION UPDATE USING VALUES WHEN WHERE WINDOW WITH DO".split()
)
_COMPARE = {"=", "==", "<>", "!="}
_ORDERED = {"<", "<=", ">", ">="}
_BITS = {"<<", ">>", "&", "|"}


class Parser:
    def __init__(self, sql: str):
        self.sql = sql
        self.tokens = tokens(sql)
        self.at = 0
        self.params = 0

    # Tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def take(self) -> Token:
        self.at += 1
        return self.tokens[self.at - 1]

    def is_word(self, *words: str) -> bool:
        return self.now.upper in words

    def word(self, *words: str) -> str | None:
        """Take one of the words if it is next."""
        return self.take().upper if self.now.kind == "word" and self.now.upper in words else None

    def words(self, *sequence: str) -> bool:
        """Take the whole sequence if it is next."""
        if all(self.ahead(i).upper == w for i, w in enumerate(sequence)):
            self.at += len(sequence)
            return True
        return False

    def op(self, *ops: str) -> str | None:
        return self.take().value if self.now.kind == "op" and self.now.value in ops else None

    def need(self, *sequence: str) -> None:
        for x in sequence:
            if not (self.op(x) or self.word(x)):
                raise SqlError(f"expected {x} at {self.now.start}, found {self.now.value or 'the end'!r}")

    def name(self) -> str:
        if self.now.kind in ("word", "quoted") or self.now.kind == "text":
            return self.take().value
        raise SqlError(f"expected a name at {self.now.start}, found {self.now.value or 'the end'!r}")

    def table_name(self) -> str:
        name = self.name()
        return self.name() if self.op(".") else name

    def names(self) -> list[str]:
        self.need("(")
        found = [self.name()]
        while self.op(","):
            found.append(self.name())
        self.need(")")
        return found

    def many(self, one) -> list:
        found = [one()]
        while self.op(","):
            found.append(one())
        return found

    def text_of(self, parse) -> str:
        """The text of what ``parse`` takes; the catalog keeps expressions as text."""
        start = self.now.start
        parse()
        return self.sql[start : self.tokens[self.at - 1].end]

    # Expressions, loosest first

    def expr(self):
        a = self._and()
        while self.word("OR"):
            a = ast.Binary("OR", a, self._and())
        return a

    def _and(self):
        a = self._not()
        while self.word("AND"):
            a = ast.Binary("AND", a, self._not())
        return a

    def _not(self):
        if self.is_word("NOT") and self.ahead().upper != "EXISTS":
            self.take()
            return ast.Unary("NOT", self._not())
        return self._equal()

    def _equal(self):
        a = self._less()
        while True:
            if self.now.kind == "op" and self.now.value in _COMPARE:
                op = {"==": "=", "!=": "<>"}.get(self.now.value, self.now.value)
                self.take()
                a = ast.Binary(op, a, self._less())
            elif self.words("IS", "NOT", "DISTINCT", "FROM"):
                a = ast.Same(a, self._less(), False)
            elif self.words("IS", "DISTINCT", "FROM"):
                a = ast.Same(a, self._less(), True)
            elif self.words("IS", "NOT"):
                a = ast.IsNull(a, True) if self.word("NULL") else ast.Same(a, self._less(), True)
            elif self.word("IS"):
                a = ast.IsNull(a, False) if self.word("NULL") else ast.Same(a, self._less(), False)
            elif self.word("ISNULL"):
                a = ast.IsNull(a, False)
            elif self.word("NOTNULL") or self.words("NOT", "NULL"):
                a = ast.IsNull(a, True)
            else:
                negated = self.is_word("NOT") and self.ahead().upper in ("BETWEEN", "IN", "LIKE", "GLOB", "REGEXP", "MATCH")
                if negated:
                    self.take()
                if self.word("BETWEEN"):
                    low = self._less()
                    self.need("AND")
                    a = ast.Between(a, low, self._less(), negated)
                elif self.word("IN"):
                    a = self._in(a, negated)
                elif op := self.word("LIKE", "GLOB", "REGEXP", "MATCH"):
                    pattern = self._less()
                    a = ast.Match(op, a, pattern, self._less() if self.word("ESCAPE") else None, negated)
                else:
                    return a

    def _in(self, x, negated: bool):
        if not self.op("("):
            core = ast.Core(items=[ast.Star(None)], source=ast.Table(self.table_name(), None))
            return ast.InQuery(x, ast.Query(core), negated)
        if self.is_word("SELECT", "WITH", "VALUES"):
            q = self.query()
            self.need(")")
            return ast.InQuery(x, q, negated)
        if self.op(")"):
            return ast.InList(x, [], negated)
        items = self.many(self.expr)
        self.need(")")
        return ast.InList(x, items, negated)

    def _left(self, ops: set, below):
        a = below()
        while self.now.kind == "op" and self.now.value in ops:
            op = self.take().value
            a = ast.Binary(op, a, below())
        return a

    def _less(self):
        return self._left(_ORDERED, self._bits)

    def _bits(self):
        return self._left(_BITS, self._sum)

    def _sum(self):
        return self._left({"+", "-"}, self._product)

    def _product(self):
        return self._left({"*", "/", "%"}, self._concat)

    def _concat(self):
        return self._left({"||", "->", "->>"}, self._unary)

    def _unary(self):
        if op := self.op("-", "+", "~"):
            return ast.Unary(op, self._unary())
        x = self._primary()
        while self.word("COLLATE"):
            x = ast.Collate(x, self.name())
        return x

    def _primary(self):
        t = self.now
        if t.kind in ("int", "real", "text", "blob", "param"):
            self.take()
            if t.kind == "int":
                return ast.Lit(int(t.value, 0) if t.value[:2].lower() == "0x" else int(t.value), "int")
            if t.kind == "param":
                if t.value == "?":
                    self.params += 1
                    return ast.Param(str(self.params))
                return ast.Param(t.value[1:])
            return ast.Lit(float(t.value) if t.kind == "real" else t.value, t.kind)
        if self.op("("):
            if self.is_word("SELECT", "WITH", "VALUES"):
                q = self.query()
                self.need(")")
                return ast.Scalar(q)
            items = self.many(self.expr)
            self.need(")")
            return items[0] if len(items) == 1 else ast.Row(items)
        if t.kind == "word":
            word = t.upper
            if word in ("NULL", "TRUE", "FALSE"):
                self.take()
                return ast.Lit(None, "null") if word == "NULL" else ast.Lit(word == "TRUE", "bool")
            if word in ("CURRENT_DATE", "CURRENT_TIME", "CURRENT_TIMESTAMP"):
                self.take()
                return ast.Lit(word, "now")
            if word == "CAST":
                self.take()
                self.need("(")
                x = self.expr()
                self.need("AS")
                kind = self.type_name()
                self.need(")")
                return ast.Cast(x, kind)
            if word == "CASE":
                return self._case()
            if word == "NOT" or word == "EXISTS":
                negated = bool(self.word("NOT"))
                self.need("EXISTS", "(")
                q = self.query()
                self.need(")")
                return ast.Exists(q, negated)
            if word == "RAISE" and self.ahead().value == "(":
                self.take()
                self.need("(")
                kind = self.word("IGNORE", "ABORT", "FAIL", "ROLLBACK")
                message = self.take().value if self.op(",") else None
                self.need(")")
                return ast.Raise(kind or "ABORT", message)
            if self.ahead().value == "(" and self.ahead().kind == "op" and (word not in RESERVED or word in ("GLOB", "LIKE", "MATCH", "REGEXP")):
                return self._call()
        if t.kind in ("word", "quoted") and t.upper not in RESERVED:
            parts = [self.name()]
            while self.op("."):
                parts.append(self.name())
            return ast.Col(parts[-1], parts[-2] if len(parts) > 1 else None)
        raise SqlError(f"expected an expression at {t.start}, found {t.value or 'the end'!r}")

    def _case(self):
        self.need("CASE")
        base = None if self.is_word("WHEN") else self.expr()
        whens = []
        while self.word("WHEN"):
            c = self.expr()
            self.need("THEN")
            whens.append((c, self.expr()))
        otherwise = self.expr() if self.word("ELSE") else None
        self.need("END")
        return ast.Case(base, whens, otherwise)

    def _call(self):
        call = ast.Call(self.take().value.lower(), [])
        self.need("(")
        if self.op("*"):
            call.star = True
        elif not (self.now.kind == "op" and self.now.value == ")"):
            call.distinct = bool(self.word("DISTINCT"))
            call.args = self.many(self.expr)
            if self.words("ORDER", "BY"):
                call.order = self.many(self.order_term)
        self.need(")")
        if self.words("WITHIN", "GROUP"):
            self.need("(", "ORDER", "BY")
            call.order = self.many(self.order_term)
            self.need(")")
        if self.words("FILTER"):
            self.need("(", "WHERE")
            call.where = self.expr()
            self.need(")")
        if self.word("OVER"):
            call.over = self.window() if self.now.value == "(" else self.name()
        return call

    def window(self):
        self.need("(")
        base = None
        if self.now.kind in ("word", "quoted") and not self.is_word("PARTITION", "ORDER", "RANGE", "ROWS", "GROUPS"):
            base = self.name()
        partition = self.many(self.expr) if self.words("PARTITION", "BY") else []
        order = self.many(self.order_term) if self.words("ORDER", "BY") else []
        frame = None
        if self.is_word("RANGE", "ROWS", "GROUPS"):
            start, depth = self.now.start, 0
            while depth or not (self.now.kind == "op" and self.now.value == ")"):
                depth += {"(": 1, ")": -1}.get(self.now.value, 0) if self.now.kind == "op" else 0
                if self.now.kind == "end":
                    raise SqlError("a window frame does not end")
                self.take()
            frame = self.sql[start : self.now.start].strip()
        self.need(")")
        return ast.Window(base, partition, order, frame)

    def type_name(self) -> str:
        parts = []
        while self.now.kind in ("word", "quoted") and not self.is_word("CONSTRAINT", "PRIMARY", "NOT", "NULL", "UNIQUE", "CHECK", "DEFAULT", "COLLATE", "REFERENCES", "GENERATED", "AS"):
            parts.append(self.take().value)
        if self.op("("):
            while not self.op(")"):
                self.take()
        return " ".join(parts)

    def order_term(self):
        x = self.expr()
        desc = self.word("ASC", "DESC") == "DESC"
        nulls = (self.word("FIRST", "LAST") or "FIRST") if self.word("NULLS") else None
        return ast.Order(x, desc, nulls)

    # Queries

    def query(self):
        q = ast.Query(None)
        if self.word("WITH"):
            q.recursive = bool(self.word("RECURSIVE"))
            q.ctes = self.many(self._cte)
        q.body = self._core()
        while op := self.word("UNION", "INTERSECT", "EXCEPT"):
            if op == "UNION" and self.word("ALL"):
                op = "UNION ALL"
            q.body = ast.Compound(op, q.body, self._core())
        if self.words("ORDER", "BY"):
            q.order = self.many(self.order_term)
        q.limit, q.offset = self.limits()
        return q

    def limits(self):
        if not self.word("LIMIT"):
            return None, None
        first = self.expr()
        if self.word("OFFSET"):
            return first, self.expr()
        if self.op(","):  # offset, limit
            return self.expr(), first
        return first, None

    def _cte(self):
        name = self.name()
        columns = self.names() if self.now.value == "(" else None
        self.need("AS")
        self.word("NOT")
        self.word("MATERIALIZED")
        self.need("(")
        q = self.query()
        self.need(")")
        return name, columns, q

    def _core(self):
        if self.word("VALUES"):
            return ast.Values(self.many(self._value_row))
        self.need("SELECT")
        core = ast.Core(distinct=bool(self.word("DISTINCT")))
        self.word("ALL")
        core.items = self.many(self._item)
        if self.word("FROM"):
            core.source = self._from()
        if self.word("WHERE"):
            core.where = self.expr()
        if self.words("GROUP", "BY"):
            core.group = self.many(self.expr)
        if self.word("HAVING"):
            core.having = self.expr()
        if self.word("WINDOW"):
            core.windows = self.many(self._named_window)
        return core

    def _named_window(self):
        name = self.name()
        self.need("AS")
        return name, self.window()

    def _value_row(self):
        self.need("(")
        row = self.many(self.expr)
        self.need(")")
        return row

    def _item(self):
        if self.op("*"):
            return ast.Star(None)
        if self.now.kind in ("word", "quoted") and self.ahead().value == "." and self.ahead(2).value == "*" and self.ahead(2).kind == "op":
            table = self.name()
            self.at += 2
            return ast.Star(table)
        start = self.now.start
        x = self.expr()
        text = self.sql[start : self.tokens[self.at - 1].end]
        return ast.Item(x, self._alias(), text)

    def _alias(self) -> str | None:
        if self.word("AS"):
            return self.name()
        if self.now.kind == "quoted" or self.now.kind == "word" and self.now.upper not in RESERVED:
            return self.take().value
        return None

    def _from(self):
        left = self._table()
        while True:
            if self.op(","):
                left = ast.Join("CROSS", False, left, self._table())
                continue
            start = self.at
            natural = bool(self.word("NATURAL"))
            kind = self.word("INNER", "LEFT", "RIGHT", "FULL", "CROSS")
            if kind in ("LEFT", "RIGHT", "FULL"):
                self.word("OUTER")
            if not self.word("JOIN"):
                self.at = start
                return left
            join = ast.Join(kind or "INNER", natural, left, self._table())
            if self.word("ON"):
                join.on = self.expr()
            elif self.word("USING"):
                join.using = self.names()
            left = join

    def _table(self):
        if self.op("("):
            if self.is_word("SELECT", "WITH", "VALUES"):
                q = self.query()
                self.need(")")
                return ast.Derived(q, self._alias())
            inner = self._from()
            self.need(")")
            return inner
        name = self.table_name()
        if self.op("("):
            args = [] if self.now.value == ")" else self.many(self.expr)
            self.need(")")
            return ast.TableFunction(name.lower(), args, self._alias())
        table = ast.Table(name, self._alias())
        if self.words("INDEXED", "BY"):  # access paths are the optimizer's choice
            self.name()
        else:
            self.words("NOT", "INDEXED")
        return table

    # Statements

    def statement(self):
        if self.word("EXPLAIN"):
            plan = self.words("QUERY", "PLAN")
            return ast.Explain(self.statement(), plan)
        if self.is_word("SELECT", "VALUES"):
            return self.query()
        if self.is_word("WITH"):
            return self.query()
        if self.is_word("INSERT", "REPLACE"):
            return self._insert()
        if self.is_word("UPDATE"):
            return self._update()
        if self.is_word("DELETE"):
            return self._delete()
        if self.is_word("CREATE"):
            return self._create()
        if self.word("DROP"):
            kind = self.word("TABLE", "INDEX", "VIEW", "TRIGGER")
            if not kind:
                raise SqlError(f"cannot drop {self.now.value!r}")
            missing_ok = self.words("IF", "EXISTS")
            return ast.Drop(kind, self.table_name(), missing_ok)
        if self.words("ALTER", "TABLE"):
            return self._alter()
        if action := self.word("BEGIN", "COMMIT", "END", "ROLLBACK", "SAVEPOINT", "RELEASE"):
            self.word("DEFERRED", "IMMEDIATE", "EXCLUSIVE")
            self.word("TRANSACTION")
            to = self.word("TO")
            self.word("SAVEPOINT")
            name = self.name() if self.now.kind in ("word", "quoted") else None
            return ast.Transaction("COMMIT" if action == "END" else "ROLLBACK TO" if to else action, name)
        raise SqlError(f"unsupported statement {self.now.value!r}")

    def all(self) -> list:
        """Statements separated by semicolons, each with its text."""
        found = []
        while self.now.kind != "end":
            if self.op(";"):
                continue
            start = self.now.start
            found.append((self.statement(), self.sql[start : self.tokens[self.at - 1].end]))
            if self.now.kind != "end":
                self.need(";")
        return found

    def _insert(self):
        action = None
        if self.word("REPLACE"):
            action = "REPLACE"
        else:
            self.need("INSERT")
            if self.word("OR"):
                action = self.word("REPLACE", "IGNORE", "ABORT", "FAIL", "ROLLBACK")
        self.need("INTO")
        table = self.table_name()
        if self.word("AS"):
            self.name()
        columns = self.names() if self.now.value == "(" else None
        source = None if self.words("DEFAULT", "VALUES") else self.query()
        upsert = None
        while self.words("ON", "CONFLICT"):
            target = []
            if self.op("("):
                target = self.many(self.name)
                self.need(")")
            if self.word("WHERE"):
                self.expr()
            self.need("DO")
            found = ast.Upsert(target, None, None)
            if not self.word("NOTHING"):
                self.need("UPDATE", "SET")
                found.sets = self.many(self._set)
                found.where = self.expr() if self.word("WHERE") else None
            upsert = upsert or found
        return ast.Insert(table, columns, source, action, upsert, self._returning())

    def _set(self):
        if self.now.value == "(" and self.now.kind == "op":
            columns = self.names()
            self.need("=")
            x = self.expr()
            values = x.items if isinstance(x, ast.Row) else [x]
            if len(values) != len(columns):
                raise SqlError("a row assignment needs as many values as columns")
            return list(zip(columns, values, strict=True))
        column = self.name()
        self.need("=")
        return [(column, self.expr())]

    def _returning(self) -> list:
        return self.many(self._item) if self.word("RETURNING") else []

    def _update(self):
        self.need("UPDATE")
        if self.word("OR"):
            self.take()
        table, alias = self.table_name(), None
        if self.word("AS"):
            alias = self.name()
        self.need("SET")
        u = ast.Update(table, alias, [x for s in self.many(self._set) for x in s])
        if self.word("FROM"):
            u.source = self._from()
        u.where = self.expr() if self.word("WHERE") else None
        u.returning = self._returning()
        if self.words("ORDER", "BY"):
            u.order = self.many(self.order_term)
        u.limit, u.offset = self.limits()
        return u

    def _delete(self):
        self.need("DELETE", "FROM")
        table = self.table_name()
        d = ast.Delete(table, self.name() if self.word("AS") else None)
        d.where = self.expr() if self.word("WHERE") else None
        d.returning = self._returning()
        if self.words("ORDER", "BY"):
            d.order = self.many(self.order_term)
        d.limit, d.offset = self.limits()
        return d

    def _create(self):
        start = self.now.start
        self.need("CREATE")
        unique = bool(self.word("UNIQUE"))
        self.word("TEMP", "TEMPORARY")
        kind = self.word("TABLE", "INDEX", "VIEW", "TRIGGER")
        if not kind:
            raise SqlError(f"cannot create {self.now.value!r}")
        exists_ok = self.words("IF", "NOT", "EXISTS")
        name = self.table_name()
        made = getattr(self, f"_create_{kind.lower()}")(name, exists_ok, unique)
        made.text = self.sql[start : self.tokens[self.at - 1].end]
        return made

    def _create_table(self, name, exists_ok, _):
        if self.word("AS"):
            return ast.CreateTable(name, [], [], [], [], exists_ok, self.query())
        table = ast.CreateTable(name, [], [], [], [], exists_ok)
        self.need("(")
        while True:
            if self.is_word("CONSTRAINT", "PRIMARY", "UNIQUE", "CHECK", "FOREIGN"):
                self._table_constraint(table)
            else:
                table.columns.append(self.column_def())
            if not self.op(","):
                break
        self.need(")")
        while self.words("WITHOUT", "ROWID") or self.word("STRICT"):
            self.op(",")
        table.primary = table.primary or [c.name for c in table.columns if c.primary]
        return table

    def _table_constraint(self, table):
        if self.word("CONSTRAINT"):
            self.name()
        if self.words("PRIMARY", "KEY"):
            self.need("(")
            table.primary = [o.expr.name for o in self.many(self.order_term)]
            self.need(")")
            self._conflict()
        elif self.word("UNIQUE"):
            self.need("(")
            table.unique.append([o.expr.name for o in self.many(self.order_term)])
            self.need(")")
            self._conflict()
        elif self.word("CHECK"):
            self.need("(")
            table.checks.append(self.text_of(self.expr))
            self.need(")")
        else:
            self.need("FOREIGN", "KEY")
            self.names()
            self._references()

    def _conflict(self):
        if self.words("ON", "CONFLICT"):
            self.take()

    def _references(self):
        self.need("REFERENCES")
        self.table_name()
        if self.now.value == "(":
            self.names()
        while self.is_word("ON", "MATCH", "DEFERRABLE", "NOT", "INITIALLY"):
            if self.word("ON"):
                self.take()
                if not (self.words("SET", "NULL") or self.words("SET", "DEFAULT") or self.words("NO", "ACTION")):
                    self.take()
            elif self.is_word("NOT") and self.ahead().upper != "DEFERRABLE":
                return
            else:
                self.take()
                if self.is_word("DEFERRED", "IMMEDIATE"):
                    self.take()

    def column_def(self):
        c = ast.ColumnDef(self.name(), "")
        c.type = self.type_name()
        while True:
            if self.word("CONSTRAINT"):
                self.name()
            if self.words("PRIMARY", "KEY"):
                c.primary = True
                self.word("ASC", "DESC")
                self._conflict()
                c.autoincrement = bool(self.word("AUTOINCREMENT"))
            elif self.words("NOT", "NULL"):
                c.not_null = True
                self._conflict()
            elif self.word("NULL"):
                pass
            elif self.word("UNIQUE"):
                c.unique = True
                self._conflict()
            elif self.word("DEFAULT"):
                c.default = self.text_of(self._unary)
            elif self.word("CHECK"):
                self.need("(")
                c.check = self.text_of(self.expr)
                self.need(")")
            elif self.word("COLLATE"):
                self.name()
            elif self.is_word("REFERENCES"):
                self._references()
            elif self.words("GENERATED", "ALWAYS", "AS") or self.word("AS"):
                self.need("(")
                c.generated = self.text_of(self.expr)
                self.need(")")
                self.word("STORED", "VIRTUAL")
            else:
                return c

    def _create_index(self, name, exists_ok, unique):
        self.need("ON")
        table = self.table_name()
        self.need("(")
        columns = self.many(self.order_term)
        self.need(")")
        where = self.expr() if self.word("WHERE") else None
        return ast.CreateIndex(name, table, columns, unique, where, exists_ok)

    def _create_view(self, name, exists_ok, _):
        columns = self.names() if self.now.value == "(" else None
        self.need("AS")
        start = self.now.start
        q = self.query()
        return ast.CreateView(name, columns, q, exists_ok, query_text=self.sql[start : self.tokens[self.at - 1].end])

    def _create_trigger(self, name, exists_ok, _):
        timing = self.word("BEFORE", "AFTER") or ("INSTEAD OF" if self.words("INSTEAD", "OF") else "BEFORE")
        event = self.word("INSERT", "UPDATE", "DELETE")
        of = self.many(self.name) if event == "UPDATE" and self.word("OF") else []
        self.need("ON")
        table = self.table_name()
        self.words("FOR", "EACH", "ROW")
        when = self.expr() if self.word("WHEN") else None
        self.need("BEGIN")
        body = []
        while not self.word("END"):
            body.append(self.statement())
            self.need(";")
        return ast.CreateTrigger(name, table, timing, event, of, when, body, exists_ok)

    def _alter(self):
        table = self.table_name()
        if self.words("RENAME", "TO"):
            return ast.Alter(table, "rename", (self.name(),))
        if self.word("RENAME"):
            self.word("COLUMN")
            old = self.name()
            self.need("TO")
            return ast.Alter(table, "rename_column", (old, self.name()))
        if self.word("ADD"):
            self.word("COLUMN")
            return ast.Alter(table, "add", (self.column_def(),))
        if self.word("DROP"):
            self.word("COLUMN")
            return ast.Alter(table, "drop", (self.name(),))
        raise SqlError(f"unsupported ALTER TABLE action {self.now.value!r}")


def parse(sql: str) -> list:
    """(statement, text) of each statement."""
    return Parser(sql).all()


def parse_one(sql: str):
    found = parse(sql)
    if len(found) != 1:
        raise SqlError(f"expected one statement, found {len(found)}")
    return found[0][0]


def parse_expr(sql: str):
    p = Parser(sql)
    x = p.expr()
    if p.now.kind != "end":
        raise SqlError(f"unexpected {p.now.value!r} after an expression")
    return x

"""The dialect against hand-written results: expressions, joins, grouping, sorting, set operations."""

import pytest

from lakeweave.plans.lexer import SqlError, tokens
from lakeweave.plans.parser import parse, parse_one
from lakeweave.workspace import Workspace


@pytest.fixture(scope="module")
def ws(spark):
    def table(rows, schema):
        return spark.createDataFrame(rows, schema)

    return Workspace(
        spark,
        {
            "users": table([(1, "alice"), (2, "bob"), (3, "charlie")], "id long, name string"),
            "orders": table([(10, 1, "widget"), (11, 1, "gadget"), (12, 2, "thing")], "id long, user_id long, product string"),
            "emp": table([(1, "eng", "dev", 100), (2, "eng", "dev", 120), (3, "eng", "qa", 90), (4, "sales", "rep", 80), (5, "sales", "rep", 85), (6, "sales", "mgr", 150), (7, "hr", "admin", 70)], "id long, dept string, role string, salary long"),
            "n": table([(1, "a", None), (2, None, 2.5), (3, "a", 0.0), (4, None, -1.0)], "id long, category string, x double"),
            "k": table([(1, 1), (2, None), (3, 3)], "id long, key long"),
            "m": table([(1, 1), (2, None), (4, 4)], "id long, key long"),
            "dates": table([(1, "1996-05-01"), (2, "1996-07-15"), (3, "1996-07-16"), (4, "1996-12-31")], "id long, d string").selectExpr("id", "cast(d as timestamp_ntz) d"),
        },
        {"users": ("id",), "orders": ("id",), "emp": ("id",), "n": ("id",)},
    )


def rows(ws, text, params=None):
    return [tuple(r) for r in ws.sql(text, params).collect()]


EXPRESSIONS = [
    ("1 + 2 * 3 - 4 / 3", 6), ("-7 / 2", -3), ("-7 % 3", -1), ("7 / 2.0", 3.5), ("5.5 % 2", 1.5), ("1 / 0.0", float("inf")), ("-3 / 0.0", float("-inf")),
    ("'a' || 1 || 2.0 || 2.5", "a122.5"), ("'a' || NULL", None), ("1 = 1.0", 1), ("NOT 0", 1), ("NOT 'x'", 0), ("NULL IS NULL", 1), ("1 IS NOT NULL", 1), ("NULL = NULL", None),
    ("NULL IS 1", 0), ("2 IS NOT 1", 1), ("1 IS DISTINCT FROM 1", 0), ("NULL IS NOT DISTINCT FROM NULL", 1), ("NULL ISNULL", 1), ("1 NOTNULL", 1), ("1 NOT NULL", 1),
    ("NULL OR 1", 1), ("NULL OR 0", None), ("0 AND NULL", 0), ("3 BETWEEN 1 AND 3", 1), ("NULL BETWEEN 1 AND 2", None), ("3 NOT BETWEEN 1 AND 2", 1),
    ("1 IN (1, NULL)", 1), ("2 IN (1, NULL)", None), ("2 NOT IN (1, 3)", 1), ("1 IN ()", 0), ("NULL NOT IN ()", 1), ("(1, 2) < (1, 3)", 1), ("(1, 2) IN ((1, 2), (3, 4))", 1),
    ("CAST(-1.7 AS INTEGER)", -1), ("CAST('12' AS INT)", 12), ("CAST(3 AS TEXT) || 'x'", "3x"), ("CAST(2.0 AS VARCHAR(10))", "2"), ("CAST(7 AS REAL)", 7.0), ("CAST(1.9 AS NUMERIC)", 1),
    ("CASE WHEN NULL THEN 1 WHEN 2 THEN 'b' END", "b"), ("CASE 3 WHEN 1 THEN 'a' ELSE 'z' END", "z"), ("'ABC' LIKE 'a_c'", 1), ("'a%c' LIKE 'a\\%c'", 0), ("'a%c' LIKE 'a!%c' ESCAPE '!'", 1),
    ("'abc' GLOB 'a*'", 1), ("'abc' GLOB 'A*'", 0), ("'a.c' GLOB 'a.?'", 1), ("'abc' REGEXP '^a.c$'", 1), ("6 & 3 | 8", 10), ("1 << 4 >> 2", 4), ("~5", -6), ("TRUE + TRUE", 2), ("0x1F", 31),
    ("'it''s'", "it's"), ("'back\\slash'", "back\\slash"), ("1e3", 1000.0), ("'{\"a\":[1,{\"b\":2}]}' -> '$.a[1].b'", "2"), ("'[1,2]' ->> 1", "2"), ("max(1, NULL, 3)", 3), ("min(2, 1.5)", 1.5),
    ("like('A%', 'abc')", 1), ("substr('hello', 2, 3)", "ell"), ("substr('hello', -3)", "llo"), ("substr('hello', 0, 2)", "he"), ("substr('abc', -5, 2)", "ab"), ("substr('abc', 2, -1)", ""),
    ("unicode('')", None), ("unicode('é')", 233), ("char(72, 105)", "Hi"), ("quote('it''s')", "'it''s'"), ("quote(NULL)", "NULL"), ("quote(1.5)", "1.5"), ("typeof(1.5)", "real"), ("typeof(NULL)", "null"),
    ("printf('%d|%s|%%|%i', 3.9, NULL, 4)", "3|NULL|%|4"), ("printf('%d')", "?"), ("length('añb')", 3), ("hex('Az')", "417A"), ("instr('hello', 'l')", 3), ("nullif(1, 1)", None), ("ifnull(NULL, 2)", 2),
    ("trim(' \t\n x ')", "x"), ("rtrim('xyzzy', 'zy')", "x"), ("iif(NULL, 1, 2)", 2), ("abs(-3)", 3), ("replace('aXbX', 'X', '')", "ab"), ("date('2024-03-05 06:07:08')", "2024-03-05"),
    ("hour(CAST('2024-03-05 06:07:08' AS DATETIME))", 6), ("-9223372036854775808", -(2**63)), ("(SELECT count(*) FROM users)", 3), ("EXISTS (SELECT 1 FROM users WHERE id > 9)", 0), ("json_extract('{\"a\":5}', '$.a')", "5"),
]


@pytest.mark.parametrize("start", range(0, len(EXPRESSIONS), 20))
def test_expressions(ws, start):
    part = EXPRESSIONS[start : start + 20]
    got = rows(ws, "SELECT " + ", ".join(f"{x} AS c{i}" for i, (x, _) in enumerate(part)))[0]
    for (text, expected), value in zip(part, got, strict=True):
        assert value == expected and type(value) is type(expected), text


def test_unicode_of_the_first_code_point(ws):
    assert rows(ws, "SELECT unicode(char(0)), unicode(char(0, 65)), unicode(NULL), unicode(''), unicode(char(1114111))") == [(0, 0, None, None, 0x10FFFF)]


@pytest.mark.parametrize("text", ["5 / 0", "5 % 0", "CAST('abc' AS INTEGER)", "9223372036854775807 + 1"])
def test_run_time_errors(ws, text):
    with pytest.raises(Exception):
        rows(ws, f"SELECT {text} AS x")


@pytest.mark.parametrize("text", ["SELECT nope FROM users", "SELECT * FROM nope", "SELECT abs(1, 2)", "SELECT nofn(1)", "SELECT 1 FROM", "SELECT 'open", "SELECT 1 LIMIT id", "SELECT id FROM users UNION SELECT 1, 2", "SELECT sum(id) OVER (ORDER BY id GROUPS 1 PRECEDING) FROM users", "VALUES (1), (2, 3)", "SELECT :missing"])
def test_rejected(ws, text):
    with pytest.raises(SqlError):
        rows(ws, text)


def test_joins(ws):
    assert len(rows(ws, "SELECT * FROM users JOIN orders ON users.id = orders.user_id")) == 3
    assert len(rows(ws, "SELECT u.*, o.product FROM users u LEFT JOIN orders o ON u.id = o.user_id")) == 4
    assert rows(ws, "SELECT u.name FROM orders o RIGHT JOIN users u ON u.id = o.user_id WHERE o.id IS NULL") == [("charlie",)]
    assert len(rows(ws, "SELECT * FROM users, orders")) == 9
    assert sorted(rows(ws, "SELECT k.id, m.id FROM k JOIN m ON k.key = m.key")) == [(1, 1)]
    assert sorted(rows(ws, "SELECT k.id FROM k JOIN m ON k.key IS m.key")) == [(1,), (2,)]
    assert sorted(rows(ws, "SELECT id, k.key FROM k JOIN m USING (id)")) == [(1, 1), (2, None)]
    assert sorted(rows(ws, "SELECT * FROM k NATURAL JOIN m")) == [(1, 1)]
    full = rows(ws, "SELECT k.id, m.id FROM k FULL JOIN m ON k.key = m.key")
    assert len(full) == 5
    assert sorted(rows(ws, "SELECT u.id FROM users u LEFT JOIN orders o ON u.id = o.user_id AND o.product = 'gadget' WHERE o.id IS NULL")) == [(2,), (3,)]
    assert rows(ws, "SELECT a.name FROM (users a JOIN orders b ON a.id = b.user_id) WHERE b.product LIKE 'GAD%'") == [("alice",)]


def test_grouping(ws):
    assert sorted(rows(ws, "SELECT dept, count(*) FROM emp GROUP BY dept")) == [("eng", 3), ("hr", 1), ("sales", 3)]
    assert sorted(rows(ws, "SELECT dept, sum(salary) s FROM emp GROUP BY dept HAVING s > 100 AND count(*) > 1"), key=str) == [("eng", 310), ("sales", 315)]
    assert sorted(rows(ws, "SELECT category, count(*) FROM n GROUP BY category"), key=str) == [("a", 2), (None, 2)]
    assert rows(ws, "SELECT count(*), count(x), sum(x), total(x), avg(x) FROM n") == [(4, 3, 1.5, 1.5, 0.5)]
    assert rows(ws, "SELECT count(*), sum(x), total(x), group_concat(category) FROM n WHERE id > 9") == [(0, None, 0.0, None)]
    assert sorted(rows(ws, "SELECT dept, role, max(id) FROM emp GROUP BY dept"))[0] == ("eng", "qa", 3)
    assert rows(ws, "SELECT count(DISTINCT dept), count(*) FILTER (WHERE salary > 85) FROM emp") == [(3, 4)]
    assert rows(ws, "SELECT group_concat(role, '/' ORDER BY id) FROM emp WHERE dept = 'eng'") == [("dev/dev/qa",)]
    assert rows(ws, "SELECT sum(salary) + 1, max(salary) - min(salary) FROM emp") == [(696, 80)]
    assert rows(ws, "SELECT substr(role, 1, 1) AS r, count(*) FROM emp GROUP BY r HAVING r = 'd'") == [("d", 2)]
    assert sorted(rows(ws, "SELECT dept FROM emp GROUP BY dept HAVING max(salary) > 100")) == [("eng",), ("sales",)]
    assert rows(ws, "SELECT sum(salary > 85) FROM emp") == [(4,)]


def test_order_and_limit(ws):
    assert rows(ws, "SELECT id FROM emp ORDER BY salary DESC LIMIT 2") == [(6,), (2,)]
    assert rows(ws, "SELECT id FROM emp ORDER BY dept, salary DESC LIMIT 1, 2") == [(1,), (3,)]
    assert rows(ws, "SELECT id FROM n ORDER BY category, id DESC") == [(4,), (2,), (3,), (1,)]
    assert rows(ws, "SELECT id FROM n ORDER BY category DESC NULLS FIRST, 1") == [(2,), (4,), (1,), (3,)]
    assert rows(ws, "SELECT id * 2 AS d FROM users ORDER BY d DESC") == [(6,), (4,), (2,)]
    assert len(rows(ws, "SELECT id FROM users LIMIT -1")) == 3 and rows(ws, "SELECT id FROM users LIMIT 0") == []
    assert rows(ws, "SELECT id FROM users ORDER BY id LIMIT :n OFFSET ?2", {"n": 1, "2": 1}) == [(2,)]
    assert rows(ws, "SELECT DISTINCT dept FROM emp ORDER BY dept DESC LIMIT 2") == [("sales",), ("hr",)]


def test_sets_and_subqueries(ws):
    assert sorted(rows(ws, "SELECT 'x' UNION ALL SELECT 'x' UNION SELECT 'y'")) == [("x",), ("y",)]
    assert rows(ws, "SELECT 1 UNION SELECT 2 INTERSECT SELECT 2") == [(2,)]
    assert rows(ws, "SELECT id FROM users EXCEPT SELECT 2 ORDER BY id DESC") == [(3,), (1,)]
    assert rows(ws, "SELECT name FROM users WHERE id IN (SELECT user_id FROM orders GROUP BY user_id HAVING count(*) > 1)") == [("alice",)]
    assert rows(ws, "SELECT name FROM users u WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.user_id = u.id)") == [("charlie",)]
    assert rows(ws, "SELECT (SELECT name FROM users WHERE id = 99), (SELECT max(id) FROM orders)") == [(None, 12)]
    assert rows(ws, "WITH a(x) AS (SELECT id FROM users), b AS (SELECT x + 1 AS y FROM a) SELECT sum(y) FROM b") == [(9,)]
    assert rows(ws, "WITH RECURSIVE f(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM f WHERE n < 5) SELECT count(*), sum(n) FROM f") == [(5, 15)]
    assert rows(ws, "SELECT t.a FROM (VALUES (1, 'x'), (2, 'y')) AS v JOIN (SELECT 2 AS a) t ON t.a = v.column1") == [(2,)]
    assert sorted(rows(ws, "SELECT id FROM dates WHERE d > '1996-07-15' AND d < '1996-12-01'")) == [(3,)]


def test_not_in_subqueries(ws):
    """Three-valued: NULL beside NULLs unless found, true beside no rows."""
    assert sorted(rows(ws, "SELECT id, key NOT IN (SELECT id FROM users WHERE id < 3) FROM k")) == [(1, 0), (2, None), (3, 1)]
    assert sorted(rows(ws, "SELECT id, id NOT IN (SELECT key FROM m) FROM k")) == [(1, 0), (2, None), (3, None)]
    assert sorted(rows(ws, "SELECT id, key NOT IN (SELECT key FROM m WHERE id > 9) FROM k")) == [(1, 1), (2, 1), (3, 1)]
    assert rows(ws, "SELECT id FROM k WHERE id NOT IN (SELECT key FROM m)") == []
    assert sorted(rows(ws, "SELECT id FROM k WHERE id NOT IN (SELECT key FROM m WHERE key NOT NULL)")) == [(2,), (3,)]
    assert sorted(rows(ws, "SELECT id FROM k WHERE key NOT IN (SELECT key FROM m WHERE id > 9)")) == [(1,), (2,), (3,)]
    assert rows(ws, "SELECT id FROM k WHERE key NOT IN (SELECT id FROM users WHERE id < 3)") == [(3,)]
    assert sorted(rows(ws, "SELECT id FROM k WHERE id NOT IN (SELECT key FROM m WHERE m.id = k.id)")) == [(3,)]
    assert rows(ws, "SELECT id FROM k WHERE NOT (id = 3 OR id IN (SELECT id FROM m WHERE id < 2))") == [(2,)]
    assert rows(ws, "SELECT id FROM k WHERE NOT (id NOT IN (SELECT key FROM m))") == [(1,)]
    assert rows(ws, "SELECT dept FROM emp GROUP BY dept HAVING count(*) NOT IN (SELECT key FROM k WHERE key NOT NULL)") == []
    assert sorted(rows(ws, "SELECT dept FROM emp GROUP BY dept HAVING count(*) NOT IN (SELECT id FROM users WHERE id > 1)")) == [("hr",)]
    assert rows(ws, "SELECT id FROM k WHERE id NOT IN (SELECT id FROM users ORDER BY id LIMIT 2)") == [(3,)]


def test_windows(ws):
    got = rows(ws, "SELECT id, row_number() OVER (PARTITION BY dept ORDER BY salary) r, sum(salary) OVER (PARTITION BY dept ORDER BY id ROWS UNBOUNDED PRECEDING) s, lag(id) OVER w l FROM emp WINDOW w AS (ORDER BY id) ORDER BY id")
    assert [g[1:] for g in got] == [(2, 100, None), (3, 220, 1), (1, 310, 2), (1, 80, 3), (2, 165, 4), (3, 315, 5), (1, 70, 6)]


def test_parameters(ws):
    assert rows(ws, "SELECT ?, ?, :a, @b, $c", {"1": 1, "2": None, "A": "x'y\\", "b": 1.5, "c": b"\x01"}) == [(1, None, "x'y\\", 1.5, bytearray(b"\x01"))]
    assert rows(ws, "SELECT name FROM users WHERE id = ?", [2]) == [("bob",)]


def test_plans(ws):
    plan = rows(ws, "EXPLAIN QUERY PLAN SELECT dept, count(*) FROM emp WHERE salary > 80 GROUP BY dept")
    assert plan[0][:2] == (1, 0) and all(0 < parent < i for i, parent, _ in plan[1:])
    assert any("HashAggregate" in d for _, _, d in plan)


def test_comments_and_names(ws):
    assert rows(ws, 'SELECT "name" AS [the name], `id` -- a comment\n FROM main.users /* another */ WHERE id=1;') == [("alice", 1)]
    assert [t.value for t in tokens("a->>'x' 1.5e-3 .5 x'00ff'")][:-1] == ["a", "->>", "x", "1.5e-3", ".5", "00ff"]
    assert len(parse("SELECT 1; ; SELECT 2;")) == 2
    assert parse_one("SELECT a FROM t INDEXED BY i WHERE b NOT NULL").body.source.name == "t"

"""DDL, DML, triggers and transactions against hand-written end states."""

import io

import pytest

from lakeweave.cli import complete, main
from lakeweave.connection import connect
from lakeweave.database import ConstraintError, Database
from lakeweave.plans.lexer import SqlError


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, str(tmp_path / "db"))


def rows(db, text, params=None):
    return [tuple(r) for r in db.query(text, params).collect()]


def filled(db):
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT, val INTEGER)")
    db.execute("INSERT INTO t VALUES (1,'rowan',10),(2,'birch',20),(3,'cedar',30),(4,'aspen',40),(5,'elm',50)")


def test_insert_update_delete(db):
    filled(db)
    assert db.execute("UPDATE t SET val = val + 1, name = name || val WHERE id > 3") == 2
    assert rows(db, "SELECT name, val FROM t WHERE id > 3 ORDER BY id") == [("aspen40", 41), ("elm50", 51)]
    assert db.execute("UPDATE t SET id = id * 10 WHERE id = 1") == 1
    assert db.execute("DELETE FROM t WHERE val BETWEEN 20 AND 30") == 2
    assert rows(db, "SELECT id FROM t ORDER BY id") == [(4,), (5,), (10,)]
    assert db.execute("DELETE FROM t") == 3 and db.scalar("SELECT count(*) FROM t") == 0


def test_update_from(db):
    filled(db)
    db.execute("CREATE TABLE src (k INTEGER PRIMARY KEY, id INTEGER, v INTEGER); INSERT INTO src VALUES (1, 2, 7), (2, 2, 7), (3, 4, 9), (4, 99, 1)")
    assert db.execute("UPDATE t SET val = src.v FROM src WHERE src.id = t.id") == 2
    assert rows(db, "SELECT id, val FROM t ORDER BY id") == [(1, 10), (2, 7), (3, 30), (4, 9), (5, 50)]
    db.execute("CREATE TABLE p (a INTEGER, b INTEGER, v INTEGER, PRIMARY KEY (a, b)); INSERT INTO p VALUES (1, 1, 0), (1, 2, 0), (2, 1, 0)")
    assert db.execute("UPDATE p SET v = src.v FROM src WHERE src.id = p.a * 2") == 3
    assert rows(db, "SELECT a, b, v FROM p ORDER BY a, b") == [(1, 1, 7), (1, 2, 7), (2, 1, 9)]


def test_constraints(db):
    filled(db)
    for bad in (
        "INSERT INTO t VALUES (1, 'x', 0)", "INSERT INTO t VALUES (9, 'x', 0), (9, 'y', 0)", "INSERT INTO t VALUES (NULL, 'x', 0)", "INSERT INTO t VALUES (9, 5, 0)",
        "INSERT INTO t VALUES (9, 'x', 'y')", "UPDATE t SET id = 2 WHERE id = 1", "UPDATE t SET val = 'x'", "INSERT OR ABORT INTO t VALUES (1, 'x', 0)",
    ):
        with pytest.raises(ConstraintError):
            db.execute(bad)
    for bad in ("INSERT INTO t VALUES (9)", "INSERT INTO t (id, nope) VALUES (9, 1)", "INSERT INTO nope VALUES (1)", "UPDATE t SET nope = 1", "CREATE TABLE u (a INTEGER)", "CREATE TABLE t (a INTEGER PRIMARY KEY)", "DROP TABLE nope"):
        with pytest.raises(SqlError):
            db.execute(bad)
    assert db.scalar("SELECT count(*) FROM t") == 5
    db.execute("CREATE TABLE c (id INTEGER PRIMARY KEY, v INTEGER NOT NULL CHECK (v > 0), u TEXT UNIQUE, g INTEGER AS (v * 2))")
    db.execute("INSERT INTO c (id, v, u) VALUES (1, 2, 'a'), (2, 3, NULL), (3, 4, NULL)")
    assert rows(db, "SELECT g FROM c ORDER BY id") == [(4,), (6,), (8,)]
    for bad in ("INSERT INTO c (id, v) VALUES (9, 0)", "INSERT INTO c (id) VALUES (9)", "INSERT INTO c (id, v, u) VALUES (9, 1, 'a')", "UPDATE c SET v = -1 WHERE id = 1", "UPDATE c SET u = 'a'"):
        with pytest.raises(ConstraintError):
            db.execute(bad)


def test_conflicts(db):
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT, val INTEGER)")
    db.execute("INSERT INTO t VALUES (1, 'old', 10)")
    assert db.execute("INSERT INTO t VALUES (1, 'new', 99) ON CONFLICT DO NOTHING") == 0
    db.execute("INSERT INTO t VALUES (1, 'new', 99) ON CONFLICT (id) DO UPDATE SET val = excluded.val")
    assert rows(db, "SELECT * FROM t") == [(1, "old", 99)]
    db.execute("INSERT INTO t VALUES (1, 'new', 5), (1, 'newer', 6), (2, 'two', 1) ON CONFLICT (id) DO UPDATE SET val = val + excluded.val, name = excluded.name")
    assert rows(db, "SELECT * FROM t ORDER BY id") == [(1, "newer", 110), (2, "two", 1)]
    db.execute("INSERT INTO t VALUES (1, 'x', 50) ON CONFLICT (id) DO UPDATE SET val = excluded.val WHERE excluded.val > t.val")
    assert db.scalar("SELECT val FROM t WHERE id = 1") == 110
    assert db.execute("INSERT OR REPLACE INTO t VALUES (1, 'rep', 0), (3, 'c', 1), (3, 'd', 2)") == 2
    assert rows(db, "SELECT * FROM t ORDER BY id") == [(1, "rep", 0), (2, "two", 1), (3, "d", 2)]


def test_defaults_and_autoincrement(db):
    db.execute("CREATE TABLE a (id INTEGER PRIMARY KEY AUTOINCREMENT, s TEXT DEFAULT 'none', d DATETIME)")
    db.execute("INSERT INTO a (d) VALUES ('2024-01-02 03:04:05')")
    db.execute("INSERT INTO a VALUES (10, 'x', NULL), (NULL, NULL, NULL)")
    db.execute("INSERT INTO a DEFAULT VALUES")
    assert rows(db, "SELECT id, s, year(d) FROM a ORDER BY id") == [(1, "none", 2024), (10, "x", None), (12, "none", None), (13, "none", None)]


def test_limits_and_returning(db):
    filled(db)
    assert db.execute("UPDATE t SET val = 0 LIMIT 2 OFFSET 1") == 2
    assert rows(db, "SELECT id FROM t WHERE val = 0 ORDER BY id") == [(2,), (3,)]
    assert [tuple(r) for r in db.execute("DELETE FROM t WHERE val = 0 RETURNING id, name || '!' AS n").orderBy("id").collect()] == [(2, "birch!"), (3, "cedar!")]
    assert [tuple(r) for r in db.execute("INSERT INTO t VALUES (7, 'g', 1) RETURNING *").collect()] == [(7, "g", 1)]
    assert [tuple(r) for r in db.execute("UPDATE t SET val = val * 2 WHERE id = 7 RETURNING val").collect()] == [(2,)]


def test_triggers(db):
    filled(db)
    db.execute("""
        CREATE TABLE audit (id INTEGER PRIMARY KEY AUTOINCREMENT, msg TEXT);
        CREATE TRIGGER i AFTER INSERT ON t WHEN NEW.val > 5 BEGIN INSERT INTO audit (msg) VALUES ('in ' || NEW.name); END;
        CREATE TRIGGER u AFTER UPDATE OF val ON t BEGIN INSERT INTO audit (msg) SELECT OLD.val || '>' || NEW.val WHERE NEW.val <> OLD.val; END;
        CREATE TRIGGER d BEFORE DELETE ON t BEGIN SELECT RAISE(ABORT, 'kept') WHERE OLD.id = 1; END;
        CREATE TRIGGER g BEFORE INSERT ON t BEGIN SELECT RAISE(IGNORE) WHERE NEW.name IS NULL; END
    """)
    assert db.execute("INSERT INTO t VALUES (6, 'f', 6), (7, 'g', 1), (8, NULL, 9)") == 2
    db.execute("UPDATE t SET val = val + 1 WHERE id IN (6, 7)")
    db.execute("UPDATE t SET name = 'z' WHERE id = 6")
    assert sorted(rows(db, "SELECT msg FROM audit")) == [("1>2",), ("6>7",), ("in f",)]
    with pytest.raises(ConstraintError, match="kept"):
        db.execute("DELETE FROM t")
    assert db.execute("DELETE FROM t WHERE id > 1") == 6
    db.execute("CREATE TRIGGER loop AFTER INSERT ON audit BEGIN INSERT INTO audit (msg) SELECT 'again' WHERE (SELECT count(*) FROM audit) < 6; END")


def test_upserts_fire_update_triggers(db):
    filled(db)
    db.execute("CREATE TABLE audit (id INTEGER PRIMARY KEY AUTOINCREMENT, msg TEXT)")
    db.execute("CREATE TRIGGER u AFTER UPDATE ON t BEGIN INSERT INTO audit (msg) VALUES (OLD.name || '>' || NEW.name); END")
    assert db.execute("INSERT INTO t VALUES (1, 'z', 0), (9, 'n', 0) ON CONFLICT (id) DO UPDATE SET name = excluded.name") == 2
    assert rows(db, "SELECT msg FROM audit") == [("rowan>z",)]


def test_row_triggers_see_earlier_rows(db):
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, k TEXT); CREATE TABLE n (k TEXT PRIMARY KEY, c INTEGER)")
    db.execute("CREATE TRIGGER c AFTER INSERT ON t BEGIN INSERT INTO n VALUES (NEW.k, 1) ON CONFLICT (k) DO UPDATE SET c = c + 1; END")
    db.execute("INSERT INTO t VALUES (1, 'a'), (2, 'b'), (3, 'a')")
    assert rows(db, "SELECT * FROM n ORDER BY k") == [("a", 2), ("b", 1)]


def test_schema_changes(db):
    filled(db)
    db.execute("ALTER TABLE t ADD COLUMN status TEXT DEFAULT 'x'; ALTER TABLE t RENAME COLUMN name TO label; INSERT INTO t VALUES (6, 'f', 60, 'y')")
    assert rows(db, "SELECT id, status FROM t WHERE id > 4 ORDER BY id") == [(5, "x"), (6, "y")]
    db.execute("ALTER TABLE t DROP COLUMN val; ALTER TABLE t RENAME TO u")
    assert db.query("SELECT * FROM u").columns == ["id", "label", "status"]
    with pytest.raises(SqlError):
        db.execute("ALTER TABLE u DROP COLUMN id")
    db.execute("CREATE INDEX i ON u (label); CREATE VIEW v AS SELECT label FROM u; CREATE TABLE IF NOT EXISTS u (x INTEGER PRIMARY KEY)")
    assert [r[1:3] for r in db.schema_rows()] == [("table", "u"), ("index", "i"), ("view", "v")]
    assert db.scalar("SELECT count(*) FROM v") == 6
    db.execute("DROP TABLE u; DROP TABLE IF EXISTS u")
    assert [r[2] for r in db.schema_rows()] == ["v"]


def test_transactions_and_reopening(spark, db):
    filled(db)
    before = db.query("SELECT count(*) AS n FROM t")
    db.begin()
    db.execute("DELETE FROM t WHERE id < 3")
    assert db.scalar("SELECT count(*) FROM t") == 3 and before.first()[0] == 5
    assert Database(spark, db.store.root).scalar("SELECT count(*) FROM t") == 5
    db.rollback()
    assert db.scalar("SELECT count(*) FROM t") == 5
    db.execute("BEGIN; CREATE TABLE u (id INTEGER PRIMARY KEY); SAVEPOINT a; DELETE FROM t; ROLLBACK TO a; COMMIT")
    other = Database(spark, db.store.root)
    assert other.scalar("SELECT count(*) FROM t") == 5 and other.tables() == ["t", "u"]
    other.execute("DELETE FROM t WHERE id = 1")
    with pytest.raises(RuntimeError):
        db.execute("DELETE FROM t WHERE id = 2")


def test_a_failed_statement_changes_nothing(db):
    filled(db)
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO t VALUES (6, 'f', 1), (1, 'dup', 2)")
    assert db.scalar("SELECT count(*) FROM t") == 5


def test_plan_cache(db):
    filled(db)
    text = "SELECT count(*) FROM t WHERE name = 'A'"
    db.query(text)
    db.query(text)
    assert db.hits == 1
    db.query(text.replace("'A'", "'a'"))
    db.execute("INSERT INTO t VALUES (6, 'A', 0)")
    assert db.scalar(text) == 1 and db.hits == 1


def test_connection_and_shell(spark, tmp_path):
    path = str(tmp_path / "shared")
    with connect(path, spark) as a, connect(path, spark) as b:
        a.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT)")
        assert a.execute("INSERT INTO t VALUES (1, 'x'), (2, 'y')").rowcount == 2
        cursor = b.execute("SELECT id, name FROM t ORDER BY id")
        assert [d[0] for d in cursor.description] == ["id", "name"]
        assert cursor.fetchone() == (1, "x") and cursor.fetchall() == [(2, "y")]
        assert b.execute("SELECT max(id) FROM t").scalar() == 2
    out = io.StringIO()
    main([path], io.StringIO("SELECT *\nFROM t\nWHERE id = 1;\n.schema\nSELECT nope;\n.tables\n.quit\n"), out)
    shown = out.getvalue()
    assert "1  | x" in shown and "CREATE TABLE t" in shown and "error: no such column" in shown
    assert complete("SELECT 1;") and not complete("SELECT ';'") and not complete("CREATE TRIGGER a AFTER INSERT ON t BEGIN SELECT 1;")


def test_only_touched_segments_are_rewritten(db):
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v INTEGER)")
    for low in (0, 10, 20):
        db.execute(f"INSERT INTO t SELECT value, 0 FROM generate_series({low}, {low + 9})")
    paths = lambda: [s["path"] for s in db.state["tables"]["t"]["segments"]]
    first = paths()
    db.execute("UPDATE t SET v = 1 WHERE id = 15")
    db.execute("DELETE FROM t WHERE id = 16")
    assert len(paths()) == 3 and first[0] in paths() and first[2] in paths() and first[1] not in paths()
    assert db.scalar("SELECT sum(v) * 100 + count(*) FROM t") == 129
    db.compact("t")
    assert len(paths()) == 1 and db.scalar("SELECT count(*) FROM t") == 29


def test_distinct_on_an_enforced_key_is_free(db):
    db.execute("CREATE TABLE k (id INTEGER PRIMARY KEY, v INTEGER)")
    db.execute("INSERT INTO k VALUES (1, 2), (2, 2)")
    assert "Aggregate" not in db.query("SELECT DISTINCT id, v FROM k")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" in db.query("SELECT DISTINCT v FROM k")._jdf.queryExecution().executedPlan().toString()

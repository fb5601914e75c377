"""Tables: data changes, constraints, transactions, sequences, types, functions."""

import pytest

from lodestar.errors import SqlError


def rows(engine, sql):
    return sorted(engine.collect(sql), key=str)


def state(engine, sql):
    with pytest.raises(SqlError) as caught:
        engine.collect(sql)
    return caught.value.state


def test_serial_default_generated_and_returning(engine):
    engine.sql("CREATE TABLE t (id serial PRIMARY KEY, v int NOT NULL, tag text DEFAULT 'x', twice int GENERATED ALWAYS AS (v * 2) STORED)")
    assert rows(engine, "INSERT INTO t (v) VALUES (5), (6) RETURNING id, tag, twice") == [(1, "x", 10), (2, "x", 12)]
    assert rows(engine, "UPDATE t SET v = v + 1 WHERE id = 2 RETURNING v, twice") == [(7, 14)]
    assert rows(engine, "DELETE FROM t WHERE id = 1 RETURNING *") == [(1, 5, "x", 10)]
    assert state(engine, "INSERT INTO t (v, twice) VALUES (1, 2)") == "428C9"
    assert state(engine, "INSERT INTO t (v) VALUES (NULL)") == "23502"


def test_unique_check_and_upsert(engine):
    engine.sql("CREATE TABLE t (k int PRIMARY KEY, n int CHECK (n < 100))")
    engine.sql("INSERT INTO t VALUES (1, 1), (2, NULL)")
    assert state(engine, "INSERT INTO t VALUES (1, 5)") == "23505"
    assert state(engine, "INSERT INTO t VALUES (3, 100)") == "23514"
    assert rows(engine, "INSERT INTO t VALUES (1, 9), (3, 3) ON CONFLICT DO NOTHING RETURNING k") == [(3,)]
    assert rows(engine, "INSERT INTO t VALUES (1, 9), (4, 4) ON CONFLICT (k) DO UPDATE SET n = t.n + excluded.n RETURNING k, n") == [(1, 10), (4, 4)]
    assert state(engine, "INSERT INTO t VALUES (1, 1), (1, 2) ON CONFLICT (k) DO UPDATE SET n = 0") == "21000"
    assert state(engine, "INSERT INTO t VALUES (1, 1) ON CONFLICT (n) DO NOTHING") == "42P10"
    assert rows(engine, "SELECT * FROM t") == [(1, 10), (2, None), (3, 3), (4, 4)]


def test_foreign_keys(engine):
    engine.sql("CREATE TABLE p (k int PRIMARY KEY)")
    engine.sql("CREATE TABLE c (k int REFERENCES p ON DELETE CASCADE ON UPDATE CASCADE, s int REFERENCES p ON DELETE SET NULL)")
    engine.sql("INSERT INTO p VALUES (1), (2), (3)")
    engine.sql("INSERT INTO c VALUES (1, 2), (2, 3), (NULL, NULL)")
    assert state(engine, "INSERT INTO c VALUES (9, NULL)") == "23503"
    engine.sql("UPDATE p SET k = 10 WHERE k = 1")
    assert rows(engine, "SELECT * FROM c") == [(10, 2), (2, 3), (None, None)]
    engine.sql("DELETE FROM p WHERE k = 2")
    assert rows(engine, "SELECT * FROM c") == [(10, None), (None, None)]
    engine.sql("CREATE TABLE d (k int REFERENCES p)")
    engine.sql("INSERT INTO d VALUES (3)")
    assert state(engine, "DELETE FROM p WHERE k = 3") == "23503"


def test_transactions(engine):
    engine.sql("CREATE TABLE t (k int)")
    engine.sql("BEGIN; INSERT INTO t VALUES (1); SAVEPOINT a; INSERT INTO t VALUES (2); ROLLBACK TO a; COMMIT")
    assert rows(engine, "SELECT * FROM t") == [(1,)]
    engine.sql("BEGIN")
    engine.sql("DELETE FROM t")
    assert state(engine, "SELECT * FROM missing") == "42P01"
    assert state(engine, "SELECT 1") == "25P02"
    engine.sql("ROLLBACK")
    assert rows(engine, "SELECT * FROM t") == [(1,)]


def test_update_and_delete_with_other_relations(engine):
    engine.sql("CREATE TABLE t (k int, v text); INSERT INTO t VALUES (1, 'a'), (2, 'b'), (3, 'c')")
    engine.sql("CREATE TABLE s (k int, w text); INSERT INTO s VALUES (1, 'x'), (3, 'z')")
    engine.sql("UPDATE t SET v = s.w FROM s WHERE s.k = t.k")
    assert rows(engine, "SELECT * FROM t") == [(1, "x"), (2, "b"), (3, "z")]
    engine.sql("DELETE FROM t AS u USING s WHERE s.k = u.k AND s.w = 'x'")
    assert rows(engine, "SELECT k FROM t") == [(2,), (3,)]


def test_sequences(engine):
    engine.sql("CREATE SEQUENCE s START 100 INCREMENT -3 MINVALUE 95 MAXVALUE 100")
    assert state(engine, "SELECT currval('s')") == "55000"
    assert rows(engine, "SELECT nextval('s') AS a, nextval('s') AS b") == [(100, 97)]
    assert state(engine, "SELECT nextval('s')") == "2200H"


def test_enum_domain_and_lengths(engine):
    engine.sql("CREATE TYPE mood AS ENUM ('sad', 'ok', 'happy'); CREATE DOMAIN pos AS int CHECK (value > 0)")
    engine.sql("CREATE TABLE t (m mood, p pos, v varchar(3)); INSERT INTO t VALUES ('happy', 1, 'abc'), ('sad', 2, NULL)")
    assert engine.collect("SELECT m FROM t ORDER BY m") == [("sad",), ("happy",)]
    assert engine.collect("SELECT max(m) AS m FROM t WHERE m < 'happy'::mood") == [("sad",)]
    assert state(engine, "INSERT INTO t VALUES ('ok', -1, 'a')") == "23514"
    assert state(engine, "INSERT INTO t VALUES ('angry', 1, 'a')") == "22P02"


def test_notifications(engine, spark):
    from lodestar.session import Engine

    other = Engine(spark)
    engine.sql("LISTEN news")
    other.sql("NOTIFY news, 'hello'")
    assert engine.notifications() == [("news", "hello")] and engine.notifications() == []


def files(engine, name):
    table = engine.catalog.table(name)
    return {f for path in table.files for f in engine.spark.read.parquet(path).inputFiles()}


def test_a_change_writes_only_files_that_hold_changed_rows(engine):
    engine.catalog.load("t", engine.spark.range(2000).selectExpr("CAST(id AS int) AS k", "CAST(id AS int) AS v").repartitionByRange(200, "k"), ["k"])
    before = files(engine, "t")
    assert len(before) >= 100
    engine.sql("UPDATE t SET v = -1 WHERE k = 77")
    after = files(engine, "t")
    assert len(before - after) == 1 and 1 <= len(after - before) <= 4
    engine.sql("DELETE FROM t WHERE k = 1500")
    assert len(after - files(engine, "t")) == 1
    assert rows(engine, "SELECT count(*), sum(CASE WHEN v = -1 THEN 1 END), max(k) FROM t") == [(1999, 1, 1999)]
    assert state(engine, "UPDATE t SET k = 5 WHERE k = 6") == "23505" and state(engine, "INSERT INTO t VALUES (7, 0)") == "23505"
    engine.sql("UPDATE t SET k = k + 10000 WHERE k < 100")
    assert rows(engine, "SELECT count(*), min(k), max(k) FROM t") == [(1999, 100, 10099)]


def test_changes_through_views(engine):
    engine.sql("CREATE TABLE p (k int PRIMARY KEY, v text DEFAULT 'x', n int); INSERT INTO p VALUES (1,'a',1),(2,'b',2),(3,'c',30)")
    engine.sql("CREATE VIEW vv AS SELECT k AS key, v AS val FROM p WHERE n < 10; CREATE VIEW g AS SELECT count(*) AS c FROM p; CREATE VIEW d AS SELECT DISTINCT v FROM p; CREATE VIEW u AS SELECT key AS kk FROM vv")
    assert rows(engine, "INSERT INTO vv VALUES (7,'q') RETURNING key, val") == [(7, "q")]
    assert rows(engine, "INSERT INTO vv (key) VALUES (8) RETURNING *") == [(8, "x")]
    assert rows(engine, "UPDATE vv SET val = val || '!' WHERE key >= 2 RETURNING key, val") == [(2, "b!")]
    assert rows(engine, "DELETE FROM u WHERE kk = 1 RETURNING *") == [(1,)]
    assert rows(engine, "SELECT * FROM p") == [(2, "b!", 2), (3, "c", 30), (7, "q", None), (8, "x", None)]
    for sql, code in (("DELETE FROM g", "55000"), ("DELETE FROM d", "55000"), ("UPDATE vv SET nope = 1", "42703"), ("INSERT INTO vv VALUES (2, 'again')", "23505")):
        assert state(engine, sql) == code
    assert rows(engine, "SELECT count(*) FROM p") == [(4,)]


def test_system_catalogs(engine):
    engine.sql("CREATE TABLE p (k int PRIMARY KEY, v text DEFAULT 'x'); CREATE TABLE c (id serial, pk int REFERENCES p ON DELETE CASCADE, n int CHECK (n > 0), UNIQUE (pk, n)); CREATE UNIQUE INDEX ci ON c (n); CREATE VIEW vv AS SELECT k FROM p WHERE k > 1")
    engine.sql("CREATE FUNCTION f1(a int) RETURNS int LANGUAGE sql AS $$ SELECT a $$")
    assert engine.collect("SELECT n.nspname, c.relname, c.relkind FROM pg_class c JOIN pg_catalog.pg_namespace n ON n.oid = c.relnamespace ORDER BY 2") == [("public", "c", "r"), ("public", "c_id_seq", "S"), ("public", "ci", "i"), ("public", "p", "r"), ("public", "vv", "v")]
    assert engine.collect("SELECT a.attname, t.typname, a.attnotnull, format_type(a.atttypid, NULL) FROM pg_attribute a JOIN pg_class c ON c.oid = a.attrelid JOIN pg_type t ON t.oid = a.atttypid WHERE c.relname = 'p' ORDER BY attnum") == [("k", "int4", True, "integer"), ("v", "text", False, "text")]
    assert [r[1:] for r in engine.collect("SELECT conname, contype, pg_get_constraintdef(oid) FROM pg_constraint ORDER BY 1")] == [("c", "CHECK ((n > 0))"), ("f", "FOREIGN KEY (pk) REFERENCES p(k) ON DELETE CASCADE"), ("u", "UNIQUE (pk, n)"), ("p", "PRIMARY KEY (k)")]
    assert engine.collect("SELECT pg_get_indexdef(indexrelid) FROM pg_index") == [("CREATE UNIQUE INDEX ci ON public.c USING btree (n)",)]
    assert engine.collect("SELECT pg_get_viewdef('vv') LIKE 'SELECT%', (SELECT count(*) FROM pg_trigger), (SELECT proname FROM pg_proc), (SELECT check_clause FROM information_schema.check_constraints)") == [(True, 0, "f1", "((n > 0))")]

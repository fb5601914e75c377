"""PL/pgSQL functions, procedures and blocks."""

import pytest

from lodestar.errors import SqlError

FUNCTIONS = [
    ("gcd(a int, b int) RETURNS int", "DECLARE t int; BEGIN WHILE b <> 0 LOOP t := a % b; a := b; b := t; END LOOP; RETURN a; END", "gcd(48, 18)", 6),
    ("grade(n int) RETURNS text", "BEGIN IF n >= 90 THEN RETURN 'A'; ELSIF n >= 50 THEN RETURN 'B'; ELSE RETURN 'C'; END IF; END", "grade(60)", "B"),
    ("total(n int) RETURNS int", "DECLARE s int := 0; BEGIN FOR i IN 1..n LOOP CONTINUE WHEN i % 2 = 0; EXIT WHEN i > 7; s := s + i; END LOOP; RETURN s; END", "total(100)", 16),
    ("kind(x int) RETURNS text", "BEGIN CASE x WHEN 1, 2 THEN RETURN 'small'; ELSE RETURN 'other'; END CASE; END", "kind(2)", "small"),
    ("safe(a int, b int) RETURNS int", "BEGIN RETURN a / b; EXCEPTION WHEN division_by_zero THEN RETURN -1; END", "safe(1, 0)", -1),
    ("summed(a int[]) RETURNS int", "DECLARE s int := 0; x int; BEGIN FOREACH x IN ARRAY a LOOP s := s + x; END LOOP; RETURN s; END", "summed(ARRAY[1, 2, 3])", 6),
    ("opt(a int, b int DEFAULT 5) RETURNS int", "BEGIN RETURN a + b; END", "opt(1)", 6),
]


@pytest.mark.parametrize("head, body, call, expected", FUNCTIONS)
def test_function(engine, head, body, call, expected):
    engine.sql(f"CREATE FUNCTION {head} LANGUAGE plpgsql AS $$ {body} $$")
    assert engine.collect(f"SELECT {call} AS v") == [(expected,)]


def test_queries_loops_and_diagnostics(engine):
    engine.sql("CREATE TABLE t (k int, v int); INSERT INTO t VALUES (1, 10), (2, 20), (3, 30)")
    engine.sql(
        "DO $$ DECLARE r record; s int := 0; n int; BEGIN FOR r IN SELECT k, v FROM t ORDER BY k LOOP s := s + r.v; END LOOP;"
        " UPDATE t SET v = v + 1 WHERE k > 1; GET DIAGNOSTICS n = ROW_COUNT; SELECT max(v) INTO s FROM t;"
        " RAISE NOTICE 'changed % of %', n, s; INSERT INTO t VALUES (4, s); EXECUTE 'DELETE FROM t WHERE k = $1' USING 1; END $$"
    )
    assert engine.notices == [("notice", "changed 2 of 31")]
    assert engine.collect("SELECT k, v FROM t ORDER BY k") == [(2, 21), (3, 31), (4, 31)]


def test_set_returning_and_procedure(engine):
    engine.sql("CREATE FUNCTION evens(n int) RETURNS SETOF int LANGUAGE plpgsql AS $$ BEGIN FOR i IN 1..n LOOP IF i % 2 = 0 THEN RETURN NEXT i; END IF; END LOOP; RETURN QUERY SELECT 100; END $$")
    assert engine.collect("SELECT * FROM evens(5) AS e(x) ORDER BY x") == [(2,), (4,), (100,)]
    engine.sql("CREATE TABLE log (x int)")
    engine.sql("CREATE PROCEDURE note(x int) LANGUAGE plpgsql AS $$ BEGIN INSERT INTO log VALUES (x); END $$")
    engine.sql("CALL note(7)")
    assert engine.collect("SELECT x FROM log") == [(7,)]


def test_handlers_undo_the_block(engine):
    engine.sql("CREATE TABLE t (k int PRIMARY KEY); INSERT INTO t VALUES (1)")
    engine.sql("DO $$ BEGIN INSERT INTO t VALUES (2); INSERT INTO t VALUES (1); EXCEPTION WHEN unique_violation THEN RAISE WARNING 'dup: %', sqlstate; END $$")
    assert engine.collect("SELECT k FROM t") == [(1,)] and engine.notices == [("warning", "dup: 23505")]
    with pytest.raises(SqlError) as caught:
        engine.sql("DO $$ BEGIN RAISE EXCEPTION 'no %', 5 USING ERRCODE = '22012'; END $$")
    assert (caught.value.state, caught.value.message) == ("22012", "no 5")


def test_cursor(engine):
    engine.sql("DO $$ DECLARE c CURSOR FOR SELECT g FROM generate_series(1, 3) AS s(g); x int; s int := 0; BEGIN OPEN c; LOOP FETCH c INTO x; EXIT WHEN NOT found; s := s + x; END LOOP; CLOSE c; RAISE INFO '%', s; END $$")
    assert engine.notices == [("info", "6")]


def test_row_triggers_change_and_log(engine):
    engine.sql("CREATE TABLE t (k int PRIMARY KEY, v text, n int DEFAULT 0); CREATE TABLE log (op text, k int, was text, now_ text)")
    engine.sql("CREATE FUNCTION tidy() RETURNS trigger LANGUAGE plpgsql AS $$ BEGIN IF NEW.v = 'skip' THEN RETURN NULL; END IF; NEW.v := upper(NEW.v); IF TG_OP = 'UPDATE' THEN NEW.n := OLD.n + 1; END IF; RETURN NEW; END $$")
    engine.sql("CREATE FUNCTION note() RETURNS trigger LANGUAGE plpgsql AS $$ BEGIN IF TG_OP = 'DELETE' THEN INSERT INTO log VALUES (TG_OP, OLD.k, OLD.v, NULL); ELSE INSERT INTO log VALUES (TG_OP, NEW.k, OLD.v, NEW.v); END IF; RETURN NULL; END $$")
    engine.sql("CREATE TRIGGER a BEFORE INSERT OR UPDATE ON t FOR EACH ROW EXECUTE FUNCTION tidy()")
    engine.sql("CREATE TRIGGER b AFTER INSERT OR UPDATE OR DELETE ON t FOR EACH ROW EXECUTE FUNCTION note()")
    engine.sql("INSERT INTO t (k, v) VALUES (1, 'a'), (2, 'skip'), (3, 'c')")
    engine.sql("UPDATE t SET v = 'z' WHERE k = 1")
    engine.sql("DELETE FROM t WHERE k = 3")
    assert engine.collect("SELECT k, v, n FROM t") == [(1, "Z", 1)]
    assert sorted(engine.collect("SELECT * FROM log"), key=str) == [("DELETE", 3, "C", None), ("INSERT", 1, None, "A"), ("INSERT", 3, None, "C"), ("UPDATE", 1, "A", "Z")]


def test_trigger_conditions_exceptions_and_statements(engine):
    engine.sql("CREATE TABLE t (k int, v int); CREATE TABLE runs (n int)")
    engine.sql("CREATE FUNCTION check_() RETURNS trigger LANGUAGE plpgsql AS $$ BEGIN IF NEW.v < 0 THEN RAISE EXCEPTION 'negative' USING ERRCODE = 'check_violation'; END IF; RETURN NEW; END $$")
    engine.sql("CREATE FUNCTION count_() RETURNS trigger LANGUAGE plpgsql AS $$ BEGIN INSERT INTO runs SELECT count(*) FROM t; RETURN NULL; END $$")
    engine.sql("CREATE TRIGGER a BEFORE INSERT ON t FOR EACH ROW WHEN (NEW.k > 1) EXECUTE FUNCTION check_()")
    engine.sql("CREATE TRIGGER b AFTER INSERT ON t EXECUTE FUNCTION count_()")
    engine.sql("INSERT INTO t VALUES (1, -1), (2, 2)")
    with pytest.raises(SqlError) as caught:
        engine.sql("INSERT INTO t VALUES (3, -3)")
    assert (caught.value.state, caught.value.message) == ("23514", "negative")
    assert engine.collect("SELECT n FROM runs") == [(2,)]
    engine.sql("DROP TRIGGER b ON t; INSERT INTO t VALUES (5, 5)")
    assert engine.collect("SELECT count(*) AS n FROM runs") == [(1,)]


def test_functions_over_columns_are_expressions(engine):
    engine.sql("CREATE TABLE tt (x int); INSERT INTO tt VALUES (1), (5), (12), (NULL)")
    engine.sql("CREATE FUNCTION g(n int) RETURNS text LANGUAGE plpgsql AS $$ DECLARE r text := 'none'; k int; BEGIN IF n IS NULL THEN RETURN 'null'; END IF; k := n * 2; IF k > 20 THEN r := 'big'; ELSIF k > 5 THEN r := 'mid ' || k; END IF; RETURN r; END $$")
    assert sorted(engine.collect("SELECT x, g(x) FROM tt"), key=str) == [(1, "none"), (12, "big"), (5, "mid 10"), (None, "null")]
    assert engine.collect("SELECT x FROM tt WHERE g(x) = 'big'") == [(12,)] and engine.collect("SELECT g(7)") == [("mid 14",)]
    engine.sql("CREATE FUNCTION fact(n int) RETURNS bigint LANGUAGE plpgsql STRICT AS $$ DECLARE f bigint := 1; BEGIN FOR i IN 1..n LOOP f := f * i; IF i % 2 = 0 THEN f := f + 1; END IF; END LOOP; RETURN f; END $$")
    assert sorted(engine.collect("SELECT x, fact(x) FROM tt WHERE x IS NULL OR x < 6"), key=str) == [(1, 1), (5, 185), (None, None)]
    assert engine.collect("SELECT fact(5)") == [(185,)]
    text = engine.sql("SELECT fact(x) FROM tt")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text
    engine.sql("CREATE FUNCTION chk(n int) RETURNS int LANGUAGE plpgsql AS $$ BEGIN CASE n WHEN 1 THEN RETURN 10; WHEN 5 THEN RETURN 50; ELSE RAISE EXCEPTION 'bad %', n; END CASE; END $$")
    assert sorted(engine.collect("SELECT chk(x) FROM tt WHERE x < 6")) == [(10,), (50,)]
    with pytest.raises(Exception, match="bad 12"):
        engine.collect("SELECT chk(x) FROM tt WHERE x = 12")
    engine.sql("CREATE FUNCTION w(n int) RETURNS int LANGUAGE plpgsql AS $$ BEGIN WHILE n > 1 LOOP n := n / 2; END LOOP; RETURN n; END $$")
    with pytest.raises(SqlError) as caught:
        engine.collect("SELECT w(x) FROM tt")
    assert caught.value.state == "0A000" and engine.collect("SELECT w(9)") == [(1,)]


def test_overloads_and_numbers_for_each_row(engine):
    for args, body in (("a int", "'int ' || a"), ("a text", "a || '!'"), ("a int, b int", "'two'")):
        engine.sql(f"CREATE FUNCTION f({args}) RETURNS text LANGUAGE sql AS $$ SELECT {body} $$")
    assert engine.collect("SELECT f(1), f('x'), f('y'::text), f(1, 2), f(n.v) FROM (VALUES (7)) n(v)") == [("int 1", "x!", "y!", "two", "int 7")]
    with pytest.raises(SqlError) as caught:
        engine.collect("SELECT f(true)")
    assert caught.value.state == "42883"
    engine.sql("CREATE OR REPLACE FUNCTION f(a text) RETURNS text LANGUAGE sql AS $$ SELECT a || '?' $$")
    assert engine.collect("SELECT f('x'), f(2)") == [("x?", "int 2")]
    engine.sql("CREATE SEQUENCE s")
    assert engine.collect("SELECT nextval('s') FROM generate_series(1,3)") == [(1,), (2,), (3,)]
    assert engine.collect("SELECT v, nextval('s') AS a, nextval('s') AS b FROM (VALUES (3),(1),(2)) t(v) ORDER BY v") == [(1, 4, 5), (2, 6, 7), (3, 8, 9)]
    assert engine.collect("SELECT nextval('s'), currval('s')") == [(10, 10)]
    assert engine.collect("SELECT nextval('s') FROM generate_series(1,0)") == [] and engine.collect("SELECT nextval('s')") == [(11,)]

"""Data changes, transactions, types and functions: scripts of the dialect, and DuckDB SQL of what they leave."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..session import Engine, statements


def _script(text: str) -> Callable[[Engine], DataFrame]:
    """Run a script; its last statement gives the rows."""

    def run(engine: Engine) -> DataFrame:
        out = None
        for one in statements(text):
            out = engine.sql(one)
        assert out is not None
        return out

    return run


_COPY = "CREATE TABLE cust AS SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer;"
_KEYED = "CREATE TABLE nat (k int PRIMARY KEY, name text NOT NULL, r int, n int DEFAULT 0); INSERT INTO nat (k, name, r) SELECT n_nationkey, n_name, n_regionkey FROM nation;"


def _savepoints(engine: Engine) -> DataFrame:
    for one in statements(_KEYED + "BEGIN; DELETE FROM nat WHERE r = 1; SAVEPOINT a; UPDATE nat SET n = 5; ROLLBACK TO a; UPDATE nat SET n = 1 WHERE r = 2; COMMIT; BEGIN; DELETE FROM nat; ROLLBACK"):
        engine.sql(one)
    return engine.sql("SELECT k AS k, r AS r, n AS n FROM nat")


def _copy_roundtrip(engine: Engine) -> DataFrame:
    from ..sources.scratch import new_path

    path = new_path(engine.spark, "copied")
    engine.sql("CREATE TABLE a AS SELECT n_nationkey AS k, n_name || E'\\t' || nullif(n_name, 'CHINA') AS t, n_regionkey > 2 AS f FROM nation")
    engine.sql(f"COPY a TO '{path}'")
    engine.sql("CREATE TABLE b (k int, t text, f boolean)")
    engine.sql(f"COPY b FROM '{path}'")
    return engine.sql("SELECT k AS k, t AS t, f AS f FROM b")


def _copy_csv(engine: Engine) -> DataFrame:
    engine.sql("CREATE TABLE a (k int, t text, d double precision)")
    engine.copy_in("a", ["k,t,d", '1,"x, ""y""",2.5', "2,,3", "3,plain,"], format="csv", header="true")
    return engine.sql("SELECT k AS k, t AS t, d AS d FROM a")


def _udaf(engine: Engine) -> DataFrame:
    import pandas as pd

    from ..operators.aggregates import register_aggregate

    def second(values: pd.Series) -> float:
        kept = values.dropna().sort_values(ascending=False)
        return float(kept.iloc[1]) if len(kept) > 1 else float("nan")

    register_aggregate(engine, "second_largest", second, "double")
    return engine.sql("SELECT c_nationkey AS k, round(second_largest(c_acctbal), 2) AS v FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING count(*) > 1) GROUP BY c_nationkey")


def _prepared(engine: Engine) -> DataFrame:
    engine.sql("PREPARE big AS SELECT o_orderkey AS k FROM orders WHERE o_totalprice > $1 AND o_orderstatus = $2")
    return engine.sql("EXECUTE big(150000, 'F')")


def _parameters(engine: Engine) -> DataFrame:
    return engine.sql("SELECT o_orderkey AS k FROM orders WHERE o_custkey = ANY($1) AND o_totalprice >= $2", [[1, 2, 3, 4, 5, 7, 8], 1000.5])


QUERIES: dict[str, tuple[Callable[[Engine], DataFrame], str]] = {
    "dml_insert_select_defaults": (
        _script("CREATE TABLE x (id serial, k int, tag text DEFAULT 'new', twice int GENERATED ALWAYS AS (k * 2) STORED); INSERT INTO x (k) SELECT n_nationkey FROM nation; INSERT INTO x VALUES (DEFAULT, 100, DEFAULT); SELECT k AS k, tag AS tag, twice AS twice, id > 0 AS numbered FROM x"),
        "SELECT n_nationkey AS k, 'new' AS tag, n_nationkey * 2 AS twice, true AS numbered FROM nation UNION ALL SELECT 100, 'new', 200, true",
    ),
    "dml_update_from": (
        _script(_COPY + "UPDATE cust SET c_acctbal = c_acctbal + 100, c_name = n_name FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = 1; SELECT c_custkey AS k, c_name AS name, round(c_acctbal, 2) AS bal FROM cust"),
        "SELECT c_custkey AS k, CASE WHEN n_regionkey = 1 THEN n_name ELSE c_name END AS name, round(CASE WHEN n_regionkey = 1 THEN c_acctbal + 100 ELSE c_acctbal END, 2) AS bal FROM customer JOIN nation ON n_nationkey = c_nationkey",
    ),
    "dml_update_row_subquery": (
        _script(_KEYED + "UPDATE nat SET (name, n) = (SELECT r_name, r_regionkey + 100 FROM region WHERE r_regionkey = nat.r) WHERE k < 5; SELECT k AS k, name AS name, n AS n FROM nat"),
        "SELECT n_nationkey AS k, CASE WHEN n_nationkey < 5 THEN r_name ELSE n_name END AS name, CASE WHEN n_nationkey < 5 THEN r_regionkey + 100 ELSE 0 END AS n FROM nation JOIN region ON r_regionkey = n_regionkey",
    ),
    "dml_delete_using": (_script(_COPY + "DELETE FROM cust USING nation WHERE n_nationkey = c_nationkey AND n_regionkey = 2; SELECT c_custkey AS k FROM cust"), "SELECT c_custkey AS k FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 2"),
    "dml_upsert_nothing": (
        _script(_KEYED + "INSERT INTO nat (k, name, r) SELECT n_nationkey + 10, 'again', 9 FROM nation ON CONFLICT (k) DO NOTHING; SELECT k AS k, name AS name, r AS r FROM nat"),
        "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation UNION ALL SELECT n_nationkey + 10, 'again', 9 FROM nation WHERE n_nationkey + 10 NOT IN (SELECT n_nationkey FROM nation)",
    ),
    "dml_upsert_update": (
        _script(_KEYED + "INSERT INTO nat (k, name, r) SELECT n_nationkey + 10, lower(n_name), 9 FROM nation ON CONFLICT (k) DO UPDATE SET name = excluded.name, n = nat.n + excluded.r WHERE nat.r <> 1; SELECT k AS k, name AS name, r AS r, n AS n FROM nat"),
        "SELECT a.n_nationkey AS k, CASE WHEN b.n_name IS NOT NULL AND a.n_regionkey <> 1 THEN lower(b.n_name) ELSE a.n_name END AS name, a.n_regionkey AS r, CASE WHEN b.n_name IS NOT NULL AND a.n_regionkey <> 1 THEN 9 ELSE 0 END AS n FROM nation a LEFT JOIN nation b ON b.n_nationkey + 10 = a.n_nationkey UNION ALL SELECT n_nationkey + 10, lower(n_name), 9, 0 FROM nation WHERE n_nationkey + 10 NOT IN (SELECT n_nationkey FROM nation)",
    ),
    "dml_returning": (_script(_KEYED + "UPDATE nat SET n = k * 10 WHERE r = 3 RETURNING k AS k, n AS n, name || '!' AS shout"), "SELECT n_nationkey AS k, n_nationkey * 10 AS n, n_name || '!' AS shout FROM nation WHERE n_regionkey = 3"),
    "dml_with_cte": (_script(_KEYED + "WITH gone AS (SELECT r_regionkey AS x FROM region WHERE r_regionkey > 2) DELETE FROM nat USING gone WHERE nat.r = gone.x; SELECT k AS k FROM nat"), "SELECT n_nationkey AS k FROM nation WHERE n_regionkey <= 2"),
    "dml_truncate": (_script(_KEYED + "TRUNCATE nat; INSERT INTO nat VALUES (1, 'one', 2, 3); SELECT k AS k, name AS name FROM nat"), "SELECT 1 AS k, 'one' AS name"),
    "fk_cascade": (
        _script("CREATE TABLE reg (k int PRIMARY KEY); INSERT INTO reg SELECT r_regionkey FROM region; CREATE TABLE nat (k int, r int REFERENCES reg ON DELETE CASCADE); INSERT INTO nat SELECT n_nationkey, n_regionkey FROM nation; DELETE FROM reg WHERE k = 1; SELECT k AS k FROM nat"),
        "SELECT n_nationkey AS k FROM nation WHERE n_regionkey <> 1",
    ),
    "fk_set_null": (
        _script("CREATE TABLE reg (k int PRIMARY KEY); INSERT INTO reg SELECT r_regionkey FROM region; CREATE TABLE nat (k int, r int REFERENCES reg ON DELETE SET NULL); INSERT INTO nat SELECT n_nationkey, n_regionkey FROM nation; DELETE FROM reg WHERE k > 2; SELECT k AS k, r AS r FROM nat"),
        "SELECT n_nationkey AS k, CASE WHEN n_regionkey <= 2 THEN n_regionkey END AS r FROM nation",
    ),
    "alter_table": (
        _script(_KEYED + "ALTER TABLE nat ADD COLUMN extra int DEFAULT 7, DROP COLUMN n; ALTER TABLE nat RENAME COLUMN name TO label; ALTER TABLE nat ALTER COLUMN r TYPE text USING 'r' || r::text; SELECT k AS k, label AS label, r AS r, extra AS extra FROM nat"),
        "SELECT n_nationkey AS k, n_name AS label, 'r' || n_regionkey AS r, 7 AS extra FROM nation",
    ),
    "create_table_as": (_script(_COPY + "SELECT c_nationkey AS k, count(*) AS n FROM cust GROUP BY c_nationkey"), "SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey"),
    "view_query": (_script("CREATE VIEW rich AS SELECT c_custkey AS k, c_acctbal AS bal FROM customer WHERE c_acctbal > 5000; SELECT count(*) AS n, round(sum(bal), 2) AS total FROM rich"), "SELECT count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_acctbal > 5000"),
    "copy_roundtrip": (_copy_roundtrip, "SELECT n_nationkey AS k, n_name || chr(9) || nullif(n_name, 'CHINA') AS t, n_regionkey > 2 AS f FROM nation"),
    "copy_csv": (_copy_csv, "SELECT * FROM (VALUES (1, 'x, \"y\"', 2.5::double), (2, NULL, 3.0::double), (3, 'plain', NULL)) AS t(k, t, d)"),
    "copy_to_lines": (_script("COPY (SELECT n_nationkey, n_name, nullif(n_regionkey, 1) FROM nation) TO STDOUT WITH (FORMAT csv, DELIMITER ';')"), "SELECT n_nationkey || ';' || n_name || ';' || coalesce(nullif(n_regionkey, 1)::text, '') AS data FROM nation"),
    "tx_savepoint": (_savepoints, "SELECT n_nationkey AS k, n_regionkey AS r, CASE WHEN n_regionkey = 2 THEN 1 ELSE 0 END AS n FROM nation WHERE n_regionkey <> 1"),
    "udf_sql": (_script("CREATE FUNCTION taxed(price double precision, rate double precision DEFAULT 0.1) RETURNS double precision LANGUAGE sql AS $$ SELECT price * (1 + rate) $$; SELECT p_partkey AS k, round(taxed(p_retailprice), 2) AS a, round(taxed(p_retailprice, rate => 0.5), 2) AS b FROM part"), "SELECT p_partkey AS k, round(p_retailprice * (1 + 0.1::double), 2) AS a, round(p_retailprice * (1 + 0.5::double), 2) AS b FROM part"),
    "udf_plpgsql": (
        _script("CREATE FUNCTION collatz(n bigint) RETURNS int LANGUAGE plpgsql AS $$ DECLARE s int := 0; BEGIN WHILE n > 1 LOOP IF n % 2 = 0 THEN n := n / 2; ELSE n := 3 * n + 1; END IF; s := s + 1; END LOOP; RETURN s; END $$; SELECT n_nationkey AS k, collatz(6) AS steps FROM nation"),
        "SELECT n_nationkey AS k, 8 AS steps FROM nation",
    ),
    "plpgsql_block": (
        _script(_KEYED + "DO $$ DECLARE r record; total int := 0; BEGIN FOR r IN SELECT k, n FROM nat WHERE r = 1 LOOP total := total + r.k; END LOOP; UPDATE nat SET n = total WHERE k < 3; EXCEPTION WHEN division_by_zero THEN NULL; END $$; SELECT k AS k, n AS n FROM nat"),
        "SELECT n_nationkey AS k, CASE WHEN n_nationkey < 3 THEN (SELECT sum(n_nationkey) FROM nation WHERE n_regionkey = 1)::int ELSE 0 END AS n FROM nation",
    ),
    "udtf_table": (_script("CREATE FUNCTION below(n int) RETURNS TABLE (k int, name text) LANGUAGE sql AS $$ SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < n $$; SELECT k AS k, name AS name FROM below(6)"), "SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey < 6"),
    "udaf_custom": (_udaf, "SELECT c_nationkey AS k, round(list_sort(list(c_acctbal), 'DESC')[2], 2) AS v FROM customer GROUP BY c_nationkey HAVING count(*) > 1"),
    "prepare_execute": (_prepared, "SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'F'"),
    "query_parameters": (_parameters, "SELECT o_orderkey AS k FROM orders WHERE o_custkey IN (1, 2, 3, 4, 5, 7, 8) AND o_totalprice >= 1000.5"),
    "info_schema_columns": (_script(_KEYED + "SELECT column_name AS c, data_type AS t, is_nullable AS n FROM information_schema.columns WHERE table_name = 'nat'"), "SELECT * FROM (VALUES ('k', 'integer', 'NO'), ('name', 'text', 'NO'), ('r', 'integer', 'YES'), ('n', 'integer', 'YES')) AS t(c, t, n)"),
    "sequence_nextval": (_script("CREATE SEQUENCE s START 10 INCREMENT 5; SELECT nextval('s'); SELECT nextval('s') AS a, currval('s') AS b, lastval() AS c"), "SELECT 15::bigint AS a, 15::bigint AS b, 15::bigint AS c"),
    "enum_ordering": (
        _script("CREATE TYPE level AS ENUM ('low', 'mid', 'high'); CREATE TABLE e (k int, l level); INSERT INTO e SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'mid' ELSE 'high' END FROM nation; SELECT k AS k, l AS l, l >= 'mid'::level AS over_, row_number() OVER (ORDER BY l DESC, k) AS place FROM e"),
        "SELECT k, l, l <> 'low' AS over_, row_number() OVER (ORDER BY CASE l WHEN 'low' THEN 1 WHEN 'mid' THEN 2 ELSE 3 END DESC, k) AS place FROM (SELECT n_nationkey AS k, CASE n_nationkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'mid' ELSE 'high' END AS l FROM nation)",
    ),
    "domain_check": (_script("CREATE DOMAIN pos AS int CHECK (value >= 0); CREATE TABLE d (k pos, t varchar(40)); INSERT INTO d SELECT n_nationkey, n_name FROM nation; SELECT k AS k, t AS t FROM d"), "SELECT n_nationkey AS k, n_name AS t FROM nation"),
    "sequence_rows": (
        _script("CREATE SEQUENCE s START 10 INCREMENT 5; SELECT n_nationkey AS k, nextval('s') AS a FROM nation ORDER BY n_nationkey"),
        "SELECT n_nationkey AS k, 10 + 5 * (row_number() OVER (ORDER BY n_nationkey) - 1)::bigint AS a FROM nation",
    ),
    "function_overloads": (
        _script("CREATE FUNCTION f(a int) RETURNS text LANGUAGE sql AS $$ SELECT 'int ' || a $$; CREATE FUNCTION f(a text) RETURNS text LANGUAGE sql AS $$ SELECT a || '!' $$; CREATE FUNCTION f(a int, b int) RETURNS text LANGUAGE sql AS $$ SELECT a || '/' || b $$; SELECT n_nationkey AS k, f(n_regionkey) AS i, f(n_name) AS t, f(n_nationkey, n_regionkey) AS two, f('x') AS lit FROM nation"),
        "SELECT n_nationkey AS k, 'int ' || n_regionkey AS i, n_name || '!' AS t, n_nationkey || '/' || n_regionkey AS two, 'x!' AS lit FROM nation",
    ),
    "plpgsql_columns": (
        _script("CREATE FUNCTION grade(price double precision, bonus int DEFAULT 0) RETURNS text LANGUAGE plpgsql STRICT AS $$ DECLARE p double precision := price + bonus; r text; BEGIN IF p >= 1500 THEN r := 'high'; ELSIF p >= 1000 THEN r := 'mid'; ELSE RETURN 'low ' || bonus; END IF; RETURN r || '/' || length(r); END $$; CREATE FUNCTION fold(n int) RETURNS bigint LANGUAGE plpgsql AS $$ DECLARE s bigint := 0; BEGIN FOR i IN 1..n LOOP IF i % 2 = 0 THEN s := s + i; ELSE s := s + 1; END IF; END LOOP; RETURN s; END $$; SELECT p_partkey AS k, grade(p_retailprice) AS g, grade(p_retailprice, p_size) AS h, fold(p_size) AS f FROM part"),
        "SELECT p_partkey AS k, CASE WHEN p_retailprice >= 1500 THEN 'high/4' WHEN p_retailprice >= 1000 THEN 'mid/3' ELSE 'low 0' END AS g, CASE WHEN p_retailprice + p_size >= 1500 THEN 'high/4' WHEN p_retailprice + p_size >= 1000 THEN 'mid/3' ELSE 'low ' || p_size END AS h, (coalesce((SELECT sum(CASE WHEN i % 2 = 0 THEN i ELSE 1 END) FROM generate_series(1, p_size) AS t(i)), 0))::bigint AS f FROM part",
    ),
    "view_changes": (
        _script(_KEYED + "CREATE VIEW low AS SELECT k AS key, name AS label, n AS n FROM nat WHERE r < 3; UPDATE low SET label = label || '!', n = key WHERE key > 5; DELETE FROM low WHERE n = 0; INSERT INTO low VALUES (100, 'new', 7); SELECT k AS k, name AS name, r AS r, n AS n FROM nat"),
        "SELECT n_nationkey AS k, CASE WHEN n_regionkey < 3 THEN n_name || '!' ELSE n_name END AS name, n_regionkey AS r, CASE WHEN n_regionkey < 3 THEN n_nationkey ELSE 0 END AS n FROM nation WHERE NOT (n_regionkey < 3 AND n_nationkey <= 5) UNION ALL SELECT 100, 'new', NULL, 7",
    ),
    "trigger_audit": (
        _script(_KEYED + "CREATE TABLE log (k int, what text); CREATE FUNCTION stamp() RETURNS trigger LANGUAGE plpgsql AS $$ BEGIN NEW.n := NEW.k * 2; RETURN NEW; END $$; CREATE FUNCTION audit() RETURNS trigger LANGUAGE plpgsql AS $$ BEGIN INSERT INTO log VALUES (NEW.k, OLD.name || '>' || NEW.name); RETURN NULL; END $$; CREATE TRIGGER a BEFORE UPDATE ON nat FOR EACH ROW EXECUTE FUNCTION stamp(); CREATE TRIGGER b AFTER UPDATE ON nat FOR EACH ROW EXECUTE FUNCTION audit(); UPDATE nat SET name = lower(name) WHERE r = 2; SELECT l.k AS k, l.what AS what, t.n AS n FROM log l JOIN nat t ON t.k = l.k"),
        "SELECT n_nationkey AS k, n_name || '>' || lower(n_name) AS what, n_nationkey * 2 AS n FROM nation WHERE n_regionkey = 2",
    ),
    "plpgsql_exception": (
        _script(_KEYED + "DO $$ BEGIN UPDATE nat SET n = 1; UPDATE nat SET k = 1 WHERE k = 2; EXCEPTION WHEN unique_violation THEN UPDATE nat SET n = 9 WHERE r = 1; END $$; SELECT k AS k, n AS n FROM nat"),
        "SELECT n_nationkey AS k, CASE WHEN n_regionkey = 1 THEN 9 ELSE 0 END AS n FROM nation",
    ),
    "index_unique": (
        _script(_KEYED + "CREATE UNIQUE INDEX by_name ON nat (lower(name)); INSERT INTO nat (k, name, r) VALUES (100, 'nowhere', 1); SELECT indexname AS i, (SELECT count(*) FROM nat) AS rows_ FROM pg_indexes"),
        "SELECT 'by_name' AS i, count(*) + 1 AS rows_ FROM nation",
    ),
    "session_settings": (_script("SET search_path = public; SET application_name = 'x'; SHOW application_name"), "SELECT 'x' AS application_name"),
    "maintenance_commands": (_script(_KEYED + "VACUUM nat; GRANT SELECT ON nat TO public; ANALYZE nat; SELECT count(*) AS n FROM nat"), "SELECT count(*) AS n FROM nation"),
    "system_catalogs": (
        _script(_KEYED + "CREATE TABLE child (id int PRIMARY KEY, k int REFERENCES nat ON DELETE CASCADE, n int CHECK (n > 0)); SELECT c.relname AS rel, a.attname AS att, t.typname AS kind, format_type(t.oid, NULL) AS shown, a.attnotnull AS nn, a.attnum::int AS place FROM pg_attribute a JOIN pg_class c ON c.oid = a.attrelid JOIN pg_namespace s ON s.oid = c.relnamespace JOIN pg_type t ON t.oid = a.atttypid WHERE s.nspname = 'public'"),
        "SELECT * FROM (VALUES ('nat', 'k', 'int4', 'integer', true, 1), ('nat', 'name', 'text', 'text', true, 2), ('nat', 'r', 'int4', 'integer', false, 3), ('nat', 'n', 'int4', 'integer', false, 4), ('child', 'id', 'int4', 'integer', true, 1), ('child', 'k', 'int4', 'integer', false, 2), ('child', 'n', 'int4', 'integer', false, 3)) AS t(rel, att, kind, shown, nn, place)",
    ),
    "constraint_definitions": (
        _script(_KEYED + "CREATE TABLE child (id int PRIMARY KEY, k int REFERENCES nat ON DELETE CASCADE, UNIQUE (id, k)); SELECT conname AS name, contype AS kind, pg_get_constraintdef(oid) AS def FROM pg_constraint"),
        "SELECT * FROM (VALUES ('nat_pkey', 'p', 'PRIMARY KEY (k)'), ('child_pkey', 'p', 'PRIMARY KEY (id)'), ('child_k_fkey', 'f', 'FOREIGN KEY (k) REFERENCES nat(k) ON DELETE CASCADE'), ('child_id_k_key', 'u', 'UNIQUE (id, k)')) AS t(name, kind, def)",
    ),
}

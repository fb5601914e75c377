"""Predicates, projections, sorting, limits, distinct and set operations: SQL of the dialect, and of DuckDB where it differs."""

QUERIES = {
    "filter_cmp_3vl": "SELECT c_custkey AS k, c_acctbal > 0 AND nullif(c_nationkey, 3) > 5 AS both_true, c_acctbal > 0 OR nullif(c_nationkey, 3) > 5 AS either, NOT (nullif(c_nationkey, 3) > 5) AS negated FROM customer WHERE c_acctbal <> 0 OR nullif(c_nationkey, 3) >= 10",
    "between_symmetric": (
        "SELECT p_partkey AS k, p_size BETWEEN SYMMETRIC 30 AND 10 AS inside, p_size NOT BETWEEN 10 AND 30 AS outside FROM part WHERE nullif(p_size, 7) BETWEEN SYMMETRIC 40 AND 5",
        "SELECT p_partkey AS k, p_size BETWEEN 10 AND 30 AS inside, p_size NOT BETWEEN 10 AND 30 AS outside FROM part WHERE nullif(p_size, 7) BETWEEN 5 AND 40",
    ),
    "in_list_null": "SELECT n_nationkey AS k, n_regionkey IN (1, 2, NULL) AS found, nullif(n_regionkey, 0) NOT IN (1, 2) AS missing FROM nation WHERE n_nationkey IN (1, 2, 3, 5, 8, 13, 21)",
    "like_ilike_escape": (
        "SELECT p_partkey AS k, p_name LIKE '%a_e%' AS liked, p_type ILIKE 'PROMO%' AS any_case, p_brand NOT LIKE 'Brand#1%' AS other, '10%' LIKE '10!%' ESCAPE '!' AS escaped, 'a\\_b' LIKE 'a\\\\\\_b' AS backslash FROM part",
        "SELECT p_partkey AS k, p_name LIKE '%a_e%' AS liked, p_type ILIKE 'PROMO%' AS any_case, p_brand NOT LIKE 'Brand#1%' AS other, true AS escaped, true AS backslash FROM part",
    ),
    "similar_to": (
        "SELECT p_partkey AS k, p_brand SIMILAR TO 'Brand#(1|2)_' AS brand, p_type SIMILAR TO '%(TIN|STEEL|tin|steel)' AS metal, p_name NOT SIMILAR TO '[a-m]%' AS late FROM part",
        "SELECT p_partkey AS k, regexp_full_match(p_brand, 'Brand#(1|2).') AS brand, regexp_full_match(p_type, '.*(TIN|STEEL|tin|steel)') AS metal, NOT regexp_full_match(p_name, '[a-m].*') AS late FROM part",
    ),
    "regex_ops": (
        "SELECT p_partkey AS k, p_name ~ '^[a-f]' AS early, p_type ~* 'brass|copper' AS metal, p_brand !~ '[1-3]' AS high, p_name !~* 'E' AS no_e FROM part",
        "SELECT p_partkey AS k, regexp_matches(p_name, '^[a-f]') AS early, regexp_matches(p_type, 'brass|copper', 'i') AS metal, NOT regexp_matches(p_brand, '[1-3]') AS high, NOT regexp_matches(p_name, 'E', 'i') AS no_e FROM part",
    ),
    "case_simple_searched": "SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS status, CASE WHEN o_totalprice > 200000 THEN 3 WHEN o_totalprice > 100000 THEN 2 WHEN o_totalprice > 50000 THEN 1 END AS band FROM orders",
    "coalesce_nullif_greatest_least": "SELECT c_custkey AS k, coalesce(nullif(c_nationkey, 1), nullif(c_nationkey, 2), -1) AS c, greatest(c_nationkey, 10, nullif(c_nationkey, 20)) AS g, least(c_nationkey, 10, nullif(c_nationkey, 5)) AS l FROM customer",
    "is_distinct_from": "SELECT n_nationkey AS k, nullif(n_regionkey, 1) IS DISTINCT FROM nullif(n_regionkey, 2) AS differs, nullif(n_regionkey, 1) IS NOT DISTINCT FROM NULL AS is_null FROM nation",
    "int_division_mod": ("SELECT l_orderkey AS k, l_linenumber AS n, l_orderkey / 7 AS q, -l_orderkey / 7 AS nq, -l_orderkey % 7 AS m, 2 ^ l_linenumber AS p FROM lineitem", "SELECT l_orderkey AS k, l_linenumber AS n, l_orderkey // 7 AS q, -(l_orderkey // 7) AS nq, -l_orderkey % 7 AS m, power(2, l_linenumber) AS p FROM lineitem"),
    "bool_tests": (
        "SELECT n_nationkey AS k, (nullif(n_regionkey, 1) > 2) IS TRUE AS t, (nullif(n_regionkey, 1) > 2) IS NOT TRUE AS nt, (nullif(n_regionkey, 1) > 2) IS FALSE AS f, (nullif(n_regionkey, 1) > 2) IS NOT FALSE AS nf, (nullif(n_regionkey, 1) > 2) IS UNKNOWN AS u, (nullif(n_regionkey, 1) > 2) IS NOT UNKNOWN AS nu FROM nation",
        "SELECT n_nationkey AS k, coalesce(nullif(n_regionkey, 1) > 2, false) AS t, NOT coalesce(nullif(n_regionkey, 1) > 2, false) AS nt, NOT coalesce(nullif(n_regionkey, 1) > 2, true) AS f, coalesce(nullif(n_regionkey, 1) > 2, true) AS nf, nullif(n_regionkey, 1) IS NULL AS u, nullif(n_regionkey, 1) IS NOT NULL AS nu FROM nation",
    ),
    "cast_matrix": "SELECT l_orderkey AS k, l_linenumber AS n, l_quantity::int AS i, l_quantity::bigint AS b, l_orderkey::text AS t, ('1' || l_linenumber::text)::int AS back, (l_linenumber > 3)::int AS flag, l_shipdate::date AS d, CAST(l_linenumber AS double precision) AS f, '2024-01-05'::date AS fixed FROM lineitem",
    "row_compare": "SELECT o_orderkey AS k, (o_orderstatus, o_custkey) < ('O', 50) AS before_, (o_orderstatus, o_custkey) = ('F', o_custkey) AS same FROM orders",
    "order_nulls": "SELECT k, v FROM (SELECT n_nationkey AS k, nullif(n_regionkey, 2) AS v FROM nation) AS t ORDER BY v DESC NULLS LAST, k LIMIT 12",
    "order_by_expr": "SELECT c_custkey AS k, c_name AS name FROM customer ORDER BY c_acctbal * -1, c_custkey LIMIT 40",
    "limit_offset": "SELECT o_orderkey AS k FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 100",
    "topk": "SELECT l_orderkey AS k, l_linenumber AS n, l_extendedprice AS price FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100",
    "distinct_rows": "SELECT DISTINCT l_returnflag AS flag, l_linestatus AS status, l_linenumber AS n FROM lineitem",
    "distinct_on": "SELECT DISTINCT ON (o_custkey) o_custkey AS cust, o_orderkey AS k, o_totalprice AS price FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
    "values_table": ("SELECT t.column1 AS a, t.column2 AS b, n.n_name AS name FROM (VALUES (1, 'one'), (2, 'two'), (30, NULL)) AS t LEFT JOIN nation n ON n.n_nationkey = t.column1", "SELECT t.a, t.b, n.n_name AS name FROM (VALUES (1, 'one'), (2, 'two'), (30, NULL)) AS t(a, b) LEFT JOIN nation n ON n.n_nationkey = t.a"),
    "table_command": ("TABLE region", "SELECT * FROM region"),
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except": "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey < 12",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "setop_order_limit": "(SELECT c_custkey AS k, c_name AS name FROM customer) UNION ALL (SELECT s_suppkey, s_name FROM supplier) ORDER BY k DESC, name LIMIT 20 OFFSET 3",
    "setop_precedence": "SELECT n_nationkey AS k FROM nation UNION SELECT c_nationkey + 20 FROM customer INTERSECT SELECT s_nationkey + 20 FROM supplier",
    "for_update_ignored": ("SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1 FOR UPDATE SKIP LOCKED", "SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1"),
    "fetch_first": "SELECT p_partkey AS k FROM part ORDER BY p_partkey DESC OFFSET 2 ROWS FETCH FIRST 5 ROWS ONLY",
}

"""Joins, subqueries and common tables."""

QUERIES = {
    "join_inner": "SELECT o.o_orderkey AS k, c.c_name AS name, n.n_name AS nation FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey",
    "join_left": "SELECT c.c_custkey AS cust, o.o_orderkey AS k FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 150000",
    "join_right": "SELECT o.o_orderkey AS k, c.c_custkey AS cust FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F'",
    "join_full": "SELECT c.c_custkey AS cust, s.s_suppkey AS supp FROM customer c FULL OUTER JOIN supplier s ON c.c_custkey = s.s_suppkey * 3",
    "join_full_theta": "SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a FULL JOIN region b ON a.n_nationkey < b.r_regionkey",
    "join_cross": "SELECT r.r_name AS region, n.n_name AS nation FROM region r CROSS JOIN nation n",
    "join_comma": "SELECT n.n_name AS nation, r.r_name AS region FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey",
    "join_using": "SELECT k, a.n_name AS name, b.c AS customers FROM (SELECT n_nationkey AS k, n_name FROM nation) a LEFT JOIN (SELECT c_nationkey AS k, count(*) AS c FROM customer GROUP BY c_nationkey) b USING (k)",
    "join_natural": "SELECT k, x, y FROM (SELECT n_nationkey AS k, n_regionkey AS x FROM nation) a NATURAL JOIN (SELECT s_nationkey AS k, s_suppkey AS y FROM supplier) b",
    "join_self": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_theta_band": "SELECT p.p_partkey AS p, s.s_suppkey AS s FROM part p JOIN supplier s ON p.p_retailprice BETWEEN s.s_acctbal AND s.s_acctbal + 20",
    "join_multi": "SELECT r.r_name AS region, count(*) AS lines, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY r.r_name",
    "join_null_keys": "SELECT a.k AS a, b.k AS b FROM (SELECT nullif(n_regionkey, 1) AS k FROM nation) a JOIN (SELECT nullif(r_regionkey, 2) AS k FROM region) b ON a.k = b.k",
    "join_lateral": "SELECT c.c_custkey AS cust, x.k AS k, x.price AS price FROM customer c, LATERAL (SELECT o.o_orderkey AS k, o.o_totalprice AS price FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 2) x",
    "join_left_lateral": "SELECT c.c_custkey AS cust, x.n AS n, x.top AS top FROM customer c LEFT JOIN LATERAL (SELECT count(*) AS n, max(o.o_totalprice) AS top FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O') x ON true",
    "exists_semi": "SELECT c_custkey AS k FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)",
    "not_exists_anti": "SELECT c_custkey AS k FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "exists_in_or": "SELECT c_custkey AS k FROM customer c WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')",
    "in_subquery": "SELECT s_suppkey AS k FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
    "not_in_null_aware": "SELECT n_nationkey AS k FROM nation WHERE n_nationkey NOT IN (SELECT nullif(c_nationkey, 4) FROM customer WHERE c_custkey < 0) AND n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 2)",
    "row_in_subquery": "SELECT o_orderkey AS k FROM orders WHERE (o_custkey, o_orderstatus) IN (SELECT c_custkey, 'F' FROM customer WHERE c_nationkey < 5)",
    "scalar_subquery_corr": "SELECT c_custkey AS k, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)",
    "any_subquery": ("SELECT p_partkey AS k FROM part WHERE p_size > ANY (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND p_size = SOME (SELECT n_nationkey + 10 FROM nation)", "SELECT p_partkey AS k FROM part WHERE p_size > (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 1) AND p_size IN (SELECT n_nationkey + 10 FROM nation)"),
    "all_subquery": ("SELECT p_partkey AS k FROM part WHERE p_size > ALL (SELECT n_nationkey FROM nation) AND p_size <> ALL (SELECT n_nationkey + 25 FROM nation WHERE n_regionkey < 2) AND p_size < ALL (SELECT 100 FROM nation WHERE n_nationkey < 0)", "SELECT p_partkey AS k FROM part WHERE p_size > (SELECT max(n_nationkey) FROM nation) AND p_size NOT IN (SELECT n_nationkey + 25 FROM nation WHERE n_regionkey < 2)"),
    "any_all_array": ("SELECT p_partkey AS k, p_size = ANY(ARRAY[1, 2, 3, 50]) AS hit, p_size > ALL(ARRAY[5, 10]) AS over_, p_size < ANY(ARRAY[NULL, 3]) AS maybe FROM part", "SELECT p_partkey AS k, p_size IN (1, 2, 3, 50) AS hit, p_size > 10 AS over_, CASE WHEN p_size < 3 THEN true END AS maybe FROM part"),
    "array_subquery": ("SELECT r_regionkey AS k, array_to_string(ARRAY(SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name DESC), ',') AS nations FROM region", "SELECT r_regionkey AS k, (SELECT string_agg(n_name, ',' ORDER BY n_name DESC) FROM nation WHERE n_regionkey = r_regionkey) AS nations FROM region"),
    "cte_chain": "WITH big AS (SELECT o_custkey AS cust, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), ranked(cust, total, place) AS (SELECT cust, total, rank() OVER (ORDER BY total DESC, cust) FROM big) SELECT cust, round(total, 2) AS total, place FROM ranked WHERE place <= 10",
    "cte_nested": "WITH a AS (WITH b AS (SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY n_regionkey) SELECT * FROM b WHERE n > 1) SELECT a.r AS r, a.n AS n, x.r AS other FROM a JOIN a AS x ON x.n = a.n",
    "recursive_union_all": "WITH RECURSIVE t(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM t WHERE n < 50) SELECT n, total FROM t",
    "recursive_hierarchy": "WITH RECURSIVE edge AS (SELECT 'r' || r_regionkey::text AS child, 'root' AS parent FROM region UNION ALL SELECT 'n' || n_nationkey::text, 'r' || n_regionkey::text FROM nation), walk(node, depth) AS (SELECT 'root', 0 UNION ALL SELECT edge.child, walk.depth + 1 FROM walk JOIN edge ON edge.parent = walk.node) SELECT node, depth FROM walk",
    "recursive_union_distinct": "WITH RECURSIVE edge(a, b) AS (SELECT n_nationkey, (n_nationkey * 7 + 3) % 25 FROM nation), reach(x) AS (SELECT 0 UNION SELECT edge.b FROM reach JOIN edge ON edge.a = reach.x) SELECT x FROM reach",
    "derived_columns": "SELECT t.a AS a, t.b AS b FROM (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 0) AS t(a, b)",
    "quantified_values": "SELECT n_nationkey AS k, n_nationkey > ANY (SELECT nullif(r_regionkey, 0) FROM region) AS a, n_nationkey >= ALL (SELECT r_regionkey FROM region) AS b, n_nationkey < ALL (SELECT nullif(r_regionkey, 0) FROM region) AS c, n_nationkey = ANY (SELECT nullif(r_regionkey, 3) FROM region) AS d, n_regionkey <= ANY (SELECT 1) AS e FROM nation",
    "not_in_values": "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
}

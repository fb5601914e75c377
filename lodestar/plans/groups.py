"""Aggregates and windows."""

QUERIES = {
    "agg_basic": "SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus",
    "agg_empty_global": "SELECT count(*) AS n, sum(n_nationkey)::bigint AS s, max(n_name) AS m FROM nation WHERE n_nationkey < 0",
    "agg_filter": "SELECT o_orderstatus AS status, count(*) FILTER (WHERE o_totalprice > 100000) AS big, round(sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 2) AS urgent, min(o_orderkey) FILTER (WHERE o_totalprice < 0) AS none FROM orders GROUP BY o_orderstatus",
    "agg_distinct": "SELECT l_returnflag AS flag, count(DISTINCT l_suppkey) AS supps, sum(DISTINCT l_linenumber)::bigint AS lines, round(avg(DISTINCT l_quantity), 4) AS qty FROM lineitem GROUP BY l_returnflag",
    "agg_bool": ("SELECT n_regionkey AS r, bool_and(n_nationkey > 1) AS every_big, bool_or(n_nationkey > 20) AS some_big, every(nullif(n_nationkey, 3) < 30) AS e FROM nation GROUP BY n_regionkey", "SELECT n_regionkey AS r, bool_and(n_nationkey > 1) AS every_big, bool_or(n_nationkey > 20) AS some_big, bool_and(nullif(n_nationkey, 3) < 30) AS e FROM nation GROUP BY n_regionkey"),
    "string_agg_ordered": "SELECT n_regionkey AS r, string_agg(n_name, '; ' ORDER BY n_name DESC) AS names, string_agg(nullif(n_name, 'FRANCE'), ',' ORDER BY n_nationkey) FILTER (WHERE n_nationkey > 3) AS late FROM nation GROUP BY n_regionkey",
    "array_agg_ordered_nulls": ("SELECT n_regionkey AS r, array_to_string(array_agg(nullif(n_nationkey, 7) ORDER BY n_nationkey DESC), ',', 'null') AS keys, cardinality(array_agg(nullif(n_nationkey, 7)))::bigint AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey AS r, string_agg(coalesce(nullif(n_nationkey, 7)::text, 'null'), ',' ORDER BY n_nationkey DESC) AS keys, count(*) AS n FROM nation GROUP BY n_regionkey"),
    "json_agg_ordered": ("SELECT n_regionkey AS r, json_agg(nullif(n_nationkey, 7) ORDER BY n_nationkey) AS keys FROM nation GROUP BY n_regionkey", "SELECT n_regionkey AS r, '[' || string_agg(coalesce(nullif(n_nationkey, 7)::text, 'null'), ',' ORDER BY n_nationkey) || ']' AS keys FROM nation GROUP BY n_regionkey"),
    "json_object_agg": ("SELECT n_regionkey AS r, cardinality(array(SELECT 1))::bigint AS one, json_object_agg(n_name, n_nationkey) ->> 'FRANCE' AS france FROM nation GROUP BY n_regionkey", "SELECT n_regionkey AS r, CAST(1 AS BIGINT) AS one, max(CASE WHEN n_name = 'FRANCE' THEN n_nationkey::text END) AS france FROM nation GROUP BY n_regionkey"),
    "having": "SELECT c_nationkey AS k, count(*) AS n, round(avg(c_acctbal), 6) AS a FROM customer GROUP BY c_nationkey HAVING count(*) > 5 AND avg(c_acctbal) > 3000",
    "group_by_expr": ("SELECT extract(year FROM o_orderdate)::int AS y, o_orderkey % 3 AS m, count(*) AS n FROM orders GROUP BY extract(year FROM o_orderdate)::int, o_orderkey % 3", "SELECT extract(year FROM o_orderdate)::int AS y, o_orderkey % 3 AS m, count(*) AS n FROM orders GROUP BY ALL"),
    "group_by_ordinal": "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "grouping_sets": "SELECT l_returnflag AS flag, l_linestatus AS status, grouping(l_returnflag)::int AS g, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "cube": "SELECT o_orderstatus AS status, o_orderpriority AS priority, grouping(o_orderstatus, o_orderpriority)::int AS g, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "rollup": "SELECT n_regionkey AS r, n_nationkey AS n, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)",
    "win_ranking": "SELECT o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS dr FROM orders",
    "win_ntile": "SELECT c_custkey AS k, ntile(7) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS tile FROM customer",
    "win_dist": "SELECT p_partkey AS k, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS cd, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS pr FROM part",
    "win_lag_lead": "SELECT o_orderkey AS k, lag(o_totalprice) OVER w AS before_, lead(o_totalprice, 2, -1) OVER w AS after_ FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "win_first_last_nth": "SELECT o_orderkey AS k, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l, nth_value(o_orderkey, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "win_rows_frame": "SELECT l_orderkey AS k, l_linenumber AS n, sum(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)::bigint AS s, count(*) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS 2 PRECEDING) AS c, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS m FROM lineitem",
    "win_range_peers": "SELECT p_partkey AS k, count(*) OVER (PARTITION BY p_brand ORDER BY p_size) AS upto, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING)::bigint AS near FROM part",
    "win_range_interval": "SELECT o_orderkey AS k, count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate RANGE BETWEEN INTERVAL '7 days' PRECEDING AND CURRENT ROW) AS week FROM orders",
    "win_groups_frame": "SELECT p_partkey AS k, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)::bigint AS s FROM part",
    "win_named": "SELECT c_custkey AS k, sum(c_nationkey) OVER w::bigint AS s, count(*) OVER (w ORDER BY c_custkey) AS n FROM customer WINDOW w AS (PARTITION BY c_mktsegment)",
    "win_distinct_count": "SELECT o_orderkey AS k, count(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey) AS kinds FROM orders",
    "win_filter": "SELECT o_orderkey AS k, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS done, max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') OVER (PARTITION BY o_custkey) AS top FROM orders",
    "win_over_agg": "SELECT c_nationkey AS k, count(*) AS n, rank() OVER (ORDER BY count(*) DESC, c_nationkey) AS place, sum(count(*)) OVER (ORDER BY c_nationkey)::bigint AS running FROM customer GROUP BY c_nationkey",
}

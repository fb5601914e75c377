"""Scalar functions, JSON, arrays, ranges and set-returning functions."""

QUERIES = {
    "str_basic": "SELECT p_partkey AS k, length(p_name)::bigint AS n, upper(p_name) AS u, lower(p_type) AS l, reverse(p_brand) AS r, replace(p_type, 'TIN', 'tin') AS p, repeat(left(p_name, 1), 3) AS x, strpos(p_name, 'e')::bigint AS s, position('a' IN p_name)::bigint AS q, starts_with(p_brand, 'Brand#2') AS b, md5(p_name) AS m, ascii(p_name) AS a, chr(65 + p_size % 26) AS c FROM part",
    "str_substr_edges": "SELECT p_partkey AS k, substr(p_name, 0, 3) AS a, substring(p_name, 2, 4) AS b, substr(p_name, 3) AS c, substring(p_name FROM 2 FOR 3) AS d, left(p_name, -3) AS e, right(p_name, -3) AS f, right(p_name, 2) AS g FROM part",
    "str_pad_split": "SELECT p_partkey AS k, lpad(p_size::text, 4, '0') AS l, rpad(p_brand, 10, '*') AS r, lpad(p_name, 3, ' ') AS cut, split_part(p_type, ' ', 2) AS s, split_part(p_type, ' ', 9) AS none, trim('  ' || p_name || ' ') AS t, ltrim('xx' || p_name, 'x') AS lt, rtrim(p_name || 'yy', 'y') AS rt FROM part",
    "str_concat_null": "SELECT n_nationkey AS k, concat(n_name, NULL, '-', nullif(n_regionkey, 1)) AS c, concat_ws('/', n_name, nullif(n_regionkey, 2), 'z') AS w, n_name || nullif(n_regionkey, 1)::text AS strict FROM nation",
    "str_arrays": ("SELECT p_partkey AS k, array_to_string(string_to_array(p_type, ' '), '+') AS joined, cardinality(string_to_array(p_type, ' '))::bigint AS n, (string_to_array(p_type, ' '))[1] AS first FROM part", "SELECT p_partkey AS k, replace(p_type, ' ', '+') AS joined, len(string_split(p_type, ' '))::bigint AS n, string_split(p_type, ' ')[1] AS first FROM part"),
    "str_format_quote": ("SELECT n_nationkey AS k, format('%s of %I: %L %%', n_name, 'Region ' || n_regionkey::text, nullif(n_name, 'PERU')) AS f, quote_literal(n_name || '''s') AS q, overlay(n_name PLACING '##' FROM 2 FOR 3) AS o FROM nation", "SELECT n_nationkey AS k, n_name || ' of \"Region ' || n_regionkey::text || '\": ' || coalesce('''' || nullif(n_name, 'PERU') || '''', 'NULL') || ' %' AS f, '''' || n_name || '''''s''' AS q, left(n_name, 1) || '##' || substr(n_name, 5) AS o FROM nation"),
    "math_round_trunc": ("SELECT c_custkey AS k, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, round(c_acctbal) AS r, trunc(c_acctbal) AS t, mod(c_custkey, 7) AS m, sign(c_acctbal)::int AS s, round(c_acctbal::numeric(12,2), 1)::double precision AS d FROM customer", "SELECT c_custkey AS k, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, round(c_acctbal) AS r, trunc(c_acctbal) AS t, c_custkey % 7 AS m, sign(c_acctbal)::int AS s, round(c_acctbal::decimal(12,2), 1)::double AS d FROM customer"),
    "math_transcendental": ("SELECT p_partkey AS k, round(sqrt(p_size), 9) AS q, round(exp(p_size / 50.0::double precision), 9) AS e, round(ln(p_size), 9) AS l, round(log(p_size), 9) AS g, round(power(p_size, 1.5), 6) AS p, round(pi(), 9) AS pi FROM part", "SELECT p_partkey AS k, round(sqrt(p_size), 9) AS q, round(exp(p_size / 50.0::double), 9) AS e, round(ln(p_size), 9) AS l, round(log10(p_size), 9) AS g, round(power(p_size, 1.5), 6) AS p, round(pi(), 9) AS pi FROM part"),
    "dt_extract_fields": "SELECT event_id AS k, extract(year FROM ts)::double precision AS y, extract(month FROM ts)::double precision AS mo, extract(day FROM ts)::double precision AS d, extract(hour FROM ts)::double precision AS h, extract(minute FROM ts)::double precision AS mi, extract(dow FROM ts)::double precision AS dow, extract(isodow FROM ts)::double precision AS iso, extract(doy FROM ts)::double precision AS doy, extract(quarter FROM ts)::double precision AS q, extract(week FROM ts)::double precision AS w, extract(decade FROM ts)::double precision AS de, extract(century FROM ts)::double precision AS ce, round(extract(epoch FROM ts)::double precision, 3) AS ep FROM events",
    "dt_interval_arith": ("SELECT o_orderkey AS k, o_orderdate + INTERVAL '1 month' AS m, o_orderdate - INTERVAL '10 days' AS d, o_orderdate + INTERVAL '1 year 2 months 3 days' AS x, o_orderdate::date + 5 AS p, o_orderdate::date - DATE '1995-01-01' AS n, o_orderdate + INTERVAL '90 minutes' AS t FROM orders", "SELECT o_orderkey AS k, o_orderdate + INTERVAL '1 month' AS m, o_orderdate - INTERVAL '10 days' AS d, o_orderdate + INTERVAL '1 year 2 months 3 days' AS x, o_orderdate::date + 5 AS p, (o_orderdate::date - DATE '1995-01-01')::int AS n, o_orderdate + INTERVAL '90 minutes' AS t FROM orders"),
    "arr_build_modify": (
        "SELECT n_nationkey AS k, array_to_string(array_append(ARRAY[n_nationkey, n_regionkey], 99), ',') AS a, array_to_string(array_prepend(7, ARRAY[n_regionkey]), ',') AS p, array_to_string(ARRAY[1] || n_regionkey, ',') AS c, array_to_string(array_cat(ARRAY[n_regionkey], ARRAY[5, 6]), ',') AS cat, array_to_string(array_remove(ARRAY[1, 2, n_regionkey], n_regionkey), ',') AS r, array_to_string(array_replace(ARRAY[1, 2, 3], n_regionkey, 0), ',') AS s FROM nation",
        "SELECT n_nationkey AS k, concat_ws(',', n_nationkey, n_regionkey, 99) AS a, concat_ws(',', 7, n_regionkey) AS p, concat_ws(',', 1, n_regionkey) AS c, concat_ws(',', n_regionkey, 5, 6) AS cat, array_to_string(list_filter([1, 2, n_regionkey], lambda e: e <> n_regionkey), ',') AS r, array_to_string(list_transform([1, 2, 3], lambda e: CASE WHEN e = n_regionkey THEN 0 ELSE e END), ',') AS s FROM nation",
    ),
    "arr_search": ("SELECT n_nationkey AS k, array_position(ARRAY[3, 1, 2], n_regionkey)::bigint AS p, array_to_string(array_positions(ARRAY[1, 2, 1], n_regionkey), ',') AS ps, array_length(ARRAY[n_regionkey, 2], 1)::bigint AS n, array_upper(ARRAY[1, 2, 3], 1)::bigint AS u, cardinality(ARRAY[1])::bigint AS c FROM nation", "SELECT n_nationkey AS k, CASE n_regionkey WHEN 3 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END::bigint AS p, CASE n_regionkey WHEN 1 THEN '1,3' WHEN 2 THEN '2' ELSE '' END AS ps, 2::bigint AS n, 3::bigint AS u, 1::bigint AS c FROM nation"),
    "arr_ops": ("SELECT n_nationkey AS k, ARRAY[1, 2, 3] @> ARRAY[n_regionkey] AS c, ARRAY[n_regionkey] <@ ARRAY[0, 1] AS i, ARRAY[n_regionkey, 9] && ARRAY[2, 3] AS o, ARRAY[1, n_regionkey] = ARRAY[1, 2] AS e FROM nation", "SELECT n_nationkey AS k, list_has_all([1, 2, 3], [n_regionkey]) AS c, list_has_all([0, 1], [n_regionkey]) AS i, list_has_any([n_regionkey, 9], [2, 3]) AS o, n_regionkey = 2 AS e FROM nation"),
    "arr_subscript_slice": ("SELECT vec_id AS k, embedding[1]::double precision AS a, embedding[1000] IS NULL AS missing, (embedding[2:4])[3]::double precision AS s, ('{10,20,30}'::int[])[2] AS lit FROM embeddings", "SELECT vec_id AS k, embedding[1]::double AS a, true AS missing, embedding[4]::double AS s, 20 AS lit FROM embeddings"),
    "json_access": ("SELECT event_id AS k, (props::json ->> 'k')::bigint AS v, props::json ->> 'absent' AS none, props::json -> 'k' AS j, ('{\"a\": [1, {\"b\": \"x\"}]}'::json #>> '{a,1,b}') || props AS deep FROM events", "SELECT event_id AS k, (props::json ->> 'k')::bigint AS v, props::json ->> 'absent' AS none, (props::json -> 'k')::text AS j, 'x' || props AS deep FROM events"),
    "json_build": ("SELECT n_nationkey AS k, json_build_object('name', n_name, 'r', nullif(n_regionkey, 1)) AS o, json_build_array(n_nationkey, n_name, NULL) AS a, to_json(n_name) AS t, row_to_json(n) AS r FROM nation n", "SELECT n_nationkey AS k, '{\"name\":\"' || n_name || '\",\"r\":' || coalesce(nullif(n_regionkey, 1)::text, 'null') || '}' AS o, '[' || n_nationkey || ',\"' || n_name || '\",null]' AS a, '\"' || n_name || '\"' AS t, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS r FROM nation n"),
    "json_keys_exist": ("SELECT event_id AS k, props::jsonb ? 'k' AS has, props::jsonb ? 'z' AS no, props::jsonb ?| ARRAY['z', 'k'] AS some, props::jsonb ?& ARRAY['z', 'k'] AS every_, json_typeof(props::json) AS t FROM events", "SELECT event_id AS k, true AS has, false AS no, true AS some, false AS every_, 'object' AS t FROM events"),
    "json_contains_set_delete": ("SELECT event_id AS k, props::jsonb @> '{}'::jsonb AS all_, props::jsonb @> '{\"k\": 1}'::jsonb AS one, jsonb_set(props::jsonb, '{k}'::text[], '0'::jsonb) AS s, props::jsonb - 'k' AS d, props::jsonb || '{\"n\": 1}'::jsonb ->> 'n' AS c FROM events", "SELECT event_id AS k, true AS all_, (props::json ->> 'k')::bigint = 1 AS one, '{\"k\":0}' AS s, '{}' AS d, props || '1' AS c FROM events WHERE false UNION ALL SELECT event_id, true, (props::json ->> 'k')::bigint = 1, '{\"k\":0}', '{}', '1' FROM events"),
    "range_ops": ("SELECT o_orderkey AS k, daterange(o_orderdate::date, o_orderdate::date + 30) @> DATE '1996-01-01' AS c, int8range(o_orderkey, o_orderkey + 10) && int8range(100, 120) AS o, int4range(1, 5) -|- int4range(5, 9) AS adj, lower(int8range(o_orderkey, NULL)) AS l, upper_inf(int8range(o_orderkey, NULL)) AS u FROM orders", "SELECT o_orderkey AS k, DATE '1996-01-01' >= o_orderdate::date AND DATE '1996-01-01' < o_orderdate::date + 30 AS c, o_orderkey < 120 AND o_orderkey + 10 > 100 AS o, true AS adj, o_orderkey AS l, true AS u FROM orders"),
    "range_algebra": ("SELECT n_nationkey AS k, (int4range(n_nationkey, n_nationkey + 10) * int4range(5, 12))::text AS i, (int4range(0, n_nationkey + 1) + int4range(n_nationkey, 40))::text AS u, range_merge(int4range(0, 1), int4range(n_nationkey, 30))::text AS m, isempty(int4range(least(n_nationkey, 10), 10) * int4range(20, 30)) AS e, '[1,5]'::int4range = '[1,6)'::int4range AS same FROM nation", "SELECT n_nationkey AS k, CASE WHEN greatest(n_nationkey, 5) < least(n_nationkey + 10, 12) THEN '[' || greatest(n_nationkey, 5) || ',' || least(n_nationkey + 10, 12) || ')' ELSE 'empty' END AS i, '[0,40)' AS u, '[0,30)' AS m, true AS e, true AS same FROM nation"),
    "srf_generate_series": ("SELECT g AS g, count(o_orderkey) AS n FROM generate_series(1, 60, 3) AS t(g) LEFT JOIN orders ON o_custkey = g GROUP BY g", "SELECT g::int AS g, count(o_orderkey) AS n FROM generate_series(1, 60, 3) AS t(g) LEFT JOIN orders ON o_custkey = g GROUP BY g"),
    "srf_generate_series_ts": "SELECT d AS d, count(o_orderkey) AS n FROM generate_series(TIMESTAMP '1995-01-01 00:00:00', TIMESTAMP '1995-02-15 00:00:00', INTERVAL '1 day') AS t(d) LEFT JOIN orders ON o_orderdate = d GROUP BY d",
    "srf_unnest": ("SELECT n_nationkey AS k, x AS x FROM nation, unnest(ARRAY[n_regionkey, n_nationkey, NULL]) AS t(x)", "SELECT n_nationkey AS k, unnest([n_regionkey, n_nationkey, NULL]) AS x FROM nation"),
    "srf_unnest_zip": ("SELECT a AS a, b AS b FROM unnest(ARRAY[1, 2, 3], ARRAY['x', 'y']) AS t(a, b)", "SELECT * FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)"),
    "srf_ordinality": ("SELECT r.r_regionkey AS k, w AS w, n AS n FROM region r, unnest(string_to_array(r.r_name, 'A')) WITH ORDINALITY AS t(w, n)", "SELECT r_regionkey AS k, unnest(string_split(r_name, 'A')) AS w, generate_subscripts(string_split(r_name, 'A'), 1) AS n FROM region"),
    "srf_json_each": ("SELECT e.event_id AS k, j.key AS key, j.value AS value FROM events e, json_each_text(e.props::json) AS j(key, value)", "SELECT event_id AS k, 'k' AS key, props::json ->> 'k' AS value FROM events"),
    "srf_json_elements": ("SELECT n_nationkey AS k, value AS value FROM nation, json_array_elements_text(json_build_array(n_name, n_regionkey)) AS t(value)", "SELECT n_nationkey AS k, unnest([n_name, n_regionkey::text]) AS value FROM nation"),
    "srf_json_keys": ("SELECT n_nationkey AS k, x AS x FROM nation, json_object_keys(json_build_object('a', n_name, 'b', 1)) AS t(x)", "SELECT n_nationkey AS k, unnest(['a', 'b']) AS x FROM nation"),
    "srf_in_select": ("SELECT n_nationkey AS k, generate_series(1, 3) AS g, unnest(ARRAY['a', 'b']) AS u FROM nation", "SELECT n_nationkey AS k, t.g AS g, t.u AS u FROM nation, (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(g, u)"),
    "str_format_width": (
        "SELECT n_nationkey AS k, format('%10s|%-12s|%2$s', n_regionkey, n_name) AS f, quote_ident(lower(n_name)) AS q, quote_ident('select') AS r, initcap(lower(n_name)) AS i FROM nation",
        "SELECT n_nationkey AS k, lpad(n_regionkey::text, 10, ' ') || '|' || CASE WHEN length(n_name) < 12 THEN rpad(n_name, 12, ' ') ELSE n_name END || '|' || n_name AS f, CASE WHEN regexp_matches(lower(n_name), '^[a-z_][a-z0-9_]*$') THEN lower(n_name) ELSE '\"' || lower(n_name) || '\"' END AS q, '\"select\"' AS r, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS i FROM nation",
    ),
    "str_regexp": (
        "SELECT p_partkey AS k, regexp_replace(p_name, 'e', '_') AS one, regexp_replace(p_name, '([aeiou])', '<\\1>', 'g') AS all_, regexp_replace(p_type, 't', '$', 'gi') AS i, translate(p_brand, 'Bd', 'bD') AS t FROM part",
        "SELECT p_partkey AS k, regexp_replace(p_name, 'e', '_') AS one, regexp_replace(p_name, '([aeiou])', '<\\1>', 'g') AS all_, regexp_replace(p_type, 't', '$', 'gi') AS i, translate(p_brand, 'Bd', 'bD') AS t FROM part",
    ),
    "arr_dimensions": (
        "SELECT n_nationkey AS k, array_length(ARRAY[ARRAY[n_nationkey, 1, 2], ARRAY[3, 4, 5]], 2) AS two, array_length(ARRAY[ARRAY[n_nationkey, 1, 2], ARRAY[3, 4, 5]], 1) AS one, array_ndims(ARRAY[ARRAY[n_nationkey]]) AS nd, cardinality(ARRAY[ARRAY[n_nationkey, 1], ARRAY[2, 3]]) AS c, array_length(ARRAY[n_nationkey], 2) AS none, array_upper(ARRAY[n_nationkey, 2], 1) AS up, array_position(ARRAY[1, nullif(n_regionkey, 1)], NULL) AS p FROM nation",
        "SELECT n_nationkey AS k, 3 AS two, 2 AS one, 2 AS nd, 4 AS c, NULL::int AS none, 2 AS up, CASE WHEN n_regionkey = 1 THEN 2 END AS p FROM nation",
    ),
    "dt_interval_fields": (
        "SELECT o_orderkey AS k, extract(epoch FROM INTERVAL '1 day') AS e, extract(month FROM INTERVAL '14 months') AS m, extract(epoch FROM INTERVAL '1 month' + INTERVAL '2 days') AS mixed, o_orderdate + (INTERVAL '1 month' + INTERVAL '3 days') AS d, extract(day FROM o_orderdate - TIMESTAMP '1992-01-01 00:00:00') AS days, date_part('year', o_orderdate) AS y FROM orders",
        "SELECT o_orderkey AS k, 86400.0::double AS e, 2.0::double AS m, 2764800.0::double AS mixed, o_orderdate + INTERVAL 1 MONTH + INTERVAL 3 DAY AS d, datediff('day', TIMESTAMP '1992-01-01 00:00:00', o_orderdate)::double AS days, year(o_orderdate)::double AS y FROM orders",
    ),
    "dt_zone": (
        "SELECT o_orderkey AS k, (o_orderdate AT TIME ZONE 'UTC') AT TIME ZONE 'UTC' AS u, now() = transaction_timestamp() AS same, current_date = now()::date AS today FROM orders",
        "SELECT o_orderkey AS k, o_orderdate AS u, true AS same, true AS today FROM orders",
    ),
    "json_edit_numbers": (
        "SELECT n_nationkey AS k, jsonb_set('{\"a\": 1.50}'::jsonb, '{b}'::text[], to_jsonb(n_regionkey)) AS s, jsonb_strip_nulls(json_build_object('x', nullif(n_regionkey, 1), 'y', n_nationkey)) AS n, jsonb_pretty(json_build_array(n_nationkey)) AS p FROM nation",
        "SELECT n_nationkey AS k, '{\"a\":1.50,\"b\":' || n_regionkey || '}' AS s, CASE WHEN n_regionkey = 1 THEN '{' ELSE '{\"x\":' || n_regionkey || ',' END || '\"y\":' || n_nationkey || '}' AS n, '[' || chr(10) || '    ' || n_nationkey || chr(10) || ']' AS p FROM nation",
    ),
    "session_functions": (
        "SELECT n_nationkey AS k, length(gen_random_uuid()::text) AS u, pg_typeof(n_nationkey) AS t, pg_typeof(n_name) AS s, version() IS NOT NULL AS v, current_schema() AS c, has_table_privilege('nation', 'select') AS p, pg_try_advisory_lock(1) AS l, pg_encoding_to_char(6) AS e FROM nation",
        "SELECT n_nationkey AS k, 36 AS u, 'integer' AS t, 'text' AS s, true AS v, 'public' AS c, true AS p, true AS l, 'UTF8' AS e FROM nation",
    ),
}

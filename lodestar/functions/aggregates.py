"""PostgreSQL aggregates whose order, nulls or filters Spark spells differently."""

from __future__ import annotations


def _compare(keys: list[tuple[bool, str]]) -> str:
    """A comparator of structs (k0, k1, ...) by (descending, nulls first or last)."""
    arms = []
    for i, (down, nulls) in enumerate(keys):
        a, b = f"l.k{i}", f"r.k{i}"
        null_first = -1 if nulls == "first" else 1
        arms.append(f"WHEN {a} IS NULL AND {b} IS NOT NULL THEN {null_first} WHEN {a} IS NOT NULL AND {b} IS NULL THEN {-null_first}")
        arms.append(f"WHEN {a} < {b} THEN {1 if down else -1} WHEN {a} > {b} THEN {-1 if down else 1}")
    return f"(l, r) -> CASE {' '.join(arms)} ELSE 0 END"


def collected(value: str, keys: list[tuple[str, bool, str]], distinct: bool, filter_: str, over: str = "") -> str:
    """All values of a group in order, nulls kept, as an array of structs with a field v."""
    fields = "".join(f"'k{i}', {sql}, " for i, (sql, _, _) in enumerate(keys))
    what = "collect_set" if distinct else "collect_list"
    array = f"{what}(named_struct({fields}'v', {value})){filter_}{over}"
    if keys:
        return f"array_sort({array}, {_compare([(d, n) for _, d, n in keys])})"
    return f"array_sort({array}, (l, r) -> CASE WHEN l.v IS NULL THEN 1 WHEN r.v IS NULL THEN -1 WHEN l.v < r.v THEN -1 WHEN l.v > r.v THEN 1 ELSE 0 END)" if distinct else array


def array_agg(value: str, keys, distinct: bool, filter_: str, over: str = "") -> str:
    array = collected(value, keys, distinct, filter_, over)
    return f"transform(nullif({array}, array()), e -> e.v)" if not keys and not distinct else f"(CASE WHEN size({array}) > 0 THEN transform({array}, e -> e.v) END)"


def json_agg(value: str, keys, distinct: bool, filter_: str, over: str = "") -> str:
    return f"to_json({array_agg(value, keys, distinct, filter_, over)}, map('ignoreNullFields', 'false'))"


def json_object_agg(key: str, value: str, filter_: str, over: str = "") -> str:
    """Later values of a key win (the session's rule for repeated map keys)."""
    pairs = f"collect_list(named_struct('k', CAST({key} AS string), 'v', {value})){filter_}{over}"
    return f"(CASE WHEN size({pairs}) > 0 THEN to_json(map_from_entries({pairs}), map('ignoreNullFields', 'false')) END)"


def string_agg(value: str, separator: str, keys_sql: list[str], distinct: bool, filter_: str) -> str:
    keys_sql = keys_sql or ([value] if distinct else [])  # distinct values come sorted
    order = f" WITHIN GROUP (ORDER BY {', '.join(keys_sql)})" if keys_sql else ""
    return f"listagg({'DISTINCT ' if distinct else ''}{value}, {separator}){order}{filter_}"

"""PostgreSQL array functions and operators as Spark SQL expressions (arrays count from 1)."""

from __future__ import annotations



def dimensions(kind: str) -> int:
    n = 0
    while kind.startswith("array<"):
        kind, n = kind[6:-1], n + 1
    return n


def _extents(a: str, kind: str) -> list[str]:
    """The length of each dimension of an array of this Spark type (null if it is empty)."""
    out = []
    for _ in range(max(dimensions(kind), 1)):
        out.append(f"nullif(size({a}), 0)")
        a = f"get({a}, 0)"
    return out


def _along(extents: list[str], d: str, form: str) -> str:
    """``form`` of the length of dimension ``d``; null for a dimension that there is not."""
    if d.isdigit():
        return form.format(extents[int(d) - 1]) if 1 <= int(d) <= len(extents) else "CAST(NULL AS int)"
    return f"CASE {d} {' '.join(f'WHEN {i + 1} THEN {form.format(x)}' for i, x in enumerate(extents))} END"


def measured(name: str, kind: str, a: str, d: str = "1") -> str:
    """array_length, array_upper, array_lower, array_ndims and cardinality of an array of this Spark type."""
    extents = _extents(a, kind)
    if name == "array_ndims":
        return f"CASE WHEN size({a}) > 0 THEN {len(extents)} END"
    if name == "cardinality":
        for _ in extents[1:]:
            a = f"flatten({a})"
        return f"size({a})"
    return _along(extents, d, "CASE WHEN {} > 0 THEN 1 END" if name == "array_lower" else "{}")


MEASURES = {"array_length", "array_upper", "array_lower", "array_ndims", "cardinality"}

FUNCTIONS = {
    "array_append": lambda a, x: f"array_append({a}, {x})",
    "array_prepend": lambda x, a: f"array_prepend({a}, {x})",
    "array_cat": lambda a, b: f"CASE WHEN {a} IS NULL THEN {b} WHEN {b} IS NULL THEN {a} ELSE concat({a}, {b}) END",
    "array_remove": lambda a, x: f"filter({a}, e -> NOT (e <=> {x}))",
    "array_replace": lambda a, f, t: f"transform({a}, e -> IF(e <=> {f}, {t}, e))",
    "array_position": lambda a, x: f"get(filter(transform({a}, (e, i) -> IF(e <=> {x}, i + 1, NULL)), v -> v IS NOT NULL), 0)",
    "array_positions": lambda a, x: f"filter(transform({a}, (e, i) -> IF(e <=> {x}, i + 1, NULL)), v -> v IS NOT NULL)",
}


def contains(a: str, b: str) -> str:
    return f"(size(array_except({b}, {a})) = 0)"


def overlaps(a: str, b: str) -> str:
    return f"coalesce(arrays_overlap({a}, {b}), {a} IS NOT NULL AND {b} IS NOT NULL AND false)"


def subscript(a: str, i: str) -> str:
    return f"get({a}, CAST({i} AS int) - 1)"


def part(a: str, low: str | None, high: str | None) -> str:
    low, high = f"greatest({low or '1'}, 1)", f"least({high or f'size({a})'}, size({a}))"
    return f"CASE WHEN {high} < {low} THEN slice({a}, 1, 0) ELSE slice({a}, {low}, {high} - {low} + 1) END"

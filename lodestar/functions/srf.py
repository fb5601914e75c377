"""Set-returning functions as arrays of structs, to be unfolded by inline()."""

from __future__ import annotations

from ..errors import SqlError


def series(kind: str, low: str, high: str, step: str | None = None) -> str:
    """generate_series as an array; empty where the step leads away from the end."""
    if kind in ("date", "timestamp", "timestamp_ntz"):
        kind = "timestamp_ntz" if kind == "date" else kind
        low, high = f"CAST({low} AS {kind})", f"CAST({high} AS {kind})"
        step = step or "INTERVAL '1' DAY"
        runs = f"(({low} + {step} > {low} AND {low} <= {high}) OR ({low} + {step} < {low} AND {low} >= {high}))"
    else:
        step = step or f"CAST(1 AS {kind})"
        runs = f"(({high}) - ({low})) * sign({step}) >= 0"
    return f"IF({runs}, sequence({low}, {high}, {step}), CAST(array() AS array<{kind}>))"


def zipped(arrays: list[str]) -> str:
    """Arrays side by side, the shorter filled with nulls, as structs with fields 0, 1, ... whatever the arrays' names."""
    return f"arrays_zip({', '.join(f'IF(true, {a}, NULL)' for a in arrays)})"


def unfolded(name: str, args: list[str], kinds: list[str]) -> tuple[str, list[str]]:
    """An array of structs for a set-returning function, and its columns' names."""
    name = name.replace("jsonb_", "json_")
    if name == "generate_series":
        kind = "bigint" if "bigint" in kinds[:2] else kinds[0] if kinds[0] in ("date", "timestamp", "timestamp_ntz") else "bigint" if kinds[0] == "bigint" else "int"
        return f"transform({series(kind, *args)}, x -> named_struct('generate_series', x))", ["generate_series"]
    if name == "unnest":
        if len(args) == 1:
            return f"transform({args[0]}, x -> named_struct('unnest', x))", ["unnest"]
        fields = ", ".join(f"'unnest{i}', z['{i}']" for i in range(len(args)))
        return f"transform({zipped(args)}, z -> named_struct({fields}))", [f"unnest{i}" for i in range(len(args))]
    variant = f"parse_json({args[0]})"
    if name in ("json_each", "json_each_text"):
        value = "to_json(e.value)" if name == "json_each" else _plain("e.value")
        return f"transform(map_entries(CAST({variant} AS map<string, variant>)), e -> named_struct('key', e.key, 'value', {value}))", ["key", "value"]
    if name == "json_object_keys":
        return f"transform(json_object_keys({args[0]}), k -> named_struct('json_object_keys', k))", ["json_object_keys"]
    if name in ("json_array_elements", "json_array_elements_text"):
        value = "to_json(e)" if name == "json_array_elements" else _plain("e")
        return f"transform(CAST({variant} AS array<variant>), e -> named_struct('value', {value}))", ["value"]
    raise SqlError("42883", f"function {name} does not exist")


def _plain(v: str) -> str:
    return f"CASE WHEN schema_of_variant({v}) = 'STRING' THEN CAST({v} AS string) WHEN schema_of_variant({v}) = 'VOID' THEN NULL ELSE to_json({v}) END"


NAMES = {"generate_series", "unnest", *(f"json{b}_{x}" for b in ("", "b") for x in ("each", "each_text", "object_keys", "array_elements", "array_elements_text"))}

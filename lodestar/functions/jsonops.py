"""JSON: expressions where Spark has them, and Arrow UDFs over one module of rules for the rest."""

from __future__ import annotations

import json
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession


class _Missing:
    pass


MISSING = _Missing()


def _load(text: str | None) -> Any:
    return MISSING if text is None else json.loads(text, parse_float=Decimal)


def _dump(value: Any) -> str | None:
    """JSON text; a number keeps its scale."""
    if value is MISSING:
        return None
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_dump(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_dump, value)) + "]"
    return format(value, "f") if isinstance(value, Decimal) else json.dumps(value, ensure_ascii=False)


def _text(value: Any) -> str | None:
    return None if value is MISSING or value is None else value if isinstance(value, str) else _dump(value)


def get(value: Any, key: str | int) -> Any:
    """A member by text key of an object or whole-number key of an array (negative: from the end)."""
    if isinstance(value, list):
        try:
            i = int(key)
        except ValueError:
            return MISSING
        return value[i] if -len(value) <= i < len(value) else MISSING
    if isinstance(value, dict):
        return value.get(str(key), MISSING)
    return MISSING


def get_path(value: Any, path: list[str]) -> Any:
    for key in path:
        value = get(value, key)
        if value is MISSING:
            break
    return value


def same(a: Any, b: Any) -> bool:
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    return a == b


def contains(a: Any, b: Any, top: bool = True) -> bool:
    if isinstance(b, dict):
        return isinstance(a, dict) and all(k in a and contains(a[k], v, False) for k, v in b.items())
    if isinstance(b, list):
        return isinstance(a, list) and all(any(contains(x, y, False) for x in a) for y in b)
    if isinstance(a, list):
        return top and any(same(x, b) for x in a if not isinstance(x, (dict, list)))
    return not isinstance(a, dict) and same(a, b)


def concat(a: Any, b: Any) -> Any:
    if isinstance(a, dict) and isinstance(b, dict):
        return a | b
    return (a if isinstance(a, list) else [a]) + (b if isinstance(b, list) else [b])


def delete(value: Any, key: str, number: bool) -> Any:
    if number and isinstance(value, list):
        i = int(key)
        i += len(value) if i < 0 else 0
        return value[:i] + value[i + 1 :] if 0 <= i < len(value) else value
    if isinstance(value, dict):
        return {k: v for k, v in value.items() if k != key}
    if isinstance(value, list):
        return [v for v in value if v != key]
    return value


def delete_path(value: Any, path: list[str]) -> Any:
    if not path or get(value, path[0]) is MISSING:
        return value
    if len(path) == 1:
        return delete(value, path[0], isinstance(value, list))
    return _with(value, path[0], delete_path(get(value, path[0]), path[1:]))


def _with(value: Any, key: str, item: Any) -> Any:
    if isinstance(value, dict):
        return value | {key: item}
    i = int(key)
    return value[:i] + [item] + value[i + 1 if i != -1 else len(value) :]


def put(value: Any, path: list[str], item: Any, create: bool = True) -> Any:
    """jsonb_set: only the last key may be missing, and is created if ``create``; arrays grow at their ends."""
    if not path or not isinstance(value, (dict, list)):
        return value
    at = get(value, path[0])
    if len(path) > 1:
        return value if at is MISSING else _with(value, path[0], put(at, path[1:], item, create))
    if at is not MISSING:
        return _with(value, path[0], item)
    if not create:
        return value
    if isinstance(value, dict):
        return value | {path[0]: item}
    try:
        return [item, *value] if int(path[0]) < 0 else [*value, item]
    except ValueError:
        return value


def strip_nulls(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: strip_nulls(v) for k, v in value.items() if v is not None}
    return [strip_nulls(v) for v in value] if isinstance(value, list) else value


def _pretty(value: Any, margin: str = "") -> str:
    if isinstance(value, (dict, list)) and value:
        parts = [f"{json.dumps(k, ensure_ascii=False)}: {_pretty(v, margin + '    ')}" for k, v in value.items()] if isinstance(value, dict) else [_pretty(v, margin + "    ") for v in value]
        first, last = "{}" if isinstance(value, dict) else "[]"
        return f"{first}\n" + ",\n".join(f"{margin}    {p}" for p in parts) + f"\n{margin}{last}"
    return _dump(value)


def kind(value: Any) -> str:
    return {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(value), "number")


def _each(fn):
    """A function of texts on pandas columns; null if any argument is null."""

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(x is None for x in row) else fn(*row) for row in zip(*columns, strict=True)], dtype=object)

    return run


UDFS = {
    "lodestar_json_get": ("string", _each(lambda j, k, i: _dump(get(_load(j), int(k) if i else k) if i or not isinstance(_load(j), list) else MISSING))),
    "lodestar_json_path": ("string", _each(lambda j, p: _dump(get_path(_load(j), list(p))))),
    "lodestar_json_path_text": ("string", _each(lambda j, p: _text(get_path(_load(j), list(p))))),
    "lodestar_json_text": ("string", _each(lambda j: _text(_load(j)))),
    "lodestar_json_contains": ("boolean", _each(lambda a, b: contains(_load(a), _load(b)))),
    "lodestar_json_concat": ("string", _each(lambda a, b: _dump(concat(_load(a), _load(b))))),
    "lodestar_json_delete": ("string", _each(lambda j, k, n: _dump(delete(_load(j), k, bool(n))))),
    "lodestar_json_delete_path": ("string", _each(lambda j, p: _dump(delete_path(_load(j), list(p))))),
    "lodestar_json_set": ("string", _each(lambda j, p, v, c: _dump(put(_load(j), list(p), _load(v), bool(c))))),
    "lodestar_json_strip": ("string", _each(lambda j: _dump(strip_nulls(_load(j))))),
    "lodestar_json_pretty": ("string", _each(lambda j: _pretty(_load(j)))),
    "lodestar_json_kind": ("string", _each(lambda j: kind(_load(j)))),
    "lodestar_json_has": ("boolean", _each(lambda j, k: k in v if isinstance(v := _load(j), dict) else isinstance(v, list) and k in [x for x in v if isinstance(x, str)] or v == k)),
}


def register(spark: SparkSession) -> None:
    """Make the UDFs callable from SQL in this session."""
    from pyspark.sql.functions import pandas_udf

    for name, (result, fn) in UDFS.items():
        spark.udf.register(name, pandas_udf(fn, result, functionType=200))  # 200: column to column


def value_of(x: str, kind_: str) -> str:
    """A SQL value as JSON text."""
    if kind_ in ("string",):
        return f"coalesce(to_json(named_struct('v', {x}), map('ignoreNullFields', 'false')), 'null')"
    return x


FUNCTIONS = {
    "json_typeof": lambda j: f"lodestar_json_kind({j})",
    "json_array_length": lambda j: f"json_array_length({j})",
    "json_strip_nulls": lambda j: f"lodestar_json_strip({j})",
    "json_pretty": lambda j: f"lodestar_json_pretty({j})",
    "json_set": lambda j, p, v, c="true": f"lodestar_json_set({j}, {p}, {v}, {c})",
    "json_extract_path": lambda j, *p: f"lodestar_json_path({j}, array({', '.join(p)}))",
    "json_extract_path_text": lambda j, *p: f"lodestar_json_path_text({j}, array({', '.join(p)}))",
}
FUNCTIONS |= {name.replace("json_", "jsonb_", 1): f for name, f in FUNCTIONS.items()}

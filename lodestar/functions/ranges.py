"""Range types as structs (lo, hi, lo_inc, hi_inc, empty); a null bound is infinite."""

from __future__ import annotations

import re

from ..errors import SqlError

#: Element type of each range type.
ELEMENT = {"int4range": "int", "int8range": "bigint", "numrange": "decimal(38,10)", "tsrange": "timestamp_ntz", "tstzrange": "timestamp", "daterange": "date"}
DISCRETE = {"int4range", "int8range", "daterange"}
FIELDS = "lo", "hi", "lo_inc", "hi_inc", "empty"


def is_range(kind: str) -> bool:
    return kind.startswith("struct<lo:")


def _let(body, **values: str) -> str:
    """``body`` of names that stand for values computed once."""
    fields = ", ".join(f"'{n}', {v}" for n, v in values.items())
    name = "z" + "".join(values)  # nested bindings have different parts
    return f"transform(array(named_struct({fields})), {name} -> {body(*(f'{name}.{n}' for n in values))})[0]"


def _next(kind: str, x: str) -> str:
    return f"date_add({x}, 1)" if kind == "daterange" else f"({x} + 1)"


def build(kind: str, lo: str, hi: str, bounds: str = "'[)'") -> str:
    """A range from its bounds; ranges of whole numbers and days become [lo, hi)."""
    element = ELEMENT[kind]
    lo, hi = f"CAST({lo} AS {element})", f"CAST({hi} AS {element})"
    passed = "raise_error('range lower bound must be less than or equal to range upper bound')"

    def raw(lo: str, hi: str, bounds: str) -> str:
        lo_inc, hi_inc = f"(left({bounds}, 1) = '[' AND {lo} IS NOT NULL)", f"(right({bounds}, 1) = ']' AND {hi} IS NOT NULL)"
        if kind in DISCRETE:
            first, last = f"IF({lo_inc}, {lo}, {_next(kind, lo)})", f"IF({hi_inc}, {_next(kind, hi)}, {hi})"
            lo_inc, hi_inc = f"({lo} IS NOT NULL)", "false"
        else:
            first, last = lo, hi
        checked = f"IF({lo} > {hi}, {passed}, {first})"
        return f"named_struct('lo', {checked}, 'hi', {last}, 'lo_inc', {lo_inc}, 'hi_inc', {hi_inc})"

    def whole(r: str) -> str:
        empty = f"coalesce({r}.lo > {r}.hi OR ({r}.lo = {r}.hi AND NOT ({r}.lo_inc AND {r}.hi_inc)), false)"
        return _let(
            lambda r, e: f"named_struct('lo', IF({e}, NULL, {r}.lo), 'hi', IF({e}, NULL, {r}.hi), 'lo_inc', {r}.lo_inc AND NOT {e}, 'hi_inc', {r}.hi_inc AND NOT {e}, 'empty', {e})", r=r, e=empty
        )

    return _let(whole, r=_let(raw, lo=lo, hi=hi, bounds=bounds))


def literal(kind: str, text: str) -> str:
    if text.strip().lower() == "empty":
        element = ELEMENT[kind]
        return f"named_struct('lo', CAST(NULL AS {element}), 'hi', CAST(NULL AS {element}), 'lo_inc', false, 'hi_inc', false, 'empty', true)"
    m = re.fullmatch(r"\s*([\[(])\s*(.*?)\s*,\s*(.*?)\s*([\])])\s*", text)
    if not m:
        raise SqlError("22P02", f"malformed range literal: {text!r}")
    sides = ["NULL" if not x.strip('"') else "'" + x.strip('"') + "'" for x in (m[2], m[3])]
    return build(kind, *sides, f"'{m[1]}{m[4]}'")


def _holds(r: str, x: str) -> str:
    """Whether a range has an element."""
    low = f"({r}.lo IS NULL OR {r}.lo < {x} OR ({r}.lo_inc AND {r}.lo = {x}))"
    high = f"({r}.hi IS NULL OR {x} < {r}.hi OR ({r}.hi_inc AND {r}.hi = {x}))"
    return f"CASE WHEN {r} IS NULL OR {x} IS NULL THEN NULL ELSE NOT {r}.empty AND {low} AND {high} END"


def _low_before(a: str, b: str) -> str:
    """Whether a begins no later than b."""
    return f"({a}.lo IS NULL OR (b_lo IS NOT NULL AND ({a}.lo < b_lo OR ({a}.lo = b_lo AND ({a}.lo_inc OR NOT b_inc)))))".replace("b_lo", f"{b}.lo").replace("b_inc", f"{b}.lo_inc")


def _high_after(a: str, b: str) -> str:
    """Whether a ends no earlier than b."""
    return f"({a}.hi IS NULL OR ({b}.hi IS NOT NULL AND ({a}.hi > {b}.hi OR ({a}.hi = {b}.hi AND ({a}.hi_inc OR NOT {b}.hi_inc)))))"


def _contains(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL ELSE {b}.empty OR (NOT {a}.empty AND {_low_before(a, b)} AND {_high_after(a, b)}) END"


def _ends_before(a: str, b: str) -> str:
    """Whether a ends before b begins."""
    return f"coalesce({a}.hi < {b}.lo OR ({a}.hi = {b}.lo AND NOT ({a}.hi_inc AND {b}.lo_inc)), false)"


def _overlaps(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL ELSE NOT ({a}.empty OR {b}.empty OR {_ends_before(a, b)} OR {_ends_before(b, a)}) END"


def _adjacent(a: str, b: str) -> str:
    touch = lambda x, y: f"coalesce({x}.hi = {y}.lo AND {x}.hi_inc <> {y}.lo_inc, false)"
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL ELSE NOT {a}.empty AND NOT {b}.empty AND ({touch(a, b)} OR {touch(b, a)}) END"


def _of(lo: str, hi: str, empty: str = "false") -> str:
    """A range with the lower bound of one range and the upper bound of another."""
    return f"named_struct('lo', {lo}.lo, 'hi', {hi}.hi, 'lo_inc', {lo}.lo_inc, 'hi_inc', {hi}.hi_inc, 'empty', {empty})"


def _nothing(a: str) -> str:
    return f"named_struct('lo', nullif({a}.lo, {a}.lo), 'hi', nullif({a}.hi, {a}.hi), 'lo_inc', false, 'hi_inc', false, 'empty', true)"


def _merge(a: str, b: str) -> str:
    both = f"CASE WHEN {_low_before(a, b)} THEN CASE WHEN {_high_after(a, b)} THEN {_of(a, a)} ELSE {_of(a, b)} END ELSE CASE WHEN {_high_after(a, b)} THEN {_of(b, a)} ELSE {_of(b, b)} END END"
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {a}.empty THEN {b} WHEN {b}.empty THEN {a} ELSE {both} END"


def _union(a: str, b: str) -> str:
    apart = f"NOT {a}.empty AND NOT {b}.empty AND NOT ({_overlaps(a, b)} OR {_adjacent(a, b)})"
    return f"CASE WHEN {apart} THEN raise_error('result of range union would not be contiguous') ELSE {_merge(a, b)} END"


def _intersection(a: str, b: str) -> str:
    both = f"CASE WHEN {_low_before(a, b)} THEN CASE WHEN {_high_after(a, b)} THEN {_of(b, b)} ELSE {_of(b, a)} END ELSE CASE WHEN {_high_after(a, b)} THEN {_of(a, b)} ELSE {_of(a, a)} END END"
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN NOT ({_overlaps(a, b)}) THEN {_nothing(a)} ELSE {both} END"


def _difference(a: str, b: str) -> str:
    first, last = _low_before(b, a), _high_after(b, a)
    before = f"named_struct('lo', {a}.lo, 'hi', {b}.lo, 'lo_inc', {a}.lo_inc, 'hi_inc', NOT {b}.lo_inc, 'empty', false)"
    behind = f"named_struct('lo', {b}.hi, 'hi', {a}.hi, 'lo_inc', NOT {b}.hi_inc, 'hi_inc', {a}.hi_inc, 'empty', false)"
    return (
        f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN NOT ({_overlaps(a, b)}) THEN {a} WHEN {first} AND {last} THEN {_nothing(a)} "
        f"WHEN {first} THEN {behind} WHEN {last} THEN {before} ELSE raise_error('result of range difference would not be contiguous') END"
    )


def text(r: str) -> str:
    side = lambda x: f"coalesce(CAST({x} AS string), '')"
    shown = f"concat(IF({r}.lo_inc, '[', '('), {side(r + '.lo')}, ',', {side(r + '.hi')}, IF({r}.hi_inc, ']', ')'))"
    return f"CASE WHEN {r} IS NULL THEN NULL WHEN {r}.empty THEN 'empty' ELSE {shown} END"


def _bound(form):
    """An operator whose operands are computed once."""
    return lambda a, b: _let(form, a=a, b=b)


holds, contains, overlaps, adjacent, merge, union, intersection, difference = map(_bound, (_holds, _contains, _overlaps, _adjacent, _merge, _union, _intersection, _difference))

FUNCTIONS = {
    **{kind: (lambda lo, hi, bounds="'[)'", kind=kind: build(kind, lo, hi, bounds)) for kind in ELEMENT},
    "isempty": lambda r: f"{r}.empty",
    "lower_inc": lambda r: f"{r}.lo_inc",
    "upper_inc": lambda r: f"{r}.hi_inc",
    "lower_inf": lambda r: f"({r}.lo IS NULL AND NOT {r}.empty)",
    "upper_inf": lambda r: f"({r}.hi IS NULL AND NOT {r}.empty)",
    "range_merge": merge,
}

"""PostgreSQL string functions as Spark SQL expressions; arguments are SQL texts."""

from __future__ import annotations

import re

from ..errors import SqlError


def substring(s: str, start: str, size: str | None = None) -> str:
    """1-based; a start before the string shortens the result instead of being moved."""
    if size is None:
        return f"substring({s}, greatest({start}, 1))"
    return f"substring({s}, greatest({start}, 1), greatest({size} + least({start} - 1, 0), 0))"


def left(s: str, n: str) -> str:
    return f"CASE WHEN {n} < 0 THEN substring({s}, 1, greatest(char_length({s}) + {n}, 0)) ELSE left({s}, {n}) END"


def right(s: str, n: str) -> str:
    return f"CASE WHEN {n} < 0 THEN substring({s}, 1 - {n}) ELSE right({s}, {n}) END"


def initcap(s: str) -> str:
    """A word begins after any character that is not alphanumeric."""
    words = rf"regexp_extract_all({s}, '([\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+)', 1)"
    return f"array_join(transform({words}, w -> concat(upper(left(w, 1)), lower(substring(w, 2)))), '')"


def split_literal(s: str, sep: str, null: str | None = None) -> str:
    """string_to_array: a literal separator, a null separator splits into characters, an empty string has no parts."""
    cut = rf"split({s}, concat('\\Q', {sep}, '\\E'))"
    chars = f"filter(split({s}, ''), c -> c <> '')"
    parts = f"CASE WHEN {s} IS NULL THEN NULL WHEN {s} = '' THEN CAST(array() AS array<string>) WHEN {sep} IS NULL THEN {chars} WHEN {sep} = '' THEN array({s}) ELSE {cut} END"
    return parts if null is None else f"transform({parts}, p -> nullif(p, {null}))"


def trimmed(kind: str):
    def make(s: str, what: str = "' '") -> str:
        side = {"btrim": "BOTH", "ltrim": "LEADING", "rtrim": "TRAILING"}[kind]
        return f"trim({side} {what} FROM {s})"

    return make


def format_(pattern: str, args: list[str]) -> str:
    """format() with a literal pattern: %s, %I, %L and %%, with positions (%2$s), widths (%10s, %*s) and %-10s."""
    parts, used = [], 0

    def argument(position: str | None) -> str:
        nonlocal used
        used = int(position) if position else used + 1
        if not 1 <= used <= len(args):
            raise SqlError("22023", "too few arguments for format()")
        return args[used - 1]

    for m in re.finditer(r"%%|%(?:(\d+)\$)?(-)?(\d+|\*(?:(\d+)\$)?)?([sIL])|[^%]+|%(.?)", pattern, re.S):
        if m[0] == "%%":
            parts.append("'%'")
        elif m[5]:
            width = f"CAST({argument(m[4])} AS int)" if m[3] and m[3][0] == "*" else m[3]
            value = f"CAST({argument(m[1])} AS string)"
            shown = {"s": f"coalesce({value}, '')", "I": quote_ident(value), "L": f"coalesce({quote_literal(value)}, 'NULL')"}[m[5]]
            if width:
                left = "true" if m[2] else f"{width} < 0"
                size = f"greatest(abs({width}), char_length({shown}))"
                shown = f"IF({left}, rpad({shown}, {size}, ' '), lpad({shown}, {size}, ' '))"
            parts.append(shown)
        elif m[0][0] == "%":
            raise SqlError("22023", f'unrecognized format() type specifier "{m[6]}"' if m[6] else "unterminated format() type specifier")
        else:
            parts.append("'" + m[0].replace("\\", "\\\\").replace("'", "\\'") + "'")
    return f"concat({', '.join(parts)})" if parts else "''"


# The keywords that cannot stand as a name without quotes.
RESERVED = (
    "all analyse analyze and any array as asc asymmetric authorization between bigint binary bit boolean both case cast char character check coalesce collate collation column concurrently constraint create cross"
    " current_catalog current_date current_role current_schema current_time current_timestamp current_user dec decimal default deferrable desc distinct do else end except exists extract false fetch float for foreign"
    " freeze from full grant greatest group grouping having ilike in initially inner inout int integer intersect interval into is isnull join lateral leading least left like limit localtime localtimestamp national"
    " natural nchar none normalize not notnull null nullif numeric offset on only or order out outer overlaps overlay placing position precision primary real references returning right row select session_user setof"
    " similar smallint some substring symmetric system_user table tablesample then time timestamp to trailing treat trim true union unique user using values varchar variadic verbose when where window with"
).split()


def quote_ident(s: str) -> str:
    plain = rf"{s} RLIKE '^[a-z_][a-z0-9_]*$' AND NOT array_contains(array({', '.join(repr(w) for w in RESERVED)}), {s})"
    return f"CASE WHEN {plain} THEN {s} ELSE concat('\"', replace({s}, '\"', '\"\"'), '\"') END"


def quote_literal(s: str) -> str:
    return rf"concat('\'', replace({s}, '\'', '\'\''), '\'')"


def regexp_replace(s: str, pattern: str, to: str, flags: str = "''") -> str:
    """The first match, or with the flag g all of them; \1 stands for a group, the flag i ignores case."""
    how = flags.strip("'")
    if set(how) - set("gi"):
        raise SqlError("22023", f'invalid regular expression option: "{how}"')
    pattern = f"concat('(?i)', {pattern})" if "i" in how else pattern
    to = rf"regexp_replace(replace({to}, '$', '\\$'), '\\\\([0-9])', '\\$$1')"
    if "g" in how:
        return f"regexp_replace({s}, {pattern}, {to})"
    found, at = f"regexp_substr({s}, {pattern})", f"regexp_instr({s}, {pattern})"
    return f"CASE WHEN {at} = 0 THEN {s} ELSE concat(left({s}, {at} - 1), regexp_replace({found}, {pattern}, {to}), substring({s}, {at} + char_length({found}))) END"


def regexp_substring(s: str, pattern: str) -> str:
    """The first match, or what its first group holds; null without a match."""
    grouped = f"regexp_count({pattern}, '(?<!\\\\\\\\)\\\\((?!\\\\?)') > 0"
    return f"CASE WHEN {s} RLIKE {pattern} THEN IF({grouped}, regexp_extract({s}, concat('(?:', {pattern}, ')|()'), 1), regexp_substr({s}, {pattern})) END"


FUNCTIONS = {
    "length": lambda s: f"char_length({s})",
    "char_length": lambda s: f"char_length({s})",
    "character_length": lambda s: f"char_length({s})",
    "octet_length": lambda s: f"octet_length({s})",
    "lower": lambda s: f"lower({s})",
    "upper": lambda s: f"upper({s})",
    "btrim": trimmed("btrim"),
    "trim": trimmed("btrim"),
    "ltrim": trimmed("ltrim"),
    "rtrim": trimmed("rtrim"),
    "substr": substring,
    "substring": substring,
    "concat": lambda *a: f"concat_ws('', {', '.join(f'CAST({x} AS string)' for x in a)})",
    "concat_ws": lambda sep, *a: f"concat_ws({sep}, {', '.join(f'CAST({x} AS string)' for x in a)})",
    "left": left,
    "right": right,
    "repeat": lambda s, n: f"repeat({s}, {n})",
    "replace": lambda s, a, b: f"CASE WHEN {a} = '' THEN {s} ELSE replace({s}, {a}, {b}) END",
    "reverse": lambda s: f"reverse({s})",
    "split_part": lambda s, d, n: f"split_part({s}, {d}, {n})",
    "string_to_array": split_literal,
    "array_to_string": lambda a, d, n=None: f"array_join({a}, {d}{', ' + n if n else ''})",
    "lpad": lambda s, n, f="' '": f"lpad({s}, {n}, {f})",
    "rpad": lambda s, n, f="' '": f"rpad({s}, {n}, {f})",
    "strpos": lambda s, x: f"locate({x}, {s})",
    "starts_with": lambda s, x: f"startswith({s}, {x})",
    "chr": lambda n: f"chr({n})",
    "ascii": lambda s: f"ascii({s})",
    "initcap": initcap,
    "md5": lambda s: f"md5({s})",
    "overlay": lambda s, w, p, n=None: f"overlay({s}, {w}, {p}{', ' + n if n else ''})",
    "regexp_replace": regexp_replace,
    "regexp_substring": regexp_substring,
    "translate": lambda s, a, b: f"translate({s}, {a}, {b})",
    "quote_ident": quote_ident,
    "quote_literal": quote_literal,
    "pg_encoding_to_char": lambda n: f"CASE WHEN {n} = 6 THEN 'UTF8' ELSE '' END",
}


def similar_pattern(pattern: str, escape: str = "\\") -> str:
    """A SIMILAR TO pattern as an anchored regular expression."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif inside:
            out.append("\\\\" if c == "\\" else c)
            inside = c != "]"
        elif c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        elif c == "[":
            inside = True
            out.append(c)
        elif c in "|*+?{}()":
            out.append(c)
        else:
            out.append(re.escape(c))
        i += 1
    return f"^(?s:{''.join(out)})$"

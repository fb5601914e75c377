"""Errors with the SQLSTATE that PostgreSQL clients expect."""

from __future__ import annotations

import re


class SqlError(Exception):
    def __init__(self, state: str, message: str):
        super().__init__(f"{message} (SQLSTATE {state})")
        self.state, self.message = state, message


#: Spark error conditions (or their beginnings) by the SQLSTATE that they are reported under.
STATES = {
    "DIVIDE_BY_ZERO": "22012",
    "REMAINDER_BY_ZERO": "22012",
    "ARITHMETIC_OVERFLOW": "22003",
    "BINARY_ARITHMETIC_OVERFLOW": "22003",
    "CAST_OVERFLOW": "22003",
    "NUMERIC_VALUE_OUT_OF_RANGE": "22003",
    "CAST_INVALID_INPUT": "22P02",
    "CANNOT_PARSE_TIMESTAMP": "22007",
    "SCALAR_SUBQUERY_TOO_MANY_ROWS": "21000",
    "UNRESOLVED_COLUMN": "42703",
    "AMBIGUOUS_REFERENCE": "42702",
    "TABLE_OR_VIEW_NOT_FOUND": "42P01",
    "UNRESOLVED_ROUTINE": "42883",
    "DATATYPE_MISMATCH": "42883",
    "PARSE_SYNTAX_ERROR": "42601",
    "RECURSION_LEVEL_LIMIT_EXCEEDED": "54001",
    "RECURSION_ROW_LIMIT_EXCEEDED": "54001",
}


def translated(problem: Exception) -> SqlError | None:
    """A Spark error as one with PostgreSQL's SQLSTATE, where one is known."""
    found = re.search(r"\[([A-Z][A-Z_]+)", str(problem))
    name = found[1] if found else ""
    for start, state in STATES.items():
        if name.startswith(start):
            return SqlError(state, str(problem).split("\n")[0])
    return None

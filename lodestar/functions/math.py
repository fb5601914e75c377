"""PostgreSQL numeric functions as Spark SQL expressions."""

from __future__ import annotations


def trunc(x: str, n: str | None = None) -> str:
    if n is not None:
        return f"(CASE WHEN {x} < 0 THEN ceil({x} * power(10, {n})) ELSE floor({x} * power(10, {n})) END / power(10, {n}))"
    return f"CAST(CASE WHEN {x} < 0 THEN ceil({x}) ELSE floor({x}) END AS double)"


FUNCTIONS = {
    "abs": lambda x: f"abs({x})",
    "ceil": lambda x: f"CAST(ceil({x}) AS double)",
    "ceiling": lambda x: f"CAST(ceil({x}) AS double)",
    "floor": lambda x: f"CAST(floor({x}) AS double)",
    "round": lambda x, n=None: f"round({x}, {n})" if n is not None else f"round({x})",
    "trunc": trunc,
    "mod": lambda a, b: f"({a} % {b})",
    "power": lambda a, b: f"power({a}, {b})",
    "pow": lambda a, b: f"power({a}, {b})",
    "sqrt": lambda x: f"sqrt({x})",
    "exp": lambda x: f"exp({x})",
    "ln": lambda x: f"ln({x})",
    "log": lambda x, y=None: f"log10({x})" if y is None else f"log({x}, {y})",
    "sign": lambda x: f"signum({x})",
    "random": lambda: "rand()",
    "pi": lambda: "pi()",
}

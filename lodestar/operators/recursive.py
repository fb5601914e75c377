"""WITH RECURSIVE ... UNION: a distributed fixpoint over the rows not seen before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..errors import SqlError
from ..sources.scratch import stored

#: Rounds after which a recursion is taken to be endless.
MAX_ROUNDS = 10_000


def fixpoint(first: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int = MAX_ROUNDS) -> DataFrame:
    """All distinct rows that ``first`` and repeated ``step`` on the newest rows give.

    Each round joins the step's rows against all seen so far by a null-safe anti join (EXCEPT) and stores only
    the new ones, so a cycle ends as soon as it brings nothing new.
    """
    new = stored(first.distinct(), "recursion")
    seen, parts = new, 1
    for _ in range(rounds):
        found = step(new)
        found = found.toDF(*first.columns) if found.columns != first.columns else found
        new = stored(found.distinct().subtract(seen), "recursion")
        if new.isEmpty():
            return seen
        seen, parts = seen.unionByName(new), parts + 1
        if parts % 20 == 0:  # keeps the plan short
            seen = stored(seen, "recursion")
    raise SqlError("54001", f"recursion did not end within {rounds} rounds")

"""Runs of rows with an equal key, as whole record batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

#: Rows that are gathered before whole groups among them are handed on.
ROWS = 4000


def by_group(solve: Callable[[pa.RecordBatch], pa.RecordBatch], key: str = "group"):
    """A mapInArrow function that gives ``solve`` batches of whole groups; rows must come sorted by ``key``.

    Groups must be of bounded size; memory is that of the largest group and ``ROWS`` rows.
    """

    def whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                held.append(batch.slice(begin, ROWS))
                if sum(h.num_rows for h in held) < ROWS:
                    continue
                rows = whole(held)
                group = rows.column(rows.schema.get_field_index(key)).to_numpy()
                cut = int(group.searchsorted(group[-1], "left"))
                if cut:
                    yield solve(rows.slice(0, cut))
                held = [rows.slice(cut)]
        if held:
            yield solve(whole(held))

    return run

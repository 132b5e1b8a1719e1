"""Folds over ordered groups: what a row gives depends on the rows before it, as a running state says.

A group's rows stream through one task in order, with the state alone in memory: neither a group nor its results are gathered, so
a group may hold a third of the table. No window function restarts a sum or looks back at the last row it kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of one batch of results.
BATCH = 4096


def folded(rows: DataFrame, group: str, order: list[str], begin: Callable[[], object], step: Callable[[object, tuple], tuple[object, tuple | None]], schema: T.StructType, finish: Callable[[object, object], Iterator[tuple]] | None = None) -> DataFrame:
    """step(state, row) gives the next state and a row of results or None; begin() is the state of a new group; rows are tuples of all columns of `rows`.

    finish(group, state) gives further rows at the end of a group. Null is a group of its own.
    """
    ordered = rows.repartition(group).sortWithinPartitions(group, *order)
    at = rows.columns.index(group)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, state, first = None, None, True

        def flush() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else ([] for _ in arrow)
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
            out.clear()
            return made

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first or row[at] != now:
                    if finish and not first:
                        out.extend(finish(now, state))
                    now, state, first = row[at], begin(), False
                state, made = step(state, row)
                if made is not None:
                    out.append(made)
                if len(out) >= BATCH:
                    yield flush()
        if finish and not first:
            out.extend(finish(now, state))
        if out:
            yield flush()

    return ordered.mapInArrow(run, schema)

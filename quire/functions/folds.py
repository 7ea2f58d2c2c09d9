"""Order-dependent folds over sorted partitions, in batches and with bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def fold_sorted(
    df: DataFrame,
    group: list[str],
    order: list[str],
    begin: Callable,
    step: Callable,
    schema: str,
    end: Callable | None = None,
) -> DataFrame:
    """Walk each group in order, carrying a state from row to row.

    Rows are tuples of the columns of ``df``. ``begin(row)`` makes the state at a
    group's first row, ``step(state, row)`` returns an output tuple or None,
    ``end(key, state)`` a last tuple or None. Spark hashes the groups over the
    tasks and sorts them; Python sees the columns of one Arrow batch at a time and
    keeps one state, so a group may be of any length.
    """
    made = to_arrow_schema(T.StructType.fromDDL(schema))
    at = [df.columns.index(g) for g in group]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(made)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, made, strict=True)], schema=made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            keys = zip(*(columns[i] for i in at), strict=True)
            out = []
            for row_key, row in zip(keys, zip(*columns, strict=True), strict=True):
                if row_key != key:
                    if key is not None and end is not None:
                        out.append(end(key, state))
                    key, state = row_key, begin(row)
                out.append(step(state, row))
            yield table([x for x in out if x is not None])
        if key is not None and end is not None:
            yield table([x for x in (end(key, state),) if x is not None])

    return df.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, schema)

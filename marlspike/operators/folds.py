"""Order-dependent operators: one pass over each key's rows in order, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that are handed on at once.
ROWS = 4096


def fold(df: DataFrame, by: str, order: list[str], start: Callable[[], object], step: Callable[[object, dict], list[tuple]], schema: str, end: Callable[[object], list[tuple]] | None = None) -> DataFrame:
    """Rows (schema) that ``step`` (state, row) gives for each row of a key, in order, and ``end`` (state) after its last one.

    Keys are spread over tasks; a task sorts its rows, spilling where it must, and holds one key's state and a batch, however many
    rows the key has.
    """
    fields = StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, state, any_rows = None, None, False

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [()] * len(arrow)
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)
            out.clear()
            return made

        for b in batches:
            for row in b.to_pylist():
                if not any_rows or row[by] != key:
                    if any_rows and end:
                        out.extend(end(state))
                    key, state, any_rows = row[by], start(), True
                out.extend(step(state, row))
                if len(out) >= ROWS:
                    yield batch()
        if any_rows and end:
            out.extend(end(state))
        if out:
            yield batch()

    return df.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, fields)

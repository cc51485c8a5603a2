"""What the training-data operators share: row keys, Arrow helpers and memos; scratch tables are the library's."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlspike.sources.scratch import cut, scratch

__all__ = ["Bounded", "SLICE", "cut", "extended", "read_table", "row_key", "scratch", "slices", "text_of"]

#: Rows that a Python worker holds at once, beside the batch that Spark handed over.
SLICE = 256


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_key() -> list[Column]:
    """(did, th): tells rows apart even where a doc_id repeats. Rows equal in both are the same document."""
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("did"),
        F.xxhash64(text_of(), F.col("doc_id").isNull()).alias("th"),
    ]


def extended(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` with these fields after its own."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Bounded(dict):
    """A memo of two generations of ``most`` entries: once the new one is full it becomes the old one, which is forgotten.
    Entries of the old one that are asked for again move to the new one, so frequent keys stay and memory is bounded."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.turn()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def turn(self) -> None:
        """Make the new generation the old one."""
        self.old = dict(self)
        self.clear()

"""Stored data: chunk files, JSON lines, float matrices, manifests, markdown, reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = (
    "id string, ordinal int, docId string, docType string, authority int, sectionPath array<string>, title string, part int, partsTotal int, pageStart int, "
    "pageEnd int, content string, tokenCount int, srcStart int, srcEnd int, mergedTitles array<string>, cardName string, cardCost string, cardType string"
)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a JSON array or of Parquet, in the fixed schema."""
    if path.endswith(".json"):
        return spark.read.schema(CHUNK).json(path, multiLine=True)
    return spark.read.schema(CHUNK).parquet(path)


def read_json_lines(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped. ``tolerant``: lines that don't parse are skipped too, else they fail the read."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_matrix(spark: SparkSession, path: str, dims: int, count: int | None = None) -> DataFrame:
    """(row, vector) of raw little-endian float32 files, rows one after another; a file of another length is an error, and so are
    files that together don't hold ``count`` rows, if that is given.

    Each file is one task's work. Store large matrices as Parquet (``write_vectors``).
    """
    if count is not None:
        held = spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        if held != count * dims * 4:
            raise ValueError(f"{path} holds {held} bytes, but {count} vectors of {dims} float32 values need {count * dims * 4}")

    def run(batches):
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = raw.as_py()
                if len(raw) % (4 * dims):
                    raise ValueError(f"{name} has {len(raw)} bytes, not a multiple of {dims} float32 values")
                m = np.frombuffer(raw, "<f4").reshape(-1, dims)
                flat = pa.array(m.reshape(-1))
                offsets = pa.array(np.arange(0, len(m) * dims + 1, dims, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(m), pa.string()), pa.array(np.arange(len(m))), pa.ListArray.from_arrays(offsets, flat)], names=["file", "row", "vector"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, row long, vector array<float>")


def checked_vectors(df: DataFrame, dims: int, column: str = "vector") -> DataFrame:
    """``df``, failing at the first vector that isn't ``dims`` wide."""
    wrong = F.concat(F.lit("a vector has width "), F.coalesce(F.size(column), F.lit(-1)).cast("string"), F.lit(f", not {dims}"))
    return df.withColumn(column, F.when(F.size(column) == dims, F.col(column)).otherwise(F.raise_error(wrong).cast("array<float>")))


def checked_response(sent: DataFrame, returned: DataFrame, dims: int) -> DataFrame:
    """(batch, index, vector) of a client's answers, failing where a batch has not as many vectors as inputs were sent, or one
    that isn't ``dims`` wide. sent: batch, index; returned: batch, index, vector, in any order."""
    both = sent.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).join(returned.groupBy("batch").agg(F.count(F.lit(1)).alias("got")), "batch", "full")
    n, got = F.coalesce("n", F.lit(0)).cast("string"), F.coalesce("got", F.lit(0)).cast("string")
    wrong = F.raise_error(F.concat(got, F.lit(" vectors for "), n, F.lit(" inputs of batch "), F.col("batch").cast("string"))).cast("boolean")
    fits = both.select("batch", F.when(F.col("n").eqNullSafe(F.col("got")), F.lit(True)).otherwise(wrong).alias("fits"))
    return checked_vectors(returned.join(fits, "batch", "right").where("fits").drop("fits"), dims).select("batch", "index", "vector")


def write_vectors(chunks: DataFrame, vectors: DataFrame, path: str) -> None:
    """(id, vector) of all chunks as Parquet; an error if a chunk has none."""
    missing = F.raise_error(F.concat(F.lit("no vector for "), F.col("id").cast("string"))).cast("array<float>")
    chunks.select("id").join(vectors, "id", "left").select("id", F.coalesce("vector", missing).alias("vector")).write.mode("overwrite").parquet(path)


def manifest(chunks: DataFrame, model: str, dims: int, kind: str = "doc_type") -> DataFrame:
    """One row: model, dims, count, by_type, bytes."""
    by = chunks.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))
    return by.agg(F.sum("n").alias("count"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(kind, "n")))).alias("by_type")).select(F.lit(model).alias("model"), F.lit(dims).alias("dims"), "count", "by_type", (F.col("count") * dims * 4).alias("bytes"))


def index_info(manifests: DataFrame) -> DataFrame:
    """What a status page shows; not ready without a manifest."""
    m = manifests.agg(F.count(F.lit(1)).alias("n"), F.first("model").alias("model"), F.first("count").alias("count"), F.first("doc_sha").alias("doc_sha"))
    return m.select((F.col("n") > 0).alias("ready"), "model", F.coalesce("count", F.lit(0)).alias("count"), F.substring("doc_sha", 1, 12).alias("doc_sha"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, md): whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("md"))


def markdown_table(df: DataFrame, header: list[str]) -> DataFrame:
    """(line): the rows of a small report as a markdown table, header first, in the order of the first column."""
    spark = df.sparkSession
    rows = df.orderBy(df.columns[0]).select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)), F.lit(" |")).alias("line"))
    top = spark.createDataFrame([(f"| {' | '.join(header)} |",), (f"|{'---|' * len(header)}",)], "line string")
    return top.unionByName(rows)

"""A corpus pipeline of the training-data operators: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlspike.llm.common import cut, read_table
from marlspike.llm.line_runs import line_dedup
from marlspike.llm.mixing import take_mixed
from marlspike.llm.near_duplicates import keep_one
from marlspike.llm.quality_rules import keep_good
from marlspike.llm.sentence_pieces import encode_pieces
from pyspark.sql import functions as F


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules, or their source's verdict, reject go."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; n_chars is that of the new text. Documents of which no word is left go with them.

    Columns that ``docs`` lacks aren't added."""
    out = line_dedup(docs).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest doc_id."""
    return keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights; those of two epochs come twice."""
    return take_mixed(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, and the SentencePiece numbers of each text, with their count and whether they decode to it."""
    return encode_pieces(docs.select("doc_id", "lang", "source", "text")).drop("text")


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near), ("mixing", mixture), ("sentence pieces", pieces)]

#: The Viterbi search of the last stage is beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order on ``documents``; what each returns is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, name.replace(" ", "-"))
    return docs

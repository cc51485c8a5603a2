"""Checks of parsed markdown: page marks, headings, integrity, table of contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlspike.functions import text as T
from marlspike.operators.assembly import as_of
from marlspike.operators.ingest import STRICT_HEADING, breadcrumbs, headings

CLOSERS = ".!?)\"'>"


def pages_out_of_order(marks: DataFrame) -> DataFrame:
    """Marks whose page isn't above the one before."""
    prev = F.lag("page").over(Window.partitionBy("doc_id").orderBy("at"))
    return marks.withColumn("prev_page", prev).where("page <= prev_page").select("doc_id", "at", "page", "prev_page")


def page_ranges(marks: DataFrame) -> DataFrame:
    """(doc_id, lo, hi): the runs of pages without a mark between a document's first mark's page and its last one's. One row a
    run, however far apart two marks are."""
    by = Window.partitionBy("doc_id")
    ends = marks.select("doc_id", "page", F.min_by("page", "at").over(by).alias("lo"), F.max_by("page", "at").over(by).alias("hi"))
    inside = ends.where(F.col("page").between(F.col("lo"), F.col("hi"))).select("doc_id", "page").distinct()
    after = F.lead("page").over(by.orderBy("page"))
    return inside.select("doc_id", (F.col("page") + 1).alias("lo"), (after - 1).alias("hi")).where("hi >= lo")


def page_gaps(marks: DataFrame, most: int = 100_000) -> DataFrame:
    """(doc_id, page): pages of ``page_ranges`` one by one; a run of more than ``most`` pages is an error, not a list."""
    runs = page_ranges(marks)
    wide = F.raise_error(F.concat(F.lit("no marks between pages "), F.col("lo").cast("string"), F.lit(" and "), F.col("hi").cast("string"))).cast("array<int>")
    return runs.select("doc_id", F.explode(F.when(F.col("hi") - F.col("lo") < most, F.sequence("lo", "hi")).otherwise(wide)).alias("page"))


def parse_statistics(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, n_marks, n_inferred, min_page, max_page, n_chars) of every document (doc_id, md); no pages without marks."""
    sizes = docs.select("doc_id", T.units(F.col("md")).cast("long").alias("n_chars"))
    found = sizes.join(mark_summary(marks), "doc_id", "left")
    return found.select("doc_id", F.coalesce("n_marks", F.lit(0)).alias("n_marks"), F.coalesce("n_inferred", F.lit(0)).alias("n_inferred"), "min_page", "max_page", "n_chars")


def mark_summary(marks: DataFrame) -> DataFrame:
    return marks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_marks"), F.count_if("inferred").alias("n_inferred"), F.min("page").alias("min_page"), F.max("page").alias("max_page"))


def level_jumps(rows: DataFrame) -> DataFrame:
    """Headings more than one level below the one before; only ``# title`` with one space counts here."""
    heads = headings(rows, STRICT_HEADING)
    prev = F.lag("level").over(Window.partitionBy("doc_id").orderBy("n"))
    return heads.withColumn("prev_level", prev).where("level - prev_level > 1").select("doc_id", "n", "prev_level", "level", "title")


def duplicate_breadcrumbs(rows: DataFrame) -> DataFrame:
    crumbs = breadcrumbs(headings(rows, STRICT_HEADING)).withColumn("breadcrumb", T.breadcrumb(F.col("path")))
    return crumbs.groupBy("doc_id", "breadcrumb").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def integrity(docs: DataFrame) -> DataFrame:
    """(doc_id, bold_unbalanced, ends_open): an odd number of bold marks; a last character that closes no sentence."""
    tail = F.right(T.trim(F.col("md")), F.lit(1))
    return docs.select("doc_id", (F.size(F.split("md", r"\*\*")) % 2 == 0).alias("bold_unbalanced"), (~F.contains(F.lit(CLOSERS), tail)).alias("ends_open"))


def toc_nearest(rows: DataFrame, marks: DataFrame, toc: DataFrame) -> DataFrame:
    """Each entry (doc_id, name, page, actual) with the heading of its name that is nearest to its page; the first of equals.

    severity: ok, warn (no heading), fail (more than a page off).
    """
    heads = as_of(headings(rows, STRICT_HEADING).select("doc_id", "at", "title"), marks.select("doc_id", "at", "page"), ["doc_id"], "at", "page").withColumnRenamed("page", "got")
    keyed = heads.withColumn("hkey", F.regexp_replace(F.lower("title"), "[^a-z]", ""))
    want = toc.withColumn("key", T.toc_key(F.coalesce("actual", "name")))
    # The key has up to seven letters, so headings are met by their first letters of each length: an equi-join.
    short = keyed.withColumn("key", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring(F.col("hkey"), F.lit(1), i)))))
    far = F.abs(F.coalesce("got", F.lit(0)) - F.col("page"))
    joined = want.join(short.select("doc_id", "key", "at", "title", "got"), ["doc_id", "key"], "left")
    best = joined.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", "name", "page").orderBy(far, "at"))).where("_r = 1")
    severity = F.when(F.col("title").isNull(), "warn").when(F.col("got").isNotNull() & (F.abs(F.col("got") - F.col("page")) > 1), "fail").otherwise("ok")
    return best.select("doc_id", "name", "page", "title", "got", severity.alias("severity"))


def verdict(findings: DataFrame) -> DataFrame:
    """(severity, n), and whether anything failed is n of fail above 0."""
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))

"""Jobs with arguments: ``python -m marlspike.jobs JOB --tables DIR [...]``; results go to the screen, or to --out as Parquet."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.operators import checks as C
from marlspike.operators import evaluation as E
from marlspike.operators import ingest as G
from marlspike.plans import evaluation as PE
from marlspike.sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="marlspike.jobs")
    jobs = p.add_subparsers(dest="job", required=True)

    def job(name: str, text: str, tables: bool = True) -> argparse.ArgumentParser:
        j = jobs.add_parser(name, help=text)
        if tables:
            j.add_argument("--tables", required=True, help="folder of the Parquet tables")
        j.add_argument("--out", help="where to write the result as Parquet")
        return j

    r = job("retrieval", "recall and reciprocal rank by arm")
    r.add_argument("--k", type=int, default=PE.K, help="rank up to which a hit counts, at most the depth of the arms' lists")
    r.add_argument("--arms", default="", help="arms to run, comma-separated; they run in their listed order")
    a = job("answers", "rows to ask and grade")
    a.add_argument("--strata", default="permitted,forbidden,unstated", help="answer classes, comma-separated")
    a.add_argument("--limit", type=int, default=0, help="the first rows only; 0 is all")
    a.add_argument("--concurrency", type=int, default=4, help="partitions that work at a time")
    a.add_argument("--done", help="JSON lines of earlier answers (doc_id), which are left out")
    a.add_argument("--fresh", action="store_true", help="ignore earlier answers")
    v = job("verify", "checks of parsed markdown", tables=False)
    v.add_argument("--in", dest="path", required=True, help="markdown files")
    v.add_argument("--toc", help="JSON lines of entries (doc_id, name, page, actual)")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.job == "retrieval":
        if not 1 <= args.k <= PE.K:
            raise ValueError(f"--k must be from 1 to {PE.K}")
        return E.recall_mrr(PE._scores(spark, args.tables, PE.chosen(args.arms)), ["arm"], args.k)
    if args.job == "answers":
        strata = [x.strip() for x in args.strata.split(",") if x.strip()]
        rows = PE._graded(spark, args.tables).where(F.col("answer_class").isin(*strata)).select("doc_id", "answer_class")
        if args.done and not args.fresh:
            rows = rows.join(files.read_json_lines(spark, args.done, "doc_id long", tolerant=True), "doc_id", "left_anti")
        rows = rows.orderBy("doc_id")
        return (rows.limit(args.limit) if args.limit > 0 else rows).repartition(max(1, args.concurrency))
    docs = files.read_markdown(spark, args.path)
    lines = G.lines(docs)
    marks = G.page_marks(lines)
    found = C.integrity(docs).where("bold_unbalanced OR ends_open").select(F.lit("warn").alias("severity")).unionByName(C.pages_out_of_order(marks).select(F.lit("fail").alias("severity"))).unionByName(C.page_ranges(marks).select(F.lit("warn").alias("severity")))
    if args.toc:
        found = found.unionByName(C.toc_nearest(lines, marks, files.read_json_lines(spark, args.toc, "doc_id string, name string, page int, actual string")).select("severity"))
    return C.verdict(found)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"marlspike {args.job}").getOrCreate()
    out = run(spark, args)
    if args.out:
        out.write.mode("overwrite").parquet(args.out)
    else:
        out.show(200, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Batches by count and token budget, and the work that a cache leaves."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspike.functions.text import backoff_seconds
from marlspike.operators.folds import fold

# Items and tokens per batch, requests and tokens per minute.
BATCH_ITEMS, BATCH_TOKENS = 64, 8000
PER_MINUTE, TOKENS_PER_MINUTE = 3, 10000
#: Client -> seconds of a first wait, longest wait, attempts after which it gives up. Ingestion waits for the gap between requests.
LADDERS = {"query": (21.0, 90.0, 6), "rerank": (20.0, 90.0, 6), "ingest": (60.0 / PER_MINUTE, 90.0, 8)}


def greedy_batches(df: DataFrame, by: str = "queue", order: str = "pos", size: str = "tokens", items: int = BATCH_ITEMS, tokens: int = BATCH_TOKENS) -> DataFrame:
    """(by, order, batch): in order, a batch is closed before an item that would exceed its count or tokens; no batch is empty.

    Order-dependent, so a queue is one fold, which holds no more than the open batch's sums; queues are independent of each other
    and should be as many as there are workers.
    """

    def step(s: dict, r: dict) -> list[tuple]:
        if s["n"] and (s["n"] >= items or s["t"] + r[size] > tokens):
            s["batch"], s["n"], s["t"] = s["batch"] + 1, 0, 0
        s["n"], s["t"] = s["n"] + 1, s["t"] + r[size]
        return [(r[by], r[order], s["batch"])]

    kinds = {c: df.schema[c].dataType.simpleString() for c in (by, order)}
    rows = df.select(by, order, F.col(size).cast("long").alias(size))
    return fold(rows, by, [order, size], lambda: {"batch": 0, "n": 0, "t": 0}, step, f"{by} {kinds[by]}, {order} {kinds[order]}, batch long")


def minutes_left(batches: Column, tokens: Column, per_minute: int = PER_MINUTE, tokens_per_minute: int = TOKENS_PER_MINUTE) -> Column:
    """Whole minutes that the stricter of both limits needs."""
    return F.ceil(F.greatest(batches / per_minute, tokens / tokens_per_minute)).cast("long")


def split_cached(needed: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Rows that the cache holds, rows that it doesn't."""
    known = cache.select(key).distinct()
    return needed.join(known, key, "left_semi"), needed.join(known, key, "left_anti")


def isolated(df: DataFrame, work, schema: str, key: str = "id") -> DataFrame:
    """``work`` (a row as dict -> dict) on each row; a row that fails gives its error and nothing else, and stops no other."""
    import pandas as pd

    names = [x.split()[0] for x in schema.split(",")]

    def run(parts):
        for pdf in parts:
            out = []
            for r in pdf.to_dict("records"):
                try:
                    out.append({key: r[key], "error": None} | {k: work(r)[k] for k in names})
                except Exception as e:  # noqa: BLE001  the point of this operator
                    out.append({key: r[key], "error": f"{type(e).__name__}: {e}"} | dict.fromkeys(names))
            yield pd.DataFrame(out, columns=[key, "error", *names])

    return df.mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, error string, {schema}")


def with_retries(send: Callable[[], tuple[int, float | None, object]], client: str, sleep: Callable[[float], None] = time.sleep) -> object:
    """What ``send`` (status, seconds that the server asks to wait or None, result) gives at last: 429 and 5xx are tried again on
    the client's ladder, any other status of 400 or more is an error at once."""
    base, longest, most = LADDERS[client]
    attempt = 1
    while True:
        status, asked, result = send()
        if status != 429 and status < 500:
            if status >= 400:
                raise RuntimeError(f"{client} request failed with status {status}")
            return result
        if attempt > most:
            raise RuntimeError(f"{client} request failed with status {status} after {most} attempts")
        sleep(backoff_seconds(base, attempt, longest, asked or None))
        attempt += 1


def run_batches(df: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, by: str = "batch") -> int:
    """``work`` on each batch of ``df`` in turn, its result appended to ``path`` as a partition of its own once it is whole.

    Batches that ``path`` holds already are left out, so a run that ended early goes on where it stopped. For work that a rate
    limit makes sequential anyway: the driver holds the batches' numbers only. Returns how many were worked on.
    """
    spark = df.sparkSession
    from pyspark.errors import AnalysisException

    try:
        done = {r[0] for r in spark.read.parquet(path).select(by).distinct().collect()}
    except AnalysisException:  # nothing is written yet
        done = set()
    todo = sorted(r[0] for r in df.select(by).distinct().collect() if r[0] not in done)
    for b in todo:
        work(df.where(F.col(by) == b)).withColumn(by, F.lit(b)).write.mode("append").partitionBy(by).parquet(path)
    return len(todo)

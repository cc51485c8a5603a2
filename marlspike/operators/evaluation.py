"""Evaluation: span-based hits, recall, reciprocal rank, paired statistics, answer grading."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlspike.functions import text as T
from marlspike.operators.unions import stacked

# Fixed values of the scoring rules.
COVERAGE, COVERAGE_ON_PAGE = 0.8, 0.5
Z, Z_POWER, DISCORDANT = 1.96, 0.84, 0.25


def span_hits(retrieved: DataFrame, chunks: DataFrame, gold: DataFrame) -> DataFrame:
    """retrieved (qid, id, rank), chunks (id, content, page_start, page_end), gold (qid, span, page) -> qid, id, rank, hit.

    A chunk hits if it contains the normalised span, or has 80 % of its words in order, or 50 % on the span's page. Texts are
    normalised once per chunk and span, not once per pair.
    """
    used = chunks.join(retrieved.select("id").distinct(), "id", "left_semi").select("id", T.normalize(F.col("content")).alias("text"), "page_start", "page_end")
    spans = gold.select("qid", "page", T.normalize(F.col("span")).alias("span"))
    df = retrieved.join(used, "id").join(spans, "qid")
    share = T.ordered_coverage(T.words_of(F.col("text")), T.words_of(F.col("span")))
    df = df.withColumn("share", F.round(share, 6))
    same = (F.col("page") >= F.col("page_start")) & (F.col("page") <= F.coalesce("page_end", "page_start"))
    hit = F.contains(F.col("text"), F.col("span")) | (F.col("share") >= COVERAGE) | (F.coalesce(same, F.lit(False)) & (F.col("share") >= COVERAGE_ON_PAGE))
    return df.select("qid", "id", "rank", "share", hit.alias("hit"))


def unranked(chunks: DataFrame, gold: DataFrame, block: int = 4096) -> DataFrame:
    """(qid, rank): 1 if any chunk contains the normalised span, else null. An arm that hands over everything has no positions.

    Spans go out in blocks; each task reads its chunks once, with an automaton of a block's spans, and hands on what it met.
    """
    spans = gold.select("qid", T.normalize(F.col("span")).alias("span"))
    texts = chunks.select(T.normalize(F.col("content")).alias("text"))
    blocks = max(1, -(-spans.count() // block))
    met = []
    for i in range(blocks):
        mine = spans if blocks == 1 else spans.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i)
        held = [(r["qid"], r["span"]) for r in mine.where("span <> ''").collect()]

        def run(batches, held=held):
            import ahocorasick

            who: dict[str, list] = {}
            for qid, span in held:
                who.setdefault(span, []).append(qid)
            find = ahocorasick.Automaton()
            for span in who:
                find.add_word(span, span)
            find.make_automaton()
            found: set[str] = set()
            for b in batches:
                for text in b.column(0).to_pylist() if who else ():
                    found.update(span for _, span in find.iter(text or ""))
            yield pa.RecordBatch.from_arrays([pa.array([q for s in found for q in who[s]], pa.int64())], names=["qid"])

        met.append(texts.mapInArrow(run, "qid long"))
    return gold.select(F.col("qid").cast("long").alias("qid")).join(stacked(*met).distinct().withColumn("rank", F.lit(1)), "qid", "left")


def scorable(gold: DataFrame) -> DataFrame:
    return gold.where(~F.coalesce("unanswerable", F.lit(False)) & (F.coalesce("span", F.lit("")) != ""))


def first_hits(hits: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """(by, qid, rank): the rank of the first hit of every gold question, or null."""
    best = hits.groupBy(*by, "qid").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("rank"))
    return gold.select(*by, "qid").join(best, [*by, "qid"], "left")


def recall_mrr(scores: DataFrame, by: list[str], k: int) -> DataFrame:
    """Recall at k and mean reciprocal rank of scores (by, qid, rank), with a Wilson interval."""
    ok = F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))
    df = scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(ok).alias("hits"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))
    lo, hi = wilson(F.col("hits"), F.col("n"))
    return df.select(*by, "n", "hits", F.round(F.col("hits") / F.col("n"), 6).alias("recall"), "mrr", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


def wilson(s: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """The Wilson interval of s of n; 0 and 0 for n = 0."""
    m = F.greatest(n, F.lit(1)).cast("double")
    p, d = s / m, 1 + z * z / m
    mid, half = p + z * z / (2 * m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    lo, hi = F.greatest(F.lit(0.0), (mid - half) / d), F.least(F.lit(1.0), (mid + half) / d)
    return F.when(n == 0, 0.0).otherwise(lo), F.when(n == 0, 0.0).otherwise(hi)


def mcnemar(b: Column, c: Column) -> Column:
    """The exact two-sided p-value for b and c discordant pairs; 1 without any."""
    n = (b + c).cast("int")
    lo = F.least(b, c).cast("int")
    log_choose = lambda i: F.aggregate(F.when(i > 0, F.sequence(F.lit(1), i)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, j: a + F.log(n - i + j) - F.log(j.cast("double")))
    tail = F.aggregate(F.sequence(F.lit(0), lo), F.lit(0.0), lambda a, i: a + F.exp(log_choose(i) + n * F.log(F.lit(0.5))))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def holm(df: DataFrame, p: str = "p", order: str = "i") -> DataFrame:
    """``df`` with p_holm: step-down adjusted. One family is one sort; families are a handful of comparisons."""
    w = Window.partitionBy(F.lit(0)).orderBy(p, order)
    m = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    step = F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p))
    return df.withColumn("_s", step).withColumn("p_holm", F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_s")


def discordant(scores: DataFrame, first: str, second: str, k: int) -> DataFrame:
    """(improved, regressed): questions that only the second, only the first arm hits within k."""
    ok = F.coalesce(F.col("rank") <= k, F.lit(False))
    both = scores.where(F.col("arm").isin(first, second)).groupBy("qid").agg(F.max(F.when(F.col("arm") == first, ok)).alias("a"), F.max(F.when(F.col("arm") == second, ok)).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return both.agg(F.count_if(F.expr("b AND NOT a")).alias("improved"), F.count_if(F.expr("a AND NOT b")).alias("regressed"))


def detectable(n: Column, rate: float = DISCORDANT) -> Column:
    """The smallest difference that n pairs resolve; 1 for none."""
    d = n * rate
    return F.when(d <= 0, 1.0).otherwise((Z + Z_POWER) * F.sqrt(d) / F.greatest(n, F.lit(1)))


def settled(stance: Column) -> Column:
    return stance.isin("PERMITTED", "FORBIDDEN", "FACTUAL")


def stance_matches(stance: Column, answer_class: Column) -> Column:
    """Unstated wants UNSTATED, forbidden wants FORBIDDEN or FACTUAL, others want any settled stance."""
    return F.when(answer_class == "unstated", stance == "UNSTATED").when(answer_class == "forbidden", stance.isin("FORBIDDEN", "FACTUAL")).otherwise(settled(stance))


def false_permissions(rows: DataFrame) -> DataFrame:
    """eligible, bad, rate and its Wilson interval: permissions given where the corpus gives none."""
    e = rows.agg(F.count_if(F.col("answer_class").isin("forbidden", "unstated")).alias("eligible"), F.count_if(F.col("answer_class").isin("forbidden", "unstated") & (F.col("stance") == "PERMITTED")).alias("bad"))
    lo, hi = wilson(F.col("bad"), F.col("eligible"))
    rate = F.when(F.col("eligible") == 0, 0.0).otherwise(F.col("bad") / F.greatest("eligible", F.lit(1)))
    return e.select("eligible", "bad", F.round(rate, 6).alias("rate"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


def refusal_counterweight(rows: DataFrame) -> DataFrame:
    """eligible, ok, declined, ungradeable of permitted questions; ok and what was missed make up eligible."""
    p = F.col("answer_class") == "permitted"
    ok = stance_matches(F.col("stance"), F.lit("permitted"))
    return rows.agg(F.count_if(p).alias("eligible"), F.count_if(p & ok).alias("ok"), F.count_if(p & (F.col("stance") == "UNSTATED")).alias("declined"), F.count_if(p & (F.col("stance") == "UNCLEAR")).alias("ungradeable"))


def stratum_accuracy(rows: DataFrame) -> DataFrame:
    ok = stance_matches(F.col("stance"), F.col("answer_class"))
    df = rows.groupBy("answer_class").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("ok"))
    lo, hi = wilson(F.col("ok"), F.col("n"))
    return df.select("answer_class", "n", "ok", F.round(F.col("ok") / F.col("n"), 6).alias("accuracy"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


def index_agrees(gold: DataFrame, manifest: DataFrame, digits: int = 16) -> DataFrame:
    """``gold`` (doc_sha, ...), failing at the first row that was labelled on another document than the index holds.

    Only the first digits count, and only where both have a hash. manifest: one row (doc_sha).
    """
    held = manifest.select(F.substring("doc_sha", 1, digits).alias("_held"))
    mine = F.substring("doc_sha", 1, digits)
    wrong = F.raise_error(F.concat(F.lit("labels are for document "), mine)).cast("string")
    return gold.crossJoin(F.broadcast(held)).withColumn("doc_sha", F.when(mine.isNull() | F.col("_held").isNull() | (mine == F.col("_held")), F.col("doc_sha")).otherwise(wrong)).drop("_held")


def search_share(rows: DataFrame) -> DataFrame:
    """n, attached, share of rows with a search attached, and token totals."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("used_search").alias("attached"), F.round(F.avg(F.col("used_search").cast("int")), 6).alias("share"), F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("long").alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("long").alias("output_tokens"))


def checkpoint_key(fields: list[Column]) -> Column:
    """The first 16 hex digits of a hash of these fields as JSON, in their order."""
    return F.substring(F.sha2(F.to_json(F.struct(*fields)), 256), 1, 16)


def split_cached(wanted: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """What the cache has (its last line per key), and what is still to do."""
    last = cache.groupBy(key).agg(F.max_by("row", "line_no").alias("row"))
    return wanted.join(last, key), wanted.join(cache.select(key).distinct(), key, "left_anti")

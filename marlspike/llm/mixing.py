"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

Leaves of a tree (domain, language, source) hold tokens. A budget goes down the tree in proportion to weights; a child gets
no more than its leaves can give in ``max_epochs`` passes, and what it can't use goes to its siblings by their weights, to the
parent's siblings only once all children are full. Each leaf's budget then is some whole epochs and a token-prefix of one
more, in an order seeded by epoch. Prefix sums run over hash buckets of about BUCKET_ROWS documents, so no task orders a
whole leaf, and what is windowed per leaf is one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, read_table, row_key, text_of
from .quality_rules import WORD

LEVELS = ("domain", "lang", "source")
#: Weights by level and name; others have the default. They needn't sum to 1.
WEIGHTS = {"domain": {"d0": 0.4, "d1": 0.3, "d2": 0.2, "d3": 0.1}, "lang": {"en": 0.55, "fr": 0.15, "de": 0.15, "es": 0.15}, "source": {}}
DEFAULT = {"domain": 0.1, "lang": 0.05, "source": 1.0}
MAX_EPOCHS = 2
BUDGET_PERCENT = 100  # of all tokens
SEED = 17
BUCKET_ROWS = 2000


def domain_of(source: str = "source") -> Column:
    """The domain of a source: d0 to d3 by the number at its end, else "other"."""
    n = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(n == "", F.lit("other")).otherwise(F.concat(F.lit("d"), F.pmod(n.try_cast("long"), F.lit(4)).cast("string")))


def _weight(level: str, weights: dict, default: dict) -> Column:
    out = F.lit(float(default[level]))
    for name, w in weights[level].items():
        out = F.when(F.col(level) == name, F.lit(float(w))).otherwise(out)
    return out


def _pour(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """alloc of each child from its parent's ``budget``: min(cap, x * weight), with x such that all is spent if it can be."""
    by = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), child)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    df = children.withColumn("x", x)
    rate = F.first(F.when(F.col("x") * F.col("w") <= F.col("cap"), F.col("x")), ignorenulls=True).over(whole)
    return df.withColumn("rate", rate).withColumn("alloc", F.coalesce(F.least("cap", F.col("rate") * F.col("w")), F.col("cap"))).drop("x", "rate")


def leaf_budgets(leaves: DataFrame, levels=LEVELS, weights=WEIGHTS, default=DEFAULT, max_epochs=MAX_EPOCHS, percent=BUDGET_PERCENT) -> DataFrame:
    """(levels, supply, n_docs) -> the same with target: tokens to take of the leaf, at most max_epochs times its supply.

    Null level values are nodes of their own (their text is empty in the tree).
    """
    leaves = leaves.withColumn("cap", F.col("supply").cast("double") * max_epochs)
    top = leaves.groupBy().agg((F.coalesce(F.sum("supply"), F.lit(0)) * percent / 100).cast("double").alias("budget"))
    for i, level in enumerate(levels):
        nodes = leaves.groupBy(*levels[: i + 1]).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(level, weights, default))
        nodes = nodes.crossJoin(F.broadcast(top)) if i == 0 else nodes.join(top, list(levels[:i]))  # the root is one row
        nodes = nodes.withColumn("_root", F.lit(0))
        poured = cut(_pour(nodes, ["_root", *levels[:i]], level), "poured")
        top = poured.select(*levels[: i + 1], F.col("alloc").alias("budget"))
    done = top.select(*levels, F.floor(F.round("budget", 3)).cast("long").alias("target"))
    return leaves.drop("cap").join(done, list(levels))


def mix(docs: DataFrame, levels=LEVELS, weights=WEIGHTS, default=DEFAULT, max_epochs=MAX_EPOCHS, percent=BUDGET_PERCENT, seed=SEED, text: str = "text") -> DataFrame:
    """(did, th, doc_id, levels, n_tokens, copies) of each distinct document; copies: how many epochs take it.

    ``docs`` has doc_id, text and the levels. Tokens are words between ASCII spaces; null texts have none. Null level values
    stand as the empty text. Rows equal in doc_id and text are one unit: taken together, and their tokens count for each.
    Documents without tokens are taken with the prefix that reaches them. A very long text is one unit as any other: the prefix
    that reaches its first token takes it whole. Other columns aren't looked at, whatever their names. An empty table gives an
    empty table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(), *(F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in levels), F.regexp_count(text_of(text), F.lit(WORD)).cast("long").alias("n_tokens"))
    units = cut(rows.groupBy("doc_id", "did", "th", *levels).agg(F.first("n_tokens").alias("n_tokens"), F.sum("n_tokens").alias("unit_tokens")), "units")
    leaves = cut(leaf_budgets(cut(units.groupBy(*levels).agg(F.sum("unit_tokens").alias("supply"), F.count(F.lit(1)).alias("n_docs")), "leaves"), levels, weights, default, max_epochs, percent), "budgets")
    leaves = leaves.select(*levels, "supply", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BUCKET_ROWS)).alias("buckets"), F.when(F.col("supply") > 0, F.floor(F.col("target") / F.greatest("supply", F.lit(1)))).otherwise(0).cast("long").alias("epochs"), "target")
    leaves = leaves.withColumn("rest", F.col("target") - F.col("epochs") * F.col("supply"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    placed = units.join(leaves, list(levels)).withColumn("key", key)
    share = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    placed = cut(placed.withColumn("bucket", F.floor(share * F.col("buckets") / F.lit(2**32)).cast("long")), "placed")
    sums = cut(placed.groupBy(*levels, "bucket").agg(F.sum("unit_tokens").alias("tokens")), "sums")
    running = Window.partitionBy(*levels).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(sums.withColumn("base", F.coalesce(F.sum("tokens").over(running), F.lit(0))).select(*levels, "bucket", "base"), "bases")
    inner = Window.partitionBy(*levels, "bucket").orderBy("key", "did", "th").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("base") + F.coalesce(F.sum("unit_tokens").over(inner), F.lit(0))
    out = placed.join(bases, [*levels, "bucket"]).withColumn("at", at)
    return out.select("did", "th", "doc_id", *levels, "n_tokens", (F.col("epochs") + (F.col("at") < F.col("rest")).cast("long")).alias("copies")).where("copies > 0")


def take_mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, source) in the mixture, with all their columns and no other; a document that several
    epochs take comes that often. Nulls in any column and repeated rows are treated as in ``mix``; rows that share a doc_id and
    differ in text are told apart. Columns named ``domain``, ``copies`` or ``key`` stay as they are; names that begin with an
    underscore and are used here (_k1, _k2, _did, _th, _d, _l, _s, _e, _copies) are refused.
    """
    if clash := {"_k1", "_k2", "_did", "_th", "_d", "_l", "_s", "_e", "_copies"} & set(docs.columns):
        raise ValueError(f"columns of these names are used inside: {sorted(clash)}")
    docs_in = docs.drop("domain").withColumn("domain", domain_of())
    chosen = cut(mix(docs_in).select(F.col("did").alias("_did"), F.col("th").alias("_th"), F.col("domain").alias("_d"), F.col("lang").alias("_l"), F.col("source").alias("_s"), "copies"), "chosen")
    did, th = row_key()
    same = (F.col("_k1") == F.col("_did")) & (F.col("_k2") == F.col("_th")) & (F.coalesce("lang", F.lit("")) == F.col("_l")) & (F.coalesce("source", F.lit("")) == F.col("_s"))
    out = docs.withColumns({"_k1": did, "_k2": th}).join(chosen.withColumnRenamed("copies", "_copies").hint("merge"), same)
    return out.withColumn("_e", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op8(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text").withColumn("domain", domain_of())
    return mix(docs).select("doc_id", *LEVELS, "n_tokens", "copies")


def sql(table: str = "documents") -> str:
    levels = [("domain", ""), ("lang", "domain, "), ("source", "domain, lang, ")]
    steps = []
    above = "root"
    for i, (level, parent) in enumerate(levels):
        cols = parent + level
        w = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in WEIGHTS[level].items())
        w = f"CASE {level} {w} ELSE {DEFAULT[level]}::DOUBLE END" if w else f"{DEFAULT[level]}::DOUBLE"
        join = f"JOIN {above} USING ({parent.rstrip(', ')})" if i else "CROSS JOIN root"
        win = (f"PARTITION BY {parent.rstrip(', ')} " if i else "") + f"ORDER BY cap / w, {level}"
        steps.append(f"""
n{i} AS (SELECT n.*, budget FROM (SELECT {cols}, sum(cap) AS cap, {w} AS w FROM leaves GROUP BY {cols}) n {join}),
x{i} AS (SELECT *, (budget - coalesce(sum(cap) OVER ({win} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
          (sum(w) OVER ({win} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - coalesce(sum(w) OVER ({win} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS x FROM n{i}),
y{i} AS (SELECT *, first_value(CASE WHEN x * w <= cap THEN x END IGNORE NULLS) OVER ({win} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS rate FROM x{i}),
b{i} AS (SELECT {cols}, CASE WHEN rate IS NULL THEN cap ELSE least(cap, rate * w) END AS budget FROM y{i}),""")
        above = f"b{i}"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN 'other'
                       ELSE 'd' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::BIGINT % 4) END AS domain,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM {table}),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply, count(*) AS n_docs, sum(n_tokens)::DOUBLE * {MAX_EPOCHS} AS cap FROM d GROUP BY ALL),
root AS (SELECT (coalesce(sum(supply), 0) * {BUDGET_PERCENT} / 100)::DOUBLE AS budget FROM leaves),{"".join(steps)}
t AS (SELECT leaves.*, floor(round(budget, 3))::BIGINT AS target FROM leaves JOIN b2 USING (domain, lang, source)),
e AS (SELECT *, CASE WHEN supply > 0 THEN target // supply ELSE 0 END AS epochs FROM t),
k AS (SELECT d.*, epochs, target - epochs * supply AS rest, md5('{SEED}:' || epochs || ':' || coalesce(doc_id::VARCHAR, '')) AS key FROM d JOIN e USING (domain, lang, source)),
a AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM k)
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, (epochs + (pos < rest)::INT)::BIGINT AS copies FROM a WHERE epochs + (pos < rest)::INT > 0
"""


SQL = sql()

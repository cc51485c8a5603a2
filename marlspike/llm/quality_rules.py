"""Quality rules with host-level verdicts, in DataFrame functions only.

Each text gets its counts, and fails some of RULES or none. Failures of each rule are aggregated by host; a host's failure rate
is shrunk towards the rule's mean by a beta prior that is fitted to all hosts by moments, one prior a rule. A host whose shrunk
rate of any rule exceeds MAX_HOST_RATE is rejected with all its documents. On others the host's verdict on a rule is strict, if the
rule fails there often enough to be no accident (STRICT_RATE), and documents that fail it go; or else lenient, and they stay.
BASE rules hold on every host. What is aggregated is one row per host and task, so a hot host needs no salting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, read_table, row_key, text_of

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Rule -> what fails it, in SQL that holds on both engines.
RULES = {
    "few_words": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars > 12 * n_words OR word_chars < 2 * n_words",
}
BASE = ("few_words", "repeats")
#: A host goes if a shrunk failure rate is above this; above the lower one, its documents that fail the rule go.
MAX_HOST_RATE, STRICT_RATE = 0.5, 0.02
#: Bounds of the prior's weight (alpha + beta), in documents.
MIN_WEIGHT, MAX_WEIGHT = 1.0, 1000.0
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(df: DataFrame) -> DataFrame:
    """n_repeat_words from the words in _w: positions in 3-word windows that occur twice or more in the text.

    Windows are sorted by hash, so equal ones are neighbours: n log n for a text of n words, however often they repeat.
    """
    w = F.col("_w")
    window = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    df = df.withColumn("_g", F.when(F.size(w) >= 3, F.sort_array(window)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    g = F.col("_g")
    again = F.filter(g, lambda x, i: (x.h == F.get(g, i - 1).h).eqNullSafe(True) | (x.h == F.get(g, i + 1).h).eqNullSafe(True))
    df = df.withColumn("_s", F.sort_array(F.transform(again, lambda x: x.i)))
    s = F.col("_s")
    cover = F.transform(s, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(s, i + 1) - x, F.lit(3))))
    return df.withColumn("n_repeat_words", F.aggregate(cover, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_g", "_s")


def counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the five counts (null text: all 0), n_lines (with a word) and base_failed; columns of these names are replaced."""
    t = text_of(text)
    df = df.drop(*COUNTS, "n_lines", "base_failed").withColumn("_t", t).withColumn("_w", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    df = df.withColumn("_l", lines).withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.translate("_t", SPACES, "")).cast("long"),
            "n_symbols": (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        }
    )
    df = _repeat_words(df).drop("_t", "_w", "_l")
    return df.withColumn("base_failed", base_failed())


def base_failed() -> Column:
    return F.expr(" OR ".join(f"({RULES[r]})" for r in BASE))


def host_verdicts(counted: DataFrame, host: str = "host") -> DataFrame:
    """One row per host: n_docs; of each rule its shrunk rate (rate_<rule>); host_rejected; strict, the rules that hold there.

    Null is a host of its own. A rule's prior: mean m of all documents' failures; weight m(1-m)/v - 1 for the variance v of the
    hosts' rates, within bounds; the upper bound where the rates don't vary. Rates are rounded to 9 digits before they are compared.
    """
    failed = [F.count_if(F.expr(c)).alias(f"k_{r}") for r, c in RULES.items()]
    hosts = cut(counted.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), *failed), "hosts")
    total = F.sum("n_docs")
    prior = hosts.agg(*(x for r in RULES for x in (F.coalesce(F.sum(f"k_{r}") / total, F.lit(0.0)).alias(f"m_{r}"), F.coalesce(F.round(F.var_pop(F.col(f"k_{r}") / F.col("n_docs")), 12), F.lit(0.0)).alias(f"v_{r}"))))
    out = hosts.crossJoin(F.broadcast(prior))  # the priors are one row
    for r in RULES:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        weight = F.when(v > 0, F.greatest(F.lit(MIN_WEIGHT), F.least(F.lit(MAX_WEIGHT), m * (1 - m) / v - 1))).otherwise(F.lit(MAX_WEIGHT))
        out = out.withColumn(f"_w_{r}", weight).withColumn(f"rate_{r}", F.round((F.col(f"k_{r}") + m * F.col(f"_w_{r}")) / (F.col("n_docs") + F.col(f"_w_{r}")), 9))
    rates = [F.col(f"rate_{r}") for r in RULES]
    strict = F.filter(F.array(*(F.when(F.lit(r in BASE) | (F.col(f"rate_{r}") > STRICT_RATE), F.lit(r)) for r in RULES)), lambda x: x.isNotNull())
    return out.select(host, "n_docs", *rates, (F.greatest(*rates) > MAX_HOST_RATE).alias("host_rejected"), strict.alias("strict"))


def quality_rules(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, did, th, host, the counts, base_failed, host_rate (the largest of a rule), kept, reason.

    reason: null if kept, else the first that holds of base, host, and the rules in their order. Null texts have no words and
    fail. Null hosts are one host. Repeated rows each count for their host. Columns of other names aren't looked at; an empty
    table gives an empty table.
    """
    rows = docs.select(F.col("doc_id"), *row_key(), F.col(host).cast("string").alias("host"), text_of(text).alias("text"))
    counted = cut(counts(rows).drop("text"), "counted")
    hosts = cut(host_verdicts(counted), "verdicts").withColumnRenamed("host", "_host")
    out = counted.join(hosts, F.col("host").eqNullSafe(F.col("_host")), "left")
    reason = F.when(F.col("base_failed"), "base").when(F.col("host_rejected"), "host")
    for r, failed in RULES.items():
        if r not in BASE:
            reason = reason.when(F.expr(failed) & F.array_contains("strict", r), r)
    out = out.withColumn("reason", reason).withColumn("host_rate", F.greatest(*(f"rate_{r}" for r in RULES)))
    return out.select("doc_id", "did", "th", "host", *COUNTS, "base_failed", "host_rate", F.col("reason").isNull().alias("kept"), "reason")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns. Texts move once, in a sort-merge join at every size."""
    kept = cut(quality_rules(docs).where("kept").select(F.col("did").alias("_did"), F.col("th").alias("_th")).distinct(), "kept")
    did, th = row_key()
    return docs.withColumns({"_k1": did, "_k2": th}).join(kept.hint("merge"), (F.col("_k1") == F.col("_did")) & (F.col("_k2") == F.col("_th")), "left_semi").drop("_k1", "_k2")


def op9(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "host_rate", "reason")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
b AS (SELECT rid, doc_id, source, len(ws) AS n_words, ws,
             coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
             len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM w),
g AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS k
      FROM b WHERE len(ws) >= 3),
h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM g),
s AS (SELECT rid, i, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 3) AS gap FROM h WHERE n > 1),
r AS (SELECT rid, sum(least(3, gap))::BIGINT AS n_repeat_words FROM s GROUP BY rid),
c AS (SELECT b.rid, doc_id, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM b LEFT JOIN r USING (rid)),
""" + f"""
f AS (SELECT *, {", ".join(f"{c} AS f_{r}" for r, c in RULES.items())}, {" OR ".join(f"({RULES[r]})" for r in BASE)} AS base_failed FROM c),
hosts AS (SELECT source, count(*) AS n, {", ".join(f"count(*) FILTER (f_{r}) AS k_{r}" for r in RULES)} FROM f GROUP BY source),
p AS (SELECT {", ".join(f"sum(k_{r}) / sum(n) AS m_{r}, round(var_pop(k_{r} / n), 12) AS v_{r}" for r in RULES)} FROM hosts),
q AS (SELECT *, {", ".join(f"CASE WHEN v_{r} > 0 THEN greatest({MIN_WEIGHT}, least({MAX_WEIGHT}, m_{r} * (1 - m_{r}) / v_{r} - 1)) ELSE {MAX_WEIGHT} END AS w_{r}" for r in RULES)} FROM p),
z AS (SELECT source, {", ".join(f"round((k_{r} + m_{r} * w_{r}) / (n + w_{r}), 9) AS rate_{r}" for r in RULES)} FROM hosts, q),
x AS (SELECT *, greatest({", ".join(f"rate_{r}" for r in RULES)}) AS host_rate FROM z),
v AS (SELECT f.*, host_rate, CASE WHEN base_failed THEN 'base' WHEN host_rate > {MAX_HOST_RATE} THEN 'host' {" ".join(f"WHEN f_{r} AND rate_{r} > {STRICT_RATE} THEN '{r}'" for r in RULES if r not in BASE)} END AS reason
      FROM f JOIN x ON f.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words,
       base_failed, reason IS NULL AS kept, host_rate, reason
FROM v
"""

"""Registered queries: hits, metrics, statistics, grading, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.functions import text as T
from marlspike.operators import evaluation as E
from marlspike.operators import packing as P
from marlspike.operators import retrieval as R
from marlspike.operators.unions import stacked
from marlspike.plans import tables as t
from marlspike.sources.scratch import cut

QUERIES: dict = {}
ORACLE_SQL: dict = {}
K = 8
ARMS = ("keyword", "bm25", "bm25_rules")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def chosen(names: str) -> tuple[str, ...]:
    """The arms of a comma-separated list, in the order of ARMS; all for an empty one."""
    wanted = [x.strip() for x in names.split(",") if x.strip()]
    if unknown := set(wanted) - set(ARMS):
        raise ValueError(f"no such arms: {', '.join(sorted(unknown))}")
    return tuple(a for a in ARMS if a in wanted) if wanted else ARMS


def _gold(spark, sf_dir):
    """Benchmark items: the question and the span are the text, the page is a tenth of the number."""
    return t.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"), F.col("text").alias("span"), (F.floor(F.col("item_id") / 10) + 1).cast("int").alias("page"), (F.col("item_id") % 17 == 0).alias("unanswerable"))


def _arms(spark, sf_dir, arms=ARMS):
    """The ranked lists of the chosen arms; both lexical ones come from one ranking of 2 K."""
    c, q = t.chunks(spark, sf_dir), E.scorable(_gold(spark, sf_dir))
    wide = cut(R.bm25_top(c, q, 2 * K), "wide") if {"bm25", "bm25_rules"} & set(arms) else None
    make = {
        "keyword": lambda: R.top(R.keyword_scores(c, q), K, F.desc("score"), F.col("id")),
        "bm25": lambda: wide.where(F.col("rank") <= K),
        "bm25_rules": lambda: R.of_types(wide, c, ["rulebook"], K),
    }
    return stacked(*(make[a]().select("qid", "id", F.col("rank").cast("long").alias("rank"), F.lit(a).alias("arm")) for a in arms))


def _hits(spark, sf_dir, arms=ARMS):
    lists = cut(_arms(spark, sf_dir, arms), "lists")
    once = lists.select("qid", "id").distinct().withColumn("rank", F.lit(0))  # texts are compared once per pair, whatever the arms
    hit = E.span_hits(once, t.chunks(spark, sf_dir), _gold(spark, sf_dir)).select("qid", "id", "share", "hit")
    return lists.join(hit, ["qid", "id"])


def _scores(spark, sf_dir, arms=ARMS):
    gold = E.scorable(_gold(spark, sf_dir)).select("qid").crossJoin(F.broadcast(spark.createDataFrame([(a,) for a in arms], "arm string")))
    return E.first_hits(_hits(spark, sf_dir, arms), gold, ["arm"])


HITS = f"""WITH RECURSIVE {t.CHUNKS}, gold AS (SELECT item_id AS qid, text AS question, text AS span, (item_id // 10 + 1)::INT AS page FROM benchmark WHERE item_id % 17 <> 0 AND text <> ''),
kh AS (SELECT DISTINCT id, unnest({t.keywords_sql('content')}) AS term FROM chunks), ka AS (SELECT qid, unnest({t.keywords_sql('question')}) AS term FROM gold), kd AS (SELECT term, count(*) AS df FROM kh GROUP BY term),
ks AS (SELECT qid, kh.id, round(sum(ln(((SELECT count(*) FROM chunks) + 1) / (df + 1)) + 1), 6) AS score FROM ka JOIN kh USING (term) JOIN kd USING (term) GROUP BY ALL),
k AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM ks QUALIFY rank <= {K}),
{t.bm25_sql('gold', 'b', 2 * K)},
lists AS (SELECT qid, id, rank, 'keyword' AS arm FROM k UNION ALL SELECT qid, id, rank, 'bm25' FROM b WHERE rank <= {K}
  UNION ALL SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY rank), 'bm25_rules' FROM b JOIN chunks USING (id) WHERE doc_type = 'rulebook'),
cut AS (SELECT * FROM lists WHERE rank <= {K}), pairs AS (SELECT DISTINCT qid, id FROM cut),
nc AS MATERIALIZED (SELECT id, {t.normalize_sql('content')} AS text, page_start, page_end FROM chunks WHERE id IN (SELECT id FROM pairs)), ng AS MATERIALIZED (SELECT qid, page, {t.normalize_sql('span')} AS span FROM gold),
w AS MATERIALIZED (SELECT qid, id, text, span, page, page_start, page_end, list_filter(string_split(text, ' '), lambda x: x <> '') AS src, list_filter(string_split(span, ' '), lambda x: x <> '') AS tgt FROM pairs JOIN nc USING (id) JOIN ng USING (qid)),
v AS (SELECT qid, id, text, span, page, page_start, page_end, len(tgt) AS m, list_reduce(src, lambda i, x: CASE WHEN tgt[i::INT + 1] = x THEN (i::INT + 1)::VARCHAR ELSE i END, '0')::INT AS met FROM w),
s AS (SELECT *, round(CASE WHEN m = 0 THEN 0 ELSE met / m END, 6) AS share FROM v),
h AS (SELECT qid, id, share, contains(text, span) OR share >= 0.8 OR (coalesce(page >= page_start AND page <= coalesce(page_end, page_start), false) AND share >= 0.5) AS hit FROM s),
hits AS (SELECT c.qid, c.id, c.rank, c.arm, share, hit FROM cut c JOIN h USING (qid, id)),
arms AS (SELECT unnest(['keyword', 'bm25', 'bm25_rules']) AS arm, unnest([0, 1, 2]) AS ord),
sc AS (SELECT arm, ord, g.qid, (SELECT min(rank) FROM hits x WHERE x.qid = g.qid AND x.arm = arms.arm AND hit) AS rank FROM gold g, arms)"""
WILSON = "round(CASE WHEN {n} = 0 THEN 0 ELSE greatest(0, (({s} / {n}) + 3.8416 / (2 * {n}) - 1.96 * sqrt(({s} / {n}) * (1 - {s} / {n}) / {n} + 3.8416 / (4.0 * {n} * {n}))) / (1 + 3.8416 / {n})) END, 6) AS lo, round(CASE WHEN {n} = 0 THEN 0 ELSE least(1, (({s} / {n}) + 3.8416 / (2 * {n}) + 1.96 * sqrt(({s} / {n}) * (1 - {s} / {n}) / {n} + 3.8416 / (4.0 * {n} * {n}))) / (1 + 3.8416 / {n})) END, 6) AS hi"


@query(HITS + " SELECT qid, id, rank, arm, share, hit FROM hits")
def span_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("qid", "id", "rank", "arm", "share", "hit")


@query(HITS + f", a AS (SELECT arm, count(*) AS n, count(*) FILTER (rank <= {K}) AS hits, round(avg(coalesce(1 / rank, 0)), 6) AS mrr FROM sc GROUP BY arm) SELECT arm, n, hits, round(hits / n, 6) AS recall, mrr, {WILSON.format(s='hits', n='n')} FROM a")
def recall_mrr_by_arm(spark, sf_dir):
    return E.recall_mrr(_scores(spark, sf_dir), ["arm"], K)


@query(HITS + f", a AS (SELECT arm, count(*) AS n, count(*) FILTER (rank <= {K}) AS hits, round(avg(coalesce(1 / rank, 0)), 6) AS mrr FROM sc WHERE arm IN ('keyword', 'bm25_rules') GROUP BY arm) SELECT arm, n, hits, round(hits / n, 6) AS recall, mrr, {WILSON.format(s='hits', n='n')} FROM a")
def recall_mrr_chosen(spark, sf_dir):
    """Two arms, named in another order than the listed one: they run in that."""
    return E.recall_mrr(_scores(spark, sf_dir, chosen("bm25_rules,keyword")), ["arm"], K)


@query(f"""WITH {t.CHUNKS}, gold AS (SELECT item_id AS qid, {t.normalize_sql('text')} AS span FROM benchmark WHERE item_id % 17 <> 0 AND text <> ''), c AS MATERIALIZED (SELECT {t.normalize_sql('content')} AS text FROM chunks),
sc AS (SELECT qid, CASE WHEN EXISTS (SELECT 1 FROM c WHERE contains(c.text, span)) THEN 1 END AS rank FROM gold), a AS (SELECT count(*) AS n, count(rank) AS hits, round(avg(coalesce(1 / rank, 0)), 6) AS mrr FROM sc)
SELECT 'everything' AS arm, n, hits, round(hits / n, 6) AS recall, mrr, {WILSON.format(s='hits', n='n')} FROM a""")
def recall_mrr_unranked(spark, sf_dir):
    """The arm that hands over the whole corpus: what it contains counts as rank 1."""
    gold = E.scorable(_gold(spark, sf_dir))
    return E.recall_mrr(E.unranked(t.chunks(spark, sf_dir), gold).withColumn("arm", F.lit("everything")), ["arm"], K)


MCNEMAR = """CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(b, c)::BIGINT + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) + (b + c) * ln(0.5))))) END"""


def _pairs(spark, sf_dir):
    scores = _scores(spark, sf_dir)
    rows = []
    for i, (a, b) in enumerate(zip(ARMS, ARMS[1:], strict=False)):
        rows.append(E.discordant(scores, a, b, K).select(F.lit(i).alias("i"), F.lit(a).alias("first"), F.lit(b).alias("second"), "improved", "regressed"))
    return stacked(*rows).withColumn("p", F.round(E.mcnemar(F.col("improved"), F.col("regressed")), 6))


PAIRS = HITS + f""", d AS (SELECT x.ord AS i, x.arm AS first, y.arm AS second, count(*) FILTER (coalesce(y.rank <= {K}, false) AND NOT coalesce(x.rank <= {K}, false)) AS b, count(*) FILTER (coalesce(x.rank <= {K}, false) AND NOT coalesce(y.rank <= {K}, false)) AS c
  FROM sc x JOIN sc y ON x.qid = y.qid AND y.ord = x.ord + 1 GROUP BY ALL), p AS (SELECT i::INT AS i, first, second, b AS improved, c AS regressed, round({MCNEMAR}, 6) AS p FROM d)"""


@query(PAIRS + " SELECT * FROM p")
def mcnemar_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query(PAIRS + ", hs AS (SELECT i, p, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, i) + 1) * p) AS s FROM p) SELECT i, p, round(max(s) OVER (ORDER BY p, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS p_holm FROM hs")
def holm_adjust(spark, sf_dir):
    return E.holm(_pairs(spark, sf_dir).select("i", "p")).withColumn("p_holm", F.round("p_holm", 6))


@query(f"WITH x AS (SELECT source, count(*) AS n, count(*) FILTER (n_chars > 1000) AS s FROM documents GROUP BY source) SELECT source, n, s, {WILSON.format(s='s', n='n')} FROM x")
def wilson_ci(spark, sf_dir):
    d = t.read(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") > 1000).alias("s"))
    lo, hi = E.wilson(F.col("s"), F.col("n"))
    return d.select("source", "n", "s", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query("WITH x AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT source, n, round(CASE WHEN n * 0.25 <= 0 THEN 1 ELSE 2.8 * sqrt(n * 0.25::DOUBLE) / n END, 6) AS mde FROM x")
def mde_table(spark, sf_dir):
    d = t.read(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return d.select("source", "n", F.round(E.detectable(F.col("n")), 6).alias("mde"))


def _graded(spark, sf_dir):
    """Labels as graded answers: toxic is forbidden, else quality is permitted, else unstated; the stance goes by number."""
    i = F.pmod("doc_id", F.lit(5)).cast("int")
    cls = F.when(F.col("toxic") == 1, "forbidden").when(F.col("quality") == 1, "permitted").otherwise("unstated")
    return t.read(spark, sf_dir, "labels").select("doc_id", cls.alias("answer_class"), T.stance(F.concat(F.lit("It is "), F.lower(F.element_at(F.array(*map(F.lit, T.STANCES)), i + 1)))).alias("stance"))


GRADED = "WITH g AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'forbidden' WHEN quality = 1 THEN 'permitted' ELSE 'unstated' END AS answer_class, ['PERMITTED', 'FORBIDDEN', 'FACTUAL', 'UNSTATED', 'UNCLEAR'][(doc_id % 5)::INT + 1] AS stance FROM labels), m AS (SELECT *, CASE answer_class WHEN 'unstated' THEN stance = 'UNSTATED' WHEN 'forbidden' THEN stance IN ('FORBIDDEN', 'FACTUAL') ELSE stance IN ('PERMITTED', 'FORBIDDEN', 'FACTUAL') END AS ok FROM g)"


@query(GRADED + " SELECT doc_id, answer_class, stance, ok FROM m")
def stance_match(spark, sf_dir):
    return _graded(spark, sf_dir).withColumn("ok", E.stance_matches(F.col("stance"), F.col("answer_class")))


@query(GRADED + f", x AS (SELECT count(*) FILTER (answer_class IN ('forbidden', 'unstated')) AS eligible, count(*) FILTER (answer_class IN ('forbidden', 'unstated') AND stance = 'PERMITTED') AS bad FROM g) SELECT eligible, bad, round(CASE WHEN eligible = 0 THEN 0 ELSE bad / eligible END, 6) AS rate, {WILSON.format(s='bad', n='eligible')} FROM x")
def false_permission(spark, sf_dir):
    return E.false_permissions(_graded(spark, sf_dir))


@query(GRADED + " SELECT count(*) FILTER (answer_class = 'permitted') AS eligible, count(*) FILTER (answer_class = 'permitted' AND ok) AS ok, count(*) FILTER (answer_class = 'permitted' AND stance = 'UNSTATED') AS declined, count(*) FILTER (answer_class = 'permitted' AND stance = 'UNCLEAR') AS ungradeable FROM m")
def refusal_counterweight(spark, sf_dir):
    return E.refusal_counterweight(_graded(spark, sf_dir))


@query(GRADED + f", x AS (SELECT answer_class, count(*) AS n, count(*) FILTER (ok) AS k FROM m GROUP BY answer_class) SELECT answer_class, n, k AS ok, round(k / n, 6) AS accuracy, {WILSON.format(s='k', n='n')} FROM x")
def stratum_accuracy(spark, sf_dir):
    return E.stratum_accuracy(_graded(spark, sf_dir))


@query(GRADED + " SELECT answer_class, count(*) AS n FROM g GROUP BY answer_class")
def strata_counts(spark, sf_dir):
    return _graded(spark, sf_dir).groupBy("answer_class").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def failed_rows(spark, sf_dir):
    """Selected rows that were never completed."""
    return t.read(spark, sf_dir, "documents").select("doc_id").join(t.read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


KEYED = """WITH w AS (SELECT doc_id, left(sha256(json_object('q', text, 'lang', lang)), 16) AS key FROM documents), c AS (SELECT DISTINCT key FROM w WHERE doc_id IN (SELECT doc_id FROM labels))"""


def _keys(spark, sf_dir):
    return t.read(spark, sf_dir, "documents").select("doc_id", E.checkpoint_key([F.col("text").alias("q"), "lang"]).alias("key"))


@query(KEYED + " SELECT doc_id, key, key IN (SELECT key FROM c) AS cached FROM w")
def checkpoint_resume(spark, sf_dir):
    """A cache that holds what is labelled: rows whose content-derived key it has, and the rest. Its last line per key counts."""
    w = _keys(spark, sf_dir)
    cache = w.join(t.read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("key", F.col("doc_id").alias("line_no"), F.col("doc_id").alias("row"))
    done, todo = E.split_cached(w, cache)
    return stacked(done.select("doc_id", "key", F.lit(True).alias("cached")), todo.select("doc_id", "key", F.lit(False).alias("cached")))


@query("WITH w AS (SELECT doc_id, sha256(coalesce(text, '')) AS key FROM documents), c AS (SELECT DISTINCT key FROM w WHERE doc_id % 2 = 0) SELECT CASE WHEN key IN (SELECT key FROM c) THEN 'cached' ELSE 'needed' END AS state, count(*) AS n, count(DISTINCT key) AS n_keys FROM w GROUP BY 1")
def cache_split(spark, sf_dir):
    """A content-addressed cache that has seen every other document."""
    w = t.read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    cached, needed = P.split_cached(w, w.where("doc_id % 2 = 0"))
    both = stacked(cached.withColumn("state", F.lit("cached")), needed.withColumn("state", F.lit("needed")))
    return both.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("n_keys"))


BATCHES = f"""WITH RECURSIVE q AS (SELECT doc_id // 1000 AS queue, doc_id AS pos, {t.tokens_sql("coalesce(text, '')")} AS s, row_number() OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id) AS r FROM documents),
w AS (SELECT queue, 0::BIGINT AS r, NULL::BIGINT AS pos, 0::BIGINT AS batch, 0::BIGINT AS n, 0::BIGINT AS t FROM (SELECT DISTINCT queue FROM q) UNION ALL
  SELECT w.queue, q.r, q.pos, batch + f::INT, CASE WHEN f THEN 1 ELSE n + 1 END, CASE WHEN f THEN q.s ELSE t + q.s END FROM (SELECT w.*, n > 0 AND (n >= 64 OR t + s > 8000) AS f, q.r AS qr FROM w JOIN q ON q.queue = w.queue AND q.r = w.r + 1) w JOIN q ON q.queue = w.queue AND q.r = w.qr),
packed AS (SELECT queue, pos, batch FROM w WHERE r > 0)"""


def _batches(spark, sf_dir):
    d = t.read(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 1000).alias("queue"), F.col("doc_id").alias("pos"), T.est_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    return d, P.greedy_batches(d)


@query(BATCHES + " SELECT * FROM packed")
def greedy_batches(spark, sf_dir):
    return _batches(spark, sf_dir)[1]


@query(BATCHES + ", b AS (SELECT queue, max(batch) + 1 AS n FROM packed GROUP BY queue), s AS (SELECT queue, sum(s) AS tokens FROM q GROUP BY queue) SELECT queue, n AS batches, ceil(greatest(n / 3, tokens / 10000))::BIGINT AS minutes FROM b JOIN s USING (queue)")
def batch_minutes(spark, sf_dir):
    d, b = _batches(spark, sf_dir)
    n = b.groupBy("queue").agg((F.max("batch") + 1).alias("batches"))
    s = d.groupBy("queue").agg(F.sum("tokens").alias("tokens"))
    return n.join(s, "queue").select("queue", "batches", P.minutes_left(F.col("batches"), F.col("tokens")).alias("minutes"))


@query(f"SELECT count(*) AS n, count(*) FILTER (role = 'user') AS attached, round(avg((role = 'user')::INT), 6) AS share, coalesce(sum({t.tokens_sql('text')}), 0)::BIGINT AS input_tokens, coalesce(sum(length(text)), 0)::BIGINT AS output_tokens FROM conversations")
def search_share(spark, sf_dir):
    c = t.read(spark, sf_dir, "conversations").select((F.col("role") == "user").alias("used_search"), T.est_tokens(F.col("text")).alias("input_tokens"), F.length("text").alias("output_tokens"))
    return E.search_share(c)


@query("SELECT item_id AS qid, left(sha256('corpus'), 20) AS doc_sha FROM benchmark")
def index_agreement(spark, sf_dir):
    """Labels and index agree in the first 16 digits, or the query fails."""
    gold = t.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.substring(F.sha2(F.lit("corpus"), 256), 1, 20).alias("doc_sha"))
    return E.index_agrees(gold, spark.range(1).select(F.sha2(F.lit("corpus"), 256).alias("doc_sha")))


@query(GRADED + " SELECT doc_id, answer_class FROM g WHERE answer_class IN ('forbidden', 'unstated')")
def strata_rows(spark, sf_dir):
    """All rows of the chosen strata: what a run without a limit works on."""
    return _graded(spark, sf_dir).where(F.col("answer_class").isin("forbidden", "unstated")).select("doc_id", "answer_class")


@query(GRADED + " SELECT doc_id, answer_class FROM g WHERE answer_class IN ('forbidden', 'unstated') ORDER BY doc_id LIMIT 25")
def strata_selection(spark, sf_dir):
    """Chosen strata, and the first 25 rows of them: a run's own limit."""
    return _graded(spark, sf_dir).where(F.col("answer_class").isin("forbidden", "unstated")).select("doc_id", "answer_class").orderBy("doc_id").limit(25)


@query("SELECT doc_id // 100 AS request, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM documents GROUP BY 1")
def restore_order(spark, sf_dir):
    """Responses that arrive in any order, back in the order of their requests."""
    d = t.read(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 100).alias("request"), "doc_id")
    return d.groupBy("request").agg(F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("ids"))

"""Registered queries: text, index, retrieval, assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.functions import shape as S
from marlspike.functions import text as T
from marlspike.operators import assembly as A
from marlspike.operators import retrieval as R
from marlspike.plans import tables as t
from marlspike.sources import files
from marlspike.sources.scratch import cut

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {t.CHUNKS}, x AS (SELECT id, {t.terms_sql('content')} AS ts FROM chunks) SELECT id, len(ts)::INT AS n_terms, md5(array_to_string(ts, ' ')) AS terms_md5 FROM x")
def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = t.chunks(spark, sf_dir).select("id", T.terms(F.col("content")).alias("ts"))
    return df.select("id", F.size("ts").alias("n_terms"), F.md5(F.array_join("ts", " ")).alias("terms_md5"))


@query(f"WITH {t.CHUNKS}, x AS (SELECT id, {t.keywords_sql('content')} AS ts FROM chunks) SELECT id, len(ts)::INT AS n_terms, md5(array_to_string(ts, ' ')) AS terms_md5 FROM x")
def keyword_tokens(spark, sf_dir):
    df = t.chunks(spark, sf_dir).select("id", T.keywords(F.col("content")).alias("ts"))
    return df.select("id", F.size("ts").alias("n_terms"), F.md5(F.array_join("ts", " ")).alias("terms_md5"))


@query(f"""WITH {t.CHUNKS} SELECT id, {t.tokens_sql('content')} AS est_tokens, sha256(content) AS sha,
  'rulebook:' || left(sha256('rulebook ' || array_to_string(path, ' > ') || ' ' || content), 12) AS chunk_id,
  length(array_to_string(path, ' > ') || chr(10) || chr(10) || content)::INT AS embed_len, length(array_to_string(path, ' ') || ' ' || content)::INT AS index_len, length(array_to_string(path, ' > ') || chr(10) || content)::INT AS rerank_len FROM chunks""")
def chunk_ids(spark, sf_dir):
    p, c = F.col("path"), F.col("content")
    return t.chunks(spark, sf_dir).select(
        "id", T.est_tokens(c).alias("est_tokens"), F.sha2("content", 256).alias("sha"), T.chunk_id(F.lit("rulebook"), p, c).alias("chunk_id"),
        T.units(T.embed_input(p, F.col("title"), c)).alias("embed_len"), T.units(T.index_input(p, c)).alias("index_len"), T.units(T.rerank_input(p, c)).alias("rerank_len"),
    )


@query(f"WITH {t.CHUNKS}, x AS (SELECT id, {t.normalize_sql('content')} AS s FROM chunks) SELECT id, length(s)::INT AS n, md5(s) AS normal_md5, len(list_filter(string_split(s, ' '), lambda w: w <> ''))::INT AS n_words FROM x")
def normalize_text(spark, sf_dir):
    df = t.chunks(spark, sf_dir).select("id", T.normalize(F.col("content")).alias("s"))
    return df.select("id", F.length("s").alias("n"), F.md5("s").alias("normal_md5"), F.size(T.words_of(F.col("s"))).alias("n_words"))


@query(f"""WITH {t.CHUNKS} SELECT id, CASE WHEN page_start IS NULL THEN '' WHEN page_end <> page_start THEN ' (pp. ' || page_start || '-' || page_end || ')' ELSE ' (p. ' || page_start || ')' END AS label,
  CASE doc_type WHEN 'cards' THEN 'cards:' || array_to_string(path[1:len(path) - 1], ' > ') ELSE array_to_string(path[1:len(path) - 1], ' > ') END AS group_key,
  left(regexp_replace(lower(content), '[^a-z]', '', 'g'), 7) AS toc_key, len(regexp_extract_all(content, '\\*\\*[^*]+\\*\\*|`[^`]+`'))::INT AS n_marks,
  CASE WHEN left(regexp_replace(content, '\\n+', ' ', 'g'), 160) = '' THEN '(none)' ELSE left(regexp_replace(content, '\\n+', ' ', 'g'), 160) END AS snippet FROM chunks""")
def text_labels(spark, sf_dir):
    c = F.col("content")
    return t.chunks(spark, sf_dir).select(
        "id", T.page_label(F.col("page_start"), F.col("page_end")).alias("label"), T.group_key(F.col("doc_type"), F.col("path")).alias("group_key"), T.toc_key(c).alias("toc_key"),
        F.size(T.inline_marks(c)).alias("n_marks"), T.snippet(c, 160, "(none)").alias("snippet"),
    )


@query(f"""WITH {t.CHUNKS}, x AS (SELECT id, {t.terms_sql('content')} AS ts FROM chunks), u AS (SELECT id, unnest(ts) AS term FROM x),
p AS (SELECT id, term, count(*) AS tf FROM u GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, max(tf) AS max_tf FROM p GROUP BY term""")
def postings_terms(spark, sf_dir):
    return R.postings(R.tokenized(t.chunks(spark, sf_dir))).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


@query(f"WITH {t.CHUNKS}, x AS (SELECT {t.terms_sql('content')} AS ts FROM chunks) SELECT count(*) AS n, round(avg(len(ts)), 6) AS avg_len FROM x")
def bm25_index_stats(spark, sf_dir):
    return R.Lexical(t.chunks(spark, sf_dir)).stats().select("n", F.round("avg_len", 6).alias("avg_len"))


@query(f"WITH {t.CHUNKS} SELECT doc_type, count(*) AS n, (count(*) * 64 * 4)::BIGINT AS bytes FROM chunks GROUP BY doc_type")
def manifest_by_type(spark, sf_dir):
    m = files.manifest(t.chunks(spark, sf_dir), "table", 64)
    return m.select(F.explode("by_type").alias("doc_type", "n")).select("doc_type", "n", (F.col("n") * 64 * 4).alias("bytes"))


@query("SELECT true AS ready, 'table' AS model, count(*) AS count, left(sha256(count(*)::VARCHAR), 12) AS doc_sha FROM documents")
def index_info(spark, sf_dir):
    m = files.manifest(t.chunks(spark, sf_dir), "table", 64)
    return files.index_info(m.withColumn("doc_sha", F.sha2(F.col("count").cast("string"), 256)))


@query(f"WITH {t.CHUNKS}, {t.QUESTIONS}, {t.bm25_sql('qs', 'best', 8)} SELECT qid, id, score, rank FROM best")
def bm25_top8(spark, sf_dir):
    return R.bm25_top(t.chunks(spark, sf_dir), t.questions(spark, sf_dir), 8).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {t.CHUNKS}, {t.QUESTIONS}, {t.bm25_sql('qs', 'wide', 80)} SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank
FROM wide JOIN chunks USING (id) WHERE doc_type = 'rulebook' QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 40""")
def bm25_doctype_overfetch(spark, sf_dir):
    return R.bm25_of_types(t.chunks(spark, sf_dir), t.questions(spark, sf_dir), ["rulebook"]).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


KEYWORD = f"""WITH {t.CHUNKS}, {t.QUESTIONS}, h AS (SELECT DISTINCT id, unnest({t.keywords_sql('content')}) AS term FROM chunks),
a AS (SELECT qid, unnest({t.keywords_sql('question')}) AS term FROM qs), d AS (SELECT term, count(*) AS df FROM h GROUP BY term),
s AS (SELECT qid, h.id, round(sum(ln(((SELECT count(*) FROM chunks) + 1) / (df + 1)) + 1), 6) AS score FROM a JOIN h USING (term) JOIN d USING (term) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s)"""


@query(KEYWORD + "SELECT qid, id, score, rank FROM best WHERE rank <= 8")
def keyword_idf_top8(spark, sf_dir):
    return R.top(R.keyword_scores(t.chunks(spark, sf_dir), t.questions(spark, sf_dir)), 8, F.desc("score"), F.col("id")).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(KEYWORD.replace("WITH ", "WITH RECURSIVE ", 1) + """,
lim AS (SELECT qid, id, rank, length(content) AS size FROM best JOIN chunks USING (id)),
walk AS (SELECT qid, 0::BIGINT AS rank, 0 AS n, 9000::BIGINT AS budget, NULL::BIGINT AS id FROM (SELECT DISTINCT qid FROM lim) UNION ALL
  SELECT w.qid, l.rank, w.n + (w.n < 6 AND l.size <= w.budget)::INT, w.budget - CASE WHEN w.n < 6 AND l.size <= w.budget THEN l.size ELSE 0 END, CASE WHEN w.n < 6 AND l.size <= w.budget THEN l.id END FROM walk w JOIN lim l ON l.qid = w.qid AND l.rank = w.rank + 1),
ok AS (SELECT qid, id, n::BIGINT AS rank FROM walk WHERE id IS NOT NULL),
f AS (SELECT id, row_number() OVER (ORDER BY id) AS r FROM chunks), fit AS (SELECT min(id) AS id FROM chunks WHERE length(content) <= 9000),
none AS (SELECT qid, qid IN (SELECT qid FROM a) AS has FROM qs WHERE qid NOT IN (SELECT qid FROM ok))
SELECT qid, id, rank FROM ok UNION ALL SELECT qid, fit.id, 1 FROM none, fit WHERE has AND fit.id IS NOT NULL
UNION ALL SELECT qid, f.id, f.r FROM none, f WHERE f.r <= CASE WHEN NOT has THEN 6 WHEN (SELECT id FROM fit) IS NULL THEN 2 ELSE 0 END""")
def keyword_budget(spark, sf_dir):
    return R.keyword_budget(t.chunks(spark, sf_dir), t.questions(spark, sf_dir)).select("qid", "id", F.col("rank").cast("long").alias("rank"))


def _dense(spark, sf_dir, k=R.PER_ARM):
    return R.dense_top(t.vectors(spark, sf_dir), t.hybrid(spark, sf_dir).select("qid", "vector"), k).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH q AS (SELECT vec_id AS qid, embedding AS vector, label AS own FROM embeddings WHERE vec_id % 100 = 0),
d AS (SELECT qid, own, vec_id AS id, label, round(list_cosine_similarity(vector::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM q, embeddings)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM d QUALIFY rank <= 40""")
def dense_top40(spark, sf_dir):
    v = t.vectors(spark, sf_dir)
    return R.dense_top(v, v.where("id % 100 = 0").withColumnRenamed("id", "qid")).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH v AS (SELECT vec_id, embedding FROM embeddings), q AS (SELECT vec_id AS qid, embedding AS vector FROM v WHERE vec_id % 100 = 0),
d AS (SELECT qid, vec_id AS id, round(list_cosine_similarity(vector::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM q, v JOIN documents ON doc_id = vec_id WHERE source IN ('src0', 'src1', 'src2', 'src3'))
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM d QUALIFY rank <= 40""")
def dense_doctype(spark, sf_dir):
    v = t.vectors(spark, sf_dir)
    rules = t.chunks(spark, sf_dir).where(F.col("doc_type") == "rulebook").select("id")
    return R.dense_top(v.join(rules, "id", "left_semi"), v.where("id % 100 = 0").withColumnRenamed("id", "qid")).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH q AS (SELECT vec_id AS qid, embedding AS vector, label AS own FROM embeddings WHERE vec_id % 100 = 0),
d AS (SELECT qid, own, label, vec_id AS id, round(list_cosine_similarity(vector::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM d QUALIFY rank <= 10)
SELECT own AS label, count(*) AS n, round(avg((own = label)::INT), 6) AS purity FROM r GROUP BY own""")
def knn_label_purity(spark, sf_dir):
    e = t.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    v = t.vectors(spark, sf_dir)
    hits = R.dense_top(v, v.where("id % 100 = 0").withColumnRenamed("id", "qid"), 10)
    both = hits.join(e.withColumnsRenamed({"label": "near"}), "id").join(e.withColumnsRenamed({"id": "qid"}), "qid")
    return both.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("label") == F.col("near")).cast("int")), 6).alias("purity"))


def _sparse(spark, sf_dir):
    return R.bm25_top(t.chunks(spark, sf_dir), t.hybrid(spark, sf_dir).select("qid", "question"), R.PER_ARM)


def _fused(spark, sf_dir, dense=None):
    return R.fuse([("dense", dense if dense is not None else _dense(spark, sf_dir)), ("sparse", _sparse(spark, sf_dir))])


@query(t.FUSED + " SELECT qid, id, score, dense_rank, sparse_rank, rank FROM fused")
def rrf_hybrid(spark, sf_dir):
    return _fused(spark, sf_dir).select("qid", "id", "score", F.col("dense_rank").cast("long").alias("dense_rank"), F.col("sparse_rank").cast("long").alias("sparse_rank"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {t.CHUNKS}, {t.HYBRID}, {t.bm25_sql('hq', 'sparse', 40)} SELECT qid, id, round(1.0::DOUBLE / (60 + rank), 6) AS score, rank FROM sparse")
def rrf_single_arm(spark, sf_dir):
    return R.fuse([("sparse", _sparse(spark, sf_dir))]).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


def _scorer():
    q, c = F.array_distinct(T.terms(F.col("question"))), F.array_distinct(T.terms(F.col("content")))
    return F.size(F.array_intersect(q, c)) / F.greatest(F.size(q), F.lit(1))


@query(t.FUSED + f""", c AS (SELECT f.*, list_distinct({t.terms_sql('question')}) AS qt, list_distinct({t.terms_sql('content')}) AS ct FROM fused f JOIN hq USING (qid) JOIN chunks USING (id) WHERE rank <= 40),
s AS (SELECT qid, id, rank AS fused_rank, round(len(list_intersect(qt, ct)) / greatest(len(qt), 1), 4) AS score FROM c)
SELECT qid, id, fused_rank, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, fused_rank) AS rank FROM s""")
def rerank_standin(spark, sf_dir):
    """A stand-in scorer (share of the question's terms), not a cross-encoder."""
    texts = t.chunks(spark, sf_dir).select("id", "content")
    df = _fused(spark, sf_dir).where("rank <= 40").join(texts, "id").join(t.hybrid(spark, sf_dir).select("qid", "question"), "qid")
    out = R.rerank(df, _scorer())
    return out.select("qid", "id", F.col("fused_rank").cast("long").alias("fused_rank"), "score", F.col("rank").cast("long").alias("rank"))


def _options(spark, sf_dir):
    s = F.col("shape")
    return t.hybrid(spark, sf_dir).select("qid", "shape", S.option(s, 0).alias("k"), S.option(s, 1).alias("per_arm"), S.option(s, 2).alias("section_complete"), S.option(s, 3).alias("floor"), S.effort(s).alias("effort"))


@query(f"WITH {t.HYBRID} SELECT qid, shape, CASE shape WHEN 'prohibition' THEN 10 ELSE 8 END AS k, 40 AS per_arm, shape = 'prohibition' AS section_complete, CASE shape WHEN 'prohibition' THEN 4 ELSE 2 END AS floor, CASE shape WHEN 'prohibition' THEN 'medium' ELSE 'low' END AS effort FROM hq")
def production_options(spark, sf_dir):
    return _options(spark, sf_dir)


def _floored(spark, sf_dir):
    from pyspark.sql.window import Window

    info = t.chunks(spark, sf_dir).select("id", "doc_type")
    known = _fused(spark, sf_dir).join(info, "id").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    return R.rule_floor(known.select("qid", "id", "score", "doc_type", "rank"), _options(spark, sf_dir))


@query(t.FLOORED + " SELECT qid, id, doc_type, promoted, rank FROM floored")
def rulebook_floor(spark, sf_dir):
    return _floored(spark, sf_dir).select("qid", "id", "doc_type", "promoted", F.col("rank").cast("long").alias("rank"))


def _selected(spark, sf_dir):
    """Written once: the expansion reads the ranking three times, and what follows reads it again."""
    return cut(R.section_complete(cut(_floored(spark, sf_dir), "floored"), t.chunks(spark, sf_dir), _options(spark, sf_dir)), "selected")


@query(t.COMPLETE + " SELECT qid, id, round(score, 6) AS score, rank::BIGINT AS rank, sibling FROM hits")
def section_complete(spark, sf_dir):
    return _selected(spark, sf_dir).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"), "sibling")


@query(t.FUSED + f" SELECT f.qid, f.id, f.rank, c.doc_type, {t.tokens_sql('content')} AS tokens FROM fused f JOIN chunks c USING (id)")
def materialize_hits(spark, sf_dir):
    c = t.chunks(spark, sf_dir).select("id", "doc_type", T.est_tokens(F.col("content")).alias("tokens"))
    return R.materialize(_fused(spark, sf_dir).select("qid", "id", F.col("rank").cast("long").alias("rank")), c)


@query(f"WITH {t.CHUNKS} SELECT ordinal, id, doc_type, title FROM chunks WHERE id = 7")
def point_lookup(spark, sf_dir):
    """One chunk by its id: the filter reaches the scan."""
    return t.chunks(spark, sf_dir).where("id = 7").select("ordinal", "id", "doc_type", "title")


@query("SELECT vec_id AS id, len(embedding)::INT AS width, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def vector_checks(spark, sf_dir):
    """All vectors are 64 wide, or the query fails."""
    v = files.checked_vectors(t.vectors(spark, sf_dir), 64)
    return v.select("id", F.size("vector").alias("width"), F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), 6).alias("norm"))


@query(f"WITH {t.CHUNKS}, x AS (SELECT doc_type, count(*) AS n, sum(length(content))::BIGINT AS chars FROM chunks GROUP BY doc_type) SELECT '| ' || doc_type || ' | ' || n || ' | ' || chars || ' |' AS line FROM x UNION ALL SELECT '| type | chunks | chars |' UNION ALL SELECT '|---|---|---|'")
def report_table(spark, sf_dir):
    x = t.chunks(spark, sf_dir).groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))
    return files.markdown_table(x, ["type", "chunks", "chars"])


@query(t.FUSED + " SELECT h.qid, shape, shape = 'prohibition' OR coalesce(score, 0) < 0.02 AS attach FROM hq h LEFT JOIN fused f ON f.qid = h.qid AND f.rank = 1")
def search_attach_gate(spark, sf_dir):
    return R.weak_evidence(t.hybrid(spark, sf_dir), _fused(spark, sf_dir))


@query(t.FUSED + ", x AS (SELECT qid, id, score, rank, 'fused' AS list FROM fused WHERE rank <= 12 UNION ALL SELECT qid, id, score, rank, 'dense' FROM dense WHERE rank <= 12) SELECT qid, list, string_agg(id || ':' || rank || ':' || CASE list WHEN 'fused' THEN format('{:.5f}', round(score, 5)) ELSE format('{:.4f}', round(score, 4)) END, ' ' ORDER BY rank) AS entries FROM x GROUP BY qid, list")
def trace_rows(spark, sf_dir):
    dense = cut(_dense(spark, sf_dir), "dense")
    d = R.trace(dense, 4).withColumn("list", F.lit("dense"))
    return R.trace(_fused(spark, sf_dir, dense), 5).withColumn("list", F.lit("fused")).unionByName(d)


@query(t.FUSED + " SELECT f.qid, f.id, f.rank, d.rank AS dense_rank, d.rank - f.rank AS move FROM fused f LEFT JOIN dense d ON d.qid = f.qid AND d.id = f.id AND d.rank <= 12 WHERE f.rank <= 10")
def trace_moves(spark, sf_dir):
    dense = cut(_dense(spark, sf_dir), "dense")
    out = R.rank_moves(dense, _fused(spark, sf_dir, dense).where("rank <= 10"))
    return out.select("qid", "id", F.col("rank").cast("long").alias("rank"), F.col("dense_rank").cast("long").alias("dense_rank"), F.col("move").cast("long").alias("move"))


@query(t.COMPLETE + " SELECT h.qid, h.id, h.rank::BIGINT AS rank, sibling, d.rank AS dense_rank, d.rank - h.rank AS move FROM hits h LEFT JOIN dense d ON d.qid = h.qid AND d.id = h.id AND d.rank <= 12")
def trace_siblings(spark, sf_dir):
    """The moves of what an answer is given, with what came as a section's sibling marked."""
    out = R.rank_moves(_dense(spark, sf_dir), _selected(spark, sf_dir))
    return out.select("qid", "id", F.col("rank").cast("long").alias("rank"), "sibling", F.col("dense_rank").cast("long").alias("dense_rank"), F.col("move").cast("long").alias("move"))


def _placed(spark, sf_dir):
    hits = _selected(spark, sf_dir).select("qid", "id", "rank").join(t.chunks(spark, sf_dir), "id")
    return A.spans(hits)


@query(t.SPANS + " SELECT qid, doc_no::INT AS doc_no, title, md5(text) AS text_md5, length(text)::INT AS n_units, n_spans FROM assembled")
def assemble_documents(spark, sf_dir):
    return A.documents(_placed(spark, sf_dir)).select("qid", "doc_no", "title", F.md5("text").alias("text_md5"), T.units(F.col("text")).alias("n_units"), "n_spans")


CITED = """, cites AS (SELECT qid * 10 + c AS cid, qid, CASE c WHEN 4 THEN 'web_search_result_location' WHEN 5 THEN 'page_location' ELSE 'char_location' END AS type,
  CASE c WHEN 3 THEN 99 ELSE c % 3 END AS doc_no, CASE c WHEN 0 THEN NULL ELSE c * 700 END AS at_, CASE c WHEN 4 THEN 'https://www.host' || qid || '.example/p' END AS url, CASE c WHEN 5 THEN 7 END AS page FROM hq, range(6) r(c)),
r AS (SELECT c.*, a.title AS doc_title, p.id, p.page_start, p.page_end, p.title AS span_title, p.doc_type,
  row_number() OVER (PARTITION BY c.cid ORDER BY (p.start <= coalesce(c.at_, 0)) DESC, CASE WHEN p.start <= coalesce(c.at_, 0) THEN -p.start ELSE p.start END) AS pick
  FROM cites c LEFT JOIN assembled a ON a.qid = c.qid AND a.doc_no = c.doc_no LEFT JOIN placed p ON p.qid = c.qid AND p.doc_no = c.doc_no QUALIFY pick = 1),
resolved AS (SELECT cid, qid, type = 'web_search_result_location' OR doc_title IS NOT NULL AS resolved,
  CASE WHEN type = 'char_location' AND doc_title IS NOT NULL THEN id END AS chunk_id,
  CASE WHEN doc_title IS NULL OR c4 THEN NULL WHEN type = 'page_location' THEN page ELSE page_start END::INT AS page,
  CASE WHEN doc_title IS NULL OR c4 OR type = 'page_location' THEN NULL ELSE page_end END::INT AS page_end,
  CASE WHEN c4 THEN url WHEN doc_title IS NULL THEN NULL WHEN type = 'page_location' THEN doc_title ELSE span_title END AS title,
  CASE WHEN c4 THEN 'web' WHEN doc_title IS NULL THEN NULL WHEN type = 'page_location' THEN 'rulebook' ELSE doc_type END AS doc_type,
  CASE WHEN c4 THEN 'web' WHEN doc_title IS NOT NULL THEN 'corpus' END AS source FROM (SELECT *, type = 'web_search_result_location' AS c4 FROM r))"""


@query(t.SPANS + CITED + " SELECT * FROM resolved")
def resolve_citations(spark, sf_dir):
    placed = cut(_placed(spark, sf_dir), "placed")
    c = F.col("c")
    cites = t.hybrid(spark, sf_dir).select("qid").withColumn("c", F.explode(F.array(*map(F.lit, range(6))))).select(
        (F.col("qid") * 10 + c).alias("cid"), "qid", F.when(c == 4, "web_search_result_location").when(c == 5, "page_location").otherwise("char_location").alias("type"),
        F.when(c == 3, 99).otherwise(c % 3).alias("document_index"), F.when(c != 0, c * 700).alias("start_char_index"), F.lit("").alias("cited_text"),
        F.when(c == 4, F.concat(F.lit("https://www.host"), F.col("qid").cast("string"), F.lit(".example/p"))).alias("url"), F.lit(None).cast("string").alias("title"),
        F.when(c == 5, 7).alias("start_page"), F.lit(None).cast("int").alias("end_page"),
    )
    return A.resolve(cites, A.documents(placed), placed)


@query("""SELECT page_id, coalesce(nullif(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '^www\\.', ''), ''), 'web') AS label,
  'Rulebook p.' || page_id || ' - a > b' AS rule_label, CASE WHEN page_id % 2 = 0 THEN 'up p.' || page_id ELSE 'up' END AS upload_label FROM pages""")
def citation_labels(spark, sf_dir):
    p, none = F.col("page_id"), F.lit(None)
    path = F.array(F.lit("a"), F.lit("b"))
    return t.read(spark, sf_dir, "pages").select(
        "page_id", T.citation_label(F.lit("web"), F.col("url"), F.lit("web"), F.array(), F.lit(""), none, none).alias("label"),
        T.citation_label(F.lit("corpus"), none, F.lit("rulebook"), path, F.lit("t"), p, p).alias("rule_label"),
        T.citation_label(F.lit("corpus"), none, F.lit("upload"), F.array(), F.lit("up"), F.when(p % 2 == 0, p), none).alias("upload_label"),
    )


@query("""WITH c AS (SELECT conv_id AS mid, turn AS seq, role AS source, '' AS url, left(md5(text), 1) AS label, left(text, 20) AS quote FROM conversations),
f AS (SELECT mid, source, url, label, quote, min(seq) AS seq FROM c GROUP BY ALL)
SELECT mid, source, url, label, min(seq) AS seq, coalesce(string_agg(quote, '|' ORDER BY seq) FILTER (quote <> ''), '') AS quotes, (count(*) FILTER (quote <> ''))::INT AS n_quotes FROM f GROUP BY ALL""")
def dedupe_citations(spark, sf_dir):
    c = t.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("mid"), F.col("turn").alias("seq"), F.col("role").alias("source"), F.lit("").alias("url"), F.left(F.md5("text"), F.lit(1)).alias("label"), F.left("text", F.lit(20)).alias("quote"))
    return A.dedupe_citations(c)

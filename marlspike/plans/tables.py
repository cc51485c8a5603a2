"""How the given tables stand for the model's entities, once for Spark and once as SQL.

Documents are chunks (four sources as rulebook, the others as cards), and, with marks and headings put before some of their
lines, markdown files. Benchmark items are questions and gold spans. Vectors and documents share ids; the hybrid queries are
those whose id is divisible by 100.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.functions import text as T

RULE_SOURCES = ("src0", "src1", "src2", "src3")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.coalesce(F.col("source").isin(*RULE_SOURCES), F.lit(False))
    page = (F.floor(F.col("doc_id") / 10) + 1).cast("int")
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("ordinal"), F.coalesce("text", F.lit("")).alias("content"), F.when(rule, "rulebook").otherwise("cards").alias("doc_type"),
        F.array("lang", "source", F.col("doc_id").cast("string")).alias("path"), F.concat(F.lit("Title "), F.col("doc_id").cast("string")).alias("title"),
        F.when(rule, page).alias("page_start"), F.when(rule, page + (F.col("n_chars") > 2000).cast("int")).alias("page_end"),
    )


CHUNKS = f"""chunks AS (SELECT doc_id AS id, doc_id AS ordinal, coalesce(text, '') AS content,
  CASE WHEN source IN {RULE_SOURCES} THEN 'rulebook' ELSE 'cards' END AS doc_type, [lang, source, doc_id::VARCHAR] AS path, 'Title ' || doc_id AS title,
  CASE WHEN source IN {RULE_SOURCES} THEN (doc_id // 10 + 1)::INT END AS page_start,
  CASE WHEN source IN {RULE_SOURCES} THEN (doc_id // 10 + 1 + (n_chars > 2000)::INT)::INT END AS page_end FROM documents)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


QUESTIONS = "qs AS (SELECT item_id AS qid, text AS question FROM benchmark)"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def terms_sql(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex(lower({x}), '{T.TERM_SPLIT}'), lambda t: regexp_replace(regexp_replace(t, '^[.+-]+', ''), '[.-]+$', '')), lambda t: t <> '' AND NOT list_contains({_list(T.STOPWORDS)}, t))"


def keywords_sql(x: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(lower({x}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda t: length(t) >= {T.KEYWORD_MIN} AND NOT list_contains({_list(T.KEYWORD_STOPWORDS)}, t))"


def normalize_sql(x: str) -> str:
    s = f"lower(strip_accents({x}))"
    for a, b in ((r"[‘’‛]", "''"), (r"[“”]", '"'), (r"[‐-―]", "-"), ("­", ""), (r"-\s*\n\s*", ""), (r"""[^a-z0-9''\".+\-\s]""", " "), (r"\s+", " "), (r"^\s+|\s+$", "")):
        s = f"regexp_replace({s}, '{a}', '{b}', 'g')"
    return s


def tokens_sql(x: str) -> str:
    return f"ceil(length({x}) / 4)::INT"


def clean_sql(x: str) -> str:
    s = f"regexp_replace({x}, '<!--\\s*page:\\s*(\\d+)(\\s+inferred)?\\s*-->', '', 'g')"
    return f"regexp_replace(regexp_replace({s}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, md): every document as markdown: the first word of each fifth line as a heading of level 1, 3 or 2, definitions between them in every
    third document, a page mark before every fourth line, two lines of each five parted by a blank line."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")

    def line(x, i):
        level = F.repeat(F.lit("#"), (F.floor(i / 5) * 2 % 3 + 1).cast("int"))
        word = F.split_part(x, F.lit(" "), F.lit(1))
        head = F.concat(level, F.lit(" "), word)
        definition = F.concat(F.lit("**"), word, F.lit("x** - "), x)
        page = F.concat(F.lit("<!-- page: "), (F.floor(i / 4) + F.when(i % 24 == 14, 2).otherwise(1)).cast("string"), F.when(i % 20 == 10, " inferred").otherwise(""), F.lit(" -->\n"))
        body = F.when(i % 5 == 0, head).when((F.pmod("doc_id", F.lit(3)) == 0) & (i % 5 != 3), definition).otherwise(F.concat(x, F.lit("\n")))
        return F.concat(F.when(i % 4 == 2, page).otherwise(""), body)

    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(lines, line), "\n").alias("md"))


MD = """md AS (SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, j:
  CASE WHEN (j - 1) % 4 = 2 THEN '<!-- page: ' || ((j - 1) // 4 + CASE WHEN (j - 1) % 24 = 14 THEN 2 ELSE 1 END) || CASE WHEN (j - 1) % 20 = 10 THEN ' inferred' ELSE '' END || ' -->' || chr(10) ELSE '' END ||
  CASE WHEN (j - 1) % 5 = 0 THEN repeat('#', ((j - 1) // 5 * 2 % 3 + 1)::INT) || ' ' || split_part(x, ' ', 1)
       WHEN doc_id % 3 = 0 AND (j - 1) % 5 <> 3 THEN '**' || split_part(x, ' ', 1) || 'x** - ' || x
       ELSE x || chr(10) END), chr(10)) AS md FROM documents)"""

MARK_RE = r"<!--\s*page:\s*(\d+)(\s+inferred)?\s*-->"
LINES = MD + """,
li AS (SELECT doc_id, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) - 1 AS n FROM md),
lines AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at_ FROM li)"""
MARKS = LINES + f""",
marks AS (SELECT doc_id, at_ + instr(line, '<!--') - 1 AS at_, regexp_extract(line, '{MARK_RE}', 1)::INT AS page, regexp_extract(line, '{MARK_RE}', 2) <> '' AS inferred FROM lines WHERE regexp_matches(line, '{MARK_RE}'))"""
HEAD_RE = r"^(#{1,6})\s+(.+?)\s*#*$"


def heads_sql(pattern: str = HEAD_RE, name: str = "heads") -> str:
    return f"""{name} AS (SELECT doc_id, n, at_, length(regexp_extract(line, '{pattern}', 1))::INT AS level, trim(regexp_extract(line, '{pattern}', 2)) AS title, at_ + length(line) + 1 AS own_start
  FROM lines WHERE regexp_matches(line, '{pattern}'))"""


#: The path of a heading: of each higher level, the last heading since the last one above that level.
PATHS = """
anc AS (SELECT h.doc_id, h.n, a.level, max(a.n) AS an FROM heads h JOIN heads a ON a.doc_id = h.doc_id AND a.n <= h.n AND (a.level < h.level OR a.n = h.n) GROUP BY ALL),
open_ AS (SELECT x.doc_id, x.n, x.level, x.an FROM anc x WHERE NOT EXISTS (SELECT 1 FROM anc y WHERE y.doc_id = x.doc_id AND y.n = x.n AND y.level < x.level AND y.an > x.an)),
paths AS (SELECT o.doc_id, o.n, list(a.title ORDER BY o.level) AS path FROM open_ o JOIN heads a ON a.doc_id = o.doc_id AND a.n = o.an GROUP BY ALL)"""


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, question, vector, shape): documents with a vector and an id divisible by 100; every other one asks whether it may."""
    v = read(spark, sf_dir, "embeddings").where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), F.coalesce("text", F.lit("")).alias("question"))
    return v.join(d, "qid").withColumn("shape", F.when(F.floor(F.col("qid") / 100) % 2 == 1, "prohibition").otherwise("lookup"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


HYBRID = "hq AS (SELECT vec_id AS qid, embedding AS vector, coalesce(text, '') AS question, CASE WHEN vec_id // 100 % 2 = 1 THEN 'prohibition' ELSE 'lookup' END AS shape FROM embeddings JOIN documents ON vec_id = doc_id WHERE vec_id % 100 = 0)"


def bm25_sql(queries: str, out: str, k: int, extra: str = "") -> str:
    """CTEs from chunks and a query table (qid, question) to the k best of each."""
    return f"""
{out}_t AS (SELECT id, {terms_sql('content')} AS ts FROM chunks),
{out}_q AS (SELECT DISTINCT qid, unnest({terms_sql('question')}) AS term FROM {queries}),
{out}_x AS (SELECT id, len(ts) AS len, unnest(ts) AS term FROM {out}_t),
{out}_p AS (SELECT id, len, term, count(*) AS tf FROM {out}_x WHERE term IN (SELECT term FROM {out}_q) GROUP BY ALL),
{out}_d AS (SELECT term, count(*) AS df FROM {out}_p GROUP BY term),
{out}_n AS (SELECT count(*) AS n, avg(len(ts)) AS al FROM {out}_t),
{out}_w AS (SELECT id, term, greatest(ln((n - df + 0.5) / (df + 0.5) + 1), 1e-6) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * len / CASE WHEN al > 0 THEN al ELSE 1 END)) AS part FROM {out}_p JOIN {out}_d USING (term), {out}_n),
{out}_s AS (SELECT qid, id, round(sum(part), 6) AS score FROM {out}_w JOIN {out}_q USING (term) GROUP BY ALL),
{out} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {out}_s QUALIFY rank <= {k})"""


DENSE = """
dense AS (SELECT qid, vec_id AS id, round(list_cosine_similarity(vector::DOUBLE[], embedding::DOUBLE[]), 6) AS score,
  row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(vector::DOUBLE[], embedding::DOUBLE[]), 6) DESC, vec_id) AS rank FROM hq, embeddings QUALIFY rank <= 40)"""
FUSED = f"""WITH {CHUNKS}, {HYBRID}, {DENSE}, {bm25_sql('hq', 'sparse', 40)},
arms AS (SELECT qid, id, 0 AS arm, rank FROM dense UNION ALL SELECT qid, id, 1, rank FROM sparse),
fz AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, min(arm * 1000 + rank) AS tie, min(rank) FILTER (arm = 0) AS dense_rank, min(rank) FILTER (arm = 1) AS sparse_rank FROM arms GROUP BY ALL),
fused AS (SELECT qid, id, score, dense_rank, sparse_rank, row_number() OVER (PARTITION BY qid ORDER BY score DESC, tie) AS rank FROM fz)"""
#: Only rows that are chunks go on from here.
FLOORED = FUSED + """,
opt AS (SELECT qid, shape, CASE shape WHEN 'prohibition' THEN 10 ELSE 8 END AS k, CASE shape WHEN 'prohibition' THEN 4 ELSE 2 END AS floor_, shape = 'prohibition' AS complete FROM hq),
known AS (SELECT f.*, c.doc_type, row_number() OVER (PARTITION BY qid ORDER BY rank) AS r FROM fused f JOIN chunks c USING (id)),
have AS (SELECT qid, count(*) FILTER (r <= k AND doc_type <> 'cards') AS have, count(*) FILTER (r > k AND doc_type <> 'cards') AS below FROM known JOIN opt USING (qid) GROUP BY qid),
need AS (SELECT qid, k, complete, CASE WHEN floor_ <= 0 THEN 0 ELSE greatest(0, least(least(floor_, k) - have, below)) END AS m FROM have JOIN opt USING (qid)),
num AS (SELECT known.*, k, complete, m, row_number() OVER (PARTITION BY qid, r > k, doc_type = 'cards' ORDER BY r) AS up, row_number() OVER (PARTITION BY qid, r > k, doc_type = 'cards' ORDER BY r DESC) AS down FROM known JOIN need USING (qid)),
floored AS (SELECT qid, id, score, doc_type, k, complete, r > k AS promoted, row_number() OVER (PARTITION BY qid ORDER BY r > k, r) AS rank FROM num
  WHERE (r > k AND doc_type <> 'cards' AND up <= m) OR (r <= k AND (doc_type <> 'cards' OR down > m)))"""
COMPLETE = FLOORED + """,
pre AS (SELECT id, ordinal, doc_type, array_to_string(path[1:greatest(len(path) - 1, 1)], ' > ') AS prefix FROM chunks),
seed AS (SELECT qid, k, complete, arg_min(prefix, (f.doc_type = 'cards')::INT * 1000 + rank) AS prefix, max(rank) AS last FROM floored f JOIN pre USING (id) GROUP BY ALL),
sib AS (SELECT s.qid, p.id, s.last + row_number() OVER (PARTITION BY s.qid ORDER BY p.ordinal) AS rank, s.k FROM seed s JOIN pre p ON p.prefix = s.prefix AND p.doc_type <> 'cards'
  WHERE s.complete AND NOT EXISTS (SELECT 1 FROM floored f WHERE f.qid = s.qid AND f.id = p.id)),
hits AS (SELECT qid, id, score, rank, false AS sibling FROM floored UNION ALL SELECT qid, id, 0.0, rank, true FROM sib WHERE rank <= greatest(k, 14))"""
SPANS = COMPLETE + """,
hk AS (SELECT h.qid, h.rank, c.*, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS body,
  CASE doc_type WHEN 'cards' THEN 'cards:' || array_to_string(path[1:len(path) - 1], ' > ') ELSE array_to_string(path[1:greatest(len(path) - 1, 1)], ' > ') END AS key,
  '## ' || array_to_string(path, ' > ') || CASE WHEN page_start IS NULL THEN '' WHEN page_end <> page_start THEN ' (pp. ' || page_start || '-' || page_end || ')' ELSE ' (p. ' || page_start || ')' END || chr(10) || chr(10) AS head
  FROM hits h JOIN chunks c USING (id)),
hf AS (SELECT *, min(rank) OVER (PARTITION BY qid, key) AS first_rank FROM hk),
hd AS (SELECT *, dense_rank() OVER (PARTITION BY qid ORDER BY first_rank) - 1 AS doc_no, head || body || chr(10) || chr(10) AS piece FROM hf),
placed AS (SELECT *, (coalesce(sum(length(piece)) OVER (PARTITION BY qid, doc_no ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head))::BIGINT AS start FROM hd),
docs AS (SELECT qid, doc_no, key, any_value(doc_type) AS kind, arg_min(title, ordinal) AS head_title, min(page_start) AS lo, max(page_start) AS hi, string_agg(piece, '' ORDER BY ordinal) AS text, count(*) AS n_spans FROM placed GROUP BY ALL),
titled AS (SELECT *, CASE WHEN lo IS NULL THEN '' ELSE ' (pp. ' || lo || '-' || hi || ')' END AS pages FROM docs),
assembled AS (SELECT qid, doc_no, CASE kind WHEN 'cards' THEN 'Card compendium - ' || key[7:] ELSE 'Rulebook - ' || key || pages END AS title,
  regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, n_spans FROM titled)"""

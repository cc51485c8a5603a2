"""Registered queries: structural ingestion and its checks, over documents as markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.functions import text as T
from marlspike.operators import checks as C
from marlspike.operators import ingest as G
from marlspike.operators.assembly import as_of
from marlspike.operators.unions import stacked
from marlspike.plans import tables as t

QUERIES: dict = {}
ORACLE_SQL: dict = {}
STRICT = "^(#{1,6}) (.+)$"
DEF = T.DEFINITION
BR = "array_to_string(path, ' > ')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _lines(spark, sf_dir):
    return G.lines(t.markdown(spark, sf_dir))


@query(f"WITH {t.LINES} SELECT doc_id, count(*) AS n_lines, max(at_) AS last_at, md5(string_agg(line, chr(10) ORDER BY n)) AS md5 FROM lines GROUP BY doc_id")
def markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x.line)
    return _lines(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.max("at").alias("last_at"), F.md5(F.array_join(rows, "\n")).alias("md5"))


@query(f"WITH {t.MARKS} SELECT doc_id, at_::BIGINT AS at, page, inferred FROM marks")
def page_marks(spark, sf_dir):
    return G.page_marks(_lines(spark, sf_dir))


@query(f"WITH {t.MARKS}, {t.heads_sql()}, f AS (SELECT doc_id, arg_min(page, at_) AS page FROM marks GROUP BY doc_id) SELECT h.doc_id, h.at_::BIGINT AS at, coalesce(m.page, f.page) AS page FROM heads h ASOF LEFT JOIN marks m ON m.doc_id = h.doc_id AND m.at_ <= h.at_ LEFT JOIN f ON f.doc_id = h.doc_id")
def page_asof(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    return as_of(G.headings(rows).select("doc_id", "at"), G.page_marks(rows).select("doc_id", "at", "page"), ["doc_id"], "at", "page")


@query(f"WITH {t.LINES}, {t.heads_sql()}, {t.PATHS} SELECT doc_id, n::INT AS n, level, {BR} AS breadcrumb, own_start::BIGINT AS own_start FROM heads JOIN paths USING (doc_id, n)")
def heading_tree(spark, sf_dir):
    h = G.breadcrumbs(G.headings(_lines(spark, sf_dir)))
    return h.select("doc_id", "n", "level", T.breadcrumb(F.col("path")).alias("breadcrumb"), "own_start")


SECTIONS = f"""WITH {t.LINES}, {t.heads_sql()}, {t.PATHS},
own AS (SELECT h.*, path, coalesce(lead(at_) OVER (PARTITION BY doc_id ORDER BY n), length(md)) AS own_end, md FROM heads h JOIN paths USING (doc_id, n) JOIN md USING (doc_id)),
sl AS (SELECT *, substr(md, own_start::INT + 1, greatest(0, own_end - own_start)::INT) AS slice FROM own),
secs AS (SELECT doc_id, n, level, title, path, at_, own_start, own_end, slice, {t.clean_sql('slice')} AS body FROM sl WHERE {t.clean_sql('slice')} <> ''),
cl AS (SELECT *, list_filter(list_transform(string_split(slice, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '' AND NOT starts_with(x, '<!-- page:')) AS rows FROM secs),
lists AS (SELECT *, len(list_filter(rows, lambda x: regexp_matches(x, '{DEF}'))) AS n_defs, len(rows) AS n_content FROM cl),
typed AS (SELECT *, n_defs >= 4 AND n_defs / greatest(n_content, 1) >= 0.6 AS is_list FROM lists)"""


@query(SECTIONS + " SELECT doc_id, n::INT AS n, own_start::BIGINT AS own_start, own_end::BIGINT AS own_end, md5(body) AS body_md5, ceil(length(body) / 4)::INT AS tokens FROM secs")
def sections(spark, sf_dir):
    s = G.sections(t.markdown(spark, sf_dir))
    return s.select("doc_id", "n", "own_start", "own_end", F.md5("body").alias("body_md5"), T.est_tokens(F.col("body")).alias("tokens"))


@query(SECTIONS + " SELECT doc_id, n::INT AS n, n_defs::INT AS n_defs, n_content::INT AS n_content, is_list FROM typed")
def definition_lists(spark, sf_dir):
    return G.definition_lists(G.sections(t.markdown(spark, sf_dir))).select("doc_id", "n", "n_defs", "n_content", "is_list")


RAW = SECTIONS + f""",
sln AS (SELECT doc_id, n, path, title, own_start, own_end, at_, unnest(string_split(slice, chr(10))) AS raw, generate_subscripts(string_split(slice, chr(10)), 1) - 1 AS i FROM typed WHERE is_list),
slo AS (SELECT *, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS tx, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id, n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM sln),
defs AS (SELECT doc_id, n, i::INT AS sub, trim(regexp_extract(tx, '{DEF}', 1)) AS title, list_append(path, trim(regexp_extract(tx, '{DEF}', 1))) AS path, {BR} AS parent, own_start + off AS start, own_start + off + length(tx) AS stop, tx AS body, true AS atomic FROM slo WHERE regexp_matches(tx, '{DEF}')),
left_ AS (SELECT doc_id, n, any_value(title) AS title, any_value(path) AS path, any_value(at_) AS start, any_value(own_end) AS stop, string_agg(raw, chr(10) ORDER BY i) FILTER (NOT regexp_matches(tx, '{DEF}')) AS s FROM slo GROUP BY ALL),
rest AS (SELECT doc_id, n, 1073741824 AS sub, title, path, array_to_string(path[1:len(path) - 1], ' > ') AS parent, start, stop, {t.clean_sql("coalesce(s, '')")} AS body, false AS atomic FROM left_),
raw AS (SELECT doc_id, n, -1 AS sub, title, path, array_to_string(path[1:len(path) - 1], ' > ') AS parent, at_ AS start, own_end AS stop, body, false AS atomic FROM typed WHERE NOT is_list
  UNION ALL SELECT * FROM defs UNION ALL SELECT * FROM rest WHERE ceil(length(body) / 4) >= 12)"""


@query(RAW + f" SELECT doc_id, n::INT AS n, sub::INT AS sub, {BR} AS breadcrumb, parent, start::BIGINT AS start, stop::BIGINT AS stop, md5(body) AS body_md5, atomic FROM raw")
def raw_chunks(spark, sf_dir):
    r = G.raw_chunks(t.markdown(spark, sf_dir))
    return r.select("doc_id", "n", "sub", T.breadcrumb(F.col("path")).alias("breadcrumb"), "parent", "start", "stop", F.md5("body").alias("body_md5"), "atomic")


@query(RAW + f", k AS (SELECT doc_id, n, sub, {BR} AS key FROM raw) SELECT a.doc_id, a.n::INT AS n, a.sub::INT AS sub, EXISTS (SELECT 1 FROM k b WHERE b.doc_id = a.doc_id AND starts_with(b.key, a.key || ' > ')) AS has_children FROM k a")
def has_children(spark, sf_dir):
    return G.with_children(G.raw_chunks(t.markdown(spark, sf_dir))).select("doc_id", "n", "sub", "has_children")


def _kept(of: str, stop: str, body: str, merged: str) -> str:
    fields = [f"'{c}': {of}{c}" for c in ("n", "sub", "path", "start", "atomic")]
    return "{" + ", ".join([*fields, f"'stop': {stop}", f"'body': {body}", f"'merged': {merged}"]) + "}"


#: One row at a time by document: the list of chunks so far, in which the last one of a path may grow.
MERGED = RAW.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
ky AS (SELECT *, {BR} AS key, row_number() OVER (PARTITION BY doc_id ORDER BY n, sub) AS i, ceil(length(body) / 4) AS tok FROM raw),
hc AS MATERIALIZED (SELECT a.*, NOT atomic AND tok < 120 AND NOT EXISTS (SELECT 1 FROM ky b WHERE b.doc_id = a.doc_id AND starts_with(b.key, a.key || ' > ')) AS small FROM ky a),
mg AS (SELECT doc_id, i, [{_kept('', 'stop', 'body', '0')}] AS kept FROM hc WHERE i = 1
  UNION ALL
  SELECT doc_id, i, CASE WHEN small AND j IS NOT NULL AND NOT kept[j].atomic AND ceil(length(kept[j].body) / 4) + tok <= 600
      THEN list_concat(kept[1:j - 1], [{_kept('kept[j].', 'greatest(kept[j].stop, stop)', "kept[j].body || chr(10) || chr(10) || '### ' || title || chr(10) || chr(10) || body", 'kept[j].merged + 1')}], kept[j + 1:])
      ELSE list_append(kept, {_kept('', 'stop', 'body', '0')}) END
  FROM (SELECT h.*, mg.kept, list_max(list_filter(range(1, len(mg.kept) + 1), lambda x: array_to_string(mg.kept[x].path, ' > ') = h.parent)) AS j FROM mg JOIN hc h ON h.doc_id = mg.doc_id AND h.i = mg.i + 1) u),
fin AS (SELECT doc_id, row_number() OVER () AS cid, c.* FROM (SELECT doc_id, unnest(arg_max(kept, i)) AS c FROM mg GROUP BY doc_id))"""


@query(MERGED + f" SELECT doc_id, n::INT AS n, sub::INT AS sub, {BR} AS breadcrumb, start::BIGINT AS start, stop::BIGINT AS stop, md5(body) AS body_md5, merged::INT AS n_merged FROM fin")
def upward_merge(spark, sf_dir):
    m = G.merge_upward(G.raw_chunks(t.markdown(spark, sf_dir)))
    return m.select("doc_id", "n", "sub", T.breadcrumb(F.col("path")).alias("breadcrumb"), "start", "stop", F.md5("body").alias("body_md5"), F.coalesce(F.size("merged"), F.lit(0)).alias("n_merged"))


@query(MERGED + f""",
big AS (SELECT cid, string_split_regex(body, '\\n\\s*\\n') AS ps FROM fin WHERE NOT atomic AND ceil(length(body) / 4) > 600),
w AS (SELECT cid, 0 AS i, 1 AS part, ''::VARCHAR AS cur FROM big UNION ALL
  SELECT cid, i + 1, CASE WHEN full_ THEN part + 1 ELSE part END, CASE WHEN full_ THEN p ELSE longer END
  FROM (SELECT *, cur <> '' AND ceil(length(longer) / 4) > 600 AS full_ FROM (SELECT w.cid, w.i, w.part, w.cur, b.ps[w.i + 1] AS p, CASE WHEN w.cur = '' THEN b.ps[w.i + 1] ELSE w.cur || chr(10) || chr(10) || b.ps[w.i + 1] END AS longer FROM w JOIN big b USING (cid) WHERE w.i < len(b.ps)) x) y),
good AS (SELECT * FROM (SELECT cid, part, arg_max(cur, i) AS body FROM w WHERE i > 0 GROUP BY ALL) WHERE NOT regexp_full_match(body, '\\s*')),
tot AS (SELECT cid, count(*) AS k FROM good GROUP BY cid),
sp AS (SELECT cid, CASE WHEN k > 1 THEN part END::INT AS part, CASE WHEN k > 1 THEN k END::INT AS parts_total, body FROM good JOIN tot USING (cid) UNION ALL SELECT cid, NULL, NULL, body FROM fin WHERE atomic OR ceil(length(body) / 4) <= 600),
{t.MARKS[t.MARKS.rindex("marks AS ("):]},
mk AS (SELECT doc_id, at_, page FROM marks),
f AS (SELECT doc_id, arg_min(page, at_) AS page FROM mk GROUP BY doc_id),
pg AS (SELECT fin.*, coalesce(a.page, f.page) AS page_start FROM fin ASOF LEFT JOIN mk a ON a.doc_id = fin.doc_id AND a.at_ <= fin.start LEFT JOIN f ON f.doc_id = fin.doc_id),
pe AS (SELECT pg.cid, coalesce(b.page, f.page) AS page_end FROM pg ASOF LEFT JOIN mk b ON b.doc_id = pg.doc_id AND b.at_ <= pg.stop - 1 LEFT JOIN f ON f.doc_id = pg.doc_id)
SELECT doc_id, 'rulebook:' || left(sha256('rulebook ' || doc_id || ' > ' || {BR} || ' ' || sp.body), 12) AS id, n::INT AS n, sub::INT AS sub, part, parts_total, page_start, page_end, ceil(length(sp.body) / 4)::INT AS token_count
FROM pg JOIN pe USING (cid) JOIN sp USING (cid)""")
def chunk_markdown(spark, sf_dir):
    """The whole ingestion."""
    c = G.chunk_markdown(t.markdown(spark, sf_dir))
    return c.select("doc_id", "id", "n", "sub", "part", "parts_total", "page_start", "page_end", "token_count")


@query(f"""WITH RECURSIVE {t.CHUNKS}, big AS (SELECT id, string_split(content, chr(10)) AS ps FROM chunks WHERE ceil(length(content) / 4) > 600),
w AS (SELECT id, 0 AS i, 1 AS part, ''::VARCHAR AS cur FROM big UNION ALL
  SELECT w.id, i + 1, CASE WHEN full_ THEN part + 1 ELSE part END, CASE WHEN full_ THEN p ELSE longer END FROM (SELECT w.id, i, part, p, longer, cur <> '' AND ceil(length(longer) / 4) > 600 AS full_ FROM (SELECT w.id, w.i, w.part, w.cur, b.ps[w.i + 1] AS p, CASE WHEN w.cur = '' THEN b.ps[w.i + 1] ELSE w.cur || chr(10) || b.ps[w.i + 1] END AS longer FROM w JOIN big b USING (id) WHERE w.i < len(b.ps)) w) w),
parts AS (SELECT id, part, arg_max(cur, i) AS body FROM w WHERE i > 0 GROUP BY ALL),
good AS (SELECT * FROM parts WHERE NOT regexp_full_match(body, '\\s*')),
tot AS (SELECT id, count(*) AS k FROM good GROUP BY id),
s AS (SELECT id, CASE WHEN k > 1 THEN part END::INT AS part, CASE WHEN k > 1 THEN k END::INT AS parts_total, body FROM good JOIN tot USING (id) UNION ALL SELECT id, NULL, NULL, content FROM chunks WHERE ceil(length(content) / 4) <= 600)
SELECT id, part, parts_total, ceil(length(body) / 4)::INT AS tokens, md5(body) AS body_md5 FROM s""")
def split_oversized(spark, sf_dir):
    s = G.split_oversized(t.chunks(spark, sf_dir).select("id", "content"), "content", "\n", "\n")
    return s.select("id", "part", "parts_total", T.est_tokens(F.col("content")).alias("tokens"), F.md5("content").alias("body_md5"))


CARDS = f"""WITH {t.LINES},
c AS (SELECT *, nullif(regexp_extract(line, '^##\\s+(.+?)\\s*$', 1), '') AS h2, nullif(regexp_extract(line, '^###\\s+(.+?)\\s*$', 1), '') AS h3, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS tx FROM lines),
g AS (SELECT *, count(h2) OVER (PARTITION BY doc_id ORDER BY n) AS gr FROM c),
f AS (SELECT *, first_value(h2 IGNORE NULLS) OVER (PARTITION BY doc_id, gr ORDER BY n) AS l2, last_value(h3 IGNORE NULLS) OVER (PARTITION BY doc_id, gr ORDER BY n) AS l3 FROM g),
e AS (SELECT doc_id, n, CASE WHEN l3 IS NOT NULL THEN coalesce(l2, 'Cards') || ' > ' || l3 ELSE coalesce(l2, '') END AS "group", trim(regexp_extract(tx, '{G.CARD}', 1)) AS name, regexp_replace(regexp_extract(tx, '{G.CARD}', 2), '^\\s+|\\s+$', '', 'g') AS rest
  FROM f WHERE regexp_matches(tx, '{G.CARD}') AND NOT regexp_matches(line, '^#{{2,3}}\\s+(.+?)\\s*$'))
SELECT doc_id, n::INT AS n, "group", name, CASE WHEN regexp_matches(rest, '^\\(([^)]*)\\)') THEN regexp_extract(rest, '^\\(([^)]*)\\)', 1) END AS cost,
  CASE WHEN regexp_matches(rest, '\\[([A-Za-z ]+)\\]') THEN regexp_extract(rest, '\\[([A-Za-z ]+)\\]', 1) END AS type, ceil(length(rest) / 4)::INT AS token_count FROM e WHERE rest <> ''"""


@query(CARDS)
def card_lines(spark, sf_dir):
    return G.cards(t.markdown(spark, sf_dir)).drop("rest")


@query(f"WITH {t.CHUNKS}, s AS (SELECT doc_type, list(ceil(length(content) / 4)::INT ORDER BY ceil(length(content) / 4)) AS l FROM chunks GROUP BY doc_type) SELECT doc_type, len(l) AS n, l[floor((len(l) - 1) * 0.1)::INT + 1] AS p10, l[floor((len(l) - 1) * 0.5)::INT + 1] AS p50, l[floor((len(l) - 1) * 0.9)::INT + 1] AS p90 FROM s")
def chunk_size_percentiles(spark, sf_dir):
    return G.size_percentiles(t.chunks(spark, sf_dir).withColumn("tokens", T.est_tokens(F.col("content"))), "doc_type", "tokens")


@query(f"WITH {t.CHUNKS} SELECT count(*) - count(DISTINCT sha256(content)) AS duplicate_ids, count(*) FILTER (page_start IS NULL) AS no_page, count(DISTINCT CASE doc_type WHEN 'rulebook' THEN 10 ELSE 5 END) AS n_authorities FROM chunks")
def duplicate_ids(spark, sf_dir):
    c = t.chunks(spark, sf_dir).withColumn("authority", F.element_at(F.create_map(*(F.lit(x) for kv in G.AUTHORITY.items() for x in kv)), F.col("doc_type")))
    return c.agg((F.count(F.lit(1)) - F.countDistinct(F.sha2("content", 256))).alias("duplicate_ids"), F.count_if(F.col("page_start").isNull()).alias("no_page"), F.countDistinct("authority").alias("n_authorities"))


@query(f"WITH {t.CHUNKS} SELECT id, row_number() OVER (ORDER BY doc_type DESC, id) - 1 AS ordinal FROM chunks")
def global_ordinal(spark, sf_dir):
    """Ordinals over all chunks: counts per type and block first, then a window within each block, so no task sorts everything."""
    from pyspark.sql.window import Window

    c = t.chunks(spark, sf_dir).select("id", "doc_type", F.floor(F.col("id") / 4096).alias("block"))
    size = c.groupBy("doc_type", "block").agg(F.count(F.lit(1)).alias("n"))
    base = size.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("doc_type"), "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return c.join(base, ["doc_type", "block"]).select("id", (F.col("base") + F.row_number().over(Window.partitionBy("doc_type", "block").orderBy("id")) - 1).alias("ordinal"))


@query(f"WITH {t.MARKS}, m AS (SELECT *, lag(page) OVER (PARTITION BY doc_id ORDER BY at_) AS prev_page FROM marks) SELECT doc_id, at_::BIGINT AS at, page, prev_page FROM m WHERE page <= prev_page")
def page_order(spark, sf_dir):
    return C.pages_out_of_order(G.page_marks(_lines(spark, sf_dir)))


@query(f"WITH {t.MARKS}, e AS (SELECT doc_id, arg_min(page, at_) AS lo, arg_max(page, at_) AS hi FROM marks GROUP BY doc_id), g AS (SELECT doc_id, unnest(range(lo, hi + 1))::INT AS page FROM e) SELECT doc_id, page FROM g WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.doc_id = g.doc_id AND m.page = g.page)")
def page_gaps(spark, sf_dir):
    return C.page_gaps(G.page_marks(_lines(spark, sf_dir)))


@query(f"""WITH {t.MARKS}, x AS (SELECT doc_id, count(*) AS n_marks, count(*) FILTER (inferred) AS n_inferred, min(page) AS min_page, max(page) AS max_page FROM marks GROUP BY doc_id)
SELECT doc_id, coalesce(n_marks, 0) AS n_marks, coalesce(n_inferred, 0) AS n_inferred, min_page, max_page, length(md) AS n_chars FROM md LEFT JOIN x USING (doc_id)""")
def parse_statistics(spark, sf_dir):
    md = t.markdown(spark, sf_dir)
    return C.parse_statistics(md, G.page_marks(G.lines(md)))


@query(f"WITH {t.LINES}, {t.heads_sql(STRICT)}, p AS (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY n) AS prev_level FROM heads) SELECT doc_id, n::INT AS n, prev_level, level, title FROM p WHERE level - prev_level > 1")
def level_jumps(spark, sf_dir):
    return C.level_jumps(_lines(spark, sf_dir))


@query(f"WITH {t.LINES}, {t.heads_sql(STRICT)}, {t.PATHS}, b AS (SELECT doc_id, {BR} AS breadcrumb FROM paths) SELECT doc_id, breadcrumb, count(*) AS n FROM b GROUP BY ALL HAVING count(*) > 1")
def duplicate_breadcrumbs(spark, sf_dir):
    return C.duplicate_breadcrumbs(_lines(spark, sf_dir))


INTEGRITY = f"""WITH {t.MD}, x AS (SELECT doc_id, md, right(regexp_replace(md, '^\\s+|\\s+$', '', 'g'), 1) AS tail FROM md)
SELECT doc_id, len(string_split(md, '**')) % 2 = 0 AS bold_unbalanced, NOT contains('.!?)"''>', tail) AS ends_open FROM x"""


@query(INTEGRITY)
def text_integrity(spark, sf_dir):
    return C.integrity(t.markdown(spark, sf_dir))


TOC = f"""WITH {t.MARKS}, {t.heads_sql(STRICT)}, f AS (SELECT doc_id, arg_min(page, at_) AS page FROM marks GROUP BY doc_id),
h AS (SELECT h.doc_id, h.at_, h.title, coalesce(m.page, f.page) AS got, regexp_replace(lower(h.title), '[^a-z]', '', 'g') AS hk FROM heads h ASOF LEFT JOIN marks m ON m.doc_id = h.doc_id AND m.at_ <= h.at_ LEFT JOIN f ON f.doc_id = h.doc_id),
toc AS (SELECT doc_id, split_part(md, chr(10), 1)[3:] AS name, (doc_id % 4)::INT AS page FROM md UNION ALL SELECT doc_id, 'zzz missing', 1 FROM md WHERE doc_id % 10 = 0),
k AS (SELECT *, left(regexp_replace(lower(name), '[^a-z]', '', 'g'), 7) AS key FROM toc),
j AS (SELECT k.doc_id, k.name, k.page, h.title, h.got, row_number() OVER (PARTITION BY k.doc_id, k.name, k.page ORDER BY abs(coalesce(got, 0) - k.page), h.at_) AS r FROM k LEFT JOIN h ON h.doc_id = k.doc_id AND starts_with(h.hk, k.key)),
toced AS (SELECT doc_id, name, page, title, got, CASE WHEN title IS NULL THEN 'warn' WHEN got IS NOT NULL AND abs(got - page) > 1 THEN 'fail' ELSE 'ok' END AS severity FROM j WHERE r = 1)"""


def _toc(spark, sf_dir):
    md = t.markdown(spark, sf_dir)
    none = F.lit(None).cast("string").alias("actual")
    toc = stacked(
        md.select("doc_id", F.substring(F.split_part("md", F.lit("\n"), F.lit(1)), 3, 1 << 30).alias("name"), (F.col("doc_id") % 4).cast("int").alias("page"), none),
        md.where("doc_id % 10 = 0").select("doc_id", F.lit("zzz missing").alias("name"), F.lit(1).alias("page"), none),
    )
    rows = G.lines(md)
    return C.toc_nearest(rows, G.page_marks(rows), toc)


@query(TOC + " SELECT * FROM toced")
def toc_nearest(spark, sf_dir):
    return _toc(spark, sf_dir)


@query(TOC + " SELECT severity, count(*) AS n FROM toced GROUP BY severity")
def check_verdict(spark, sf_dir):
    return C.verdict(_toc(spark, sf_dir))

"""Structural ingestion: markdown to lines, page marks, a heading tree, definition lists, merged and split chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlspike.functions import text as T
from marlspike.operators.assembly import as_of
from marlspike.operators.folds import fold
from marlspike.operators.unions import stacked
from marlspike.sources.scratch import cut

# Chunk sizes, list rules, authority of each document type.
MIN_TOKENS, MAX_TOKENS = 120, 600
LIST_MIN, LIST_SHARE, REST_MIN = 4, 0.6, 12
AUTHORITY = {"errata": 30, "faq": 20, "rulebook": 10, "cards": 5, "strategy": 0}
HEADING = r"^(#{1,6})\s+(.+?)\s*#*$"
STRICT_HEADING = r"^(#{1,6}) (.+)$"
CARD = r"^\*\*(.+?)\*\*\s*(.*)$"


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, n, line, at): each line of ``md`` with its offset in UTF-16 units."""
    parts = F.split("md", "\n")
    ends = F.transform(parts, lambda x: T.units(x) + 1)
    flat = docs.select("doc_id", F.posexplode(F.arrays_zip(parts.alias("line"), ends.alias("len"))).alias("n", "x")).select("doc_id", "n", "x.line", "x.len")
    before = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return flat.withColumn("at", F.coalesce(F.sum("len").over(before), F.lit(0)).cast("long")).drop("len")


def page_marks(rows: DataFrame) -> DataFrame:
    """(doc_id, at, page, inferred) of each page mark in ``lines``."""
    mark = rows.where(F.col("line").rlike(T.PAGE_MARK))
    return mark.select("doc_id", (F.col("at") + F.locate("<!--", "line") - 1).alias("at"), F.regexp_extract("line", T.PAGE_MARK, 1).cast("int").alias("page"), (F.regexp_extract("line", T.PAGE_MARK, 2) != "").alias("inferred"))


def headings(rows: DataFrame, pattern: str = HEADING) -> DataFrame:
    """(doc_id, n, at, level, title, own_start) of each heading line."""
    h = rows.where(F.col("line").rlike(pattern))
    return h.select("doc_id", "n", "at", F.length(F.regexp_extract("line", pattern, 1)).alias("level"), T.trim(F.regexp_extract("line", pattern, 2)).alias("title"), (F.col("at") + T.units(F.col("line")) + 1).alias("own_start"))


def breadcrumbs(heads: DataFrame) -> DataFrame:
    """``heads`` with path: the titles of the open headings. Of each level the last heading so far is open, unless one of a higher
    level came after it: six running values, in one sort by document."""
    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = [F.last(F.when(F.col("level") == k, F.struct("n", "title")), ignorenulls=True).over(w).alias(f"_{k}") for k in range(1, 7)]
    df = heads.select("*", *last)
    crumbs = []
    for k in range(1, 7):
        above = F.greatest(F.lit(-1), F.lit(-1), *(F.coalesce(F.col(f"_{j}.n"), F.lit(-1)) for j in range(1, k)))
        crumbs.append(F.when((F.col("level") >= k) & (F.col(f"_{k}.n") > above), F.col(f"_{k}.title")))
    path = F.filter(F.array(*crumbs), lambda x: x.isNotNull())
    return df.withColumn("path", path).drop(*(f"_{k}" for k in range(1, 7)))


def sections(docs: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """doc_id, n, level, title, path, at, own_start, own_end, slice, body: what each heading owns, containers left out. rows: the
    documents' ``lines``, if they are at hand."""
    rows = lines(docs) if rows is None else rows
    heads = breadcrumbs(headings(rows))
    nxt = F.lead("at").over(Window.partitionBy("doc_id").orderBy("n"))
    heads = heads.withColumn("own_end", nxt)
    whole = docs.select("doc_id", "md", T.units(F.col("md")).cast("long").alias("size"))
    df = heads.join(whole, "doc_id").withColumn("own_end", F.coalesce("own_end", "size"))
    piece = F.substring("md", F.col("own_start").cast("int") + 1, F.greatest(F.lit(0).cast("long"), F.col("own_end") - F.col("own_start")).cast("int"))
    return df.withColumn("slice", piece).withColumn("body", T.clean(F.col("slice"))).drop("md", "size").where(F.col("body") != "")


def _content_lines(col: str = "slice") -> Column:
    t = F.transform(F.split(col, "\n"), lambda x, i: F.struct(i.alias("i"), T.trim(x).alias("t"), x.alias("raw")))
    return t


def definition_lists(secs: DataFrame) -> DataFrame:
    """``secs`` with n_defs, n_content, is_list: at least four definitions, and 60 % of the lines with content."""
    rows = F.filter(_content_lines(), lambda x: (x.t != "") & ~x.t.startswith("<!-- page:"))
    df = secs.withColumn("_rows", rows)
    defs = F.size(F.filter("_rows", lambda x: x.t.rlike(T.DEFINITION)))
    return df.withColumn("n_defs", defs).withColumn("n_content", F.size("_rows")).drop("_rows").withColumn("is_list", (F.col("n_defs") >= LIST_MIN) & (F.col("n_defs") / F.greatest("n_content", F.lit(1)) >= LIST_SHARE))


def raw_chunks(docs: DataFrame, lines_of: DataFrame | None = None) -> DataFrame:
    """doc_id, n, sub, title, path, parent, start, stop, body, atomic: definitions one by one, what they leave, other sections.

    What a list leaves is dropped below twelve tokens.
    """
    secs = definition_lists(sections(docs, lines_of))
    plain = secs.where("NOT is_list").select("doc_id", "n", F.lit(-1).alias("sub"), "title", "path", F.slice("path", 1, F.size("path") - 1).alias("up"), F.col("at").alias("start"), F.col("own_end").alias("stop"), "body", F.lit(False).alias("atomic"))
    lists = secs.where("is_list")
    rows = lists.select("doc_id", "n", "title", "path", "own_start", "own_end", "at", F.posexplode(F.split("slice", "\n")).alias("i", "raw")).withColumn("t", T.trim(F.col("raw")))
    off = F.coalesce(F.sum(T.units(F.col("raw")) + 1).over(Window.partitionBy("doc_id", "n").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_off", off)
    d = rows.where(F.col("t").rlike(T.DEFINITION)).withColumn("term", T.trim(F.regexp_extract("t", T.DEFINITION, 1))).withColumn("start", F.col("own_start") + F.col("_off"))
    defs = d.select("doc_id", "n", F.col("i").alias("sub"), F.col("term").alias("title"), F.concat("path", F.array("term")).alias("path"), F.col("path").alias("up"), "start", (F.col("start") + T.units(F.col("t"))).alias("stop"), F.col("t").alias("body"), F.lit(True).alias("atomic"))
    left = F.array_join(F.transform(F.filter(_content_lines(), lambda x: ~x.t.rlike(T.DEFINITION) | x.t.startswith("<!-- page:")), lambda x: x.raw), "\n")
    rest = lists.withColumn("body", T.clean(left)).where(T.est_tokens(F.col("body")) >= REST_MIN)
    rest = rest.select("doc_id", "n", F.lit(1 << 30).alias("sub"), "title", "path", F.slice("path", 1, F.size("path") - 1).alias("up"), F.col("at").alias("start"), F.col("own_end").alias("stop"), "body", F.lit(False).alias("atomic"))
    return stacked(plain, defs, rest).withColumn("parent", T.breadcrumb(F.col("up"))).drop("up")


def with_children(raw: DataFrame) -> DataFrame:
    """``raw`` with has_children: some other chunk of the document lies below its path. An equi-join on path prefixes."""
    below = raw.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1))), lambda i: T.breadcrumb(F.slice("path", 1, i)))).alias("key"), F.size("path").alias("_n")).where("_n > 1").select("doc_id", "key").distinct()
    keyed = raw.withColumn("key", T.breadcrumb(F.col("path")))
    return keyed.join(below.withColumn("has_children", F.lit(True)), ["doc_id", "key"], "left").withColumn("has_children", F.coalesce("has_children", F.lit(False)))


MERGED = "doc_id long, n int, sub int, title string, path array<string>, start long, stop long, body string, atomic boolean, merged array<string>"


def merge_upward(raw: DataFrame, least: int = MIN_TOKENS, most: int = MAX_TOKENS) -> DataFrame:
    """Small sections without children go into the chunk of their parent's path, in document order, while it has room.

    Order-dependent (a parent grows as it absorbs), so a document is one fold; what a task holds is one document.
    """

    def tokens(s: str) -> int:
        return -(-len(s.encode("utf-16-le")) // 8)

    def step(state: tuple[list, dict], r: dict) -> list[tuple]:
        kept, last = state
        up, size = last.get(r["parent"]), tokens(r["body"])
        if not r["atomic"] and size < least and not r["has_children"] and up is not None and not up["atomic"] and up["tokens"] + size <= most:
            up["parts"].append(f"\n\n### {r['title']}\n\n{r['body']}")
            up["units"] += len(up["parts"][-1].encode("utf-16-le")) // 2
            up["tokens"] = -(-up["units"] // 4)
            up["stop"] = max(up["stop"], r["stop"])
            up["merged"].append(r["title"])
            return []
        r |= {"parts": [r["body"]], "units": len(r["body"].encode("utf-16-le")) // 2, "tokens": size, "merged": []}
        kept.append(r)
        last[r["key"]] = r
        return []

    def end(state: tuple[list, dict]) -> list[tuple]:
        return [(r["doc_id"], r["n"], r["sub"], r["title"], r["path"], r["start"], r["stop"], "".join(r["parts"]), r["atomic"], r["merged"] or None) for r in state[0]]

    return fold(with_children(raw), "doc_id", ["n", "sub"], lambda: ([], {}), step, MERGED.replace("doc_id long", f"doc_id {raw.schema['doc_id'].dataType.simpleString()}"), end)


def pack(paragraphs: Column, most: int = MAX_TOKENS, glue: str = "\n\n") -> Column:
    """Paragraphs joined greedily up to ``most`` tokens; a longer one stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(s, p):
        longer = F.when(s.cur == "", p).otherwise(F.concat(s.cur, F.lit(glue), p))
        full = (s.cur != "") & (T.est_tokens(longer) > most)
        return F.struct(F.when(full, F.concat(s.done, F.array(s.cur))).otherwise(s.done).alias("done"), F.when(full, p).otherwise(longer).alias("cur"))

    def end(s):
        return F.when(T.trim(s.cur) != "", F.concat(s.done, F.array(s.cur))).otherwise(s.done)

    return F.aggregate(paragraphs, start, step, end)


def split_oversized(df: DataFrame, body: str = "body", separator: str = r"\n\s*\n", glue: str = "\n\n", most: int = MAX_TOKENS) -> DataFrame:
    """Rows of ``df`` with body cut into parts: part and parts_total (null if there is one only)."""
    b = F.col(body)
    atomic = F.col("atomic") if "atomic" in df.columns else F.lit(False)
    parts = F.when(atomic | (T.est_tokens(b) <= most), F.array(b)).otherwise(pack(F.split(b, separator), most, glue))
    flat = df.withColumn("_parts", parts).select(*(c for c in df.columns if c != body), F.size("_parts").alias("_k"), F.posexplode("_parts").alias("_i", body))
    many = F.col("_k") > 1
    return flat.withColumn("part", F.when(many, F.col("_i") + 1)).withColumn("parts_total", F.when(many, F.col("_k"))).drop("_k", "_i")


def chunk_markdown(docs: DataFrame) -> DataFrame:
    """All steps: chunks of ``docs`` (doc_id, md) with pages, parts, token counts and content-derived ids."""
    rows = cut(lines(docs), "lines")
    merged = merge_upward(raw_chunks(docs, rows))
    marks = page_marks(rows).select("doc_id", "at", "page")
    first = as_of(merged.withColumn("at", F.col("start")), marks, ["doc_id"], "at", "page").withColumnRenamed("page", "page_start").drop("at")
    both = as_of(first.withColumn("at", F.col("stop") - 1), marks, ["doc_id"], "at", "page").withColumnRenamed("page", "page_end").drop("at")
    out = split_oversized(both).withColumnRenamed("body", "content").withColumn("token_count", T.est_tokens(F.col("content")))
    return out.withColumn("id", T.chunk_id(F.lit("rulebook"), F.concat(F.array(F.col("doc_id").cast("string")), F.col("path")), F.col("content")))


def cards(docs: DataFrame) -> DataFrame:
    """doc_id, n, group, name, rest, cost, type, token_count of each entry of a card file; entries without a text are skipped."""
    rows = lines(docs)
    h2, h3 = T.found(F.col("line"), r"^##\s+(.+?)\s*$"), T.found(F.col("line"), r"^###\s+(.+?)\s*$")
    by = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = rows.withColumn("h2", h2).withColumn("h3", h3).withColumn("_g", F.count("h2").over(by))
    within = Window.partitionBy("doc_id", "_g").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_2", F.last("h2", ignorenulls=True).over(by)).withColumn("_3", F.last("h3", ignorenulls=True).over(within)).withColumn("_2in", F.first("h2", ignorenulls=True).over(within))
    group = F.when(F.col("_3").isNotNull(), F.array(F.coalesce("_2in", F.lit("Cards")), "_3")).when(F.col("_2in").isNotNull(), F.array("_2in")).otherwise(F.array().cast("array<string>"))
    t = T.trim(F.col("line"))
    df = df.where(~F.col("line").rlike(r"^#{2,3}\s+(.+?)\s*$") & t.rlike(CARD)).withColumn("name", T.trim(F.regexp_extract(t, CARD, 1))).withColumn("rest", T.trim(F.regexp_extract(t, CARD, 2)))
    return df.where(F.col("rest") != "").select("doc_id", "n", T.breadcrumb(group).alias("group"), "name", "rest", T.card_cost(F.col("rest")).alias("cost"), T.card_type(F.col("rest")).alias("type"), T.est_tokens(F.col("rest")).alias("token_count"))


def size_percentiles(df: DataFrame, by: str, size: str, shares: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """The element at floor((n - 1) * share) of each group's sorted sizes, counted from a histogram of sizes.

    Groups of any size: what is windowed is one row per group and distinct size.
    """
    hist = df.groupBy(by, size).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(by).orderBy(size)
    cum = hist.withColumn("hi", F.sum("c").over(w)).withColumn("total", F.sum("c").over(Window.partitionBy(by)))
    return cum.groupBy(by).agg(F.max("total").alias("n"), *(F.min(F.when(F.col("hi") > F.floor((F.col("total") - 1) * s), F.col(size))).alias(f"p{int(s * 100)}") for s in shares))

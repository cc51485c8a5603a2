"""Scalar text functions as column expressions.

Lengths that become offsets or token estimates count UTF-16 units, as the data model defines them; everything else counts
characters. All functions pass null through unless they say otherwise.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, patterns and thresholds that results depend on.
STOPWORDS = (
    "a an the of to in on at for and or is are was were be been it its this that these those as by with from i you he she they we"
).split()
KEYWORD_STOPWORDS = (
    "the a an is are was were do does did can i you he she it we they to of in on at for and or if then than that this these those "
    "my your what when how why with as be have has had not no yes there their its who which"
).split()
TERM_SPLIT = "[^a-z0-9.+-]+"
KEYWORD_MIN = 3
PAGE_MARK = r"<!--\s*page:\s*(\d+)(\s+inferred)?\s*-->"
DEFINITION = r"^>?\s*\*\*([^*]{2,120})\*\*\s*(?:[-–—]|\s)\s*(.+)$"
STANCES = ("PERMITTED", "FORBIDDEN", "FACTUAL", "UNSTATED", "UNCLEAR")
TRIM = r"^\s+|\s+$"


def units(s: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")


def trim(s: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(s, f"(?U){TRIM}", "")


def est_tokens(s: Column) -> Column:
    """A quarter of the length, rounded up."""
    return F.ceil(units(s) / 4).cast("int")


def clean(s: Column) -> Column:
    """Without page marks, with at most one blank line in a row, trimmed."""
    return trim(F.regexp_replace(F.regexp_replace(s, PAGE_MARK, ""), r"\n{3,}", "\n\n"))


def terms(s: Column) -> Column:
    """Search terms: inner dots, plus and hyphens survive, and so does a plus at the end; no stemming."""
    raw = F.split(F.lower(s), TERM_SPLIT)
    bare = F.transform(raw, lambda t: F.rtrim(F.ltrim(t, F.lit(".+-")), F.lit(".-")))
    return F.filter(bare, lambda t: (t != "") & ~t.isin(*STOPWORDS))


#: By byte: 1 for what a term begins with, 2 for what it may end with besides, 3 for what it may have inside.
TERM_BYTES = np.array([1 if chr(i) in "abcdefghijklmnopqrstuvwxyz0123456789" else 2 if i == ord("+") else 3 if chr(i) in ".-" else 0 for i in range(256)], np.uint8)


def split_terms(lowered: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What ``terms`` gives for lower-cased texts, one text after the other, and the number of each term's text. By bytes: those of
    other characters than ASCII's are above it."""
    texts = pc.fill_null(lowered, "")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, wide)
    n = int(ends[-1] - ends[0])
    if n == 0:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = (ends - ends[0]).astype(np.int64)
    kind = TERM_BYTES[data]
    edge = np.zeros(n + 1, bool)
    edge[ends] = True

    def begins(x):
        return np.flatnonzero(x & (edge[:-1] | ~np.concatenate(([False], x[:-1]))))

    def stops(x):
        return np.flatnonzero(x & (edge[1:] | ~np.concatenate((x[1:], [False])))) + 1

    run = kind > 0
    lo, hi = begins(run), stops(run)
    first, last = begins(kind == 1), stops((kind == 1) | (kind == 2))
    if not len(first):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    lo = np.append(first, n)[np.searchsorted(first, lo)]
    has = lo < hi
    lo, hi = lo[has], hi[has]
    hi = last[np.searchsorted(last, hi, "right") - 1]
    step = np.zeros(n + 1, np.int8)
    step[lo] += 1
    step[hi] -= 1
    offsets = np.concatenate(([0], np.cumsum(hi - lo)))
    bare = pa.LargeStringArray.from_buffers(len(lo), pa.py_buffer(offsets), pa.py_buffer(data[np.cumsum(step[:-1], dtype=np.int8) > 0]))
    kept = pc.invert(pc.is_in(bare, value_set=pa.array(STOPWORDS, pa.large_string())))
    return bare.filter(kept).cast(pa.string()), (np.searchsorted(ends, lo, "right") - 1)[kept.to_numpy(zero_copy_only=False)]


def keywords(s: Column) -> Column:
    """Terms of the keyword baseline: letters and digits, three at least."""
    raw = F.split(F.regexp_replace(F.lower(s), r"[^a-z0-9\s]", " "), r"\s+")
    return F.filter(raw, lambda t: (F.length(t) >= KEYWORD_MIN) & ~t.isin(*KEYWORD_STOPWORDS))


def _decomposed(s: Column) -> Column:
    """NFKD, which has no built-in function."""

    def nfkd(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKD", x))

    return F.pandas_udf(nfkd, "string")(s)


def normalize(s: Column) -> Column:
    """For comparing transcriptions: accents, case, typographic quotes and dashes, hyphenation and spacing are ignored."""
    s = F.lower(F.regexp_replace(_decomposed(s), r"[̀-ͯ]", ""))
    s = F.regexp_replace(s, r"[‘’‛]", "'")
    s = F.regexp_replace(s, r"[“”]", '"')
    s = F.regexp_replace(s, r"[‐-―]", "-")
    s = F.regexp_replace(F.regexp_replace(s, "­", ""), r"-(?U)\s*\n\s*", "")
    s = F.regexp_replace(s, r"""[^a-z0-9'".+\-\s]""", " ")
    return trim(F.regexp_replace(s, r"\s+", " "))


def words_of(normal: Column) -> Column:
    """The words of a normalised text."""
    return F.filter(F.split(normal, " "), lambda w: w != "")


def ordered_coverage(source: Column, target: Column) -> Column:
    """Share of ``target`` (words) that greedy reading of ``source`` (words) meets in order; 0 for an empty target."""
    met = F.aggregate(source, F.lit(0), lambda i, w: i + F.coalesce((w == F.get(target, i)).cast("int"), F.lit(0)))
    return F.when(F.size(target) == 0, F.lit(0.0)).otherwise(met / F.greatest(F.size(target), F.lit(1)))


def breadcrumb(path: Column) -> Column:
    return F.array_join(path, " > ")


def embed_input(path: Column, title: Column, content: Column) -> Column:
    """Breadcrumb (title if empty), blank line, content."""
    return F.concat(F.when(breadcrumb(path) == "", title).otherwise(breadcrumb(path)), F.lit("\n\n"), content)


def index_input(path: Column, content: Column) -> Column:
    return F.concat_ws(" ", F.array_join(path, " "), content)


def rerank_input(path: Column, content: Column) -> Column:
    return F.concat(breadcrumb(path), F.lit("\n"), content)


def chunk_id(doc: Column, path: Column, content: Column) -> Column:
    """Document and the first 12 hex digits of a hash of document, breadcrumb and content."""
    return F.concat(doc, F.lit(":"), F.substring(F.sha2(F.concat_ws(" ", doc, breadcrumb(path), content), 256), 1, 12))


def page_label(first: Column, last: Column) -> Column:
    """Nothing, one page, or a range."""
    many = F.concat(F.lit(" (pp. "), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(")"))
    one = F.concat(F.lit(" (p. "), first.cast("string"), F.lit(")"))
    return F.when(first.isNull(), "").when((F.coalesce(last, F.lit(0)) != 0) & (last != first), many).otherwise(one)


def group_key(doc_type: Column, path: Column) -> Column:
    """Breadcrumb without its leaf, at least one element outside cards."""
    up = F.size(path) - 1
    card = F.concat(F.lit("cards:"), breadcrumb(F.slice(path, 1, F.greatest(up, F.lit(0)))))
    return F.when(doc_type == "cards", card).otherwise(breadcrumb(F.slice(path, 1, F.greatest(up, F.lit(1)))))


def section_prefix(path: Column) -> Column:
    return breadcrumb(F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(1))))


def citation_label(source: Column, url: Column, doc_type: Column, path: Column, title: Column, page: Column, page_end: Column) -> Column:
    """The short label of a resolved citation."""
    host = F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^www\.", "")
    web = F.coalesce(host, F.when(title == "", None).otherwise(title), F.lit("web"))
    where = F.when(F.size(path) > 0, breadcrumb(path)).otherwise(title)
    upload = F.when(page.isNotNull(), F.concat(title, F.lit(" p."), page.cast("string"))).otherwise(title)
    many = (F.coalesce(page_end, F.lit(0)) != 0) & (page_end != page)
    pages = F.when(many, F.concat(F.lit("pp."), page.cast("string"), F.lit("-"), page_end.cast("string"))).otherwise(F.concat(F.lit("p."), page.cast("string")))
    return (
        F.when(source == "web", web).when(doc_type == "upload", upload).when(doc_type == "cards", F.concat(F.lit("Card - "), where)).when(page.isNull(), where)
        .otherwise(F.concat(F.lit("Rulebook "), pages, F.lit(" - "), where))
    )


def found(s: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without a match (an empty group stays empty)."""
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, group))


def card_cost(rest: Column) -> Column:
    return found(rest, r"^\(([^)]*)\)")


def card_type(rest: Column) -> Column:
    return found(rest, r"\[([A-Za-z ]+)\]")


def toc_key(s: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(s), "[^a-z]", ""), 1, 7)


def inline_marks(s: Column) -> Column:
    """Bold and code marks, in order, as they stand."""
    return F.regexp_extract_all(s, F.lit(r"\*\*[^*]+\*\*|`[^`]+`"), F.lit(0))


def stance(reply: Column) -> Column:
    """The first stance of the list, in its order, that the reply contains; UNCLEAR without one, or without a reply."""
    out = F.lit("UNCLEAR")
    for s in reversed(STANCES):
        out = F.when(F.contains(F.upper(reply), F.lit(s)), s).otherwise(out)
    return out


def snippet(s: Column, most: int, fallback: str) -> Column:
    one = F.substring(F.regexp_replace(F.coalesce(s, F.lit("")), r"\n+", " "), 1, most)
    return F.when(one == "", fallback).otherwise(one)


def backoff_seconds(base: float, attempt: int, cap: float, retry_after: float | None = None) -> float:
    """Delay before a client's next attempt; a server's own wish comes first."""
    return retry_after if retry_after is not None else min(base * attempt, cap)

"""Retrieval over many queries at once: BM25, keyword baseline, exact cosine, rank fusion, floor and section expansion.

Scores are rounded to 6 digits before they are ranked, and ties go to the smaller chunk number, so ranks don't depend on
the order in which partial sums meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlspike.functions import text as T
from marlspike.operators.unions import stacked
from marlspike.sources.scratch import cut

# Fixed values of the ranking formulas.
K1, B, IDF_FLOOR = 1.5, 0.75, 1e-6
RRF_K = 60
PER_ARM = 40
EXPANDED = 14
WEAK = 0.02
#: By how much a score may be below what it is rounded to, at 6 digits.
MARGIN = 2e-6
#: Pairs of a query and one of its terms that are held at once by the lexical arm.
PAIRS = 1 << 20
#: Scores, and parts of them, that a task of the lexical arm adds up at once.
CELLS = 1 << 20
#: Query vectors that are held at once by the dense arm.
BLOCK = 4096
#: Vectors that are multiplied by a block at once, and chunks whose terms are counted at once, unless their texts have more bytes.
ROWS = 1024
BYTES = 1 << 23


def top(df: DataFrame, k: int, *order: Column, by: tuple[str, ...] = ("qid",), rank: str = "rank") -> DataFrame:
    """The first k rows per key; Spark limits each group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def postings(docs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(id, len, term, tf) of documents (id, terms). With ``wanted`` (term), only these terms: filtered before they are counted."""
    flat = docs.select("id", F.size("terms").alias("len"), F.explode("terms").alias("term"))
    if wanted is not None:
        flat = flat.join(wanted.select("term").distinct(), "term", "left_semi")
    return flat.groupBy("id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))


def tokenized(chunks: DataFrame) -> DataFrame:
    """(id, terms) of chunks (id, content)."""
    return chunks.select("id", T.terms(F.col("content")).alias("terms"))


class Lexical:
    """The terms of a corpus, read once and written to the shared folder; queries are weighed against them."""

    def __init__(self, chunks: DataFrame):
        self.docs = cut(tokenized(chunks).withColumn("len", F.size("terms")), "terms")

    def stats(self) -> DataFrame:
        """One row: n, avg_len."""
        return self.docs.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))

    def parts(self, asked: DataFrame) -> DataFrame:
        """(term, id, part): what each of these terms adds to the score of each chunk that has it."""
        post = cut(postings(self.docs, asked), "counted")
        df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), F.lit(IDF_FLOOR))
        norm = 1 - B + B * F.col("len") / F.when(F.col("avg_len") > 0, F.col("avg_len")).otherwise(1)
        part = idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * norm)
        return post.join(df, "term").crossJoin(F.broadcast(self.stats())).select("term", "id", part.alias("part"))  # the statistics are one row


def indexed(chunks: DataFrame | Lexical) -> Lexical:
    return chunks if isinstance(chunks, Lexical) else Lexical(chunks)


def asked_terms(queries: DataFrame) -> DataFrame:
    """(qid, term): each distinct term of queries (qid, question)."""
    return queries.select("qid", F.explode(F.array_distinct(T.terms(F.col("question")))).alias("term"))


def bm25(chunks: DataFrame | Lexical, queries: DataFrame) -> DataFrame:
    """(qid, id, score) of all chunks with a term of the query; chunks (id, content), queries (qid, question)."""
    asked = asked_terms(queries)
    return indexed(chunks).parts(asked).join(asked, "term").groupBy("qid", "id").agg(F.round(F.sum("part"), 6).alias("score"))


def bm25_top(chunks: DataFrame | Lexical, queries: DataFrame, k: int, pairs: int = PAIRS) -> DataFrame:
    """(qid, id, score, rank): the k best of ``bm25``, exactly, without a row for each chunk that shares a term with a query.

    Queries go out in blocks of about ``pairs`` distinct (qid, term), whatever their number: one block is on the driver at a time,
    and its best are written before the next one. A block's terms in the corpus are counted and written as numbers; a task then adds
    up the scores of some of its chunks at a time and hands on its k best per query, so what is shuffled is k rows per query and task.
    Chunks that repeat an id are merged by their terms first, as ``bm25`` does, on the way that shuffles all scores.
    """
    asked = cut(asked_terms(queries).distinct(), "asked")
    blocks = max(1, -(-asked.count() // pairs))
    docs = chunks.docs.select("id", "terms") if isinstance(chunks, Lexical) else chunks.select("id", F.lower("content").alias("text"))
    if blocks > 1 and not isinstance(chunks, Lexical):
        docs = cut(docs, "texts")
    parts = []
    for i in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i)
        found = _lexical_block(docs, mine, k)
        if found is None:
            return top(bm25(chunks, queries), k, F.desc("score"), F.col("id"))
        best = top(found, k, F.desc("score"), F.col("id"))
        parts.append(best if blocks == 1 else cut(best, "block"))
    return stacked(*parts)


def _lexical_block(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame | None:
    """(qid, id, score) of each task's k best per query of ``asked`` (qid, term), distinct; None if ``docs`` (id, and terms or the lower-cased text) repeat an id."""
    spark = docs.sparkSession
    rows = asked.toArrow()
    words, qids = (pc.unique(rows.column(c).combine_chunks()) for c in ("term", "qid"))
    term, who = (pc.index_in(rows.column(c).combine_chunks(), value_set=v).to_numpy(zero_copy_only=False).astype(np.int64) for c, v in (("term", words), ("qid", qids)))
    asks = who[np.argsort(term, kind="stable")].astype(np.int32)  # the queries of each term, one term after the other
    at = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(words)))))
    vocabulary = spark.sparkContext.broadcast(words)

    def counted(batches):
        words = vocabulary.value
        for b in (p for b in batches for p in pieces(b)):
            texts = b.column(1)
            if pa.types.is_list(texts.type) or pa.types.is_large_list(texts.type):
                found, owner, size = texts.flatten(), pc.list_parent_indices(texts).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(texts)
            else:
                found, owner = T.split_terms(texts)
                size = pa.array(np.bincount(owner, minlength=b.num_rows), pa.int32(), mask=texts.is_null().to_numpy(zero_copy_only=False))
            found = pc.index_in(found, value_set=words)
            key = owner * max(1, len(words)) + pc.fill_null(found, -1).to_numpy(zero_copy_only=False)
            key, tf = np.unique(key[pc.is_valid(found).to_numpy(zero_copy_only=False)], return_counts=True)
            doc, word = np.divmod(key, max(1, len(words)))
            ends = pa.array(np.searchsorted(doc, np.arange(b.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), size, pa.ListArray.from_arrays(ends, pa.array(word, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32()))], names=["id", "len", "word", "tf"]
            )

    kind, asker = (df.schema[c].dataType.simpleString() for df, c in ((docs, "id"), (asked, "qid")))
    post = cut(docs.mapInArrow(counted, f"id {kind}, len int, word array<int>, tf array<int>"), "counted")
    if post.groupBy("id").count().where("count > 1").limit(1).count():
        return None
    n, avg_len = post.agg(F.count(F.lit(1)), F.avg("len")).first()

    def chunks_with(batches):
        df = np.zeros(len(at) - 1, np.int64)
        for b in batches:
            df += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), minlength=len(df))
        has = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(df[has])], names=["word", "df"])

    have = post.select("word").mapInArrow(chunks_with, "word int, df long").groupBy("word").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(words))
    df[have.column("word").to_numpy()] = have.column("df").to_numpy()
    idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5) + 1), IDF_FLOOR)
    held = spark.sparkContext.broadcast((asks, at, idf, qids))

    def scored(batches):
        asks, at, idf, qids = held.value
        best = Best(len(qids), k)
        for b in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            size = b.column(1).to_numpy(zero_copy_only=False)
            owner, word, tf = pc.list_parent_indices(b.column(2)).to_numpy(zero_copy_only=False), b.column(2).flatten().to_numpy(zero_copy_only=False), b.column(3).flatten().to_numpy(zero_copy_only=False)
            part = idf[word] * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * size[owner] / (avg_len if avg_len and avg_len > 0 else 1)))
            times = at[word + 1] - at[word]
            ends = np.concatenate(([0], np.cumsum(times)))
            first = np.searchsorted(owner, np.arange(b.num_rows + 1))
            lo = 0
            while lo < b.num_rows and len(qids):  # as many chunks as fit into CELLS, one at least
                hi = int(np.searchsorted(ends[first], ends[first[lo]] + CELLS, "right")) - 1
                hi = max(lo + 1, min(hi, b.num_rows, lo + CELLS // len(qids)))
                p, q = first[lo], first[hi]
                t = times[p:q]
                of = np.repeat(at[word[p:q]] - ends[p:q], t) + np.arange(ends[p], ends[q])
                cell = asks[of] * np.int64(hi - lo) + np.repeat(owner[p:q] - lo, t)
                s = np.bincount(cell, np.repeat(part[p:q], t), len(qids) * (hi - lo)).reshape(len(qids), hi - lo)
                best.add(s, b.column(0).slice(lo, hi - lo))
                lo = hi
        yield from best.batches(qids)

    return post.mapInArrow(scored, f"qid {asker}, id {kind}, score double")


def pieces(batch: pa.RecordBatch):
    """Slices of a batch of up to ROWS rows; fewer, down to one, where its second column has more than BYTES of text."""
    at = 0
    while at < batch.num_rows:
        part = batch.slice(at, ROWS)
        while part.num_rows > 1 and part.column(1).nbytes > BYTES:
            part = part.slice(0, part.num_rows // 2)
        yield part
        at += part.num_rows


class Best:
    """The k best (score, then the smaller id) per query of what is added; scores are rounded, and 0 is no hit."""

    def __init__(self, queries: int, k: int):
        self.k, self.least, self.n = k, np.full(queries, -np.inf), 0
        self.pool: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.most = max(4 * queries * k, CELLS // 8)

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        """scores: a row per query, a column per id."""
        q, d = np.nonzero((scores > 0) & (scores + MARGIN >= self.least[:, None]))
        s = np.round(scores[q, d], 6)
        q, d, s = (x[s >= self.least[q]] for x in (q, d, s))
        self.pool.append((q, s, ids.take(pa.array(d))))
        self.n += len(q)
        if self.n > self.most:
            self.shrink()

    def shrink(self) -> None:
        q, s = (np.concatenate([x[i] for x in self.pool]) for i in (0, 1))
        ids = pa.concat_arrays([x[2] for x in self.pool])
        place = np.empty(len(q), np.int64)
        place[pc.sort_indices(ids).to_numpy()] = np.arange(len(q))
        order = np.lexsort((place, -s, q))
        nth = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        order = order[nth < self.k]
        q, s = q[order], s[order]
        full = np.flatnonzero(np.bincount(q, minlength=len(self.least)) == self.k)
        self.least[full] = s[np.searchsorted(q, full, "right") - 1]
        self.pool, self.n = [(q, s, ids.take(pa.array(order)))], len(q)

    def batches(self, qids: pa.Array):
        if self.pool:
            self.shrink()
            q, s, ids = self.pool[0]
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), ids, pa.array(s)], names=["qid", "id", "score"])


def of_types(wide: DataFrame, chunks: DataFrame, types: list[str], k: int = PER_ARM) -> DataFrame:
    """Of a ranking over all types, the first k of these types: fewer may remain."""
    kept = wide.join(chunks.select("id", "doc_type"), "id").where(F.col("doc_type").isin(*types))
    return top(kept.drop("rank"), k, F.desc("score"), F.col("id"))


def bm25_of_types(chunks: DataFrame, queries: DataFrame, types: list[str], k: int = PER_ARM) -> DataFrame:
    """Twice k are ranked over all types, then those of other types go, then k stay."""
    return of_types(bm25_top(chunks, queries, 2 * k), chunks, types, k)


def keyword_scores(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, id, score) of the keyword baseline: idf of each query word, as often as the query has it, if the chunk has it."""
    asked = queries.select("qid", F.explode(T.keywords(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))
    has = chunks.select("id", F.explode(F.array_distinct(T.keywords(F.col("content")))).alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    df = has.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = F.broadcast(chunks.agg(F.count(F.lit(1)).alias("n")))
    idf = df.crossJoin(n).select("term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    return has.join(idf, "term").join(asked, "term").groupBy("qid", "id").agg(F.round(F.sum(F.col("times") * F.col("idf")), 6).alias("score"))


def keyword_budget(chunks: DataFrame, queries: DataFrame, n: int = 6, chars: int = 9000) -> DataFrame:
    """(qid, id, rank): greedy picks in score order that fit the rest of a budget of characters, at most n.

    What doesn't fit once never fits later, so each pick is the best chunk behind the one before that fits what is left: n
    aggregations over the scores, and no query's list is ordered in one task. If no scored chunk fits, the first that does is
    taken, or else the first two; queries without a keyword take the first n.
    """
    sized = chunks.select("id", T.units(F.col("content")).cast("long").alias("size"))
    scored = keyword_scores(chunks, queries).join(sized, "id").select("qid", F.struct((-F.col("score")).alias("s"), F.col("id").cast("long").alias("id")).alias("key"), "size")
    scored = scored.persist()  # read once per pick; lost blocks are computed anew
    state = queries.select("qid", (F.size(T.keywords(F.col("question"))) > 0).alias("has"), F.lit(None).cast("struct<s:double,id:bigint>").alias("last"), F.lit(chars).cast("long").alias("left"), F.array().cast("array<bigint>").alias("picked"))
    for _ in range(n):
        rest = scored.withColumnRenamed("qid", "_q")
        fits = (F.col("qid") == F.col("_q")) & (F.col("last").isNull() | (F.col("key") > F.col("last"))) & (F.col("size") <= F.col("left"))
        state = state.join(rest, fits, "left").groupBy("qid", "has", "last", "left", "picked").agg(F.min(F.when(F.col("key").isNotNull(), F.struct("key", "size"))).alias("b"))
        full = F.col("b").isNull()
        state = state.select(
            "qid", "has", F.coalesce("b.key", "last").alias("last"), F.when(full, F.lit(-1)).otherwise(F.col("left") - F.col("b.size")).alias("left"),
            F.when(full, F.col("picked")).otherwise(F.concat("picked", F.array("b.key.id"))).alias("picked"),
        )
    ids = chunks.select(F.lit(0).alias("one"), F.col("id").cast("long").alias("id"))
    first = top(ids, n, F.col("id"), by=("one",)).agg(F.sort_array(F.collect_list("id")).alias("first"))
    fits = sized.where(F.col("size") <= chars).agg(F.min("id").cast("long").alias("fit"))
    state = state.crossJoin(F.broadcast(first)).crossJoin(F.broadcast(fits))  # one row each
    chosen = F.when(~F.col("has"), F.col("first")).when(F.size("picked") > 0, F.col("picked")).when(F.col("fit").isNotNull(), F.array("fit")).otherwise(F.slice("first", 1, 2))
    return state.select("qid", F.posexplode(chosen).alias("pos", "id")).select("qid", "id", (F.col("pos") + 1).alias("rank"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays in double arithmetic; 0 if either has no length."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / F.nullif(norm, F.lit(0.0)))


def dense_top(vectors: DataFrame, queries: DataFrame, k: int = PER_ARM, block: int = BLOCK) -> DataFrame:
    """(qid, id, score, rank): exact cosine of each query (qid, vector) against all vectors (id, vector).

    Queries go out in blocks of about ``block`` vectors, whatever their number: one block is on the driver at a time, and its best
    are written before the next one. A task multiplies its vectors by a block and hands on its k best per query, so what is
    shuffled is k rows per query and task.
    """
    blocks = max(1, -(-queries.count() // block))
    parts = []
    for i in range(blocks):
        mine = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i)
        rows = mine.select("qid", "vector").toPandas()
        ids = rows["qid"].to_numpy(np.int64)
        q = np.stack(rows["vector"].to_numpy()).astype(np.float64) if len(rows) else np.zeros((0, 1))
        best = top(_dense_block(vectors, ids, q, k), k, F.desc("score"), F.col("id"))
        parts.append(best if blocks == 1 else cut(best, "block"))
    return stacked(*parts)


def _dense_block(vectors: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    held = vectors.sparkSession.sparkContext.broadcast((ids, q, np.sqrt((q * q).sum(1))))

    def run(batches):
        qid, qv, qn = held.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.array([], np.int64), np.array([]))] * len(qid)
        parts = (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS))
        for b in parts:
            if not len(qid):
                continue
            who = b.column(0).to_numpy()
            width = len(b.column(1)[0].as_py())
            if width != qv.shape[1]:
                raise ValueError(f"vectors of width {width} don't fit queries of width {qv.shape[1]}")
            v = b.column(1).flatten().to_numpy().astype(np.float64).reshape(-1, width)
            norm = qn[:, None] * np.sqrt((v * v).sum(1))[None, :]
            with np.errstate(invalid="ignore", divide="ignore"):
                s = np.round(np.where(norm == 0, 0.0, qv @ v.T / norm), 6)
            least = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
            for i in range(len(qid)):
                fit = np.flatnonzero(s[i] >= least[i])  # k, and what ties with the last of them
                w, t = np.concatenate((best[i][0], who[fit])), np.concatenate((best[i][1], s[i][fit]))
                keep = np.lexsort((w, -t))[:k]
                best[i] = (w[keep], t[keep])
        for i, (w, t) in enumerate(best):
            if len(w):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), qid[i])), pa.array(w), pa.array(t)], names=["qid", "id", "score"])

    return vectors.select(F.col("id").cast("long"), "vector").mapInArrow(run, "qid long, id long, score double")


def fuse(arms: list[tuple[str, DataFrame]]) -> DataFrame:
    """(qid, id, score, ranks per arm, rank) of ranked lists (qid, id, rank): the sum of 1 / (60 + rank).

    Ties go to what the earlier arm, then the better rank, has first.
    """
    rows = stacked(*(df.select("qid", "id", F.lit(i).alias("arm"), "rank") for i, (_, df) in enumerate(arms)))
    per_arm = [F.min(F.when(F.col("arm") == i, F.col("rank"))).alias(f"{name}_rank") for i, (name, _) in enumerate(arms)]
    fused = rows.groupBy("qid", "id").agg(F.round(F.sum(1 / (RRF_K + F.col("rank"))), 6).alias("score"), F.min(F.struct("arm", "rank")).alias("first"), *per_arm)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "first.arm", "first.rank")
    return fused.withColumn("rank", F.row_number().over(order)).drop("first")


def rerank(fused: DataFrame, scorer, most: int = PER_ARM) -> DataFrame:
    """The first ``most`` candidates per query in the order of ``scorer`` (a column); the others are gone."""
    cut = fused.where(F.col("rank") <= most).withColumn("score", F.round(scorer, 4)).withColumnRenamed("rank", "fused_rank")
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "fused_rank")))


def rule_floor(fused: DataFrame, options: DataFrame) -> DataFrame:
    """The first k per query, with ``floor`` non-cards at least: the best below the cut take the places of the last cards.

    fused (qid, id, doc_type, rank, ...), options (qid, k, floor). A chunk without a type counts as a rule. Promoted rows come
    last; ``rank`` is the new order. Below the cut only the first ``floor`` rules matter, so the others go first; one window
    counts what is there, one numbers the cards above the cut.
    """
    df = fused.join(options.select("qid", "k", "floor"), "qid").withColumn("rule", F.coalesce("doc_type", F.lit("")) != "cards")
    df = df.withColumn("_in", F.col("rank") <= F.col("k")).where(F.col("_in") | F.col("rule"))
    place = Window.partitionBy("qid", "_in", "rule").orderBy("rank")
    df = df.withColumn("_nth", F.row_number().over(place)).where(F.col("_in") | (F.col("_nth") <= F.least("floor", "k")))
    q = Window.partitionBy("qid")
    have, below, cards = (F.count_if(c).over(q) for c in (F.col("_in") & F.col("rule"), ~F.col("_in"), F.col("_in") & ~F.col("rule")))
    df = df.withColumns({"_have": have, "_below": below, "_cards": cards})
    need = F.when(F.col("floor") <= 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.least("floor", "k") - F.col("_have"), F.col("_below"))))
    keep = F.when(F.col("_in"), F.col("rule") | (F.col("_nth") <= F.col("_cards") - need)).otherwise(F.col("_nth") <= need)
    df = df.where(keep).withColumn("promoted", ~F.col("_in"))
    order = Window.partitionBy("qid").orderBy("promoted", "rank")
    names = [c for c in fused.columns if c != "rank"]
    return df.withColumn("_rank", F.row_number().over(order)).select(*names, "promoted", F.col("_rank").alias("rank"))


def section_complete(selected: DataFrame, chunks: DataFrame, options: DataFrame) -> DataFrame:
    """Selected rows, and for queries that want it all non-cards of the seed's section behind them, with score 0.

    The seed is the best non-card, or the best row if there is none. At most max(k, 14) rows stay. Of a section only its first
    rules meet the queries: as many as may be missing, and as many as a query may have already. selected (qid, id, score, rank),
    chunks (id, ordinal, doc_type, path), options (qid, k, section_complete).
    """
    info = chunks.select("id", "ordinal", "doc_type", T.section_prefix(F.col("path")).alias("prefix"))
    want = options.where("section_complete").select("qid", (F.greatest("k", F.lit(EXPANDED))).alias("most"))
    rows = selected.select("qid", "id", "score", "rank")
    known = rows.join(info.select("id", "doc_type", "prefix"), "id")
    seed = known.groupBy("qid").agg(F.min_by("prefix", F.struct((F.coalesce("doc_type", F.lit("")) == "cards").alias("card"), F.col("rank"))).alias("prefix"), F.max("rank").alias("last"), F.count(F.lit(1)).alias("held"))
    seed = cut(seed.join(want, "qid"), "seed")
    reach = seed.agg(F.max(F.col("most") - F.col("last") + F.col("held"))).first()[0] or 0
    rules = info.where(F.coalesce("doc_type", F.lit("")) != "cards").select("id", "ordinal", "prefix")
    rules = top(rules, reach, F.col("ordinal"), F.col("id"), by=("prefix",), rank="nth").drop("nth")
    more = seed.drop("held").join(rules, "prefix").join(rows.select("qid", "id"), ["qid", "id"], "left_anti")
    more = more.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("ordinal", "id"))).where(F.col("last") + F.col("n") <= F.col("most"))
    more = more.select("qid", "id", F.lit(0.0).alias("score"), (F.col("last") + F.col("n")).alias("rank"), F.lit(True).alias("sibling"))
    return stacked(rows.withColumn("sibling", F.lit(False)), more)


def materialize(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked ids with their chunks; unknown ids go, ranks stay."""
    return ranked.join(chunks, "id")


def weak_evidence(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(qid, attach): search is attached to prohibitions, and where the best row is absent or scores below 0.02."""
    best = results.where("rank = 1").select("qid", "score")
    return queries.select("qid", "shape").join(best, "qid", "left").select("qid", "shape", ((F.col("shape") == "prohibition") | (F.coalesce("score", F.lit(0.0)) < WEAK)).alias("attach"))


def rounded(x: Column, digits: int) -> Column:
    """``x`` with so many decimals, halves of its product with a power of ten away from zero: what prints as a half may be less in binary."""
    y = F.abs(x) * 10.0**digits
    return F.signum(x) * (F.floor(y) + (y - F.floor(y) >= 0.5).cast("int")) / 10.0**digits


def trace(ranked: DataFrame, digits: int, most: int = 12) -> DataFrame:
    """(qid, entries): the first ``most`` rows of a ranking as id:rank:score."""
    cut = ranked.where(F.col("rank") <= most).withColumn("s", rounded(F.col("score"), digits))
    return cut.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id", "s"))), lambda x: F.concat_ws(":", x.id, x.rank, F.format_number(x.s, digits))), " ").alias("entries"))


def rank_moves(dense: DataFrame, final: DataFrame, most: int = 12) -> DataFrame:
    """(qid, id, rank, dense_rank, move): how far a row rose from its place in the traced dense list; null if it wasn't there.
    ``sibling``, whether a row came with its section only, stays if ``final`` has it."""
    seen = dense.where(F.col("rank") <= most).select("qid", "id", F.col("rank").alias("dense_rank"))
    kept = ["sibling"] if "sibling" in final.columns else []
    return final.select("qid", "id", "rank", *kept).join(seen, ["qid", "id"], "left").withColumn("move", F.col("dense_rank") - F.col("rank"))

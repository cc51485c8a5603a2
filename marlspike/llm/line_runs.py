"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling.

A document is the sequence of its lines that hold a word. Lines that occur once end every repeated run; between them lie
segments, and segments of fewer than MIN_WORDS words are left out, as no run that counts fits in. Each line of the others is a
suffix, numbered in document order.

1. Order. A suffix's rank is the number of suffixes in smaller groups. Round h refines groups that agree in h lines by the
   ranks at (place, place + h); whoever is alone, or at the end of its segment, is done. Rounds go on until all are done: the
   ranks, and places among what is equal to its end, are the suffix array.
2. Longest common prefixes of neighbours in that order, by descent: from the deepest round on, both places move on by h lines
   where their ranks at depth h agree.
3. Runs. A suffix's longest run that starts earlier, too, is the largest prefix it shares with a neighbour of an earlier place
   on either side: of the common-prefix intervals around it, the deepest in which it isn't first. Intervals are kept on a stack
   while chunks of CHUNK suffixes are read in order, both ways; what stays on the stack at a chunk's end (places and depths
   that increase together, so no more than the lines of the longest repeated run) is passed on to the next chunks.

A run that isn't part of a longer one is maximal. Those of MIN_WORDS words or more go, line by line; the first copy stays.

All joins are on numbers of lines or on ranks, and their tables are written before, so a line that is in a third of all
documents is split by adaptive skew joins, and its counts are pre-aggregated. The last join, of texts with their runs, is a
sort-merge join at every size: it is the one that moves texts.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, extended, read_table, row_key, slices, text_of
from .quality_rules import SPACES

MIN_WORDS = 50
CHUNK = 1 << 16  # suffixes that one task holds
ROWS = 500_000  # of a task that orders rows


def _partitions(df: DataFrame, rows: int | None) -> int:
    """Of a range sort: as many as the session's shuffles have, or fewer for few rows."""
    most = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return most if rows is None else max(1, min(most, -(-rows // ROWS)))


def _based(df: DataFrame, size: str, out: str) -> DataFrame:
    """``df`` (written, with part and the running ``out`` within it) with ``out`` running over all parts; size: a part's total.
    What is ordered in one task, and broadcast, is one row a part."""
    totals = df.groupBy(F.col("part").alias("_part")).agg(F.expr(size).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return df.join(F.broadcast(bases), F.col("part") == F.col("_part")).withColumn(out, F.col(out) + F.col("_base")).drop("part", "_part", "_base")


def _running(df: DataFrame, cols: list[str], size: str, most: int | None = None) -> DataFrame:
    """(cols, size) with before: the sum of size of all rows that come before in the order of cols. most: rows at most, if known."""

    def run(batches):
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column(b.schema.names.index(size)).to_numpy(zero_copy_only=False)
            to = np.cumsum(n) + total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), part)), pa.array(to - n)], names=[*b.schema.names, "part", "before"])
            total = int(to[-1]) if len(to) else total

    rows = df.select(*cols, F.col(size).cast("long").alias(size))
    ordered = rows.repartitionByRange(_partitions(df, most), *cols).sortWithinPartitions(*cols)
    return _based(cut(ordered.mapInArrow(run, extended(rows, "part long, before long")), "running"), f"sum({size})", "before")


def _lines(docs: DataFrame, text: str) -> DataFrame:
    """(did, th, seq, line, words): every line with a word; line is a 128-bit hash."""

    def run(batches):
        for b in slices(batches):
            n, seq, line, words = [], [], [], []
            for t in b.column(2):
                found = [(x, k) for x in (t.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n") if (k := len(x.split()))]  # bytes: the six ASCII spaces
                n.append(len(found))
                seq += range(len(found))
                line += [xxhash.xxh3_128_digest(x) for x, _ in found]
                words += [k for _, k in found]
            of = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(seq, pa.int32()), pa.array(line, pa.binary()), pa.array(words, pa.int32())], names=["did", "th", "seq", "line", "words"])

    return docs.select(*row_key(), text_of(text).alias("text")).mapInArrow(run, "did long, th long, seq int, line binary, words int")


def _numbered(level: DataFrame, least: int) -> DataFrame:
    """(did, th, seq, words, rank) -> p, did, th, seq, words, rem, remw, rank, of segments of ``least`` words or more.

    p grows in the order of (did, th, seq), by one to the next line of a segment, by more else. rem, remw: lines and words from
    here to the segment's end. Rows are read from the last to the first; a task holds one segment besides its batch.
    """
    names = ["did", "th", "seq", "words", "rank"]

    def run(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held = {n: np.array([], np.int64) for n in names}

        def whole(rows):
            nonlocal number
            n = len(rows["seq"])
            first = np.ones(n, bool)
            first[1:] = (np.diff(rows["did"]) != 0) | (np.diff(rows["th"]) != 0) | (np.diff(rows["seq"]) != -1)
            at = np.flatnonzero(first)
            of = np.cumsum(first) - 1
            rem = np.arange(n) - at[of] + 1
            total = np.cumsum(rows["words"])
            remw = total - (total[at] - rows["words"][at])[of]
            keep = np.add.reduceat(rows["words"], at)[of] >= least
            local = np.cumsum(keep) + np.cumsum(first & keep)  # a gap between segments
            out = [pa.array(rows[x][keep]) for x in names] + [pa.array(rem[keep]), pa.array(remw[keep]), pa.array(np.full(keep.sum(), part)), pa.array(local[keep] + number)]
            number += int(local[-1])
            return pa.RecordBatch.from_arrays(out, names=[*names, "rem", "remw", "part", "number"])

        for b in batches:
            rows = {n: np.concatenate((held[n], b.column(b.schema.names.index(n)).to_numpy(zero_copy_only=False).astype(np.int64))) for n in names}
            if not len(rows["seq"]):
                continue
            same = (rows["did"] == rows["did"][-1]) & (rows["th"] == rows["th"][-1]) & (rows["seq"] + np.arange(len(rows["seq"])) == rows["seq"][-1] + len(rows["seq"]) - 1)
            cut_at = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            held = {n: x[cut_at:] for n, x in rows.items()}
            if cut_at:
                yield whole({n: x[:cut_at] for n, x in rows.items()})
        if len(held["seq"]):
            yield whole(held)

    back = [F.col(c).desc() for c in ("did", "th", "seq")]
    ordered = level.select(*(F.col(n).cast("long").alias(n) for n in names)).repartitionByRange(_partitions(level, None), *back[:2]).sortWithinPartitions(*back)
    schema = ", ".join(f"{n} long" for n in [*names, "rem", "remw", "part", "number"])
    return _based(cut(ordered.mapInArrow(run, schema), "numbered"), "max(number)", "number").withColumn("p", -F.col("number")).drop("number")


def _orders(places: DataFrame) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """(p, rank, rem) -> the final (p, rank), and of each depth h the (p, rank) of those that agree with others in h lines."""
    live, done, depths, h = places.select("p", "rank", "rem"), [], [], 1
    while n := live.count():
        depths.append((h, live.select("p", "rank")))
        known = live.select("p", "rank")
        for d in done:
            known = known.unionByName(d)
        after = known.select((F.col("p") - h).alias("p"), F.col("rank").alias("r2"))
        own = live.withColumnRenamed("rank", "r1")
        pairs = cut(own.where(F.col("rem") > h).join(after, "p").unionByName(own.where(F.col("rem") == h).withColumn("r2", F.lit(-1).cast("long"))), "pairs")
        counted = _running(pairs.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("c")), ["r1", "r2"], "c", n)
        low = counted.groupBy("r1").agg(F.min("before").alias("low"))
        fresh = counted.join(low, "r1").select("r1", "r2", "c", (F.col("r1") + F.col("before") - F.col("low")).alias("rank"))
        updated = cut(pairs.join(fresh, ["r1", "r2"]).select("p", "rank", "rem", ((F.col("c") > 1) & (F.col("rem") >= 2 * h)).alias("live")), "updated")
        done.append(updated.where("NOT live").select("p", "rank"))
        live, h = updated.where("live").drop("live"), 2 * h
    out = places.select("p", "rank").limit(0)
    for d in done:
        out = out.unionByName(d)
    return out, depths


def suffix_array(places: DataFrame, least: int) -> DataFrame:
    """(p, rank, rem, remw) -> (i, p, lcp): the suffixes of ``least`` words or more in order, with the lines that each shares
    with the one before."""
    ranks, depths = _orders(places)
    wanted = places.where(F.col("remw") >= least).select("p")
    order = cut(_running(ranks.join(wanted, "p", "left_semi").withColumn("one", F.lit(1)), ["rank", "p"], "one", places.count()).select(F.col("before").alias("i"), "p"), "order")
    pairs = order.join(order.select((F.col("i") + 1).alias("i"), F.col("p").alias("prev")), "i", "left").withColumn("lcp", F.lit(0).cast("long"))
    for h, level in reversed(depths):
        a, b = (level.select(F.col("p").alias(f"_{x}"), F.col("rank").alias(f"_r{x}")) for x in "ab")
        found = pairs.join(a, F.col("p") + F.col("lcp") == F.col("_a"), "left").join(b, F.col("prev") + F.col("lcp") == F.col("_b"), "left")
        pairs = cut(found.select("i", "p", "prev", F.when(F.col("_ra") == F.col("_rb"), F.col("lcp") + h).otherwise(F.col("lcp")).alias("lcp")), "lcp")
    return pairs.select("i", "p", "lcp")


class _Stack:
    """Earlier neighbours by depth: from bottom to top, places and the depths that they share with the next suffix increase."""

    def __init__(self, rows=()):
        self.place, self.depth = [r[0] for r in rows], [r[1] for r in rows]

    def meet(self, depth: int) -> None:
        """The next suffix shares ``depth`` lines with the one before."""
        place, depths = self.place, self.depth
        low = None
        while depths and depths[-1] > depth:
            depths.pop()
            low = place.pop()
        if low is not None and depth and not (depths and depths[-1] == depth):
            place.append(low)
            depths.append(depth)

    def push(self, p: int) -> int:
        """The deepest prefix shared with an earlier place; ``p`` is on the stack then."""
        place, depths = self.place, self.depth
        while place and place[-1] > p:
            place.pop()
            depths.pop()
        best = depths[-1] if depths else 0
        place.append(p)
        depths.append(1 << 62)
        return best

    def add(self, rows: list[tuple[int, int]]) -> None:
        """Put another stack, of places nearer to what comes next, on top."""
        for p, depth in rows:
            while self.place and self.place[-1] > p:
                self.place.pop()
                self.depth.pop()
            if not self.depth or self.depth[-1] < depth:  # else a smaller place shares as much
                self.place.append(p)
                self.depth.append(depth)

    def rows(self) -> list[tuple[int, int]]:
        return list(zip(self.place, self.depth, strict=True))


def _scan(place: list[int], lcp: list[int], before: list, after: list, behind: int) -> tuple[list[int], list, list]:
    """Each suffix's longest earlier run, and the stacks left at the end and at the start. lcp[k]: shared with the suffix before k;
    behind: shared by the last one with the suffix after it; before, after: the stacks of what lies there."""
    left, right = _Stack(before), _Stack(after)
    best = []
    for p, shared in zip(place, lcp, strict=True):
        left.meet(shared)
        best.append(left.push(p))
    for k in range(len(place) - 1, -1, -1):
        right.meet(lcp[k + 1] if k + 1 < len(place) else behind)
        best[k] = max(best[k], right.push(place[k]))
    return best, left.rows(), right.rows()


def longest_earlier(array: DataFrame) -> DataFrame:
    """(i, p, lcp) -> (p, n): the lines of each suffix's longest run that starts at an earlier place, too, if any.

    Two passes over chunks. The first one's result is, a chunk, the two stacks that it leaves and its least depth; they are put
    together on the driver: a few rows for each CHUNK suffixes, and the depths on a stack are distinct.
    """
    rows = array.withColumn("chunk", F.floor(F.col("i") / CHUNK))
    spark = array.sparkSession

    def ordered(t: pa.Table):
        t = t.sort_by("i")
        return int(t.column("chunk")[0].as_py()), t.column("p").to_pylist(), t.column("lcp").to_pylist()

    def ends(t: pa.Table) -> pa.Table:
        chunk, place, lcp = ordered(t)
        _, left, right = _scan(place, lcp, [], [], 0)
        out = [(chunk, lcp[0], min(lcp), min(lcp[1:], default=1 << 62), json.dumps(left), json.dumps(right))]
        return pa.table([pa.array(c) for c in zip(*out, strict=True)], names=["chunk", "head", "least", "inner", "left", "right"])

    if array.limit(1).count() == 0:
        return array.select("p", F.lit(0).cast("long").alias("n")).limit(0)
    found = sorted(rows.groupBy("chunk").applyInArrow(ends, "chunk long, head long, least long, inner long, left string, right string").collect())
    before, after, tails, held = {}, {}, {}, _Stack()
    for x in found:
        before[x["chunk"]] = held.rows()
        held.meet(x["least"])  # places further back share no more than the chunk's least depth with what follows it
        held.add(json.loads(x["left"]))
    held, behind = _Stack(), 0
    for x in reversed(found):
        after[x["chunk"]], tails[x["chunk"]] = held.rows(), behind
        held.meet(min(x["inner"], behind))
        held.add(json.loads(x["right"]))
        behind = x["head"]
    carried = spark.sparkContext.broadcast((before, after, tails))

    def run(t: pa.Table) -> pa.Table:
        chunk, place, lcp = ordered(t)
        b, a, tail = (x[chunk] for x in carried.value)
        best, _, _ = _scan(place, lcp, b, a, tail)
        hit = [k for k, n in enumerate(best) if n]
        return pa.table([pa.array([place[k] for k in hit], pa.int64()), pa.array([best[k] for k in hit], pa.int64())], names=["p", "n"])

    return rows.groupBy("chunk").applyInArrow(run, "p long, n long")


def _maximal(rows: list[tuple[int, int, int]], least: int) -> list[tuple[int, int]]:
    """(start, lines) of a document's runs (seq, words, lines of the run from here) of ``least`` words that aren't part of another."""
    out, end, total = [], -1, {}
    so_far = 0
    for seq, words, _ in rows:
        total[seq] = so_far
        so_far += words
        total[seq + 1] = so_far
    for seq, _, n in rows:
        if n and seq + n > end and total[seq + n] - total[seq] >= least:
            out.append((seq, n))
            end = seq + n
    return out


def repeated_runs(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(did, th, runs): per document its maximal runs (seq, n) of lines with a word, counted from 0, that repeat an earlier run."""
    lines = cut(_lines(docs, text), "lines")
    often = lines.groupBy("line").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    ids = cut(_running(often, ["line"], "c").select("line", F.col("before").alias("rank")), "ids")
    level = lines.join(ids, "line").select("did", "th", "seq", "words", "rank").dropDuplicates(["did", "th", "seq"])
    places = cut(_numbered(level, min_words), "places")
    runs = cut(longest_earlier(cut(suffix_array(places, min_words), "array")), "runs")

    def maximal(batches):
        for b in slices(batches):
            out = [[{"seq": s, "n": n} for s, n in _maximal(sorted((r["seq"], r["words"], r["n"]) for r in rows), min_words)] for rows in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.struct([("seq", pa.int32()), ("n", pa.int32())])))], names=["did", "th", "runs"])

    per_doc = places.join(runs, "p", "left").select("did", "th", "seq", "words", F.coalesce("n", F.lit(0)).alias("n")).groupBy("did", "th").agg(F.collect_list(F.struct("seq", "words", "n")).alias("rows"))
    return per_doc.where(F.exists("rows", lambda x: x.n > 0)).mapInArrow(maximal, "did long, th long, runs array<struct<seq:int,n:int>>").where(F.size("runs") > 0)


def drop_runs(text: str, runs: list[dict]) -> tuple[str, int, int]:
    """The text without these runs, its lines with a word, and how many of them went."""
    gone = {s for r in runs for s in range(r["seq"], r["seq"] + r["n"])}
    out, seq = [], 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            if seq not in gone:
                out.append(line)
            seq += 1
        else:
            out.append(line)
    return "\n".join(out), seq, len(gone)


def line_dedup(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with its text without repeated runs, and n_lines (with a word, before) and n_removed; such columns are replaced.

    Null texts stay null, with 0 lines. Lines without a word are in no run and stay, whatever lies around them. Rows equal in
    doc_id and text are one document: they don't repeat each other. Where rows share a doc_id, or it is null (which comes
    first), those with different texts are different documents, ordered by a hash of the text. A text may end up empty. An
    empty table gives an empty table. All other columns stay.
    """
    docs = docs.drop("n_lines", "n_removed")
    runs = cut(repeated_runs(docs, text, min_words), "runs").withColumnsRenamed({"did": "_did", "th": "_th"})
    did, th = row_key()
    names = docs.columns
    where = names.index(text)
    joined = docs.withColumns({"_k1": did, "_k2": th}).join(runs.hint("merge"), (F.col("_k1") == F.col("_did")) & (F.col("_k2") == F.col("_th")), "left").select(*(F.col(f"`{c}`") for c in names), "runs")

    def run(batches):
        for b in slices(batches):
            texts, n, gone = [], [], []
            for t, r in zip(b.column(where), b.column(len(names)), strict=True):
                t, r = t.as_py(), r.as_py()
                new, lines, k = drop_runs(t or "", r or [])
                texts.append(None if t is None else new)
                n.append(lines)
                gone.append(k)
            cols = [pa.array(texts, b.schema.types[where]) if i == where else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=[*names, "n_lines", "n_removed"])

    return joined.mapInArrow(run, extended(docs, "n_lines long, n_removed long"))


def op6(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
w AS (SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS seq
      FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
m AS (SELECT b.doc_id, b.seq, b.words, a.doc_id AS other, b.seq - a.seq AS diag FROM w a JOIN w b ON a.line = b.line AND (a.doc_id, a.seq) < (b.doc_id, b.seq)),
g AS (SELECT *, seq - row_number() OVER (PARTITION BY doc_id, other, diag ORDER BY seq) AS run FROM m),
s AS (SELECT *, sum(words) OVER (PARTITION BY doc_id, other, diag, run) AS total FROM g),
x AS (SELECT DISTINCT doc_id, seq FROM s WHERE total >= 50),
k AS (SELECT l.doc_id, l.i, l.line, w.seq IS NOT NULL AS worded, x.seq IS NOT NULL AS gone FROM l LEFT JOIN w USING (doc_id, i) LEFT JOIN x ON x.doc_id = w.doc_id AND x.seq = w.seq),
t AS (SELECT doc_id, count(*) FILTER (worded) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM k GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, length(text) AS n_chars, md5(text) AS text_md5 FROM t
"""

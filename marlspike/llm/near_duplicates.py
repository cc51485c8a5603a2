"""Near-duplicates by a multi-index Hamming join of b-bit MinHash signatures, confirmed on full shingle sets.

A document's set is that of its distinct word 5-grams. Equal sets form one class, and only classes are compared. A signature
has K symbols of 16 bits (MinHash values cut to b bits); its distance is the number of symbols that differ. Signatures are
split into CHUNKS chunks; with R = CHUNKS * (ERRORS + 1) - 1 differing symbols at most, some chunk differs in at most
ERRORS symbols (pigeonhole), so the index holds for each chunk every way to leave ERRORS symbols out. All pairs within R are
found, whatever their sets. Of pairs with a similarity of exactly 0.75, a share of 2e-6 has no chunk in common.

Large buckets are never expanded into pairs:

1. in each bucket all members are compared with its smallest member only (a star), links are confirmed on full sets, and
   connected components are taken. Groups of near copies collapse here;
2. buckets whose members still lie in several components: up to SMALL members, all pairs between components are compared;
3. larger ones: an exact prefix filter over the members' sets (frequent shingles last): two sets that are similar enough
   share a shingle of their prefixes. A passage that many documents share is frequent, so it comes last in that order and
   yields nothing. Up to SMALL members that share a prefix shingle are compared pair by pair. More of them are a family of
   overlapping near copies: it is dealt to blocks of about BLOCK members and BLOCK_SHINGLES shingles. A task multiplies the
   incidence matrices of two blocks, and only a spanning forest of the links that it finds leaves it. In families of more than
   DIRECT blocks, all blocks meet the first one, the pivots; members that are then in the family's largest component meet only
   those that aren't. In smaller ones all pairs of blocks meet at once, which is less work than to look at the links between.

Every step writes its table to the shared folder. Nothing is collected but the count of edges per round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, read_table, row_key, slices, text_of

WORDS = 5
NUM, DEN = 75, 100  # linked if DEN * intersection >= NUM * union
CHUNKS, CHUNK, ERRORS = 10, 4, 1
K = CHUNKS * CHUNK
SMALL = 32
BLOCK, BLOCK_SHINGLES, DIRECT = 384, 400_000, 64
FREQUENT = 1_000_000
RANGE, MOST_RANGES = 1 << 19, 1 << 20  # shingles whose counts one task merges, as long as there are no more ranges than this
FILTER = 1 << 24  # bits that tell which shingles may be in two sets; two bytes a range at least
COLUMNS = 8192  # shingles that a block's matrix holds at once
BYTES = 1 << 16  # of a text whose words are hashed together

_MUL = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(20240607).integers(1, 2**63, K, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = np.uint64(29)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse
_POWERS, _INVERSES = (np.cumprod(np.array([1] + [x] * BYTES, np.uint64)) for x in (_BASE, pow(_BASE, -1, 2**64)))


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text, by its bytes alone: a polynomial that is summed over the text at once, and taken apart
    at the words' ends. Longer words than BYTES are hashed one by one."""
    a = np.frombuffer(raw, np.uint8)
    edge = np.diff(np.concatenate(([True], _SPACE[a], [True])).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = int(np.searchsorted(end, start[i] + BYTES, "right"))
        if i == j:
            out[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]])
            i += 1
            continue
        s, e = start[i:j] - start[i], end[i:j] - start[i]
        total = np.zeros(e[-1] + 1, np.uint64)
        np.cumsum((a[start[i] : end[j - 1]].astype(np.uint64) + np.uint64(1)) * _POWERS[: e[-1]], out=total[1:])
        out[i:j] = _mix((total[e] - total[s]) * _INVERSES[s] + (e - s).astype(np.uint64) * _MUL)
        i = j
    return out


def shingles(text: str | None) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles; fewer words than WORDS: of all of them as one; none: empty."""
    w = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())  # bytes: A-Z only, and the six ASCII spaces
    if not len(w):
        return np.array([], np.uint64)
    n = min(WORDS, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = h * _MUL + w[i : len(w) - n + 1 + i]
    return np.unique(_mix(h))


def signature(s: np.ndarray) -> np.ndarray:
    """K symbols of 16 bits of a non-empty set."""
    low = np.full(K, 2**64 - 1, np.uint64)
    for at in range(0, len(s), 2048):
        low = np.minimum(low, (s[at : at + 2048, None] * _FACTORS).min(0))
    return _mix(low) >> np.uint64(48)


def keys(sig: np.ndarray) -> np.ndarray:
    """The index keys of a signature: of each chunk, each way to leave one symbol out."""
    c = sig.reshape(CHUNKS, CHUNK)
    out = []
    for drop in range(CHUNK):
        a, b, d = (c[:, i] for i in range(CHUNK) if i != drop)
        place = np.arange(CHUNKS, dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(drop)
        out.append(place << np.uint64(48) | a << np.uint64(32) | b << np.uint64(16) | d)
    return np.concatenate(out).astype(np.int64)


def signatures(rows: DataFrame) -> DataFrame:
    """(doc_id, did, th, text) -> (doc_id, did, th, n_shingles, node, keys). node: a 128-bit hash of the set, null if empty."""

    def run(batches):
        for b in slices(batches):
            n, node, found = [], [], []
            for t in b.column(3):
                s = shingles(t.as_py())
                n.append(len(s))
                node.append(xxhash.xxh3_128_digest(s.astype("<u8").tobytes()) if len(s) else None)
                found.append(keys(signature(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=[*b.schema.names[:3], "n_shingles", "node", "keys"])

    return rows.select("doc_id", "did", "th", "text").mapInArrow(run, "doc_id long, did long, th long, n_shingles long, node binary, keys array<long>")


def _sets(rows: DataFrame) -> DataFrame:
    """(node, text) -> (node, n, set)."""

    def run(batches):
        for b in slices(batches):
            s = [shingles(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, s), pa.int64()), pa.array([x.astype("<u8").tobytes() for x in s], pa.binary())], names=["node", "n", "set"])

    return rows.select("node", "text").mapInArrow(run, "node binary, n long, set binary")


def _linked(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, sa, sb) that are similar enough, by their full sets."""

    def run(batches):
        for b in slices(batches):
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(DEN * both >= NUM * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


class _Index:
    """The classes' texts and sets, made for those that are asked for."""

    def __init__(self, rows: DataFrame, classes: DataFrame):
        self.rows, self.classes = rows, classes

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, n, set) of these nodes, from the text of each class's first row."""
        first = nodes.join(self.classes, "node").select("node", F.col("first.did").alias("did"), F.col("first.th").alias("th"))
        return cut(_sets(self.rows.select("did", "th", "text").join(first, ["did", "th"]).dropDuplicates(["node"])), "sets")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs, "pairs")
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        a, b = (sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("set").alias(f"s{x}")) for x in "ab")
        near = (DEN * F.least("na", "nb") >= NUM * F.greatest("na", "nb"))
        return cut(_linked(pairs.join(a, "a").join(b, "b").where(near)), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of these edges (a, b): root is the smallest node that is reachable.

    Alternating large-star and small-star rounds; a round moves as many rows as there are edges, and their number falls to
    one per node. Hubs are no problem: minima are pre-aggregated, and joins go to a node's edges and its single minimum.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        edges = cut(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        low = cut(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")), "low")
        if not low.where("c > 1").isEmpty() or not edges.join(low, edges["v"] == low["u"], "left_semi").isEmpty():
            grown = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
            edges = cut(grown.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "small")
        else:  # every node has one edge, to a node that has none: stars
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _width(parts: int) -> int:
    """Bits of the filter that each range has."""
    return max(16, FILTER // parts // 8 * 8)


def _bit(x: np.ndarray, parts: int, width: int) -> np.ndarray:
    """Where in the filter a shingle's bit lies: each range of shingles has a share of its own."""
    return (x % np.uint64(parts)) * np.uint64(width) + (x >> np.uint64(20)) % np.uint64(width)


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The shingles of more than SMALL of these sets, sorted (of more than FREQUENT of them, the most frequent); a filter of
    FILTER bits (MOST_RANGES times two bytes at most) that has the bits of all shingles of two sets or more, and perhaps others;
    its number of ranges and the bits of each.

    Frequent ones come last in the prefix order. Any order is exact, and a shingle without its bit meets nothing, so both
    bounds cost time at worst. Counts travel packed, a row per slice of sets and range of shingles.
    """
    parts = max(1, min(MOST_RANGES, -(-(sets.agg(F.sum("n")).first()[0] or 0) // RANGE)))
    width = _width(parts)

    def count(batches):
        for b in slices(batches, 1024):
            x, n = np.unique(np.concatenate([np.frombuffer(r.as_py(), "<u8") for r in b.column(0)]), return_counts=True)
            part = (x % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            x, n, part = x[order], n[order].astype("<i8"), part[order]
            at = np.flatnonzero(np.diff(part, prepend=-1))
            ends = [*at[1:].tolist(), len(part)]
            raw = [(x[i:j].tobytes(), n[i:j].tobytes()) for i, j in zip(at.tolist(), ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[at]), pa.array([r[0] for r in raw], pa.binary()), pa.array([r[1] for r in raw], pa.binary())], names=["part", "shingles", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        x = np.concatenate([np.frombuffer(r.as_py(), "<u8") for r in table.column("shingles")])
        n = np.concatenate([np.frombuffer(r.as_py(), "<i8") for r in table.column("counts")])
        x, at = np.unique(x, return_inverse=True)
        n = np.bincount(at, n).astype(np.int64)
        bits = np.zeros(width, bool)
        bits[(_bit(x[n > 1], parts, width) % np.uint64(width)).astype(np.int64)] = True
        often = x[n > SMALL].view("<i8")
        rows = [[*often.tolist(), None], [*n[n > SMALL].tolist(), None], [None] * len(often) + [np.packbits(bits).tobytes()], [None] * len(often) + [table.column("part")[0].as_py()]]
        return pa.table([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.int64())], names=["shingle", "df", "bits", "part"])

    packed = sets.select("set").mapInArrow(count, "part long, shingles binary, counts binary")
    merged = cut(packed.groupBy("part").applyInArrow(merge, "shingle long, df long, bits binary, part long"), "counts")
    found = merged.where("shingle IS NOT NULL").orderBy(F.desc("df"), "shingle").limit(FREQUENT).select("shingle").collect()
    seen = np.zeros(width // 8 * parts, np.uint8)
    for x in merged.where("bits IS NOT NULL").select("part", "bits").toLocalIterator():
        seen[x["part"] * (width // 8) : (x["part"] + 1) * (width // 8)] = np.frombuffer(x["bits"], np.uint8)
    return np.sort(np.array([x[0] for x in found], np.int64).view(np.uint64)), seen, parts, width


def _prefix_pairs(index: _Index, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of members (node, root): candidates (a, b) of different components, and links (a, b) that are confirmed already."""
    sets = index.sets(members.select("node"))

    often, seen, parts, width = _frequent(sets)
    held = members.sparkSession.sparkContext.broadcast((often, seen))

    def run(batches):
        for batch in slices(batches, 64):
            often, seen = held.value
            node, shingle, size = [], [], []
            for who, raw in zip(batch.column(0), batch.column(1), strict=True):
                x = np.frombuffer(raw.as_py(), "<u8")
                late = np.isin(x, often)
                first = np.concatenate((x[~late], x[late]))[: len(x) + NUM * len(x) // -DEN + 1]
                at = _bit(first, parts, width).astype(np.int64)
                first = first[seen[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1]
                node += [who.as_py()] * len(first)
                shingle.append(first.view("<i8"))
                size.append(np.full(len(first), len(x)))
            if node:
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(np.concatenate(shingle)), pa.array(np.concatenate(size))], names=["node", "shingle", "n"])

    flat = cut(sets.select("node", "set").mapInArrow(run, "node binary, shingle long, n long"), "flat")
    prefix = cut(flat.join(members, "node").select("shingle", "node", "root", "n"), "prefix")
    live = cut(prefix.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("node").alias("first"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select("shingle", "first", "size"), "live")
    post = cut(prefix.join(live, "shingle"), "post")
    x, y = post.where(F.col("size") <= SMALL).alias("x"), post.where(F.col("size") <= SMALL).alias("y")
    near = DEN * F.least("x.n", "y.n") >= NUM * F.greatest("x.n", "y.n")
    pairs = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & near).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    ties = post.where((F.col("size") > SMALL) & (F.col("first") != F.col("node"))).select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    return pairs, _family_links(cut(components(ties), "families").withColumnRenamed("root", "family"), members, sets)


def _links_within(table: pa.Table) -> pa.Table:
    """(a, b) of a task's (node, root, set): enough links between components to join all that belong together."""
    node, root = table.column("node").to_pylist(), table.column("root").to_pylist()
    held = [np.frombuffer(x.as_py(), "<u8") for x in table.column("set")]
    n, size = len(node), np.array([len(x) for x in held])
    shingle, row = np.concatenate(held), np.repeat(np.arange(n), size)
    order = np.argsort(shingle, kind="stable")
    shingle, row = shingle[order], row[order]
    same = shingle[1:] == shingle[:-1]
    shared = np.concatenate((same, [False])) | np.concatenate(([False], same))  # others meet nothing
    shingle, row = shingle[shared], row[shared]
    column = np.concatenate(([0], np.cumsum(shingle[1:] != shingle[:-1])))[: len(row)]
    both = np.zeros((n, n), np.float32)
    at = 0
    while at < len(row):
        end = np.searchsorted(column, column[at] + COLUMNS)
        m = np.zeros((n, COLUMNS), np.float32)
        m[row[at:end], column[at:end] - column[at]] = 1
        both += m @ m.T
        at = end
    linked = DEN * both.astype(np.int64) >= NUM * (size[:, None] + size[None, :] - both.astype(np.int64))
    group = {r: i for i, r in enumerate(dict.fromkeys(root))}
    mine = np.array([group[r] for r in root])
    p, q = np.nonzero(np.triu(linked & (mine[:, None] != mine[None, :]), 1))
    up = list(range(len(group)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    out = []
    for i, j in zip(p.tolist(), q.tolist(), strict=True):
        u, v = find(mine[i]), find(mine[j])
        if u != v:
            up[u] = v
            out.append((node[i], node[j]))
    return pa.table([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())], names=["a", "b"])


def _dealt(rows: DataFrame) -> DataFrame:
    """(family, node, n, ...) with each family's number of blocks, and the block that the row is dealt to."""
    size = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    many = cut(rows.groupBy("family").agg(size.cast("int").alias("blocks")), "dealt")
    return rows.join(many, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def _family_links(families: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between components within families (node, family), enough of them to join all that belong together."""
    sized = sets.select("node", "n")
    rows = cut(_dealt(families.join(members, "node").join(sized, "node")), "blocks")

    def compared(pairs: DataFrame) -> DataFrame:
        held = pairs.join(sets.select("node", "set"), "node")
        return cut(held.groupBy("family", "kind", "i", "j").applyInArrow(_links_within, "a binary, b binary"), "family-links")

    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    own = F.transform(every, lambda i: F.struct(F.least(i, F.col("block")).alias("i"), F.greatest(i, F.col("block")).alias("j")))
    pivots = F.filter(own, lambda m: (F.col("blocks") <= DIRECT) | (m.i == 0))
    links = compared(rows.select("family", F.explode(pivots).alias("m"), "node", "root").select("family", F.lit("first").alias("kind"), "m.i", "m.j", "node", "root"))
    large = rows.where(F.col("blocks") > DIRECT)
    if large.isEmpty():
        return links
    merged = cut(components(large.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links)), "merged").withColumnRenamed("root", "now")
    rows = cut(large.join(merged, "node", "left").select("family", "node", "n", F.coalesce("now", "root").alias("root")), "merged-rows")
    sizes = rows.groupBy("family", "root").agg(F.count(F.lit(1)).alias("c"))
    main = cut(sizes.groupBy("family").agg(F.max(F.struct("c", "root")).alias("m"), F.count(F.lit(1)).alias("k")).where("k > 1").select("family", F.col("m.root").alias("main")), "main")
    open_ = rows.join(main, "family")
    rest = cut(_dealt(open_.where("root <> main").drop("main")), "rest")
    base = cut(_dealt(open_.where("root = main").drop("main")), "base")
    many, wide = (x.groupBy("family").agg(F.max("blocks").alias("other")) for x in (rest, base))
    others = F.explode(F.sequence(F.lit(0), F.col("other") - 1))
    within = rest.select("family", F.lit("rest").alias("kind"), F.explode(own).alias("m"), "node", "root").select("family", "kind", "m.i", "m.j", "node", "root")
    across = rest.join(cut(wide, "wide"), "family").select("family", F.lit("main").alias("kind"), F.col("block").alias("i"), others.alias("j"), "node", "root")
    against = base.join(cut(many, "many"), "family").select("family", F.lit("main").alias("kind"), others.alias("i"), F.col("block").alias("j"), "node", "root")
    return links.unionByName(compared(within.unionByName(across).unionByName(against)))


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Null texts are empty; texts without words have no shingle, are linked with nothing and kept. component_id is the smallest
    non-null doc_id of all rows in reach. Rows that repeat a doc_id each stand for their own text, and share a verdict if they
    share the text; a row with a null doc_id is linked as any other, and kept only if its component has no doc_id at all.
    An empty table gives an empty table. Other columns of ``docs`` aren't looked at.
    """
    return _verdicts(docs, text).select("doc_id", "n_shingles", "component_id", "kept")


def _verdicts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``near_duplicates`` with each row's did and th, and its group: the component's node, null for texts without words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text).alias("text")).select("doc_id", *row_key(), "text")
    signed = cut(signatures(rows), "signed")
    has = signed.where(F.col("node").isNotNull())
    classes = cut(has.groupBy("node").agg(F.min(F.struct("did", "th")).alias("first"), F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n_rows")), "classes")
    index = _Index(rows, classes)
    one = has.groupBy("node").agg(F.first("keys").alias("keys"))  # equal sets have equal keys
    flat = cut(one.select("node", F.explode("keys").alias("key")), "keys")
    shared = cut(flat.groupBy("key").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("size")).where("size > 1"), "shared")
    member = cut(flat.join(shared, "key"), "member")
    links = index.confirm(member.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct())
    roots = cut(components(links), "roots")

    labelled = cut(member.join(roots, "node", "left").select("key", "node", "low", "size", F.coalesce("root", "node").alias("root")), "labelled")
    mixed = cut(labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key"), "mixed")
    rest = cut(labelled.join(mixed, "key"), "rest")
    x, y = rest.where(F.col("size") <= SMALL).alias("x"), rest.where(F.col("size") <= SMALL).alias("y")
    few = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & (F.col("x.node") != F.col("x.low")))
    many = cut(rest.where(F.col("size") > SMALL).select("node", "root").distinct(), "many")
    late = few.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    if not many.isEmpty():
        pairs, sure = _prefix_pairs(index, many)
        late, links = late.unionByName(pairs).distinct(), links.unionByName(sure)
    roots = cut(components(links.unionByName(index.confirm(late))), "roots")

    known = cut(roots.join(classes, "node").select("node", "root", "low"), "known")
    least = cut(known.groupBy("root").agg(F.min("low").alias("component")), "least")
    verdict = cut(known.join(least, "root").select("node", "root", "component"), "verdict")
    alone = classes.where("n_rows > 1").join(verdict, "node", "left_anti").select("node", F.col("node").alias("root"), F.col("low").alias("component"))
    verdict = cut(verdict.unionByName(alone), "verdict")
    out = signed.select("doc_id", "did", "th", "n_shingles", "node").join(verdict, "node", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "doc_id")))
    return out.select("doc_id", "did", "th", F.coalesce("root", "node").alias("group"), "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` of each group that ``near_duplicates`` links, with all its columns: that of the smallest doc_id.

    Rows are told apart by doc_id and text. Where several of a group are kept (they share the doc_id, or have none), one of them
    stays, and of rows equal in both one. Texts without words are groups of their own. Texts move once, in a sort-merge join at
    every size.
    """
    own = F.concat(F.lit("a row without words "), F.concat_ws(" ", "did", "th")).cast("binary")  # longer than a node
    kept = _verdicts(docs).where("kept").groupBy(F.coalesce("group", own).alias("group")).agg(F.min(F.struct("did", "th")).alias("one"))
    kept = cut(kept.select(F.col("one.did").alias("_kept_did"), F.col("one.th").alias("_kept_th")), "kept").hint("merge")
    did, th = row_key()
    keyed = docs.withColumns({"_row_did": did, "_row_th": th})
    found = keyed.join(kept, (F.col("_row_did") == F.col("_kept_did")) & (F.col("_row_th") == F.col("_kept_th")), "left_semi")
    return found.dropDuplicates(["_row_did", "_row_th"]).drop("_row_did", "_row_th")


def op7(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))

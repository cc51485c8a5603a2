import math
import random
from bisect import bisect_right

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlspike.operators import assembly as A
from marlspike.operators import checks as C
from marlspike.operators import evaluation as E
from marlspike.operators import ingest as G
from marlspike.operators import packing as P
from marlspike.operators import retrieval as R
from marlspike.sources import files
from marlspike.streaming import events as V
from marlspike.streaming import limits as L


WORDS = [f"word{i}" for i in range(40)]


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_rrf_prefers_agreement(spark):
    dense = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "qid int, id string, rank int")
    sparse = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "d", 3)], "qid int, id string, rank int")
    got = R.fuse([("dense", dense), ("sparse", sparse)]).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["a", "b", "c", "d"]
    assert got[0]["score"] == pytest.approx(1 / 61 + 1 / 62, abs=1e-6)
    alone = R.fuse([("dense", dense)]).where("rank = 1").first()
    assert alone["score"] == pytest.approx(1 / 61, abs=1e-6)


def test_bm25_rare_terms_first(spark):
    docs = ["Traps trigger once", "The knight draws a card", "A card is a card", "Block the wolf", "Gold buys a card"]
    chunks = spark.createDataFrame(list(enumerate(docs)), "id int, content string")
    asked = spark.createDataFrame([(0, "traps card"), (1, "zebra"), (2, "")], "qid int, question string")
    got = R.bm25_top(chunks, asked, 8).orderBy("qid", "rank").collect()
    assert got[0]["id"] == 0 and {r["qid"] for r in got} == {0} and all(r["score"] >= 0 for r in got)


def test_dense_by_blocks(spark):
    random.seed(3)
    v = [(i, [random.uniform(-1, 1) for _ in range(4)]) for i in range(60)] + [(99, [0.0] * 4)]
    df = spark.createDataFrame(v, "id long, vector array<float>")
    q = df.where("id < 7").withColumnRenamed("id", "qid")
    assert rows(R.dense_top(df, q, 5, block=2)) == rows(R.dense_top(df, q, 5))
    by_column = q.crossJoin(df.withColumnRenamed("vector", "w")).select("qid", "id", F.round(R.cosine(F.col("vector"), F.col("w")), 6).alias("score"))
    assert rows(R.top(by_column, 5, F.desc("score"), F.col("id"))) == rows(R.dense_top(df, q, 5))


def test_floor_against_procedure(spark):
    random.seed(5)
    data, want = [], {}
    for q in range(60):
        n, k, floor = random.randint(1, 12), random.randint(1, 6), random.randint(0, 5)
        kinds = [random.choice(["cards", "rulebook", None]) for _ in range(n)]
        chosen = list(range(min(k, n)))
        lack = min(floor, k) - sum(kinds[i] != "cards" for i in chosen)
        if floor > 0 and lack > 0:
            more = [i for i in range(k, n) if kinds[i] != "cards"][:lack]
            if more:
                gone = [i for i in chosen if kinds[i] == "cards"][-len(more) :]
                chosen = [i for i in chosen if i not in gone] + more
        want[q] = chosen
        data += [(q, i, kinds[i], i + 1, k, floor) for i in range(n)]
    df = spark.createDataFrame(data, "qid int, id int, doc_type string, rank int, k int, floor int")
    out = R.rule_floor(df.select("qid", "id", "doc_type", "rank"), df.select("qid", "k", "floor").distinct())
    got = {}
    for r in out.orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    assert got == want


def test_as_of_against_bisect(spark):
    random.seed(7)
    marks = sorted({random.randint(0, 50) for _ in range(12)})
    probes = [random.randint(-5, 60) for _ in range(40)]
    m = spark.createDataFrame([(1, x, i) for i, x in enumerate(marks)], "d int, at int, page int")
    p = spark.createDataFrame([(1, x, i) for i, x in enumerate(probes)] + [(2, 5, 99)], "d int, at int, i int")
    got = {r["i"]: r["page"] for r in A.as_of(p, m, ["d"], "at", "page").collect()}
    assert got == {i: max(bisect_right(marks, x) - 1, 0) for i, x in enumerate(probes)} | {99: None}


MD = """<!-- page: 1 -->
# Rules
Intro text that is long enough to stand.
## Terms
**Block** - stops damage
**Burn** - adds fire
> **Chill** - slows all
**Draw** take a card
This remainder is long enough to be kept as a chunk of its own, I think.
<!-- page: 3 inferred -->
## Turns
### Start
Small.
### End
Also small.
## Rules
"""


def test_ingest_small_file(spark):
    docs = spark.createDataFrame([(1, MD), (2, ""), (3, "no heading")], "doc_id long, md string")
    marks = G.page_marks(G.lines(docs))
    assert rows(marks.select("page", "inferred")) == [(1, False), (3, True)]
    assert rows(C.page_gaps(marks)) == [(1, 2)]
    raw = G.raw_chunks(docs)
    paths = [" > ".join(r["path"]) for r in raw.orderBy("n", "sub").collect()]
    assert paths == ["Rules", "Rules > Terms > Block", "Rules > Terms > Burn", "Rules > Terms > Chill", "Rules > Terms > Draw", "Rules > Terms", "Rules > Turns > Start", "Rules > Turns > End"]
    out = G.chunk_markdown(docs).orderBy("n", "sub").collect()
    assert [r["page_start"] for r in out] == [1, 1, 1, 1, 1, 1, 3, 3] and len({r["id"] for r in out}) == 8


def test_merge_upward(spark):
    big = "word " * 300
    data = [
        (1, 0, -1, "A", ["A"], "", 0, 9, "parent", False), (1, 1, -1, "B", ["A", "B"], "A", 9, 19, "child", False), (1, 2, -1, "C", ["A", "C"], "A", 19, 29, big, False),
        (1, 3, -1, "D", ["A", "D"], "A", 29, 39, "small", False), (1, 4, -1, "E", ["A", "D", "E"], "A > D", 39, 49, "deep", False), (1, 5, 0, "F", ["A", "F"], "A", 49, 59, "atom", True),
    ]
    raw = spark.createDataFrame(data, "doc_id long, n int, sub int, title string, path array<string>, parent string, start long, stop long, body string, atomic boolean")
    got = {r["title"]: r for r in G.merge_upward(raw).collect()}
    assert set(got) == {"A", "C", "D", "F"}
    assert got["A"]["body"] == "parent\n\n### B\n\nchild" and got["A"]["stop"] == 19 and list(got["A"]["merged"]) == ["B"]
    assert got["D"]["body"] == "small\n\n### E\n\ndeep"


def test_merge_keeps_room(spark):
    """A parent absorbs while it has room: sizes are those before the joint is added."""
    body = "x" * 470  # 118 tokens
    data = [(1, 0, -1, "P", ["P"], "", 0, 1, "x" * 400, False)] + [(1, i, -1, f"c{i}", ["P", f"c{i}"], "P", i, i + 1, body, False) for i in range(1, 8)]
    raw = spark.createDataFrame(data, "doc_id long, n int, sub int, title string, path array<string>, parent string, start long, stop long, body string, atomic boolean")
    size, want = 400, 0
    for i in range(1, 8):
        if math.ceil(size / 4) + 118 <= 600:
            size, want = size + len(f"\n\n### c{i}\n\n") + 470, want + 1
        else:
            break
    got = {r["title"]: r for r in G.merge_upward(raw).collect()}
    assert len(got["P"]["merged"]) >= want and len(got["P"]["body"]) >= size


def test_split_packs_to_the_limit(spark):
    a, b = "a" * 1198, "b" * 1200
    df = spark.createDataFrame([(1, f"{a}\n\n{b}"), (2, f"{a}xyz\n\n{b}"), (3, "c" * 4000), (4, "short")], "id int, body string")
    got = rows(G.split_oversized(df).select("id", "part", "parts_total"), "id", "part")
    assert got == [(1, None, None), (2, 1, 2), (2, 2, 2), (3, None, None), (4, None, None)]


def test_cards(spark):
    md = "### Early\n**One** (1) [Attack] - hit\n## Fire\n**Two** ()\n### Rare\n**Three** no kind [Icon]\n**Empty**\n## Ice\n**Four** x"
    got = rows(G.cards(spark.createDataFrame([(1, md)], "doc_id long, md string")).select("name", "group", "cost", "type"))
    assert got == [("Four", "Ice", None, None), ("One", "Cards > Early", "1", "Attack"), ("Three", "Fire > Rare", None, "Icon"), ("Two", "Fire", "", None)]


def test_resolution(spark):
    hits = spark.createDataFrame(
        [(1, 1, 10, 2, "rulebook", ["R", "S", "x"], "x", "first body", 4, 5), (1, 2, 11, 3, "rulebook", ["R", "S", "y"], "y", "second", 7, 7), (1, 3, 12, 9, "cards", ["C", "z"], "z", "card", None, None)],
        "qid int, rank int, id long, ordinal int, doc_type string, path array<string>, title string, content string, page_start int, page_end int",
    )
    placed = A.spans(hits)
    docs = A.documents(placed)
    text = docs.where("doc_no = 0").first()["text"]
    for r in placed.where("doc_no = 0").collect():
        assert text[r["start"] : r["stop"]] == r["content"]
    second = text.index("second")
    cites = spark.createDataFrame(
        [(1, 1, "char_location", 0, second, None, None), (2, 1, "char_location", 0, None, None, None), (3, 1, "char_location", 9, 0, None, None), (4, 1, "web", 0, 0, "http://a.example", None), (5, 1, "char_location", 1, 5, None, None)],
        "cid int, qid int, type string, document_index int, start_char_index int, url string, title string",
    ).withColumns({"cited_text": F.lit(""), "start_page": F.lit(1), "end_page": F.lit(1)})
    got = {r["cid"]: r for r in A.resolve(cites, docs, placed).collect()}
    assert got[1]["chunk_id"] == 11 and got[1]["page"] == 7 and got[2]["chunk_id"] == 10
    assert not got[3]["resolved"] and got[4]["source"] == "web" and got[5]["chunk_id"] == 12


def test_page_overlap_alone_is_no_hit(spark):
    kept = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "qid int, id int, rank int")
    chunks = spark.createDataFrame([(5, "entirely other words", 3, 4), (6, "and the wolf moves two spaces now", None, None)], "id int, content string, page_start int, page_end int")
    gold = spark.createDataFrame([(1, "the wolf moves two spaces", 3)], "qid int, span string, page int")
    assert rows(E.span_hits(kept, chunks, gold).select("id", "hit")) == [(5, False), (6, True)]


def test_batches(spark):
    random.seed(11)
    sizes = [random.choice([10, 900, 4000, 9000]) for _ in range(200)]
    want, batch, n, total = [], 0, 0, 0
    for s in sizes:
        if n and (n >= 64 or total + s > 8000):
            batch, n, total = batch + 1, 0, 0
        want.append(batch)
        n, total = n + 1, total + s
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate(sizes)], "queue int, pos int, tokens int")
    assert [b for _, _, b in rows(P.greedy_batches(df), "pos")] == want


def test_failures_are_isolated(spark):
    df = spark.createDataFrame([(1, 2), (2, 0), (3, 4)], "id long, x int")
    got = rows(P.isolated(df, lambda r: {"y": 8 // r["x"]}, "y double"), "id")
    assert [g[2] for g in got][::2] == [4.0, 2.0] and "ZeroDivisionError" in got[1][1]


def test_limits(spark):
    at = [0, 1, 3_600_000_000, 3_600_000_001]
    e = spark.createDataFrame([(1, i, t) for i, t in enumerate(at)], "user_id long, event_id long, us long")
    assert [r[3] for r in rows(L.rate_limited(e, "user_id", "us"), "event_id")] == [1, 2, 2, 2]
    e = spark.createDataFrame([("k", 0, 5), ("k", 60_000_000, 7)], "key string, us long, v long")
    assert [r[3] for r in rows(L.rolling_sum(e, "key", "us", "v"), "us")] == [5, 12]


def test_throttle(spark):
    e = spark.createDataFrame([("k", i, 0, 500) for i in range(4)], "key string, seq long, us long, tokens long")
    got = rows(L.throttle_waits(e, "key", 1000, 1_000_000), "seq")
    assert [g[2] for g in got] == [0, 1_000_000, 60_000_001, 61_000_001]


def test_stream_equals_batch(spark, tmp_path):
    random.seed(2)
    events = sorted((random.randint(1, 3), i, random.randint(0, 9_000_000_000)) for i in range(60))
    events = sorted(events, key=lambda e: e[2])
    df = spark.createDataFrame(events, "user_id long, event_id long, us long")
    for i in range(3):
        spark.createDataFrame(events[i * 20 : i * 20 + 20], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b{i}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = L.rate_limited_stream(stream, most=4).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    want = L.rate_limited(df, "user_id", "us", 4).select("user_id", "event_id", "us", "n", "limited")
    assert rows(spark.table("limited"), "event_id") == rows(want, "event_id")


def test_message_stream_equals_batch(spark, tmp_path):
    random.seed(6)
    kinds = ["text", "text", "thinking", "stage", "citation", "trace", "usage", "web_error", "error"]
    frames = [(m, i, random.choice(kinds), f"v{m}.{i} ") for i in range(12) for m in range(4)] + [(m, 12, "done", "") for m in range(4)]
    frames = [(m, i, e, None if e in ("text", "stage", "web_error") and (m + i) % 5 == 0 else v) for m, i, e, v in frames]
    df = spark.createDataFrame(frames, "mid long, seq long, event string, value string")
    for i in range(0, len(frames), 18):
        spark.createDataFrame(frames[i : i + 18], df.schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i:02}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = V.fold_messages_stream(stream).writeStream.format("memory").queryName("folded").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    want = V.fold_messages(df)
    assert rows(spark.table("folded").select(*want.columns), "mid") == rows(want, "mid")


def test_frames(spark):
    raw = 'event: a\ndata: {"x":1}\n\nevent: b\ndata: {bad\n\nevent: c\n\nevent: d\ndata: {"y":2}'
    df = spark.createDataFrame([(1, raw)], "sid int, raw string")
    assert rows(V.decode_frames(df)) == [(1, 0, "a", '{"x":1}')]
    assert rows(V.unfinished(df)) == [(1, 'event: d\ndata: {"y":2}')]


def test_sources(spark, tmp_path):
    import numpy as np

    (tmp_path / "m.bin").write_bytes(np.arange(6, dtype="<f4").tobytes())
    assert rows(files.read_matrix(spark, str(tmp_path / "m.bin"), 3).select("row", "vector"), "row") == [(0, [0.0, 1.0, 2.0]), (1, [3.0, 4.0, 5.0])]
    with pytest.raises(Exception, match="not a multiple"):
        files.read_matrix(spark, str(tmp_path / "m.bin"), 4).collect()
    (tmp_path / "l.jsonl").write_text('{"k":"a"}\n\n{"k":"b"}\n{"k":')
    assert rows(files.read_json_lines(spark, str(tmp_path / "l.jsonl"), "k string", tolerant=True)) == [("a",), ("b",)]
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id int, vector array<float>")
    with pytest.raises(Exception, match="width 1"):
        files.checked_vectors(df, 2).collect()
    table = rows(files.markdown_table(spark.createDataFrame([("x", 1)], "a string, b int"), ["A", "B"]), "line")
    assert ("| x | 1 |",) in table and ("| A | B |",) in table
    assert files.index_info(spark.createDataFrame([], "model string, count long, doc_sha string")).first()["ready"] is False


def test_pushed_down_and_limited(spark):
    """Scans read what is asked for, and a top-k is limited before the shuffle."""
    from marlspike.plans import registry, tables

    plan = registry.QUERIES["bm25_top8"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    read = R.tokenized(tables.chunks(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().toString().split("ReadSchema: struct<")[1].split(">")[0]
    assert read == "doc_id:bigint,text:string"


def test_pruned_ranking_is_exact(spark):
    """The k best of bm25_top are those of all scores, where frequent terms find no chunk of their own, too."""
    import random

    r = random.Random(5)
    rare = [f"rare{i}" for i in range(300)]
    texts = [" ".join(r.choice(["common", "frequent", "usual", r.choice(rare)]) for _ in range(r.randint(0, 30))) for _ in range(400)]
    chunks = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id long, content string")
    asked = spark.createDataFrame([(q, " ".join(["common", "usual", "frequent", *r.sample(rare, r.randint(0, 4))][r.randint(0, 2) :])) for q in range(25)] + [(90, "nothing"), (91, "")], "qid long, question string")
    index = R.Lexical(chunks)
    every = R.bm25(index, asked)
    for k in (1, 3, 10):
        want = rows(R.top(every, k, F.desc("score"), F.col("id")).select("qid", "rank", "id", "score"))
        assert rows(R.bm25_top(index, asked, k).select("qid", "rank", "id", "score")) == want


def test_traced_scores_are_rounded_as_by_sql(spark):
    import duckdb

    for digits in (4, 5):
        scores = [sign * (i * 10 + 5) / 10 ** (digits + 1) for i in range(4000) for sign in (1, -1)] + [0.0, -1e-6, 1.0]
        df = spark.createDataFrame([(q, x, 1, q) for q, x in enumerate(scores)], "qid int, score double, rank int, id int")
        got = {r["qid"]: r["entries"].split(":")[2] for r in R.trace(df, digits).collect()}
        want = duckdb.execute(f"SELECT list(format('{{:.{digits}f}}', round(x, {digits}))) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [scores]).fetchone()[0]
        assert [got[q] for q in range(len(scores))] == want


def test_ranking_shares_no_rows_of_pairs(spark, monkeypatch):
    """Long questions that share most of their terms with most chunks: nothing is written or shuffled that has a row per pair."""
    r = random.Random(9)
    texts = [" ".join(r.choice(WORDS) for _ in range(r.randint(20, 60))) for _ in range(200)]
    chunks = spark.createDataFrame([(f"c{i}", x) for i, x in enumerate(texts)] + [("none", None)], "id string, content string")
    asked = chunks.where("id <> 'c7'").select(F.col("id").alias("qid"), F.col("content").alias("question"))
    want = rows(R.top(R.bm25(chunks, asked), 4, F.desc("score"), F.col("id")).select("qid", "rank", "id", "score"))
    most, pairs = [], R.asked_terms(asked).count()

    def counted(df, name="cut", cut=R.cut):
        out = cut(df, name)
        most.append(out.count())
        return out

    monkeypatch.setattr(R, "cut", counted)
    assert rows(R.bm25_top(chunks, asked, 4).select("qid", "rank", "id", "score")) == want
    assert max(most) <= max(pairs, len(texts) + 1) < 199 * 200 / 4
    assert rows(R.bm25_top(chunks, asked, 4, pairs=500).select("qid", "rank", "id", "score")) == want
    assert R.bm25_top(chunks, asked.where("qid = 'none'"), 4).count() == 0 == R.bm25_top(chunks.limit(0), asked, 4).count()


def test_ranking_of_repeated_ids_and_ties(spark, monkeypatch):
    texts = [(5, "gold card"), (5, "gold card card"), (6, "wolf"), *((i, "gold wolf") for i in range(40, 10, -1))]
    chunks = spark.createDataFrame(texts, "id int, content string")
    asked = spark.createDataFrame([(1, "gold"), (2, "gold card wolf"), (2, "gold")], "qid int, question string")
    once = asked.limit(2)
    want = rows(R.top(R.bm25(chunks, once), 3, F.desc("score"), F.col("id")).select("qid", "rank", "id", "score"))
    assert rows(R.bm25_top(chunks, once, 3).select("qid", "rank", "id", "score")) == want
    monkeypatch.setattr(R, "CELLS", 16)
    tied = R.bm25_top(chunks.where("id > 6"), asked, 3).orderBy("qid", "rank").collect()
    assert [(x["qid"], x["id"]) for x in tied] == [(q, i) for q in (1, 2) for i in (11, 12, 13)]


def test_section_meets_queries_by_its_first_rules_only(spark):
    """Large sections: what is joined with the queries is limited per section, and what comes out is the same."""
    r = random.Random(4)
    kinds = {i: r.choice(["cards", "rulebook", "rulebook", None]) for i in range(300)}
    chunks = spark.createDataFrame([(i, 1000 - i, kinds[i], ["a", f"s{i % 3}", str(i)]) for i in range(300)], "id long, ordinal long, doc_type string, path array<string>")
    picks = {q: r.sample(range(305), r.randint(1, 18)) for q in range(40)} | {50: list(range(299, 269, -3)), 51: [999]}  # 50: the first of a section
    selected = spark.createDataFrame([(q, i, 0.5, n + 1) for q, ids in picks.items() for n, i in enumerate(ids)], "qid long, id long, score double, rank int")
    options = {q: (r.choice([8, 10, 20]), q == 50 or r.random() < 0.7) for q in picks}
    got = R.section_complete(selected, chunks, spark.createDataFrame([(q, *o) for q, o in options.items()], "qid long, k int, section_complete boolean"))
    want = []
    for q, ids in picks.items():
        want += [(q, i, 0.5, n + 1, False) for n, i in enumerate(ids)]
        known = [(kinds[i] == "cards", n + 1, i) for n, i in enumerate(ids) if i in kinds]
        if known and options[q][1]:
            last, seed = max(n for _, n, _ in known), min(known)[2]
            more = [i for i in range(299, -1, -1) if i % 3 == seed % 3 and kinds[i] != "cards" and i not in ids]
            want += [(q, i, 0.0, last + n + 1, True) for n, i in enumerate(more) if last + n + 1 <= max(options[q][0], 14)]
    assert rows(got.select("qid", "id", "score", "rank", "sibling"), "qid", "rank", "sibling") == sorted(want, key=lambda x: (x[0], x[3], x[4]))
    assert "WindowGroupLimit [prefix" in got._jdf.queryExecution().executedPlan().toString()
    assert R.section_complete(selected.limit(0), chunks, spark.createDataFrame([(1, 8, True)], "qid long, k int, section_complete boolean")).count() == 0


def test_files_are_written_and_read(spark, tmp_path):
    chunks = spark.createDataFrame([(1,), (2,)], "id long")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5])], "id long, vector array<float>")
    files.write_vectors(chunks, vectors, str(tmp_path / "v"))
    assert rows(spark.read.parquet(str(tmp_path / "v")).select("id")) == [(1,), (2,)]
    with pytest.raises(Exception, match="no vector for 2"):
        files.write_vectors(chunks, vectors.where("id = 1"), str(tmp_path / "w"))
    for part in ([(1, "a")], [(2, "b")]):
        files.append_json_lines(spark.createDataFrame(part, "id long, x string"), str(tmp_path / "lines"))
    assert rows(files.read_json_lines(spark, str(tmp_path / "lines"), "id long, x string"), "id") == [(1, "a"), (2, "b")]
    (tmp_path / "md").mkdir()
    (tmp_path / "md/a.md").write_text("# A\n\ntext\n")
    (tmp_path / "md/b.md").write_text("# B")
    got = files.read_markdown(spark, str(tmp_path / "md")).collect()
    assert {r["doc_id"].rsplit("/", 1)[-1]: r["md"] for r in got} == {"a.md": "# A\n\ntext\n", "b.md": "# B"}
    (tmp_path / "m.bin").write_bytes(np.arange(6, dtype="<f4").tobytes())
    assert files.read_matrix(spark, str(tmp_path / "m.bin"), 2, 3).count() == 3
    with pytest.raises(ValueError, match="4 vectors"):
        files.read_matrix(spark, str(tmp_path / "m.bin"), 2, 4)


def test_responses_batches_and_retries(spark, tmp_path):
    sent = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "batch int, index int")
    back = spark.createDataFrame([(2, 0, [1.0]), (1, 1, [2.0]), (1, 0, [3.0])], "batch int, index int, vector array<float>")
    assert rows(files.checked_response(sent, back, 1).select("batch", "index"), "batch", "index") == [(1, 0), (1, 1), (2, 0)]
    for short in (back.where("index = 0"), back.where("batch = 1")):
        with pytest.raises(Exception, match="vectors for"):
            files.checked_response(sent, short, 1).collect()
    calls = []

    def work(df):
        calls.append(df.first()["batch"])
        if len(calls) == 2:
            raise RuntimeError("limit")
        return df.select("index")

    with pytest.raises(RuntimeError, match="limit"):
        P.run_batches(sent, work, str(tmp_path / "cp"))
    assert P.run_batches(sent, work, str(tmp_path / "cp")) == 1 and calls == [1, 2, 2]
    assert spark.read.parquet(str(tmp_path / "cp")).count() == 3
    waits, answers = [], [(429, None, None), (503, 5.0, None), (200, None, "done")]
    assert P.with_retries(lambda: answers.pop(0), "query", waits.append) == "done" and waits == [21.0, 5.0]
    waits.clear()
    with pytest.raises(RuntimeError, match="after 8 attempts"):
        P.with_retries(lambda: (429, None, None), "ingest", waits.append)
    assert waits == [20.0, 40.0, 60.0, 80.0, 90.0, 90.0, 90.0, 90.0]
    with pytest.raises(RuntimeError, match="status 401"):
        P.with_retries(lambda: (401, None, None), "rerank", waits.append)


def test_far_marks(spark):
    marks = spark.createDataFrame([(1, 0, 1), (1, 5, 2_000_000_000), (1, 3, 4), (2, 0, 3), (2, 1, 3), (3, 0, 5), (3, 1, 2)], "doc_id long, at long, page int")
    assert rows(C.page_ranges(marks)) == [(1, 2, 3), (1, 5, 1_999_999_999)]
    with pytest.raises(Exception, match="no marks between pages 5"):
        C.page_gaps(marks).collect()
    assert rows(C.page_gaps(marks.where("page < 100"))) == [(1, 2), (1, 3)]


def test_jobs(spark, tmp_path, capsys):
    from marlspike import jobs
    from marlspike.plans import evaluation as PE

    assert PE.chosen(" bm25_rules, keyword") == ("keyword", "bm25_rules") and PE.chosen("") == PE.ARMS
    with pytest.raises(ValueError, match="no such arms: x"):
        PE.chosen("x")
    tables = "/root/testdata/sf0.001"
    args = lambda *a: jobs.parser().parse_args(a)
    everything = jobs.run(spark, args("answers", "--tables", tables))
    assert 0 < jobs.run(spark, args("answers", "--tables", tables, "--limit", "5", "--strata", "forbidden")).count() <= 5 < everything.count()
    first = everything.orderBy("doc_id").first()["doc_id"]
    (tmp_path / "done.jsonl").write_text(f'{{"doc_id": {first}}}\nbroken\n')
    assert jobs.run(spark, args("answers", "--tables", tables, "--done", str(tmp_path / "done.jsonl"))).count() == everything.count() - 1
    assert jobs.run(spark, args("answers", "--tables", tables, "--done", str(tmp_path / "done.jsonl"), "--fresh")).count() == everything.count()
    got = jobs.run(spark, args("retrieval", "--tables", tables, "--arms", "keyword", "--k", "3")).collect()
    assert [r["arm"] for r in got] == ["keyword"]
    (tmp_path / "a.md").write_text(MD)
    assert {r["severity"]: r["n"] for r in jobs.run(spark, args("verify", "--in", str(tmp_path / "a.md"))).collect()} == {"warn": 2}


def test_scratch_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from marlspike.sources.scratch import scratch

    away = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch(away, "x")


def test_labels_of_another_document(spark):
    gold = spark.createDataFrame([("a" * 20,), (None,)], "doc_sha string")
    assert E.index_agrees(gold, spark.createDataFrame([("a" * 16 + "b",)], "doc_sha string")).count() == 2
    with pytest.raises(Exception, match="labels are for document"):
        E.index_agrees(gold, spark.createDataFrame([("b" * 20,)], "doc_sha string")).collect()


def test_budget_fallbacks(spark):
    chunks = spark.createDataFrame([(1, "wolf " * 3000), (2, "short"), (3, "wolf den"), (4, "wolf " * 5)], "id int, content string")
    asked = spark.createDataFrame([(1, "wolf"), (2, "is it"), (3, "zebra"), (4, "den")], "qid int, question string")
    got = {}
    for q, i, _ in rows(R.keyword_budget(chunks, asked, 2, 100), "qid", "rank"):
        got.setdefault(q, []).append(i)
    assert got == {1: [3, 4], 2: [1, 2], 3: [2], 4: [3]}
    assert [r[1] for r in rows(R.keyword_budget(chunks, asked.where("qid = 3"), 2, 1), "rank")] == [1, 2]

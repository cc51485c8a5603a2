import random

from pyspark.sql import functions as F

import corpus_pipeline
from marlspike.llm import mixing, sentence_pieces, token_counts
from marlspike.llm.near_duplicates import keep_one
from tests.llm import brute
from tests.llm.test_llm import DOCS, SF, docs_of, edited, frame, prose


def brute_pipeline(rows):
    """rows: (doc_id, text, lang, source) -> doc_id -> (copies, text)."""
    good = {d for (d, *_, kept, _rate, _why) in brute.quality([(d, s, t) for d, t, _, s in rows]) if kept}
    rows = sorted((r for r in rows if r[0] in good), key=lambda r: r[0])
    cut = brute.lines([(r[0], r[1]) for r in rows])
    rows = [(r[0], t, *r[2:]) for r, (t, n, gone) in zip(rows, cut, strict=True) if gone == 0 or gone < n]
    kept = {d for d, _, _, k in brute.near([(r[0], r[1]) for r in rows]) if k}
    rows = [r for r in rows if r[0] in kept]
    copies = brute.mix([(d, lang, s, t) for d, t, lang, s in rows], mixing.WEIGHTS, mixing.DEFAULT)
    return {r[0]: (copies[r[0]], r[1]) for r in rows if r[0] in copies}


def test_pipeline_against_brute_force(spark, tmp_path):
    r = random.Random(21)
    base, shared = prose(r, 120).split(), "\n".join(prose(r, 30) for _ in range(3))
    texts = [prose(r, r.choice([20, 80, 150])) for _ in range(30)] + [edited(r, base, k % 4) for k in range(8)] + [f"{prose(r, 60)}\n{shared}\n{prose(r, 60)}" for _ in range(5)]
    texts += [texts[1], shared, None, "", "la la la " * 60]
    df = docs_of(spark, texts)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for x in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(x["doc_id"], []).append((tuple(x["piece_ids"]), x["n_pieces"], x["lang"], x["source"], x["round_trip"]))
    known = {x["doc_id"]: x for x in df.collect()}
    want = brute_pipeline([(d, x["text"], x["lang"], x["source"]) for d, x in known.items()])
    encoder = sentence_pieces.Encoder(*sentence_pieces.load(token_counts.vocabulary(sentence_pieces.MODEL)))
    assert any(text != known[d]["text"] for d, (_, text) in want.items())  # lines went
    for d, (copies, text) in want.items():
        ids = tuple(encoder.encode(text)[0])
        assert encoder.decode(ids) == text
        assert got.pop(d) == [(ids, len(ids), known[d]["lang"], known[d]["source"], True)] * copies
    assert not got


def test_stages_keep_columns_and_edges(spark):
    r = random.Random(22)
    df = docs_of(spark, [prose(r, 80), None, "", prose(r, 80)], [1, None, 3, 4]).withColumns({"domain": F.lit("clash"), "kept": F.lit("clash"), "rank": F.lit(1)})
    for docs in (df, df.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == df.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= 0


def test_one_of_each_group_where_ids_repeat(spark):
    r = random.Random(26)
    a, b, c, d, e = (prose(r, 80) for _ in range(5))
    near = lambda x: x + " end"
    texts = [(3, near(a)), (5, a), (5, b), (6, c), (6, c), (6, near(c)), (None, d), (None, near(d)), (None, e), (None, near(b)), (None, ""), (None, ""), (8, " "), (8, "")]
    got = keep_one(docs_of(spark, [t for _, t in texts], [i for i, _ in texts]))
    rows = sorted(((x["doc_id"], x["text"]) for x in got.collect()), key=repr)
    loose = [x for x in rows if x not in [(6, c), (6, near(c)), (None, d), (None, near(d))]]
    assert loose == sorted([(3, near(a)), (5, b), (None, e), (None, ""), (8, " "), (8, "")], key=repr)
    assert sum(i == 6 for i, _ in rows) == 1 and sum(x in (d, near(d)) for _, x in rows) == 1


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near duplicates", "mixing", "sentence pieces"]
    assert frame and DOCS

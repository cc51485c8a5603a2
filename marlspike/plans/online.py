"""Registered queries: question shape, entities, rate limits, event frames, chat history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.functions import shape as S
from marlspike.plans import tables as t
from marlspike.streaming import events as V
from marlspike.streaming import limits as L

QUERIES: dict = {}
ORACLE_SQL: dict = {}
#: The hour's limit that the given events reach.
MOST = 2

#: Questions in our own words: the given tables hold none.
ASKED = (
    (1, "Can I discard a Relic during another player's turn?"), (2, "Is it legal to sell the Lantern twice?"), (3, "May we trade before they roll?"),
    (4, "What stops a Guard from moving?"), (5, "Do I have to pay for the Bridge?"), (6, "Does Frost Wall stack with 'Iron Skin'?"),
    (7, "How do we set up the board?"), (8, "Teach me the rules"), (9, "What is the goal of it all?"), (10, "How many coins does Old Mill give?"),
    (11, 'What does "Silver Key" do?'), (12, "Where is the discard pile?"), (13, "Am I meant to draw two, rather than one?"), (14, "first time playing, any advice"),
    (15, "Who wins ties between Red Queen and Black Knight?"), (16, "   out of turn   "),
)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _asked(spark):
    return spark.createDataFrame(list(ASKED), "qid int, question string")


VALUES = "q AS (SELECT * FROM (VALUES " + ", ".join("({}, '{}')".format(i, x.replace("'", "''")) for i, x in ASKED) + ") v(qid, question))"


def _any(patterns) -> str:
    return S.any_of(patterns).replace("'", "''")


SHAPE = f"CASE WHEN regexp_matches(trim(question), '{_any(S.PROHIBITION)}') THEN 'prohibition' WHEN regexp_matches(trim(question), '{_any(S.HOW_TO_PLAY)}') THEN 'how_to_play' ELSE 'lookup' END"


@query(f"WITH {VALUES}, s AS (SELECT qid, {SHAPE} AS shape FROM q) SELECT qid, shape, shape = 'prohibition' AS is_prohibition, CASE shape WHEN 'prohibition' THEN 'medium' ELSE 'low' END AS effort, CASE shape WHEN 'prohibition' THEN 10 ELSE 8 END AS k FROM s")
def classify_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _asked(spark).select("qid", S.shape(F.col("question")).alias("shape"))
    return s.select("qid", "shape", (F.col("shape") == "prohibition").alias("is_prohibition"), S.effort(F.col("shape")).alias("effort"), S.option(F.col("shape"), 0).alias("k"))


@query("WITH q AS (SELECT conv_id, turn, text AS question FROM conversations) SELECT conv_id, turn, " + SHAPE + " AS shape FROM q")
def conversation_shapes(spark, sf_dir):
    return t.read(spark, sf_dir, "conversations").select("conv_id", "turn", S.shape(F.col("text")).alias("shape"))


ENTITIES = """WITH {source},
u AS (SELECT {key}, unnest(string_split_regex(question, '\\s+')) AS raw, generate_subscripts(string_split_regex(question, '\\s+'), 1) - 1 AS i FROM q),
b AS (SELECT {key}, i, regexp_replace(raw, '[^A-Za-z''-]', '', 'g') AS w FROM u),
c AS (SELECT *, i - row_number() OVER (PARTITION BY {key} ORDER BY i) AS island FROM b WHERE i > 0 AND regexp_matches(w, '^[A-Z][a-z''-]+$')),
r AS (SELECT {key}, string_agg(w, ' ' ORDER BY i) AS e, 1000000 + min(i) AS p FROM c GROUP BY {key}, island),
qu AS (SELECT {key}, unnest(regexp_extract_all(question, '"[^"]{{2,40}}"|''[^'']{{2,40}}''')) AS e, generate_subscripts(regexp_extract_all(question, '"[^"]{{2,40}}"|''[^'']{{2,40}}'''), 1) AS p FROM q),
a AS (SELECT {key}, trim(e[2:-2]) AS e, p FROM qu UNION ALL SELECT * FROM r),
d AS (SELECT {key}, e, min(p) AS p FROM a WHERE length(e) > 1 GROUP BY ALL)
SELECT {key}, string_agg(e, '|' ORDER BY p) AS entities, count(*) AS n FROM d GROUP BY {key}"""


@query(ENTITIES.format(source=VALUES, key="qid"))
def extract_entities(spark, sf_dir):
    e = _asked(spark).select("qid", S.entities(F.col("question")).alias("e")).where(F.size("e") > 0)
    return e.select("qid", F.array_join("e", "|").alias("entities"), F.size("e").cast("long").alias("n"))


@query(ENTITIES.format(source="q AS (SELECT doc_id, text AS question FROM documents)", key="doc_id"))
def document_entities(spark, sf_dir):
    e = t.read(spark, sf_dir, "documents").select("doc_id", S.entities(F.col("text")).alias("e")).where(F.size("e") > 0)
    return e.select("doc_id", F.array_join("e", "|").alias("entities"), F.size("e").cast("long").alias("n"))


def _events(spark, sf_dir):
    return t.read(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type", "value")


@query(f"WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events) SELECT event_id, user_id, count(*) OVER w AS n, count(*) OVER w > {MOST} AS limited FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)")
def rate_limit_1h(spark, sf_dir):
    return L.rate_limited(_events(spark, sf_dir), "user_id", "us", MOST).select("event_id", "user_id", "n", "limited")


@query("WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events) SELECT event_id, user_id, count(*) OVER w AS n, count(*) OVER w > 5 AS limited FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)")
def rate_limit_24h(spark, sf_dir):
    return L.rate_limited(_events(spark, sf_dir), "user_id", "us", 5, 24 * L.HOUR_US).select("event_id", "user_id", "n", "limited")


@query("WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS us, (event_id % 500)::BIGINT AS tokens FROM events) SELECT event_id, sum(tokens) OVER (PARTITION BY event_type ORDER BY us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW)::BIGINT AS rolling FROM e")
def rolling_tokens_60s(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("tokens", F.col("event_id") % 500)
    return L.rolling_sum(e, "event_type", "us", "tokens").select("event_id", "rolling")


THROTTLE = """WITH RECURSIVE e AS (SELECT user_id, event_id AS seq, epoch_us(ts) AS us, (event_id % 500)::BIGINT AS tokens, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS i FROM events),
w AS (
  SELECT user_id, i, seq, us, us AS start_us, [{'t': us, 'n': tokens}] AS held FROM e WHERE i = 1
  UNION ALL
  SELECT user_id, i, seq, us, now_, list_append(list_filter(held, lambda x: now_ - x.t <= 60000000), {'t': now_, 'n': tokens}) FROM (
    SELECT *, list_filter(list_sort(list_prepend(base, list_filter(list_transform(held, lambda x: x.t + 60000001), lambda c: c > base))),
                          lambda c: coalesce(list_sum(list_transform(list_filter(held, lambda x: c - x.t <= 60000000), lambda x: x.n)), -1000000000) + tokens <= 900)[1] AS now_
    FROM (SELECT e.user_id, e.i, e.seq, e.us, e.tokens, w.held, greatest(e.us, w.start_us + 1000000) AS base FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1) b) s)
SELECT user_id, seq, start_us, start_us - us AS wait_us FROM w"""


@query(THROTTLE)
def throttle_waits(spark, sf_dir):
    """A simulated clock per user: a request waits for the tokens of the minute before it, and for a gap."""
    e = _events(spark, sf_dir).select("user_id", F.col("event_id").alias("seq"), "us", (F.col("event_id") % 500).alias("tokens"))
    return L.throttle_waits(e, "user_id", 900, 1_000_000)


def _streams(spark, sf_dir):
    """Each conversation as an event stream: one frame per turn, every fifth with bad JSON, and an unfinished tail."""
    data = F.when(F.col("turn") % 5 == 4, F.lit("{bad")).otherwise(F.to_json(F.struct(F.col("role").alias("r"), F.col("turn").alias("t"))))
    f = t.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("sid"), "turn", V.encode_frame(F.col("role"), data).alias("f"))
    raw = F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "f"))), lambda x: x.f), ""), F.lit("event: tail\ndata: {"))
    return f.groupBy("sid").agg(raw.alias("raw"))


@query("""WITH s AS (SELECT conv_id AS sid, role AS event, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq FROM conversations)
SELECT sid, seq::INT AS seq, event, json_object('r', event, 't', turn)::VARCHAR AS data FROM s WHERE turn % 5 <> 4""")
def sse_decode(spark, sf_dir):
    return V.decode_frames(_streams(spark, sf_dir))


@query("SELECT DISTINCT conv_id AS sid, 'event: tail' || chr(10) || 'data: {' AS tail FROM conversations")
def sse_tail(spark, sf_dir):
    return V.unfinished(_streams(spark, sf_dir))


def _frames(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("text", "thinking", "stage", "citation", "trace", "usage", "web_error"))), (F.col("turn") % 7 + 1).cast("int"))
    return t.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("mid"), F.col("turn").alias("seq"), kind.alias("event"), F.col("text").alias("value"), (F.col("turn") * 137 + F.col("conv_id") % 11).alias("at_ms"))


FRAMES = "WITH f AS (SELECT conv_id AS mid, turn AS seq, ['text', 'thinking', 'stage', 'citation', 'trace', 'usage', 'web_error'][(turn % 7)::INT + 1] AS event, text AS value, turn * 137 + conv_id % 11 AS at_ms FROM conversations)"


@query(FRAMES + """ SELECT mid, coalesce(string_agg(value, '' ORDER BY seq) FILTER (event = 'text'), '') AS text, coalesce(string_agg(value, '' ORDER BY seq) FILTER (event = 'thinking'), '') AS thinking, count(*) FILTER (event = 'citation') AS n_citations,
  coalesce(string_agg(value, ',' ORDER BY seq) FILTER (event = 'stage'), '') AS stages, arg_max(value, seq) FILTER (event = 'trace') AS trace, arg_max(value, seq) FILTER (event = 'usage') AS usage, arg_max(value, seq) FILTER (event = 'error') AS error, coalesce(string_agg(value, '; ' ORDER BY seq) FILTER (event = 'web_error'), '') AS notes FROM f GROUP BY mid""")
def fold_messages(spark, sf_dir):
    return V.fold_messages(_frames(spark, sf_dir))


@query(FRAMES + " SELECT mid, min(at_ms) FILTER (event = 'text') - min(at_ms) AS first_token_ms, max(at_ms) - min(at_ms) AS total_ms FROM f GROUP BY mid")
def first_token_latency(spark, sf_dir):
    return V.latencies(_frames(spark, sf_dir))


@query("""WITH f AS (SELECT conv_id AS mid, turn AS seq, ['text', 'stage', 'stage', 'citation'][(turn % 4)::INT + 1] AS event, role AS value, turn * 137 + conv_id % 11 AS at_ms FROM conversations),
g AS (SELECT *, min(at_ms) OVER (PARTITION BY mid) AS start FROM f), s AS (SELECT mid, value, at_ms - coalesce(lag(at_ms) OVER (PARTITION BY mid ORDER BY at_ms, seq), start) AS ms FROM g WHERE event = 'stage' AND value IS NOT NULL),
n AS (SELECT mid, value, sum(ms)::BIGINT AS ms FROM s GROUP BY ALL)
SELECT mid, string_agg(value || '=' || ms, ',' ORDER BY value) AS timings, sum(ms)::BIGINT AS total_ms FROM n GROUP BY mid""")
def stage_timings(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("text", "stage", "stage", "citation"))), (F.col("turn") % 4 + 1).cast("int"))
    f = t.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("mid"), F.col("turn").alias("seq"), kind.alias("event"), F.col("role").alias("value"), (F.col("turn") * 137 + F.col("conv_id") % 11).alias("at_ms"))
    shown = F.array_join(F.transform(F.map_entries("timings"), lambda x: F.concat(x.key, F.lit("="), x.value.cast("string"))), ",")
    return V.stage_timings(f).select("mid", shown.alias("timings"), "total_ms")


@query("SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS question, max(turn) FILTER (role = 'user') AS turn, count(*) - 1 AS n_history FROM conversations GROUP BY conv_id")
def latest_user_turn(spark, sf_dir):
    return V.latest_user_turn(t.read(spark, sf_dir, "conversations"))


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 500 WHEN event_id % 7 = 0 THEN 429 WHEN event_id % 5 = 0 THEN 400 WHEN event_id % 4 = 0 THEN 400 WHEN event_id % 3 = 0 THEN 400 ELSE 200 END AS status FROM events""")
def validate_status(spark, sf_dir):
    i = F.col("event_id")
    question = F.when(i % 3 == 0, "  ").otherwise("why")
    return t.read(spark, sf_dir, "events").select("event_id", V.request_status(i % 11 != 0, i % 7 == 0, i % 5 != 0, F.when(i % 4 != 0, 1), question).alias("status"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a' || user_id WHEN 1 THEN 'r' || user_id ELSE 'unknown' END AS client,
  CASE event_id % 4 WHEN 0 THEN 'err' || event_id WHEN 1 THEN '1,2,3,4,5' ELSE '1,2' END AS web FROM events""")
def client_key(spark, sf_dir):
    i, u = F.col("event_id"), F.col("user_id").cast("string")
    forwarded = F.when(i % 3 == 0, F.concat(F.lit(" a"), u, F.lit(" , 10.0.0.1"))).when(i % 3 == 2, "")
    many = F.when(i % 4 == 0, None).when(i % 4 == 1, F.array(*map(F.lit, "1234567"))).otherwise(F.array(F.lit("1"), F.lit("2")))
    return t.read(spark, sf_dir, "events").select("event_id", V.client_key(forwarded, F.when(i % 3 == 1, F.concat(F.lit("r"), u))).alias("client"), V.web_results(many, F.concat(F.lit("err"), i.cast("string"))).alias("web"))

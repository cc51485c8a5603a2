"""Tool-call linking in chats, in DataFrame functions only.

Calls and results are hash-joined by identifier; calls are put in topological order of what they depend on; arguments are
validated against JSON schemas as variants; and each call is serialised with its result as canonical JSON: keys sorted, no
spaces, no duplicate keys.

The order is that of the longest path from a call without parents. Calls with one parent form chains, which pointer doubling
shortens to their first call, or the last one with several parents (a chain of n calls takes log2 n joins). What remains are calls with
several parents, ordered round by round: as many rounds as such calls lie behind one another.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, read_table

MOST_QUERY, MOST_PROMPT, LONG = 320, 300, 200
#: Tool -> schema of its arguments, a subset of JSON Schema (see ``fits``).
SCHEMAS = {
    "ask": {
        "type": "object", "required": ["query", "turn", "options"], "additionalProperties": False,
        "properties": {
            "query": {"type": "string", "minLength": 1, "maxLength": MOST_QUERY},
            "turn": {"type": "integer", "minimum": 0},
            "options": {
                "type": "object", "required": ["mode", "parts"], "additionalProperties": False,
                "properties": {"mode": {"enum": ["short", "long"]}, "parts": {"type": "array", "minItems": 1, "items": {"type": "integer", "minimum": 0}}},
            },
        },
    },
    "configure": {
        "type": "object", "required": ["prompt", "turn"], "additionalProperties": False,
        "properties": {"prompt": {"type": "string", "maxLength": MOST_PROMPT}, "turn": {"type": "integer", "minimum": 0}, "strict": {"type": "boolean"}},
    },
}
#: What a variant's schema begins with, by type.
VARIANT = {"string": "STRING", "integer": "(BIGINT|DECIMAL\\(\\d+,0\\))", "number": "(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY", "null": "VOID"}
CALL = ("name", "arguments", "parents")


def fits(value: Column, schema: dict) -> Column:
    """Whether a variant fits a schema: type, enum, minimum, maximum, minLength, maxLength (code points), minItems, maxItems,
    items, properties, required and additionalProperties (a boolean). Other keywords are refused. A missing value doesn't fit."""
    known = {"type", "enum", "minimum", "maximum", "minLength", "maxLength", "minItems", "maxItems", "items", "properties", "required", "additionalProperties"}
    if unknown := set(schema) - known:
        raise ValueError(f"keywords that aren't supported: {sorted(unknown)}")
    ok = value.isNotNull()
    if "type" in schema:
        ok &= F.schema_of_variant(value).rlike(f"^{VARIANT[schema['type']]}")
    if "enum" in schema:
        ok &= F.to_json(value).isin([json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in schema["enum"]])
    number, text = F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string")
    items = F.try_variant_get(value, "$", "array<variant>")
    for keyword, size, least in (("minimum", number, True), ("maximum", number, False), ("minLength", F.length(text), True), ("maxLength", F.length(text), False), ("minItems", F.size(items), True), ("maxItems", F.size(items), False)):
        if keyword in schema:
            ok &= size >= schema[keyword] if least else size <= schema[keyword]
    if "items" in schema:
        ok &= F.forall(items, lambda x: fits(x, schema["items"]))
    props = schema.get("properties", {})
    if props or "required" in schema or "additionalProperties" in schema:
        found = F.json_object_keys(F.to_json(value))
        if schema.get("additionalProperties") is False:
            ok &= F.size(F.array_except(found, F.array(*map(F.lit, props)).cast("array<string>"))) == 0
        for name in schema.get("required", ()):
            ok &= F.array_contains(found, name)
        for name, inner in props.items():
            ok &= ~F.array_contains(found, name) | fits(F.try_variant_get(value, f"$['{name}']", "variant"), inner)
    return F.coalesce(ok, F.lit(False))


def _valid(schemas: dict) -> Column:
    """Whether ``args`` fits the schema of ``name``; null for unknown names."""
    out = F.lit(None).cast("boolean")
    for name, schema in schemas.items():
        out = F.when(F.col("name") == name, fits(F.col("args"), schema)).otherwise(out)
    return out


def topological_levels(calls: DataFrame) -> DataFrame:
    """(id, parents) -> (id, level, cyclic): the longest path to it from a call without parents; null and true if a cycle is
    on or before it.

    Parents that are null or no calls don't count, repeated ones count once. ids must be unique and non-null.
    """
    ids = calls.select("id")
    edges = cut(calls.select("id", F.explode(F.array_distinct("parents")).alias("parent")).join(ids.withColumnRenamed("id", "parent"), "parent", "left_semi"), "edges")
    fan = edges.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("only"))
    state = cut(ids.join(fan, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("only")).alias("ptr"), F.when(F.col("n") == 1, 1).otherwise(0).cast("long").alias("dist")), "chains")
    rounds = math.ceil(math.log2(max(2, state.count()))) + 1
    anchors = state.where("n <> 1").select("id", "n")
    state = state.select("id", F.coalesce("ptr", "id").alias("ptr"), "dist")  # an anchor points to itself, at a distance of 0
    for _ in range(rounds):
        b = state.select(F.col("id").alias("_id"), F.col("ptr").alias("_ptr"), F.col("dist").alias("_dist"))
        moved = cut(state.join(b, F.col("ptr") == F.col("_id")).select("id", F.col("_ptr").alias("ptr"), (F.col("dist") + F.col("_dist")).alias("dist"), (F.col("_dist") > 0).alias("moves")), "chains")
        state = moved.drop("moves")
        if moved.where("moves").isEmpty():
            break
    far = edges.join(anchors.where("n > 1").select("id"), "id", "left_semi").join(state.withColumnsRenamed({"id": "parent", "ptr": "anchor"}), "parent")
    waits = cut(far.select("id", "anchor", (F.col("dist") + 1).alias("dist")), "waits")
    done = cut(anchors.where("n = 0").select(F.col("id").alias("anchor"), F.lit(0).cast("long").alias("level")), "done")
    while True:
        seen = waits.join(done, "anchor", "left")
        ready = seen.groupBy("id").agg(F.max(F.col("level") + F.col("dist")).alias("level"), F.count_if(F.col("level").isNull()).alias("open")).where("open = 0").select(F.col("id").alias("anchor"), "level")
        ready = cut(ready, "ready")
        if ready.isEmpty():
            break
        waits = cut(waits.join(ready.select(F.col("anchor").alias("id")), "id", "left_anti"), "waits")
        done = cut(done.unionByName(ready), "done")
    out = state.join(done, F.col("ptr") == F.col("anchor"), "left")
    return out.select("id", (F.col("level") + F.col("dist")).alias("level"), F.col("level").isNull().alias("cyclic"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """calls (id, parents, name, arguments), results (id, seq, content) -> one row per distinct call, and per id of results
    without a call.

    Columns: id, name, level, status, n_calls (equal calls), n_results, message (canonical JSON; null for a result without a
    call). status is the first that holds of orphan_result, no_id, duplicate_id, cycle, unknown_tool, invalid_arguments,
    no_result, ok. Of calls that differ but share an id the smallest by name, arguments and parents is the call of that id, and
    the others are duplicate_id rows: they have no level and no result. Calls with a null id are no_id rows, results with one
    orphans. Of several results the first by seq and content counts, n_results tells how many there are. Null arguments, and
    such as aren't JSON, are invalid, and null in the message. Texts of any length pass; other columns aren't looked at. Empty
    tables give an empty table.
    """
    parents = F.array_sort(F.array_distinct(F.filter(F.coalesce("parents", F.array().cast("array<string>")), lambda x: x.isNotNull())))
    every = cut(calls.select("id", "name", "arguments", parents.alias("parents")).groupBy("id", *CALL).agg(F.count(F.lit(1)).alias("n_calls")), "calls")
    first = every.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct(*CALL, "n_calls")).alias("c"), F.count(F.lit(1)).alias("n"))
    one = cut(first.select("id", "c.*", "n"), "one")
    got = cut(results.groupBy("id").agg(F.min(F.struct("seq", "content")).alias("r"), F.count(F.lit(1)).alias("n_results")).select("id", F.col("r.content").alias("content"), "n_results"), "results")
    levels = cut(topological_levels(one.select("id", "parents")), "order")
    linked = one.join(got.hint("shuffle_hash"), "id", "left").join(levels.hint("shuffle_hash"), "id")
    args = F.try_parse_json("arguments")
    status = F.when(F.col("cyclic"), "cycle").when(F.col("valid").isNull(), "unknown_tool").when(~F.col("valid"), "invalid_arguments").when(F.col("n_results").isNull(), "no_result").otherwise("ok")
    linked = linked.withColumn("args", args).withColumn("valid", _valid(schemas)).withColumn("status", status)
    again = every.join(one.where("n > 1").select("id", F.struct(*CALL).alias("_c")), "id").where(~F.struct(*CALL).eqNullSafe(F.col("_c")))
    none = {"content": F.lit(None).cast("string"), "n_results": F.lit(None).cast("long"), "level": F.lit(None).cast("long")}
    rest = again.withColumn("status", F.lit("duplicate_id")).unionByName(every.where("id IS NULL").withColumn("status", F.lit("no_id")), allowMissingColumns=True)
    both = linked.select("id", "name", "args", "level", "status", "n_calls", "content", "n_results").unionByName(rest.withColumns(none).withColumn("args", args).select("id", "name", "args", "level", "status", "n_calls", "content", "n_results"))
    message = F.to_json(F.struct(F.col("args").alias("arguments"), "id", "level", "name", F.col("content").alias("result")), {"ignoreNullFields": "false"})
    out = both.select("id", "name", "level", "status", "n_calls", F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), message.alias("message"))
    empty = F.lit(None)
    orphans = got.join(one.select("id"), "id", "left_anti").select("id", empty.cast("string").alias("name"), empty.cast("long").alias("level"), F.lit("orphan_result").alias("status"), F.lit(0).cast("long").alias("n_calls"), "n_results", empty.cast("string").alias("message"))
    return out.unionByName(orphans)


def from_conversations(chats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table (conv_id, turn, role, text). Ids: conv_id:turn, null if either is.

    A user's turn calls ``ask``, a system's ``configure``, one of another role (or none) a tool of that name, which no schema
    knows; each depends on the turn two before it and on the conversation's first. An assistant's turn is the result of the turn
    before it. Null texts are null arguments, or null results.
    """
    turn, text = F.col("turn").cast("long"), F.col("text")
    role = F.coalesce("role", F.lit("unknown"))

    def ident(t: Column) -> Column:
        return F.concat(F.col("conv_id").cast("string"), F.lit(":"), t.cast("string"))

    options = F.struct(F.when(F.length(text) > LONG, "long").otherwise("short").alias("mode"), F.transform(F.split(text, "\n"), F.length).alias("parts"))
    keep = {"ignoreNullFields": "false"}
    args = F.when(role == "user", F.to_json(F.struct(options.alias("options"), text.alias("query"), turn.alias("turn")), keep)).otherwise(F.to_json(F.struct(text.alias("prompt"), turn.alias("turn")), keep))
    name = F.when(role == "user", "ask").when(role == "system", "configure").otherwise(role)
    parents = F.when(turn > 0, F.array(ident(F.greatest(turn - 2, F.lit(0))), ident(F.lit(0))))
    calls = chats.where(role != "assistant").select(ident(turn).alias("id"), parents.alias("parents"), name.alias("name"), args.alias("arguments"))
    results = chats.where(role == "assistant").select(ident(turn - 1).alias("id"), turn.alias("seq"), text.alias("content"))
    return calls, results


def op4(spark, sf_dir: str) -> DataFrame:
    chats = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return link_calls(*from_conversations(chats))


SQL = f"""
WITH RECURSIVE c0 AS (
  SELECT conv_id::VARCHAR || ':' || turn AS id, CASE WHEN turn > 0 THEN conv_id::VARCHAR || ':' || greatest(turn - 2, 0) END AS p1, CASE WHEN turn > 0 THEN conv_id::VARCHAR || ':0' END AS p2,
         CASE role WHEN 'user' THEN 'ask' WHEN 'system' THEN 'configure' ELSE role END AS name,
         CASE role WHEN 'user' THEN json_object('options', json_object('mode', CASE WHEN length(text) > {LONG} THEN 'long' ELSE 'short' END, 'parts', list_transform(string_split(text, chr(10)), lambda x: length(x))), 'query', text, 'turn', turn)
              ELSE json_object('prompt', text, 'turn', turn) END::VARCHAR AS arguments,
         CASE role WHEN 'user' THEN length(text) BETWEEN 1 AND {MOST_QUERY} WHEN 'system' THEN length(text) <= {MOST_PROMPT} END AS valid
  FROM conversations WHERE role <> 'assistant'),
v AS (SELECT id, name, arguments, p1, p2, valid, count(*) AS n_calls FROM c0 GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY name, arguments) AS nth FROM v),
r AS (SELECT conv_id::VARCHAR || ':' || (turn - 1) AS id, min({{'seq': turn, 'content': text}}) AS s, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1),
e AS (SELECT id, p1 AS parent FROM c WHERE nth = 1 AND p1 IN (SELECT id FROM c) UNION SELECT id, p2 FROM c WHERE nth = 1 AND p2 IN (SELECT id FROM c)),
walk AS (SELECT id, 0 AS level FROM c WHERE nth = 1 AND id NOT IN (SELECT id FROM e)
         UNION SELECT e.id, walk.level + 1 FROM e JOIN walk ON e.parent = walk.id),
lv AS (SELECT id, max(level)::BIGINT AS level FROM walk GROUP BY id)
SELECT c.id, c.name, CASE WHEN nth = 1 THEN lv.level END AS level,
       CASE WHEN nth > 1 THEN 'duplicate_id' WHEN valid IS NULL THEN 'unknown_tool' WHEN NOT valid THEN 'invalid_arguments' WHEN r.n IS NULL THEN 'no_result' ELSE 'ok' END AS status,
       n_calls, CASE WHEN nth = 1 THEN coalesce(r.n, 0) ELSE 0 END::BIGINT AS n_results,
       json_object('arguments', c.arguments::JSON, 'id', c.id, 'level', CASE WHEN nth = 1 THEN lv.level END, 'name', c.name, 'result', CASE WHEN nth = 1 THEN r.s.content END)::VARCHAR AS message
FROM c LEFT JOIN r ON c.id = r.id LEFT JOIN lv ON c.id = lv.id
UNION ALL
SELECT r.id, NULL, NULL, 'orphan_result', 0, r.n, NULL FROM r WHERE r.id NOT IN (SELECT id FROM c)
"""

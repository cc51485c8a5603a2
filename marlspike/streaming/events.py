"""Server-sent event frames, message folding, chat history, request validation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window


def encode_frame(event: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def decode_frames(streams: DataFrame) -> DataFrame:
    """(sid, seq, event, data) of each whole frame of a text ``raw``; frames without data or with bad JSON are skipped."""
    frames = F.split("raw", "\n\n")
    whole = F.slice(frames, 1, F.size(frames) - 1)
    df = streams.select("sid", F.posexplode(whole).alias("seq", "frame"))
    event = F.regexp_extract("frame", r"(?m)^event: (.*)$", 1)
    data = F.regexp_extract("frame", r"(?m)^data: (.*)$", 1)
    return df.select("sid", "seq", event.alias("event"), data.alias("data")).where((F.col("data") != "") & F.try_parse_json("data").isNotNull())


def unfinished(streams: DataFrame) -> DataFrame:
    """(sid, tail): what is left behind the last whole frame."""
    return streams.select("sid", F.element_at(F.split("raw", "\n\n"), -1).alias("tail"))


def fold_messages(frames: DataFrame) -> DataFrame:
    """One row per message of frames (mid, seq, event, value): text and thinking joined in order, citations and stages listed,
    the last trace, usage and error; a failed search appends a note."""

    def joined(event: str, by: str = "") -> Column:
        rows = F.sort_array(F.collect_list(F.when(F.col("event") == event, F.struct("seq", "value"))))
        return F.array_join(F.transform(rows, lambda x: x.value), by)

    def last(event: str) -> Column:
        return F.max_by(F.when(F.col("event") == event, F.col("value")), F.when(F.col("event") == event, F.col("seq")))

    return frames.groupBy("mid").agg(
        joined("text").alias("text"), joined("thinking").alias("thinking"), F.count_if(F.col("event") == "citation").cast("long").alias("n_citations"),
        joined("stage", ",").alias("stages"), last("trace").alias("trace"), last("usage").alias("usage"), last("error").alias("error"), joined("web_error", "; ").alias("notes"),
    )


FOLDED = ("text", "thinking", "stages", "trace", "usage", "error", "notes")


class _Folder(StatefulProcessor):
    """Keeps each open message's fields; the text so far is all that grows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        names = (*FOLDED, "n_citations")
        self.held = handle.getValueState("held", StructType([StructField(n, StringType()) for n in names]))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802  the base class's name
        had = self.held.get() if self.held.exists() else None
        m = dict(zip((*FOLDED, "n_citations"), had, strict=True)) if had else {**dict.fromkeys(FOLDED), "text": "", "thinking": "", "stages": "", "notes": "", "n_citations": "0"}
        done = False
        for pdf in rows:
            for r in pdf.sort_values("seq").itertuples():
                if r.event in ("text", "thinking", "stage", "web_error") and r.value is None:
                    continue  # as in the batch form, a frame without a value adds nothing
                if r.event in ("text", "thinking"):
                    m[r.event] += r.value
                elif r.event in ("stage", "web_error"):
                    name, glue = ("stages", ",") if r.event == "stage" else ("notes", "; ")
                    m[name] = f"{m[name]}{glue}{r.value}" if m[name] else r.value
                elif r.event in ("trace", "usage", "error"):
                    m[r.event] = r.value
                elif r.event == "citation":
                    m["n_citations"] = str(int(m["n_citations"]) + 1)
                done |= r.event == "done"
        if done:
            self.held.clear()
            yield pd.DataFrame([(key[0], *(m[n] for n in FOLDED), int(m["n_citations"]))], columns=["mid", *FOLDED, "n_citations"])
        else:
            self.held.update(tuple(m.values()))

    def close(self) -> None:
        pass


def fold_messages_stream(frames: DataFrame) -> DataFrame:
    """``fold_messages`` on a stream (mid, seq, event, value) whose frames arrive in order; a message is given at its ``done`` frame."""
    schema = "mid long, " + ", ".join(f"{n} string" for n in FOLDED) + ", n_citations long"
    return frames.groupBy("mid").transformWithStateInPandas(_Folder(), schema, "Append", "None")


def latencies(frames: DataFrame) -> DataFrame:
    """(mid, first_token_ms, total_ms): time to the first text, and of the last frame."""
    first = F.min(F.when(F.col("event") == "text", F.col("at_ms")))
    return frames.groupBy("mid").agg((first - F.min("at_ms")).alias("first_token_ms"), (F.max("at_ms") - F.min("at_ms")).alias("total_ms"))


def stage_timings(frames: DataFrame) -> DataFrame:
    """(mid, timings, total_ms) of frames (mid, seq, event, value, at_ms): each stage's time from the stage before it, or the first
    frame, as a map by its name (a name that comes again adds up); the total is the sum of these."""
    order = Window.partitionBy("mid").orderBy("at_ms", "seq")
    start = F.min("at_ms").over(Window.partitionBy("mid"))
    stages = frames.withColumn("_start", start).where((F.col("event") == "stage") & F.col("value").isNotNull())
    took = stages.withColumn("ms", F.col("at_ms") - F.coalesce(F.lag("at_ms").over(order), F.col("_start")))
    named = took.groupBy("mid", "value").agg(F.sum("ms").alias("ms"))
    return named.groupBy("mid").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("value", "ms")))).alias("timings"), F.sum("ms").alias("total_ms"))


def latest_user_turn(chats: DataFrame) -> DataFrame:
    """(conv_id, question, turn, n_history): the last message of the user; the history is all but the last message."""
    user = F.col("role") == "user"
    return chats.groupBy("conv_id").agg(F.max_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))).alias("question"), F.max(F.when(user, F.col("turn"))).alias("turn"), (F.count(F.lit(1)) - 1).alias("n_history"))


def request_status(has_key: Column, limited: Column, is_json: Column, n_messages: Column, question: Column) -> Column:
    """The first failing check's status: no key 500, limited 429, no JSON, no messages or an empty question 400, else 200."""
    return F.when(~has_key, 500).when(limited, 429).when(~is_json, 400).when(F.coalesce(n_messages, F.lit(0)) == 0, 400).when(F.trim(F.coalesce(question, F.lit(""))) == "", 400).otherwise(200)


def client_key(forwarded: Column, real_ip: Column) -> Column:
    """The first forwarded address, else the real one, else "unknown"."""
    return F.coalesce(F.nullif(F.trim(F.split_part(forwarded, F.lit(","), F.lit(1))), F.lit("")), F.nullif(real_ip, F.lit("")), F.lit("unknown"))


def web_results(results: Column, error: Column, most: int = 5) -> Column:
    """The first results, or the error code."""
    return F.when(results.isNotNull(), F.array_join(F.slice(results, 1, most), ",")).otherwise(F.coalesce(error, F.lit("unknown")))

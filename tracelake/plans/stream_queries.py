"""Registered queries of the live operators: the rows land as files in two lots, the stream runs until it has taken each, and what
it gave is read back. State must carry over from one lot to the other, so the SQL sees the whole table at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.storage import new_path
from tracelake.operators import usage as U
from tracelake.plans.log_queries import folder_of
from tracelake.plans.registry import query
from tracelake.streaming import live

#: The first lot of each session.
FIRST_ROWS = 30


def landed(df: DataFrame, operator: Callable[[DataFrame], DataFrame], mode: str = "append", order: str = "seq") -> DataFrame:
    """What the stream ``operator`` gives on ``df`` that lands in two lots, with the number of the micro-batch, ``batch``."""
    spark = df.sparkSession
    source, out, checkpoint = (new_path(spark, n) for n in ("landing", "stream-out", "stream-checkpoint"))
    write = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)
    for lot in (F.col(order) <= FIRST_ROWS, F.col(order) > FIRST_ROWS):
        df.filter(lot).write.mode("append").parquet(source)
        stream = operator(spark.readStream.schema(df.schema).parquet(source))
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(out)


def timed(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def tailed(n: DataFrame) -> DataFrame:
    spark, out, checkpoint = n.sparkSession, new_path(n.sparkSession, "tail-out"), new_path(n.sparkSession, "tail-checkpoint")
    q = live.tail_sessions(spark, folder_of(n)).writeStream.foreachBatch(lambda b, _: b.write.mode("append").parquet(out)).option("checkpointLocation", checkpoint).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    back = spark.read.schema("file_path string, at long, line string").parquet(out)
    return back.groupBy(F.element_at(F.split("file_path", "/"), -1).alias("file_name")).agg(F.count("*").alias("lines"), F.sum(F.octet_length("line") + 1).cast("long").alias("bytes"), F.max("at").alias("last_at"))


query("j1_tail_sessions", "loglines", sql="SELECT file_name, count(*) AS lines, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes, CAST(sum(strlen(line) + 1) - arg_max(strlen(line) + 1, line_no) AS BIGINT) AS last_at FROM loglines GROUP BY 1")(tailed)


def landed_files(n: DataFrame) -> DataFrame:
    spark, out = n.sparkSession, new_path(n.sparkSession, "landed-out")
    live.landed_lines(spark, folder_of(n)).writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark, "landed-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("value").agg(F.count("*").alias("n"))


query("j1_landed_lines", "loglines", sql="SELECT line AS value, count(*) AS n FROM loglines GROUP BY 1")(landed_files)


def delta_events(e: DataFrame) -> DataFrame:
    """Messages of three delta events: a start, a delta, and an end, an error or nothing more."""
    k = (F.col("seq") - 1) % 3
    kind = F.when(k == 0, "text_start").when(k == 1, "text_delta").when(F.col("event_type") == "error", "error").when(F.col("event_type") != "view", "done").otherwise("text_end")
    return timed(e).select(
        F.col("session_id").cast("string").alias("session_id"), F.floor((F.col("seq") - 1) / 3).cast("long").alias("message_no"), k.cast("long").alias("seq"), F.col("ts").alias("event_ts"), kind.alias("type"), F.lit(0).alias("content_index"),
        F.when(k == 1, F.concat(F.lit("d"), F.col("event_id").cast("string"))).alias("delta"), F.lit(None).cast("string").alias("content_signature"), F.lit(None).cast("string").alias("tool_call_id"), F.lit(None).cast("string").alias("tool_name"),
        F.when(k == 2, F.col("event_type")).alias("reason"), F.lit(None).cast("string").alias("error_message"), F.col("seq").alias("place"),
    )


query(
    "j2_fold_deltas", "ev",
    sql="m AS (SELECT CAST(session_id AS VARCHAR) AS session_id, (seq - 1) // 3 AS message_no, count(*) AS n, max(CASE WHEN (seq - 1) % 3 = 1 THEN event_id END) AS d, max(CASE WHEN (seq - 1) % 3 = 2 THEN event_type END) AS r FROM ev GROUP BY 1, 2) SELECT session_id, CAST(message_no AS BIGINT) AS message_no, CASE WHEN r = 'error' THEN 'error' ELSE 'done' END AS status, r AS stop_reason, 'd' || CAST(d AS VARCHAR) AS text FROM m WHERE n = 3 AND r != 'view'",
)(lambda e: landed(delta_events(e), lambda s: live.fold_deltas(s.drop("place"), "3650 days"), order="place").select("session_id", "message_no", "status", "stop_reason", F.get_json_object("content", "$[0].body").alias("text")))


def tool_events(e: DataFrame) -> DataFrame:
    rows = timed(e).filter("event_id % 4 != 3").select(F.col("session_id").cast("string").alias("session_id"), F.col("event_id").cast("string").alias("call_id"), F.col("event_type").alias("tool"), "ts", "event_id", "seq")
    starts = rows.select("session_id", "call_id", "tool", F.col("ts").alias("event_ts"), F.lit("tool_start").alias("type"), F.lit(None).cast("boolean").alias("is_error"), "seq")
    ends = rows.filter("event_id % 4 != 2").select("session_id", "call_id", "tool", (F.col("ts") + F.expr("make_dt_interval(0, 0, 0, event_id % 50)")).alias("event_ts"), F.lit("tool_end").alias("type"), (F.col("event_id") % 5 == 0).alias("is_error"), "seq")
    return starts.unionByName(ends)


query("j3_tool_durations", "ev", sql="SELECT CAST(session_id AS VARCHAR) AS session_id, CAST(event_id AS VARCHAR) AS call_id, event_type AS tool, CAST(event_id % 50 AS DOUBLE) AS seconds, event_id % 5 = 0 AS is_error FROM ev WHERE event_id % 4 IN (0, 1)")(
    lambda e: landed(tool_events(e), lambda s: live.tool_durations(s.drop("seq"), "3650 days")).filter("seconds IS NOT NULL").select("session_id", "call_id", "tool", "seconds", "is_error")
)


def with_marks(u: DataFrame) -> DataFrame:
    """Usage rows that now and then set a name, a thinking level or a label."""
    return timed(u).withColumns({
        "name": F.when(F.col("seq") % 11 == 0, F.concat(F.lit("n"), F.col("seq").cast("string"))), "thinking_level": F.when(F.col("seq") % 13 == 0, F.when(F.col("seq") % 2 == 0, "high").otherwise("low")),
        "label_target": F.when(F.col("seq") % 6 == 0, F.concat(F.lit("e"), (F.col("seq") % 18).cast("string"))), "label": F.when(F.col("seq") % 12 == 0, "").otherwise(F.concat(F.lit("L"), F.col("seq").cast("string"))),
    })


_STATE = (
    "s AS (SELECT session_id, count(*) FILTER (type = 'message') AS messages, count(*) FILTER (type = 'compaction') AS compactions, CAST(sum(input) AS BIGINT) AS input, CAST(sum(cost_micro) AS BIGINT) AS cost_micro, coalesce(max(seq) FILTER (type = 'message'), -1) AS last_seq, arg_max(provider, seq) FILTER (type = 'message') AS provider, arg_max(model, seq) FILTER (type = 'message') AS model, 'n' || CAST(max(seq) FILTER (seq % 11 = 0) AS VARCHAR) AS name, "
    "CASE max(seq) FILTER (seq % 13 = 0) % 2 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS thinking_level FROM usage GROUP BY 1), l AS (SELECT session_id, seq % 18 AS t, max(seq) AS m FROM usage WHERE seq % 6 = 0 GROUP BY 1, 2), x AS (SELECT session_id, string_agg('e' || CAST(t AS VARCHAR) || '=L' || CAST(m AS VARCHAR), ',' ORDER BY 'e' || CAST(t AS VARCHAR)) AS labels FROM l WHERE m % 12 != 0 GROUP BY 1)"
)
_STATE_SQL = f"{_STATE} SELECT s.*, coalesce(labels, '') AS labels FROM s LEFT JOIN x USING (session_id)"
_STATE_COLUMNS = ("session_id", "messages", "compactions", "input", "cost_micro", "last_seq", "provider", "model", "name", "thinking_level")


def labels_text() -> F.Column:
    return F.array_join(F.array_sort(F.transform(F.map_entries(F.from_json("labels", "map<string,string>")), lambda x: F.concat_ws("=", x["key"], x["value"]))), ",").alias("labels")


query("j4_live_session_state", "usage", sql=_STATE_SQL)(
    lambda u: landed(with_marks(u), live.live_session_state, "update").groupBy("session_id").agg(F.max_by(F.struct("*"), "batch").alias("r")).select("r.*").select(*_STATE_COLUMNS, labels_text())
)


def upserted(u: DataFrame) -> DataFrame:
    spark = u.sparkSession
    source, table, checkpoint = (new_path(spark, n) for n in ("landing", "state-table", "stream-checkpoint"))
    rows = with_marks(u)
    for lot in (F.col("seq") <= FIRST_ROWS, F.col("seq") > FIRST_ROWS):
        rows.filter(lot).write.mode("append").parquet(source)
        live.upsert_session_state(live.live_session_state(spark.readStream.schema(rows.schema).parquet(source)), table, checkpoint).awaitTermination()
    return live.session_state_table(spark, table).select(*_STATE_COLUMNS, labels_text())


query("j9_upsert_session_state", "usage", sql=_STATE_SQL)(upserted)
_SEG = "g AS (SELECT *, count(*) FILTER (type IN ('compaction', 'branch_summary')) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS segment, input + cache_read + cache_write AS prompt FROM usage), r AS (SELECT *, lag(prompt) OVER w AS prev_prompt, lag(provider || '/' || model) OVER w AS prev_model, max(CASE WHEN cache_read + cache_write > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, segment ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reported FROM g WHERE type = 'message' AND prompt > 0 WINDOW w AS (PARTITION BY session_id, segment ORDER BY seq))"
query("j5_live_cache_misses", "usage", sql=f"{_SEG} SELECT session_id, seq, least(prev_prompt, prompt) - cache_read AS missed, provider || '/' || model != prev_model AS model_changed FROM r WHERE prev_prompt IS NOT NULL AND (cache_read + cache_write > 0 OR reported > 0) AND least(prev_prompt, prompt) - cache_read > 1024")(
    lambda u: landed(timed(u), live.live_cache_misses, "update").select("session_id", "seq", "missed", "model_changed")
)


def alerts_of(u: DataFrame) -> DataFrame:
    return u.select("session_id", "seq", "type", "stop_reason", F.col("stop_reason").eqNullSafe("error").alias("overflow"), U.context_tokens().alias("tokens"), F.lit(20000).cast("long").alias("context_window"))


query("j6_live_compaction_alerts", "usage", sql="m AS (SELECT *, stop_reason = 'error' AS over FROM usage WHERE type = 'message'), p AS (SELECT *, lag(over) OVER (PARTITION BY session_id ORDER BY seq) AS before FROM m) SELECT session_id, seq, CASE WHEN over THEN 'overflow' ELSE 'threshold' END AS decision FROM p WHERE (over AND NOT coalesce(before, false)) OR (NOT over AND input + output + cache_read + cache_write > 20000 - 16384)")(
    lambda u: landed(alerts_of(u), live.live_compaction_alerts, "update").select("session_id", "seq", "decision")
)


def episode_events(e: DataFrame) -> DataFrame:
    kind = F.when(F.col("session_id") % 2 == 0, "agent").otherwise("turn")
    return timed(e).select(F.col("session_id").cast("string").alias("session_id"), "seq", F.col("ts").alias("event_ts"), F.concat(kind, F.when(F.col("seq") % 2 == 1, "_start").otherwise("_end")).alias("type"), F.col("event_type").alias("reason"))


query("j7_episodes", "ev", sql="SELECT CAST(session_id AS VARCHAR) AS session_id, CASE WHEN session_id % 2 = 0 THEN 'agent' ELSE 'turn' END AS kind, CAST(epoch_us(p) AS BIGINT) AS start_us, CAST(epoch_us(ts) AS BIGINT) AS end_us, event_type AS outcome FROM (SELECT *, lag(ts) OVER (PARTITION BY session_id ORDER BY seq) AS p FROM ev) WHERE seq % 2 = 0")(
    lambda e: landed(episode_events(e), lambda s: live.episodes(s, delay="3650 days", most_ms=10**12)).select("session_id", "kind", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("end_ts").alias("end_us"), "outcome")
)
query("j8_dedup_entries", "ev", sql="SELECT session_id, seq, event_id, event_type FROM ev")(
    lambda e: landed(timed(e).unionByName(timed(e).withColumn("seq", F.col("seq"))), lambda s: live.dedup_entries(s, delay="3650 days")).select("session_id", "seq", "event_id", "event_type")
)
query("j11_latest_queue", "ev", sql="SELECT session_id, arg_max(CAST(event_id AS VARCHAR), seq) AS queue, max(seq) AS seq FROM ev WHERE event_type != 'view' GROUP BY 1")(
    lambda e: landed(e.select("session_id", "seq", F.when(F.col("event_type") != "view", "queue_update").otherwise("other").alias("type"), F.col("event_id").cast("string").alias("queue")), live.latest_queue, "update").groupBy("session_id").agg(F.max_by("queue", "batch").alias("queue"), F.max("seq").alias("seq"))
)
query("a13_stream_source_sink", "usage", sql="SELECT session_id, count(*) AS messages, CAST(sum(output) AS BIGINT) AS output FROM usage WHERE type = 'message' GROUP BY 1")(
    lambda u: landed(timed(u), lambda s: s.filter("type = 'message'").select("session_id", "seq", "output")).groupBy("session_id").agg(F.count("*").alias("messages"), F.sum("output").alias("output"))
)

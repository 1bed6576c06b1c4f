"""The registered queries: each operator on a view of the given tables, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import scalars as S
from tracelake.functions.scans import Scan, scanned
from tracelake.operators import catalog as K
from tracelake.operators import context as C
from tracelake.operators import corpus as D
from tracelake.operators import edits as E
from tracelake.operators import tools as A
from tracelake.operators import trees as R
from tracelake.operators import usage as U
from tracelake.plans import hooks, log_queries, stream_queries
from tracelake.plans.registry import ORACLE_SQL, QUERIES, query
from tracelake.streaming import live

__all__ = ["ORACLE_SQL", "QUERIES", "log_queries", "stream_queries"]

def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Interpolated quantiles to 6 digits: the engines' last bits differ."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def sums(*names: str) -> str:
    return ", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in names)


TOKEN_SUMS = sums("input", "output", "cache_read", "cache_write")

# usage ---------------------------------------------------------------------------------------------------------------

query("e1_cost_by_day_provider", "usage", sql=f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, provider, {sums('cost_micro')}, count(*) AS requests, CAST(GROUPING(CAST(CAST(ts AS DATE) AS VARCHAR), provider) AS BIGINT) AS level FROM usage WHERE cost_micro IS NOT NULL GROUP BY CUBE (CAST(CAST(ts AS DATE) AS VARCHAR), provider)")(U.cost_by_day_provider)
query("e2_usage_by_day_provider", "usage", sql=f"d AS (SELECT *, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM usage) SELECT day, provider, {TOKEN_SUMS}, {sums('cost_micro')}, count(*) AS messages, count(DISTINCT session_id) AS sessions, CAST(GROUPING(day, provider) AS BIGINT) AS level FROM d GROUP BY ROLLUP (day, provider)")(U.usage_by_day_provider)
query("e3_usage_cost_breakdown", "usage", sql=f"SELECT CASE WHEN type = 'message' THEN provider || '/' || model ELSE '[summaries and tools]' END AS model, {sums('cost_micro')}, CAST(sum(input + output + cache_read + cache_write) AS BIGINT) AS tokens FROM usage GROUP BY 1 HAVING sum(cost_micro) > 0 OR sum(input + output + cache_read + cache_write) > 0")(U.usage_cost_breakdown)
query("e4_session_stats", "usage", sql=f"SELECT session_id, count(*) FILTER (type = 'message') AS messages, count(*) FILTER (stop_reason = 'error') AS errors, count(*) FILTER (type = 'compaction') AS compactions, {TOKEN_SUMS}, {sums('cost_micro')} FROM usage GROUP BY session_id")(U.session_stats)
query("e4_message_counts", "conv", sql="SELECT session_id, count(*) FILTER (role = 'user') AS user_messages, count(*) FILTER (role = 'assistant') AS assistant_messages, count(*) FILTER (role = 'toolResult') AS tool_results, count(*) AS messages FROM conv GROUP BY session_id")(U.message_counts)
query("e5_session_stats_cached", "usage", sql=f"SELECT session_id, CAST(sum(cache_read) AS BIGINT) AS cached_tokens, CAST(sum(input + cache_write) AS BIGINT) AS uncached_tokens, CAST(sum(input + output + cache_read + cache_write) AS BIGINT) AS total_tokens, {sums('cost_micro')}, count(*) AS messages FROM usage WHERE type = 'message' GROUP BY session_id")(U.session_stats_cached)
query("e24_combine_usage", "usage", sql=f"SELECT session_id, {TOKEN_SUMS}, CAST(sum(CASE WHEN cache_write > 0 THEN cache_write END) AS BIGINT) AS cache_write_1h FROM usage GROUP BY session_id")(
    lambda u: U.combine_usage(u.withColumn("cache_write_1h", F.when(F.col("cache_write") > 0, F.col("cache_write"))), ["session_id"], [*U.TOKENS, "cache_write_1h"])
)
query("c1_filter_model", "usage", sql="SELECT session_id, seq, provider, model FROM usage WHERE lower(provider || '/' || model) LIKE '%/m%' AND (lower(provider || '/' || model) LIKE 'cl%' OR lower(provider || '/' || model) LIKE 'pu%')")(
    lambda u: U.filter_model(u, "/M", ["CL", "pu"]).select("session_id", "seq", "provider", "model")
)
query("c4_last_n_days", "usage", sql="m AS (SELECT max(CAST(ts AS DATE)) AS t FROM usage) SELECT session_id, count(*) AS requests FROM usage, m WHERE ts >= t - 6 AND ts < t + 1 GROUP BY session_id")(
    lambda u: U.last_n_days(u, 7, u.agg(F.max(F.to_date("ts")).alias("t")).first()["t"]).groupBy("session_id").agg(F.count("*").alias("requests"))
)
query("c11_valid_usage", "usage", sql="SELECT session_id, count(*) AS requests, CAST(sum(input + output + cache_read + cache_write) AS BIGINT) AS tokens FROM usage WHERE type = 'message' AND stop_reason NOT IN ('error', 'aborted') AND input + output + cache_read + cache_write > 0 GROUP BY session_id")(
    lambda u: U.valid_usage(u).groupBy("session_id").agg(F.count("*").alias("requests"), F.sum(U.context_tokens()).alias("tokens"))
)
_ERR = "CASE event_id % 5 WHEN 0 THEN 'prompt is too long: 9 tokens' WHEN 1 THEN 'rate limit: too many tokens' WHEN 2 THEN '503 overloaded' WHEN 3 THEN 'insufficient_quota 429' ELSE NULL END"
query(
    "c9_is_context_overflow", "ev",
    sql=f"x AS (SELECT session_id, seq, CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 4 = 0 THEN 'length' ELSE 'stop' END AS stop, {_ERR} AS err, c % 4096 AS inp, CASE WHEN event_id % 3 = 0 THEN 0 ELSE c END AS cr, CASE WHEN event_id % 4 = 0 THEN 0 ELSE c % 997 END AS outp, 8000 AS win FROM ev) SELECT session_id, seq FROM x WHERE (stop = 'error' AND NOT regexp_matches(coalesce(err, ''), '(?i)rate limit|too many requests') AND regexp_matches(coalesce(err, ''), '(?i)prompt is too long|too many tokens')) OR (stop = 'stop' AND inp + cr > win) OR (stop = 'length' AND outp = 0 AND inp + cr >= win * 0.99)",
)(
    lambda e: e.selectExpr("session_id", "seq", "CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 4 = 0 THEN 'length' ELSE 'stop' END AS stop", f"{_ERR} AS err", "c % 4096 AS inp", "CASE WHEN event_id % 3 = 0 THEN 0 ELSE c END AS cr", "CASE WHEN event_id % 4 = 0 THEN 0 ELSE c % 997 END AS outp")
    .filter(U.is_context_overflow(F.col("stop"), F.col("err"), F.col("inp"), F.col("cr"), F.col("outp"), F.lit(8000)))
    .select("session_id", "seq")
)
query("c10_is_retryable", "ev", sql=f"x AS (SELECT session_id, seq, event_type, {_ERR} AS err FROM ev) SELECT session_id, count(*) AS n FROM x WHERE event_type = 'error' AND NOT regexp_matches(coalesce(err, ''), 'insufficient_quota') AND regexp_matches(coalesce(err, ''), '(?i)rate.?limit|overloaded|503|429|too many requests') GROUP BY session_id")(
    lambda e: e.selectExpr("session_id", "seq", "CASE WHEN event_type = 'error' THEN 'error' ELSE 'stop' END AS stop", f"{_ERR} AS err").filter(U.is_retryable(F.col("stop"), F.col("err"))).groupBy("session_id").agg(F.count("*").alias("n"))
)
_WINDOWS = "w AS (SELECT DISTINCT provider, model, 1000 * (1 + length(provider)) AS context_window FROM usage WHERE model != 'm3')"


def windows_of(u: DataFrame) -> DataFrame:
    return u.filter("model != 'm3'").select("provider", "model", (1000 * (1 + F.length("provider"))).cast("long").alias("context_window")).distinct()


query("d6_with_context_window", "usage", sql=f"{_WINDOWS}, o AS (SELECT provider, model, 5000 AS own FROM w WHERE model = 'm1') SELECT session_id, seq, coalesce(own, context_window) AS context_window FROM usage LEFT JOIN w USING (provider, model) LEFT JOIN o USING (provider, model)")(
    lambda u: U.with_context_window(u, windows_of(u), windows_of(u).filter("model = 'm1'").withColumn("context_window", F.lit(5000).cast("long"))).select("session_id", "seq", "context_window")
)


def priced(u: DataFrame) -> DataFrame:
    rate = lambda above, a, b, c, d: F.struct(*([F.lit(above).cast("long").alias("above")] if above is not None else []), F.lit(a).alias("input"), F.lit(b).alias("output"), F.lit(c).alias("cache_read"), F.lit(d).alias("cache_write"))
    tiers = F.when(F.col("model") != "m0", F.array(rate(4000, 6, 22, 1, 8), rate(9000, 8, 30, 2, 10)))
    return U.price_usage(u, tiers, rate(None, 3, 15, 0, 4))


_TIER = "CASE WHEN model = 'm0' OR input + cache_read + cache_write <= 4000 THEN 0 WHEN input + cache_read + cache_write <= 9000 THEN 1 ELSE 2 END"
query("b18_price_usage", "usage", sql=f"t AS (SELECT *, {_TIER} AS k FROM usage) SELECT session_id, seq, [3, 6, 8][k + 1] * input AS cost_input, [15, 22, 30][k + 1] * output AS cost_output, [0, 1, 2][k + 1] * cache_read AS cost_cache_read, [4, 8, 10][k + 1] * cache_write AS cost_cache_write, [3, 6, 8][k + 1] * input + [15, 22, 30][k + 1] * output + [0, 1, 2][k + 1] * cache_read + [4, 8, 10][k + 1] * cache_write AS cost_total FROM t")(
    lambda u: priced(u).select("session_id", "seq", *(f"cost_{k}" for k in (*U.TOKENS, "total")))
)
query("d7_price_tier", "usage", sql=f"SELECT session_id, seq, CASE {_TIER} WHEN 1 THEN 4000 WHEN 2 THEN 9000 END AS above FROM usage")(
    lambda u: u.select("session_id", "seq", U.price_tier(F.col("input") + F.col("cache_read") + F.col("cache_write"), F.when(F.col("model") != "m0", F.array(F.struct(F.lit(4000).cast("long").alias("above")), F.struct(F.lit(9000).cast("long").alias("above")))))["above"].alias("above"))
)
query("f6_last_usage", "usage", sql="v AS (SELECT session_id, seq, provider, model, input + output + cache_read + cache_write AS tokens, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS n FROM usage WHERE type = 'message' AND stop_reason NOT IN ('error', 'aborted') AND input + output + cache_read + cache_write > 0) SELECT session_id, seq, provider, model, tokens FROM v WHERE n = 1")(U.last_usage)
query("f6_latest_compaction", "usage", sql="SELECT session_id, max(seq) AS seq FROM usage WHERE type = 'compaction' GROUP BY session_id")(U.latest_compaction)
query("f6_last_assistant_text", "conv", sql="SELECT session_id, arg_max(text, seq) AS text FROM conv WHERE role = 'assistant' GROUP BY session_id")(lambda c: U.last_assistant_text(c.withColumn("stop_reason", F.lit("stop"))))
query("d9_model_in_effect", "usage", sql="SELECT session_id, seq, last_value(CASE WHEN seq % 3 = 1 THEN provider END IGNORE NULLS) OVER w AS provider_in_effect, last_value(CASE WHEN seq % 3 = 1 THEN model END IGNORE NULLS) OVER w AS model_in_effect FROM usage WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING)")(
    lambda u: U.model_in_effect(u.withColumns({c: F.when(F.col("seq") % 3 == 1, F.col(c)) for c in ("provider", "model")}))
)
query("e20_model_level_configs", "usage", sql="SELECT DISTINCT session_id, provider, model FROM usage")(U.model_level_configs)

# tool calls -----------------------------------------------------------------------------------------------------------


def results_of(calls: DataFrame) -> DataFrame:
    return calls.filter("is_error IS NOT NULL").select("session_id", "call_id", F.col("seq"), "is_error", "tokens")


_CALLS = "x AS (SELECT *, CASE WHEN is_error IS NULL THEN NULL ELSE NOT is_error END AS success, CASE WHEN tokens % 9 = 0 THEN NULL ELSE tokens / 8.0 END AS inflation, CASE WHEN tokens % 3 = 0 THEN 'multi' ELSE 'single' END AS mode, CASE WHEN tokens % 3 = 0 THEN 1 + tokens % 5 ELSE 1 END AS edits_count, CASE tokens % 4 WHEN 0 THEN 'edits' WHEN 1 THEN 'oldText/newText' ELSE 'unknown' END AS arg_style FROM calls)"


def edits_of(calls: DataFrame) -> DataFrame:
    matched = A.match_calls_results(calls.drop("is_error"), results_of(calls))
    n = F.col("tokens")
    return matched.withColumns({
        "inflation": F.when(n % 9 != 0, n / 8.0),
        "mode": F.when(n % 3 == 0, "multi").otherwise("single"),
        "edits_count": F.when(n % 3 == 0, 1 + n % 5).otherwise(1),
        "arg_style": F.when(n % 4 == 0, "edits").when(n % 4 == 1, "oldText/newText").otherwise("unknown"),
        "total_bytes": n,
    })


query("d1_match_calls_results", "calls", sql="SELECT session_id, call_id, tool, CASE WHEN is_error IS NULL THEN NULL ELSE NOT is_error END AS success FROM calls")(lambda c: A.match_calls_results(c.drop("is_error"), results_of(c)).select("session_id", "call_id", "tool", "success"))
query("d2_unresolved_calls", "calls", sql="SELECT session_id, call_id FROM calls WHERE is_error IS NULL")(lambda c: A.unresolved_calls(c, results_of(c)).select("session_id", "call_id"))
query("d3_unmatched_results", "calls", sql="SELECT session_id, call_id FROM calls WHERE is_error IS NOT NULL AND call_id % 5 = 0")(lambda c: A.unmatched_results(results_of(c), c.filter("call_id % 5 != 0")).select("session_id", "call_id"))
query("d17_synthesize_missing_results", "calls", sql="m AS (SELECT c.session_id, c.call_id, c.tool, coalesce(min(s.seq), 4611686018427387904) AS seq, -1 AS tie, true AS is_error FROM calls c LEFT JOIN calls s ON s.session_id = c.session_id AND s.seq % 4 = 0 AND s.seq > c.seq WHERE c.is_error IS NULL GROUP BY ALL) SELECT session_id, call_id, tool, seq, 0 AS tie, is_error FROM calls WHERE is_error IS NOT NULL UNION ALL SELECT session_id, call_id, tool, seq, tie, is_error FROM m")(
    lambda c: A.synthesize_missing_results(c, results_of(c), c.filter("seq % 4 = 0").select("session_id", "seq", F.lit("user").alias("role"))).drop("text")
)
query("e7_tool_stats", "calls", sql="SELECT tool, count(*) AS calls, count(is_error) AS results, count(*) FILTER (is_error) AS errors, CAST(coalesce(sum(CASE WHEN is_error IS NOT NULL THEN tokens END), 0) AS BIGINT) AS tokens, CAST(sum(CASE WHEN is_error IS NOT NULL THEN tokens END) AS DOUBLE) / nullif(count(is_error), 0) AS mean_tokens FROM calls GROUP BY tool")(lambda c: A.tool_stats(c.drop("is_error", "tokens"), results_of(c)))
query("e8_bash_stats", "calls", sql="x AS (SELECT *, CASE WHEN call_id % 2 = 0 THEN 'git s' || (call_id % 307) ELSE 'ls' END AS k FROM calls) SELECT k AS tool, count(*) AS calls, count(is_error) AS results, count(*) FILTER (is_error) AS errors, CAST(coalesce(sum(CASE WHEN is_error IS NOT NULL THEN tokens END), 0) AS BIGINT) AS tokens, CAST(sum(CASE WHEN is_error IS NOT NULL THEN tokens END) AS DOUBLE) / nullif(count(is_error), 0) AS mean_tokens FROM x GROUP BY k ORDER BY tokens DESC, tool LIMIT 50")(
    lambda c: A.bash_stats(c.drop("is_error", "tokens").withColumn("command", F.when(F.col("call_id") % 2 == 0, F.concat(F.lit("X=1 sudo git s"), (F.col("call_id") % 307).cast("string"), F.lit(" --all | wc -l"))).otherwise("ls -la /tmp && pwd")), results_of(c))
)
_BUCKETS = [0, *A.BUCKETS]
query("e9_token_histogram", "conv", sql="x AS (" + " UNION ALL ".join(f"SELECT '{a}-{b}' AS bucket, count(*) FILTER (tokens > {a if a else -1} AND tokens <= {b}) AS results FROM conv" for a, b in zip(_BUCKETS, _BUCKETS[1:], strict=False)) + " UNION ALL SELECT '32000+', count(*) FILTER (tokens > 32000) FROM conv) SELECT * FROM x")(A.token_histogram)
_GROUP = "count(*) AS calls, count(success) AS resolved, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed, count(*) FILTER (success IS NULL) AS unresolved, count(*) FILTER (mode = 'multi') AS multi, round(quantile_cont(inflation, 0.5), 6) AS median_inflation, round(quantile_cont(inflation, 0.95), 6) AS p95_inflation, CAST(count(*) FILTER (mode = 'multi') AS DOUBLE) / count(*) AS multi_rate, CAST(count(*) FILTER (success) AS DOUBLE) / nullif(count(success), 0) AS success_rate"
query("e10_edit_group_stats", "calls", sql=f"{_CALLS} SELECT tool AS key, {_GROUP} FROM x GROUP BY tool")(lambda c: rounded(A.edit_group_stats(edits_of(c), "tool"), "median_inflation", "p95_inflation"))
query("e10_edit_stats_by_extension", "calls", sql=f"{_CALLS} SELECT CASE WHEN path LIKE '%.%' THEN lower(regexp_extract(path, '\\.[^.]*$')) ELSE '[no_ext]' END AS key, {_GROUP} FROM x GROUP BY 1")(lambda c: rounded(A.edit_group_stats(edits_of(c), S.path_extension("path")), "median_inflation", "p95_inflation"))
query("e11_edit_summary", "calls", sql=f"{_CALLS}, l AS (SELECT 'mode' AS kind, mode AS value, success FROM x UNION ALL SELECT 'edits', CASE WHEN edits_count >= 3 THEN '3+' ELSE CAST(edits_count AS VARCHAR) END, success FROM x UNION ALL SELECT 'style', arg_style, success FROM x UNION ALL SELECT 'failure', CASE WHEN success IS NULL THEN 'missing_result' WHEN NOT success THEN CASE WHEN tokens % 2 = 0 THEN 'file_not_found' ELSE 'other' END END, success FROM x UNION ALL SELECT 'all', 'all', success FROM x) SELECT kind, value, count(*) AS calls, count(*) FILTER (NOT success) AS failed, count(success) AS resolved, CAST(count(*) FILTER (NOT success) AS DOUBLE) / nullif(count(success), 0) AS failure_rate FROM l WHERE value IS NOT NULL GROUP BY kind, value")(
    lambda c: A.edit_summary(edits_of(c).withColumn("error_kind", S.error_kind(F.when(F.col("tokens") % 2 == 0, "File not found: a").otherwise("broken"), ~F.col("success"), F.col("success").isNotNull())))
)
query("e12_inflation_stats", "calls", sql=f"{_CALLS} SELECT count(*) AS edits, " + ", ".join(f"round(quantile_cont(inflation, {p / 100}), 6) AS p{p}" for p in (50, 90, 95, 99)) + ", " + ", ".join(f"count(*) FILTER (inflation >= {n}) AS at_least_{n}" for n in (10, 25, 100)) + ", " + ", ".join(f"count(*) FILTER (tokens > {n} * 1024) AS over_{n}k" for n in (1, 4, 16, 64)) + " FROM x")(lambda c: rounded(A.inflation_stats(edits_of(c)), "p50", "p90", "p95", "p99"))
query("e12_failure_by_inflation", "calls", sql=f"{_CALLS} SELECT CASE WHEN inflation IS NULL THEN 'none' WHEN inflation < 4 THEN '<4' WHEN inflation < 10 THEN '4-10' WHEN inflation < 25 THEN '10-25' ELSE '25+' END AS bucket, count(success) AS resolved, count(*) FILTER (NOT success) AS failed, CAST(count(*) FILTER (NOT success) AS DOUBLE) / nullif(count(success), 0) AS failure_rate FROM x GROUP BY 1")(lambda c: A.failure_by_inflation(edits_of(c)))
query("e13_same_file_clusters", "calls", sql="g AS (SELECT session_id, assistant_seq, tool, count(*) AS n FROM calls GROUP BY ALL HAVING count(*) >= 2) SELECT count(*) AS clusters, count(DISTINCT (session_id, assistant_seq)) AS messages, CAST(coalesce(sum(n), 0) AS BIGINT) AS calls, avg(n) AS mean_calls FROM g")(lambda c: A.same_file_clusters(c.withColumn("path", F.col("tool"))))


def reads_of(c: DataFrame) -> DataFrame:
    return c.withColumn("mode", S.read_mode(F.when(F.col("tokens") % 2 == 0, F.col("tokens")), F.when(F.col("tokens") % 3 == 0, F.col("tokens")))).withColumn("ts", F.col("ts").cast("timestamp"))


_READ = "count(*) AS reads, count(DISTINCT (session_id, assistant_seq)) AS messages, count(*) FILTER (NOT (tokens % 2 = 0 OR tokens % 3 = 0)) AS full_reads, count(*) FILTER (tokens % 2 = 0 OR tokens % 3 = 0) AS partial_reads, CAST(count(*) FILTER (tokens % 2 = 0 OR tokens % 3 = 0) AS DOUBLE) / count(*) AS partial_rate"
query("e14_read_stats", "calls", sql=f"SELECT tool, CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week, {_READ} FROM calls GROUP BY 1, 2")(lambda c: A.read_stats(reads_of(c), {"tool": F.col("tool"), "week": S.week_label("ts")}))
query("e14_read_stats_by_hour", "calls", sql=f"SELECT strftime(ts, '%H') AS hour, {_READ} FROM calls GROUP BY 1")(lambda c: A.read_stats(reads_of(c), {"hour": S.hour_label("ts")}))
query("e15_read_stats_per_session", "calls", sql="s AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS bucket, session_id, count(*) AS n, avg(CASE WHEN tokens % 2 = 0 OR tokens % 3 = 0 THEN 1 ELSE 0 END) AS rate FROM calls GROUP BY 1, 2) SELECT bucket, count(*) AS sessions, avg(n) AS reads_per_session, median(rate) AS median_partial_rate FROM s GROUP BY bucket")(lambda c: A.read_stats_per_session(reads_of(c), S.day_label("ts")))
query("b14_classify_reads", "calls", sql="SELECT session_id, seq, CASE WHEN tokens % 2 = 0 OR tokens % 3 = 0 THEN 'partial' ELSE 'full' END AS mode FROM calls")(lambda c: reads_of(c).select("session_id", "seq", "mode"))
query("b13_classify_edit_args", "calls", sql="SELECT session_id, seq, CASE tokens % 5 WHEN 0 THEN 'edits' WHEN 1 THEN 'oldText/newText' WHEN 2 THEN 'old_string/new_string' WHEN 3 THEN 'mixed' ELSE 'unknown' END AS arg_style, CASE WHEN tokens % 5 = 0 THEN 'multi' ELSE 'single' END AS mode, CAST(CASE WHEN tokens % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) AS edits_count FROM calls")(
    lambda c: c.withColumn("args", F.parse_json(F.expr("""CASE tokens % 5 WHEN 0 THEN '{"edits":[{"oldText":"a"},{"oldText":"b"}]}' WHEN 1 THEN '{"oldText":"a","newText":""}' WHEN 2 THEN '{"old_string":"a"}' WHEN 3 THEN '{"oldText":"a","new_string":"b"}' ELSE '{"path":"x"}' END"""))).select("session_id", "seq", *(v.alias(k) for k, v in S.edit_style("args").items()))
)
_OPS = "o AS (SELECT session_id, seq, CASE tool WHEN 'click' THEN 'read' WHEN 'purchase' THEN 'write' WHEN 'error' THEN 'edit' END AS op, path FROM calls WHERE tool IN ('click', 'purchase', 'error'))"


def ops_of(c: DataFrame) -> DataFrame:
    return A.extract_file_ops(c.withColumn("tool", F.expr("CASE tool WHEN 'click' THEN 'read' WHEN 'purchase' THEN 'write' WHEN 'error' THEN 'edit' ELSE tool END")))


query("b25_extract_file_ops", "calls", sql=f"{_OPS} SELECT session_id, seq, op, path FROM o")(ops_of)
query("e19_file_lists", "calls", sql=f"{_OPS}, m AS (SELECT DISTINCT session_id, path FROM o WHERE op != 'read'), r AS (SELECT DISTINCT session_id, path FROM o WHERE op = 'read' EXCEPT SELECT session_id, path FROM m), s AS (SELECT DISTINCT session_id FROM o) SELECT session_id, coalesce((SELECT string_agg(path, ',' ORDER BY path) FROM m WHERE m.session_id = s.session_id), '') AS modified, coalesce((SELECT string_agg(path, ',' ORDER BY path) FROM r WHERE r.session_id = s.session_id), '') AS read_only FROM s")(
    lambda c: A.file_lists(ops_of(c)).select("session_id", F.array_join("modified", ",").alias("modified"), F.array_join("read_only", ",").alias("read_only"))
)
query("f1_worst_edits", "calls", sql=f"{_CALLS} SELECT session_id, call_id, inflation, tokens AS total_bytes, path FROM x ORDER BY inflation DESC NULLS FIRST, tokens DESC, path, call_id LIMIT 20")(
    lambda c: A.worst_edits(edits_of(c).withColumn("path", F.concat("path", F.lit("\u0001"), F.lpad(F.col("call_id").cast("string"), 12, "0")))).select("session_id", "call_id", "inflation", "total_bytes", F.substring_index("path", "\u0001", 1).alias("path"))
)
query("c2_filter_sessions_by_bash", "calls", sql="SELECT session_id, count(*) AS calls FROM calls WHERE session_id IN (SELECT session_id FROM calls WHERE path LIKE '%f12.PY%') GROUP BY session_id")(lambda c: A.filter_sessions_by_bash(c, c, ["f12.PY"], "path").groupBy("session_id").agg(F.count("*").alias("calls")))
query("c3_filter_calls", "calls", sql="SELECT session_id, call_id FROM calls WHERE tool = 'error' AND path LIKE '%.ts' AND is_error")(lambda c: A.filter_calls(edits_of(c), F.col("tool") == "error", S.path_extension("path") == ".ts", True).select("session_id", "call_id"))
query("c12_error_kind", "calls", sql="SELECT session_id, seq, CASE WHEN is_error IS NULL THEN 'missing_result' WHEN NOT is_error THEN NULL ELSE CASE tokens % 4 WHEN 0 THEN 'file_not_found' WHEN 1 THEN 'multiple_occurrences' WHEN 2 THEN 'aborted' ELSE 'other' END END AS kind FROM calls")(
    lambda c: c.select("session_id", "seq", S.error_kind(F.expr("CASE tokens % 4 WHEN 0 THEN 'FILE NOT FOUND' WHEN 1 THEN 'x\nFound 3 occurrences' WHEN 2 THEN 'Aborted' ELSE 'no' END"), F.col("is_error"), F.col("is_error").isNotNull()).alias("kind"))
)
query("h3_split_deferred_tools", "calls", sql="a AS (SELECT session_id, tool, min(seq) AS x FROM calls WHERE seq % 2 = 0 GROUP BY 1, 2), u AS (SELECT session_id, tool, min(seq) AS y FROM calls WHERE seq % 5 = 0 GROUP BY 1, 2) SELECT t.session_id, t.tool, coalesce(x IS NOT NULL AND (y IS NULL OR y > x), false) AS deferred FROM (SELECT DISTINCT session_id, tool FROM calls) t LEFT JOIN a USING (session_id, tool) LEFT JOIN u USING (session_id, tool)")(
    lambda c: A.split_deferred_tools(c.filter("seq % 2 = 0"), c.filter("seq % 5 = 0"), c.select("session_id", "tool").distinct())
)
query("b9_normalize_tool_call_ids", "calls", sql="SELECT session_id, 'a_' || CAST(call_id AS VARCHAR) || CASE WHEN call_id % 2 = 0 THEN '_i_' || tool ELSE '__' END AS call_id, is_error FROM calls WHERE is_error IS NOT NULL")(
    lambda c: A.normalize_tool_call_ids(*(d.withColumn("call_id", F.concat(F.lit("a."), F.col("call_id").cast("string"), F.when(F.col("call_id") % 2 == 0, F.concat(F.lit("|i+"), F.col("tool"))).otherwise("=="))) for d in (c.select("session_id", "call_id", "tool"), c.filter("is_error IS NOT NULL").select("session_id", "call_id", "tool", "is_error"))))[1].select("session_id", "call_id", "is_error")
)
query("k4_audit_calls", "calls", sql="SELECT session_id, call_id, CASE WHEN tool = 'error' THEN 'no-errors' WHEN path LIKE '%.PY' THEN 'python' END AS rule, CASE WHEN tool = 'error' THEN 'block' WHEN path LIKE '%.PY' THEN 'rewrite' ELSE 'allow' END AS action, CASE WHEN tool <> 'error' AND path LIKE '%.PY' THEN lower(path) ELSE path END AS arguments_after FROM calls")(
    lambda c: hooks.audit_calls(c.withColumn("arguments", F.col("path")), [("no-errors", F.col("tool") == "error", "block", None), ("python", F.col("path").endswith(".PY"), "rewrite", F.lower("path"))]).select("session_id", "call_id", "rule", "action", "arguments_after")
)
query("k1_transforms", "conv", sql="SELECT session_id, count(*) AS n FROM conv WHERE role != 'system' AND length(text) > 100 GROUP BY session_id")(lambda c: hooks.apply_transforms(c, [lambda d: d.filter("role != 'system'"), lambda d: d.filter(F.length("text") > 100), lambda d: d.groupBy("session_id").agg(F.count("*").alias("n"))]))


def projected(c: DataFrame) -> DataFrame:
    p = hooks.Projectors()
    p.register("note", lambda text: [("custom", text[::-1])])
    p.register("pair", lambda text: [("user", text[:20]), ("assistant", text[20:40])] if len(text) > 20 else [])
    p.register_column("shout", F.array(F.struct(F.lit("custom").alias("role"), F.concat(F.lit("! "), F.col("text")).alias("text"))))
    kind = F.when(F.col("role") == "system", "note").when(F.col("seq") % 3 == 0, "pair").when(F.col("seq") % 3 == 1, "shout").otherwise("unknown")
    return p.project(c.withColumns({"type": F.when(F.col("role") == "assistant", "message").otherwise("custom"), "custom_type": kind}), data="text")


query(
    "k2_projectors", "conv",
    sql="c AS (SELECT *, CASE WHEN role = 'system' THEN 'note' WHEN seq % 3 = 0 THEN 'pair' WHEN seq % 3 = 1 THEN 'shout' ELSE '' END AS k FROM conv WHERE role != 'assistant') SELECT session_id, seq, 0 AS part, 'custom' AS role, reverse(text) AS text FROM c WHERE k = 'note' "
    "UNION ALL SELECT session_id, seq, 0, 'user', left(text, 20) FROM c WHERE k = 'pair' AND length(text) > 20 UNION ALL SELECT session_id, seq, 1, 'assistant', substr(text, 21, 20) FROM c WHERE k = 'pair' AND length(text) > 20 UNION ALL SELECT session_id, seq, 0, 'custom', '! ' || text FROM c WHERE k = 'shout'",
)(projected)

# trees ----------------------------------------------------------------------------------------------------------------

_PATH = "leaf AS (SELECT session_id, max(seq) AS seq FROM tree GROUP BY 1), p AS (SELECT session_id, seq, 0 AS d FROM leaf UNION ALL SELECT t.session_id, t.parent_seq, d + 1 FROM p JOIN tree t ON t.session_id = p.session_id AND t.seq = p.seq WHERE t.parent_seq IS NOT NULL), path AS (SELECT session_id, seq, max(d) OVER (PARTITION BY session_id) - d AS pos FROM p)"
_PATH2 = _PATH + ", leaf2 AS (SELECT session_id, max(seq) - 1 AS seq FROM tree GROUP BY 1), q AS (SELECT session_id, seq, 0 AS d FROM leaf2 WHERE seq >= 1 UNION ALL SELECT t.session_id, t.parent_seq, d + 1 FROM q JOIN tree t ON t.session_id = q.session_id AND t.seq = q.seq WHERE t.parent_seq IS NOT NULL)"


def second_leaf(t: DataFrame) -> DataFrame:
    return t.groupBy("session_id").agg((F.max("seq") - 1).alias("seq"))


query("d4_branch_path", "tree", sql=f"{_PATH} SELECT session_id, seq, CAST(pos AS BIGINT) AS pos FROM path")(R.branch_path)
query("d4_branch_path_walk", "tree", sql=f"{_PATH} SELECT session_id, seq, CAST(pos AS BIGINT) AS pos FROM path")(lambda t: R.branch_path(t, strategy="walk"))
query("d5_path_to_root_or_compaction", "tree", sql=f"{_PATH}, c AS (SELECT path.session_id, max(pos) AS cp FROM path JOIN tree USING (session_id, seq) WHERE type = 'compaction' GROUP BY 1) SELECT path.session_id, path.seq, CAST(pos AS BIGINT) AS pos, type FROM path JOIN tree USING (session_id, seq) LEFT JOIN c ON c.session_id = path.session_id WHERE pos >= coalesce(cp, 0)")(lambda t: R.path_to_root_or_compaction(t).select("session_id", "seq", "pos", "type"))
query("d10_common_ancestor", "tree", sql=f"{_PATH2} SELECT p.session_id, max(p.seq) AS seq FROM p JOIN q ON p.session_id = q.session_id AND p.seq = q.seq GROUP BY 1")(lambda t: R.common_ancestor(t, R.last_entry(t), second_leaf(t)))
query("d11_resolve_labels", "tree", sql="l AS (SELECT session_id, parent_seq AS seq, CASE WHEN c % 3 = 0 THEN '' ELSE 'L' || CAST(c AS VARCHAR) END AS label, row_number() OVER (PARTITION BY session_id, parent_seq ORDER BY seq DESC) AS n FROM tree WHERE type = 'label') SELECT t.session_id, t.seq, l.label FROM tree t LEFT JOIN l ON l.session_id = t.session_id AND l.seq = t.seq AND n = 1 AND label != ''")(
    lambda t: R.resolve_labels(t, t.filter("type = 'label'").select("session_id", "seq", F.col("parent_seq").alias("target"), F.when(F.col("c") % 3 == 0, "").otherwise(F.concat(F.lit("L"), F.col("c").cast("string"))).alias("label"), "ts")).select("session_id", "seq", "label")
)
query(
    "d12_session_lineage", "ev",
    sql="s AS (SELECT session_id, CAST(floor(session_id / 2.0) AS BIGINT) AS parent_id, max(seq) AS ts FROM ev GROUP BY session_id), r AS (SELECT session_id AS o, session_id, 0 AS d FROM s UNION ALL SELECT o, s.parent_id, d + 1 FROM r JOIN s ON s.session_id = r.session_id JOIN s p ON p.session_id = s.parent_id WHERE s.parent_id != s.session_id), "
    "top AS (SELECT o, max(d) AS depth, arg_max(session_id, d) AS root FROM r GROUP BY o), act AS (SELECT r.session_id, max(ts) AS latest, count(*) AS size FROM r JOIN s ON s.session_id = r.o GROUP BY 1), "
    "par AS (SELECT s.session_id, p.session_id AS parent, latest FROM s JOIN act USING (session_id) LEFT JOIN s p ON p.session_id = s.parent_id AND p.session_id != s.session_id), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY latest DESC, session_id) AS n, count(*) OVER (PARTITION BY parent) AS of FROM par), "
    "w AS (SELECT session_id, lpad(CAST(n AS VARCHAR), 9, '0') AS path FROM k WHERE parent IS NULL UNION ALL SELECT k.session_id, w.path || '/' || lpad(CAST(n AS VARCHAR), 9, '0') FROM w JOIN k ON k.parent = w.session_id) "
    "SELECT top.o AS session_id, root, CAST(depth AS BIGINT) AS depth, act.latest, size, row_number() OVER (ORDER BY path) - 1 AS position, n = of AS is_last FROM top JOIN act ON act.session_id = o JOIN k ON k.session_id = o JOIN w ON w.session_id = o",
)(lambda e: R.session_lineage(e.groupBy("session_id").agg(F.max("seq").alias("ts")).withColumn("parent_id", F.floor(F.col("session_id") / 2).cast("long"))))
query("d13_children", "tree", sql="SELECT t.session_id, t.parent_seq, string_agg(CAST(t.seq AS VARCHAR), ',' ORDER BY t.ts, t.seq) AS children FROM tree t GROUP BY t.session_id, t.parent_seq")(lambda t: R.children(t).select("session_id", "parent_seq", F.array_join(F.transform("children", lambda x: x.cast("string")), ",").alias("children")))
query("c5_filter_entries", "tree", sql="SELECT session_id, seq, type FROM tree WHERE type != 'label'")(lambda t: R.filter_entries(t).select("session_id", "seq", "type"))
query("c5_filter_entries_user_only", "conv", sql="SELECT session_id, seq FROM conv WHERE role = 'user'")(lambda c: R.filter_entries(c.withColumn("type", F.lit("message")), "user-only").select("session_id", "seq"))
query("c6_search_entries", "conv", sql="SELECT session_id, seq FROM conv WHERE lower(role || ' ' || text) LIKE '%user%' AND lower(role || ' ' || text) LIKE '%the%'")(lambda c: R.search_entries(c, "USER the", F.concat_ws(" ", "role", "text")).select("session_id", "seq"))
query("c15_entries_of_type", "tree", sql="SELECT session_id, seq, c FROM tree WHERE type = 'compaction'")(lambda t: R.entries_of_type(t, "compaction").select("session_id", "seq", "c"))
query("f4_entry_slice_per_session", "tree", sql="SELECT session_id, seq, type FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM tree) WHERE n > 3 AND n <= 8")(lambda t: R.entry_slice_per_session(t, 3, 5).select("session_id", "seq", "type"))
query("f5_last_n_per_session", "tree", sql="SELECT session_id, seq, type FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS n FROM tree WHERE seq <= 40) WHERE n <= 4")(lambda t: R.last_n_per_session(t, 4, 40).select("session_id", "seq", "type"))
query("f9_latest_custom_state", "tree", sql=f"{_PATH} SELECT session_id, type, max(seq) AS seq, arg_max(c, seq) AS data FROM path JOIN tree USING (session_id, seq) WHERE type IN ('label', 'compaction') GROUP BY 1, 2")(lambda t: R.latest_custom_state(t, ["label", "compaction"], "c"))
_CTX = f"{_PATH}, x AS (SELECT path.*, type, CAST(floor(seq / 8.0) AS BIGINT) AS kept FROM path JOIN tree USING (session_id, seq)), c AS (SELECT session_id, max(pos) AS cp, arg_max(kept, pos) AS k FROM x WHERE type = 'compaction' GROUP BY 1), f AS (SELECT c.session_id, pos AS fp FROM c JOIN x ON x.session_id = c.session_id AND x.seq = c.k), y AS (SELECT x.*, cp, fp FROM x LEFT JOIN c USING (session_id) LEFT JOIN f USING (session_id) WHERE cp IS NULL OR pos >= cp OR (pos >= fp AND pos < cp))"


def with_kept(t: DataFrame) -> DataFrame:
    return t.withColumn("first_kept_seq", F.when(F.col("type") == "compaction", F.floor(F.col("seq") / 8).cast("long")))


query("g7_context_entries", "tree", sql=f"{_CTX} SELECT session_id, seq, type, CAST(row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN pos = cp THEN 0 ELSE 1 END, pos) - 1 AS BIGINT) AS context_pos FROM y")(lambda t: R.context_entries(with_kept(t)).select("session_id", "seq", "type", F.col("context_pos").cast("long").alias("context_pos")))
query("g8_session_context", "tree", sql=f"{_PATH} SELECT session_id, arg_max(m, seq) FILTER (m IS NOT NULL) AS model, coalesce(arg_max(l, seq) FILTER (l IS NOT NULL), 'off') AS thinking_level, count(*) AS path_rows FROM (SELECT path.*, CASE WHEN c % 2 = 0 THEN 'm' || CAST(c % 3 AS VARCHAR) END AS m, CASE WHEN c % 5 = 0 THEN 'high' END AS l FROM path JOIN tree USING (session_id, seq)) GROUP BY session_id")(
    lambda t: R.session_context(t.withColumns({"model": F.when(F.col("c") % 2 == 0, F.concat(F.lit("m"), (F.col("c") % 3).cast("string"))), "thinking_level": F.when(F.col("c") % 5 == 0, "high")}), state=("model", "thinking_level"))[1]
)
query("g13_contract_tree", "tree", sql="r AS (SELECT session_id, seq AS o, parent_seq AS a, 1 AS d FROM tree WHERE type != 'label' AND parent_seq IS NOT NULL UNION ALL SELECT r.session_id, o, t.parent_seq, d + 1 FROM r JOIN tree t ON t.session_id = r.session_id AND t.seq = r.a WHERE t.parent_seq IS NOT NULL), n AS (SELECT r.session_id, o, arg_min(a, d) AS v FROM r JOIN tree t ON t.session_id = r.session_id AND t.seq = r.a WHERE t.type != 'label' GROUP BY 1, 2) SELECT t.session_id, t.seq, v AS visible_parent FROM tree t LEFT JOIN n ON n.session_id = t.session_id AND n.o = t.seq WHERE t.type != 'label'")(lambda t: R.contract_tree(t, F.col("type") != "label"))
query("g13_fold_descendants", "tree", sql="f AS (SELECT session_id, seq FROM tree WHERE type = 'compaction'), u AS (SELECT t.session_id, t.seq FROM tree t JOIN f ON f.session_id = t.session_id AND f.seq = t.parent_seq UNION SELECT t.session_id, t.seq FROM tree t JOIN u ON u.session_id = t.session_id AND u.seq = t.parent_seq) SELECT session_id, seq FROM tree EXCEPT SELECT session_id, seq FROM u")(lambda t: R.fold_descendants(t, t.filter("type = 'compaction'").select("session_id", "seq")).select("session_id", "seq"))
query("g14_active_path_flags", "tree", sql=f"{_PATH}, b AS (SELECT session_id, parent_seq AS seq, count(*) > 1 AS f FROM tree WHERE parent_seq IS NOT NULL GROUP BY 1, 2) SELECT t.session_id, t.seq, path.pos IS NOT NULL AS on_path, coalesce(f, false) AS is_branch_point FROM tree t LEFT JOIN path USING (session_id, seq) LEFT JOIN b USING (session_id, seq)")(lambda t: R.active_path_flags(t).select("session_id", "seq", "on_path", "is_branch_point"))
query("h1_abandoned_entries", "tree", sql=f"{_PATH2} SELECT q.session_id, q.seq FROM q LEFT JOIN p ON p.session_id = q.session_id AND p.seq = q.seq WHERE p.seq IS NULL")(lambda t: R.abandoned_entries(t, second_leaf(t), R.last_entry(t)).select("session_id", "seq"))
query("h4_fork_session", "tree", sql=f"{_PATH} SELECT CAST(session_id AS VARCHAR) || '-fork' AS session_id, seq, type FROM path JOIN tree USING (session_id, seq)")(lambda t: R.fork_session(t, R.last_entry(t))[1].select("session_id", "seq", "type"))
query("h5_extract_branch", "tree", sql=f"{_PATH}, k AS (SELECT path.session_id, seq, type, pos FROM path JOIN tree USING (session_id, seq) WHERE type != 'label') SELECT session_id, seq, type, lag(seq) OVER w AS parent_seq, CAST(row_number() OVER w - 1 AS BIGINT) AS pos FROM k WINDOW w AS (PARTITION BY session_id ORDER BY pos)")(R.extract_branch)
query("b1_migrate_v1_to_v2", "conv", sql="i AS (SELECT session_id, seq, substr(sha256(CAST(session_id AS VARCHAR) || ':' || CAST(seq AS VARCHAR)), 1, 8) AS entry_id, CASE WHEN seq % 3 = 2 THEN seq - 1 END AS k, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM conv) SELECT i.session_id, i.seq, i.entry_id, lag(i.entry_id) OVER (PARTITION BY i.session_id ORDER BY i.seq) AS parent_id, j.entry_id AS first_kept_entry_id FROM i LEFT JOIN i j ON j.session_id = i.session_id AND j.n = i.k")(
    lambda c: R.migrate_v1_to_v2(c.withColumn("first_kept_index", F.when(F.col("seq") % 3 == 2, F.col("seq") - 1).cast("int"))).select("session_id", "seq", "entry_id", "parent_id", "first_kept_entry_id")
)
query("b2_migrate_v2_to_v3", "conv", sql="SELECT session_id, seq, CASE WHEN role = 'system' AND session_id % 2 = 0 THEN 'custom' WHEN role = 'system' THEN 'hookMessage' ELSE role END AS role, 3 AS version FROM conv")(lambda c: R.migrate_v2_to_v3(c.withColumns({"role": F.when(F.col("role") == "system", "hookMessage").otherwise(F.col("role")), "version": F.when(F.col("session_id") % 2 == 0, 2).otherwise(3)})).select("session_id", "seq", "role", "version"))

# context --------------------------------------------------------------------------------------------------------------

query("b19_estimate_tokens", "conv", sql="SELECT session_id, seq, tokens FROM conv")(lambda c: c.withColumn("content", F.array(F.struct(F.lit("text").alias("type"), F.translate("text", "\U0001f600", "").alias("text"), F.lit(None).cast("string").alias("thinking"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments")))).withColumn("role", F.when(F.col("role") == "system", "custom").otherwise(F.col("role"))).transform(lambda d: d.select("session_id", "seq", C.estimate_tokens(d).alias("tokens"))))
def _chunked(part: str, keep: str, separator: str, head: str = "''", tail: str = "''") -> str:
    return (
        f"p AS (SELECT session_id, seq, {part} AS part FROM conv WHERE {keep}), s AS (SELECT *, coalesce(sum(length(part) + length({separator})) OVER w, 0) AS before, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS back FROM p WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) "
        f"SELECT session_id, CAST(before // {C.CHUNK_CHARS} AS BIGINT) AS chunk, CASE WHEN min(before) > 0 THEN substr({separator}, 2) ELSE {head} END || string_agg(part, {separator} ORDER BY seq) || CASE WHEN min(back) = 1 THEN {tail} ELSE '' END AS text FROM s GROUP BY session_id, before // {C.CHUNK_CHARS}"
    )


query("b23_serialize_conversation", "conv", sql=_chunked("CASE role WHEN 'user' THEN '[User]: ' ELSE '[Assistant]: ' END || text", "role IN ('user', 'assistant') AND text != ''", "chr(10) || chr(10)"))(C.serialize_conversation)
query("b24_transcript", "conv", sql=_chunked("'[' || upper(role) || ']' || chr(10) || text", "role IN ('user', 'assistant') AND trim(text) != ''", "chr(10) || '---' || chr(10)", "'=== SESSION: ' || CAST(session_id AS VARCHAR) || ' ===' || chr(10)", "chr(10) || '=== END SESSION ==='"))(C.transcript)
query("b5_entries_to_context", "tree", sql="SELECT session_id, seq, CASE type WHEN 'compaction' THEN 'compactionSummary' ELSE 'user' END AS role FROM tree WHERE type IN ('compaction', 'message')")(lambda t: C.entries_to_context(t.withColumns({"role": F.lit("user"), "summary": F.lit(None).cast("string")})).select("session_id", "seq", "role"))
query("c13_should_compact", "conv", sql="t AS (SELECT session_id, CAST(sum(tokens) AS BIGINT) AS tokens FROM conv GROUP BY 1) SELECT session_id, tokens, tokens > 20000 - 19000 AS compact FROM t")(lambda c: c.groupBy("session_id").agg(F.sum("tokens").alias("tokens")).withColumn("compact", C.should_compact(F.col("tokens"), F.lit(20000), 19000)))
query("c14_turn_points", "conv", sql="SELECT session_id, seq, role != 'assistant' AS starts, true AS can_cut FROM conv")(lambda c: c.withColumn("role", F.when(F.col("role") == "system", "custom").otherwise(F.col("role"))).select("session_id", "seq", C.turn_start(F.col("role")).alias("starts"), C.cut_point(F.col("role")).alias("can_cut")))
_SEG = "g AS (SELECT *, count(*) FILTER (type IN ('compaction', 'branch_summary')) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS segment, input + cache_read + cache_write AS prompt FROM usage), r AS (SELECT *, lag(prompt) OVER w AS prev_prompt, lag(provider || '/' || model) OVER w AS prev_model, lag(ts) OVER w AS prev_ts, max(CASE WHEN cache_read + cache_write > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, segment ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reported FROM g WHERE type = 'message' AND prompt > 0 WINDOW w AS (PARTITION BY session_id, segment ORDER BY seq)), m AS (SELECT *, least(prev_prompt, prompt) - cache_read AS missed FROM r WHERE prev_prompt IS NOT NULL AND (cache_read + cache_write > 0 OR coalesce(reported, 0) > 0))"
query("d8_previous_request", "usage", sql=f"{_SEG} SELECT session_id, seq, prompt, prev_prompt, segment FROM r")(lambda u: C.previous_request(u).select("session_id", "seq", "prompt", "prev_prompt", "segment"))
query("g1_cache_misses", "usage", sql=f"{_SEG} SELECT session_id, seq, missed, provider || '/' || model <> prev_model AS model_changed, greatest(0, (epoch_us(ts) - epoch_us(prev_ts)) / 1e6) AS idle_s FROM m WHERE missed > 1024")(lambda u: C.cache_misses(u).select("session_id", "seq", "missed", "model_changed", F.round("idle_s", 6).alias("idle_s")))
query("e18_cache_waste", "usage", sql=f"{_SEG} SELECT session_id, CAST(sum(missed) AS BIGINT) AS missed_tokens, count(*) AS misses FROM m WHERE missed > 1024 GROUP BY session_id")(lambda u: C.cache_waste(C.cache_misses(u)))


def with_costs(u: DataFrame) -> DataFrame:
    return u.withColumns({"cost_input": F.col("input") * 3, "cost_cache_write": F.col("cache_write") * 4, "cost_cache_read": F.col("cache_read") * 1})


def rates_of(u: DataFrame) -> DataFrame:
    return u.filter("model != 'm2'").select("provider", "model").distinct().withColumn("cache_read_rate", F.when(F.col("model") == "m1", 0.5).otherwise(2.0))


_EXTRA = f"{_SEG}, x AS (SELECT *, missed * greatest(0, CASE WHEN input + cache_write > 0 THEN (input * 3 + cache_write * 4) / CAST(input + cache_write AS DOUBLE) ELSE 0 END - CASE WHEN cache_read > 0 THEN 1 WHEN model = 'm1' THEN 0.5 WHEN model = 'm2' THEN 0 ELSE 2 END) AS extra FROM m WHERE missed > 1024)"
query("g1_cache_miss_cost", "usage", sql=f"{_EXTRA} SELECT session_id, seq, missed, round(extra, 6) AS extra_micro FROM x")(lambda u: rounded(C.cache_misses(with_costs(u), rates_of(u)).select("session_id", "seq", "missed", "extra_micro"), "extra_micro"))
query("e18_cache_waste_cost", "usage", sql=f"{_EXTRA} SELECT session_id, CAST(sum(missed) AS BIGINT) AS missed_tokens, count(*) AS misses, round(sum(extra), 6) AS extra_micro FROM x GROUP BY session_id")(lambda u: rounded(C.cache_waste(C.cache_misses(with_costs(u), rates_of(u))), "extra_micro"))
query("e16_context_pressure_sessions", "usage", sql=f"{_WINDOWS}, y AS (SELECT *, input + cache_read + cache_write AS prompt, min(CASE WHEN type = 'compaction' THEN seq END) OVER (PARTITION BY session_id) AS fc FROM usage), s AS (SELECT session_id, max(prompt) AS max_tokens, coalesce(arg_max(prompt, seq) FILTER (type = 'message' AND (fc IS NULL OR seq < fc) AND prompt > 0), max(prompt) FILTER (seq = fc)) AS tokens_before, arg_max(provider, seq) FILTER (type = 'message') AS provider, arg_max(model, seq) FILTER (type = 'message') AS model, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS BIGINT) AS duration_s, count(*) FILTER (type = 'compaction') AS compactions FROM y GROUP BY session_id) SELECT s.*, context_window, 100.0 * max_tokens / context_window AS percent, coalesce(100.0 * max_tokens / context_window >= 80, false) AS over_80, coalesce(100.0 * max_tokens / context_window >= 90, false) AS over_90, coalesce(100.0 * max_tokens / context_window >= 100, false) AS over_100 FROM s LEFT JOIN w USING (provider, model)")(lambda u: C.context_pressure_sessions(u, windows_of(u)).drop("start"))
query("e17_context_pressure_groups", "usage", sql="s AS (SELECT session_id, max(input + cache_read + cache_write) AS t, CAST(CAST(min(ts) AS DATE) AS VARCHAR) AS day, arg_max(model, seq) FILTER (type = 'message') AS model, count(*) FILTER (type = 'compaction') AS k FROM usage GROUP BY 1) SELECT day, model, count(*) AS sessions, avg(t) AS mean_tokens, median(t) AS median_tokens, avg(CASE WHEN k > 0 THEN 1 ELSE 0 END) AS compaction_rate, CAST(GROUPING(day, model) AS BIGINT) AS level FROM s GROUP BY CUBE (day, model)")(lambda u: C.context_pressure_groups(C.context_pressure_sessions(u)))


def roles(c: DataFrame) -> DataFrame:
    return c.withColumn("role", F.when(F.col("role") == "system", "custom").otherwise(F.col("role"))).withColumn("type", F.lit("message"))


_CUT = "x AS (SELECT session_id, seq, CASE WHEN role = 'system' THEN 'custom' ELSE role END AS role, tokens, sum(tokens) OVER (PARTITION BY session_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS suf FROM conv), a AS (SELECT session_id, coalesce(max(seq) FILTER (tokens > 0 AND suf >= 150), min(seq)) AS cut FROM x GROUP BY 1), k AS (SELECT x.session_id, cut, bool_or(role != 'assistant') FILTER (seq = cut) AS st, max(seq) FILTER (role != 'assistant' AND seq <= cut) AS turn FROM x JOIN a USING (session_id) GROUP BY 1, 2), fin AS (SELECT session_id, cut, CAST(CASE WHEN st THEN -1 ELSE coalesce(turn, -1) END AS BIGINT) AS turn_start FROM k)"
query("g2_find_cut_point", "conv", sql=f"{_CUT} SELECT session_id, cut, turn_start, turn_start >= 0 AS split FROM fin")(lambda c: C.find_cut_point(roles(c), 150))
query("g3_prepare_compaction", "conv", sql=f"{_CUT}, z AS (SELECT conv.session_id, conv.seq, CASE WHEN conv.seq < CASE WHEN turn_start >= 0 THEN turn_start ELSE cut END THEN 'summarise' WHEN conv.seq < cut THEN 'turn_prefix' ELSE 'keep' END AS part FROM conv JOIN fin USING (session_id)) SELECT * FROM z WHERE session_id IN (SELECT session_id FROM z WHERE part != 'keep')")(lambda c: C.prepare_compaction(roles(c), 150).select("session_id", "seq", "part"))
query("g4_context_usage", "usage", sql="x AS (SELECT session_id, seq, input + output + cache_read + cache_write AS u, CAST(ceil(input / 4.0) AS BIGINT) AS tokens, type = 'message' AND seq % 4 = 0 AND stop_reason != 'error' AND input + output + cache_read + cache_write > 0 AS ok FROM usage), l AS (SELECT session_id, max(seq) FILTER (ok) AS usage_seq, arg_max(u, seq) FILTER (ok) AS u FROM x GROUP BY 1) SELECT x.session_id, usage_seq, coalesce(l.u, 0) AS usage_tokens, CAST(coalesce(sum(tokens) FILTER (usage_seq IS NULL OR seq > usage_seq), 0) AS BIGINT) AS trailing_tokens, CAST(coalesce(l.u, 0) + coalesce(sum(tokens) FILTER (usage_seq IS NULL OR seq > usage_seq), 0) AS BIGINT) AS tokens FROM x JOIN l USING (session_id) GROUP BY x.session_id, usage_seq, l.u")(
    lambda u: C.context_usage(u.select("session_id", "seq", "stop_reason", F.when((F.col("type") == "message") & (F.col("seq") % 4 == 0), "assistant").otherwise("user").alias("role"), U.context_tokens().alias("usage_tokens"), F.ceil(F.col("input") / 4).cast("long").alias("tokens")))
)
query("g5_select_branch_budget", "conv", sql="x AS (SELECT session_id, seq, role, tokens, sum(tokens) OVER w AS s FROM conv WINDOW w AS (PARTITION BY session_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING)), y AS (SELECT *, count(*) FILTER (s > 200) OVER (PARTITION BY session_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS o FROM x) SELECT session_id, seq FROM y WHERE o = 0 OR (o = 1 AND role = 'system' AND s - tokens < 180)")(lambda c: C.select_branch_budget(c.withColumn("type", F.when(F.col("role") == "system", "branch_summary").otherwise("message")), 200).select("session_id", "seq"))
query("g9_auto_compaction_decision", "usage", sql="x AS (SELECT *, max(CASE WHEN type = 'compaction' THEN ts END) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cts FROM usage) SELECT session_id, seq, CASE WHEN model = 'm3' OR coalesce(ts <= cts, false) THEN 'none' WHEN stop_reason = 'stop' AND input + cache_read > 9000 THEN 'overflow' WHEN stop_reason != 'error' AND input + output + cache_read + cache_write > 9000 - 2000 THEN 'threshold' ELSE 'none' END AS decision FROM x WHERE type = 'message'")(
    lambda u: C.auto_compaction_decision(scanned(u, compaction_ts=Scan("max", F.when(F.col("type") == "compaction", F.col("ts")))).withColumns({"context_window": F.lit(9000), "error_message": F.lit(None).cast("string"), "current": F.col("model") != "m3"}).filter("type = 'message'"), 2000).select("session_id", "seq", "decision")
)
query("g15_retry_episodes", "usage", sql="x AS (SELECT *, count(*) FILTER (stop_reason != 'error') OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM usage) SELECT session_id, min(seq) AS first_seq, count(*) AS attempts, 2.0 * (pow(2, least(count(*), 3)) - 1) AS backoff_s FROM x WHERE stop_reason = 'error' GROUP BY session_id, run")(lambda u: C.retry_episodes(u, F.col("stop_reason") == "error"))
_PACK = "CASE WHEN r.size > 5000 OR f.used IS NULL OR f.used + r.size + 2 > 5000 THEN f.bin + 1 ELSE f.bin END, CASE WHEN r.size > 5000 THEN NULL WHEN f.used IS NULL OR f.used + r.size + 2 > 5000 THEN r.size ELSE f.used + r.size + 2 END"
query("g6_pack_transcripts", "conv", sql=f"r AS (SELECT CAST(session_id // 8 AS VARCHAR) AS cwd, session_id * 1000 + seq AS seq, CAST(length(text) AS BIGINT) AS size, row_number() OVER (PARTITION BY session_id // 8 ORDER BY session_id * 1000 + seq) AS n FROM conv), f AS (SELECT cwd, seq, size, n, CAST(0 AS BIGINT) AS bin, CASE WHEN size <= 5000 THEN size END AS used FROM r WHERE n = 1 UNION ALL SELECT r.cwd, r.seq, r.size, r.n, {_PACK} FROM f JOIN r ON r.cwd = f.cwd AND r.n = f.n + 1) SELECT cwd, seq, bin, size FROM f")(
    lambda c: hooks.pack_transcripts(c.select(F.floor(F.col("session_id") / 8).cast("string").alias("cwd"), (F.col("session_id") * 1000 + F.col("seq")).alias("seq"), "text"), 5000)
)

# corpus ---------------------------------------------------------------------------------------------------------------

query("a8_read_corpus", "corpus", sql="x AS (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS l FROM corpus) SELECT doc_id, CAST(k - 1 AS INTEGER) AS pos, l[k] AS line FROM (SELECT *, unnest(range(1, len(l) + 1)) AS k FROM x)")(D.read_corpus)
query("c16_find_paths", "corpus", sql="SELECT path FROM corpus WHERE regexp_matches(path, '^src1[0-9]*/[^/]*\\.(en|de)$') ORDER BY path LIMIT 1000")(lambda c: D.find_paths(c, "src1*/*.{en,de}"))
query("g11_grep_corpus", "corpus", sql="l AS (SELECT doc_id, k - 1 AS pos, x[k] AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS x, unnest(range(1, len(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) + 1)) AS k FROM corpus)), m AS (SELECT *, regexp_matches(line, '(?i)licen[sc]e') AS is_match FROM l), n AS (SELECT *, max(CASE WHEN is_match THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM m) SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN length(line) > 500 THEN substr(line, 1, 500) || '... [truncated]' ELSE line END AS line, is_match FROM n WHERE near = 1")(lambda c: D.grep_corpus(c, "licen[sc]e", 1, None, True))
_LINES = "s AS (SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS t FROM corpus), l AS (SELECT doc_id, strlen(t) AS size, string_split(t, chr(10)) AS x FROM s)"
_FIT = "d AS (SELECT *, unnest(range(1, len(y) + 1)) AS k FROM f), b AS (SELECT *, y[k] AS line, sum(strlen(y[k]) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) - 1 AS b FROM d)"
query(
    "g10_truncate_lines", "corpus",
    sql=f"{_LINES}, f AS (SELECT *, x AS y FROM l), {_FIT}, a AS (SELECT doc_id, count(*) AS total_lines, any_value(size) AS total_bytes, count(*) FILTER (k <= 20 AND b <= 4000) AS lines, string_agg(line, chr(10) ORDER BY k) FILTER (k <= 20 AND b <= 4000) AS text FROM b GROUP BY doc_id) "
    "SELECT doc_id, total_lines, total_bytes, lines, strlen(coalesce(text, '')) AS bytes, coalesce(text, '') AS text, CASE WHEN lines = total_lines THEN 'none' WHEN lines = 20 THEN 'lines' ELSE 'bytes' END AS truncated_by, lines = 0 AS first_too_long FROM a",
)(lambda c: D.truncate_lines(c, 20, 4000))
query(
    "g10_truncate_lines_tail", "corpus",
    sql=f"{_LINES}, f AS (SELECT doc_id, size, list_reverse(CASE WHEN len(x) > 1 AND x[-1] = '' THEN x[:-2] ELSE x END) AS y FROM l), {_FIT}, a AS (SELECT doc_id, count(*) AS n, any_value(size) AS size, any_value(y[1]) AS last, count(*) FILTER (k <= 3 AND b <= 90) AS lines, string_agg(line, chr(10) ORDER BY k DESC) FILTER (k <= 3 AND b <= 90) AS text FROM b GROUP BY doc_id), "
    "r AS (SELECT *, CASE WHEN n <= 3 AND size <= 90 THEN (SELECT t FROM s WHERE s.doc_id = a.doc_id) WHEN lines = 0 THEN right(last, list_max(list_filter(range(0, 91), lambda k: strlen(right(last, k)) <= 90))) ELSE text END AS out FROM a) "
    "SELECT doc_id, n AS total_lines, size AS total_bytes, greatest(lines, 1) AS lines, strlen(out) AS bytes, out AS text, CASE WHEN n <= 3 AND size <= 90 THEN 'none' WHEN lines = 3 OR lines = n THEN 'lines' ELSE 'bytes' END AS truncated_by, lines = 0 AS first_too_long FROM r",
)(lambda c: D.truncate_lines(c, 3, 90, "tail"))
query("g12_read_slice", "corpus", sql="l AS (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS x FROM corpus) SELECT doc_id, CAST(len(x) AS BIGINT) AS document_lines, CAST(len(x[3:7]) AS BIGINT) AS lines, len(x) < 3 AS past_end, CASE WHEN len(x) >= 3 AND 3 + len(x[3:7]) <= len(x) THEN CAST(3 + len(x[3:7]) AS BIGINT) END AS next_offset, CASE WHEN len(x) >= 3 THEN array_to_string(x[3:7], chr(10)) END AS text FROM l")(lambda c: D.read_slice(c, 3, 5, 2000, 10_000_000).select("doc_id", "document_lines", "lines", "past_end", "next_offset", "text"))
query("e6_session_info", "conv", sql="SELECT session_id, count(*) FILTER (role IN ('user', 'assistant')) AS messages, arg_min(text, seq) FILTER (role = 'user' AND trim(text) != '') AS first_message, string_agg(text, ' ' ORDER BY seq) FILTER (role IN ('user', 'assistant') AND trim(text) != '') AS text FROM conv GROUP BY session_id")(lambda c: D.session_info(c.withColumn("type", F.lit("message"))))


def listing(c: DataFrame) -> DataFrame:
    return D.session_info(c.withColumn("type", F.lit("message"))).withColumn("modified", F.col("session_id") % 17)


_LIST = "s AS (SELECT session_id, coalesce(string_agg(text, ' ' ORDER BY seq) FILTER (role IN ('user', 'assistant') AND trim(text) != ''), '') AS text FROM conv GROUP BY session_id)"
query("c8_search_sessions", "conv", sql=f"{_LIST}, n AS (SELECT session_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM s) SELECT session_id, (strpos(t, 'the') - 1) * 0.1 + (strpos(t, 'on') - 1) * 0.1 AS score FROM n WHERE strpos(t, 'the') > 0 AND strpos(t, 'on') > 0")(lambda c: D.search_sessions(listing(c), '"The" "on"').select("session_id", F.round("score", 6).alias("score")))
query("c8_search_sessions_regex", "conv", sql=f"{_LIST} SELECT session_id FROM s WHERE regexp_matches(text, '(?i)th[aeiou]r')")(lambda c: D.search_sessions(listing(c), "re:th[aeiou]r", "recent").select("session_id"))


def fuzzy_sql(*tokens: str) -> str:
    """K5 in SQL: a token's characters in order, each at its first place after the one before; runs, gaps, lateness and word starts."""
    parts, found = ["k0 AS (SELECT session_id, seq, lower(text) AS t, CAST(0 AS DOUBLE) AS score FROM conv)"], "k0"
    for n, token in enumerate(tokens):
        steps = [f"q{n}_0 AS (SELECT *, -1 AS p, 0 AS run, CAST(0 AS DOUBLE) AS own FROM {found})"]
        for k, c in enumerate(token, 1):
            steps.append(f"s{n}_{k} AS (SELECT * EXCLUDE (p), p AS before, CASE WHEN strpos(substr(t, p + 2), '{c}') > 0 THEN p + strpos(substr(t, p + 2), '{c}') END AS p FROM q{n}_{k - 1})")
            run = "CASE WHEN p - before = 1 THEN run + 1 ELSE 0 END"
            start = "CASE WHEN p = 0 OR regexp_matches(substr(t, p, 1), '[\\s\\-_./:]') THEN 10 ELSE 0 END"
            steps.append(f"q{n}_{k} AS (SELECT session_id, seq, t, score, p, {run} AS run, own + CASE WHEN {run} > 0 THEN -5 * {run} ELSE {2 if k > 1 else 0} * (p - before - 1) END + 0.1 * p - {start} AS own FROM s{n}_{k} WHERE p IS NOT NULL)")
        found = f"k{n + 1}"
        parts += [*steps, f"{found} AS (SELECT session_id, seq, t, score + own - CASE WHEN t = '{token}' THEN 100 ELSE 0 END AS score FROM q{n}_{len(token)})"]
    return f"{', '.join(parts)} SELECT session_id, seq, round(score, 6) AS score FROM {found}"


query("k5_fuzzy_score", "conv", sql=fuzzy_sql("thon", "and"))(lambda c: rounded(D.with_fuzzy_score(c.select("session_id", "seq", "text"), "thon/and").select("session_id", "seq", "score"), "score"))
query("f2_list_sessions", "conv", sql="SELECT session_id, session_id % 17 AS modified FROM conv GROUP BY 1")(lambda c: D.list_sessions(listing(c)).select("session_id", "modified"))
query("f3_most_recent_session", "conv", sql="s AS (SELECT DISTINCT session_id, session_id % 5 AS cwd, session_id % 17 AS modified FROM conv) SELECT cwd, session_id, modified FROM (SELECT *, row_number() OVER (PARTITION BY cwd ORDER BY modified DESC, session_id) AS n FROM s) WHERE n = 1")(lambda c: D.most_recent_session(c.select("session_id", (F.col("session_id") % 5).alias("cwd"), (F.col("session_id") % 17).alias("modified")).distinct()))
query("f7_user_messages", "conv", sql="SELECT session_id, seq, text FROM conv WHERE role = 'user' AND trim(text) != ''")(lambda c: D.user_messages(c).select("session_id", "seq", "text"))
query("f8_first_wins_dedup", "corpus", sql="r AS (SELECT doc_id, lang, md5(text) AS h, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM corpus) SELECT l.doc_id, w.doc_id AS winner FROM r l JOIN r w ON w.h = l.h AND w.n = 1 WHERE l.n > 1")(lambda c: D.first_wins_dedup(c.select("doc_id", F.md5("text").alias("h")), "h", [F.asc("doc_id")], "doc_id")[1].select("doc_id", "winner"))
query("b16_path_extension", "corpus", sql="SELECT doc_id, '.' || lower(lang) AS extension FROM corpus")(lambda c: c.select("doc_id", S.path_extension("path").alias("extension")))
query("b17_provider_model", "usage", sql="SELECT session_id, seq, provider || '/' || CASE WHEN seq % 2 = 0 THEN 'r' || model ELSE model END AS name FROM usage")(lambda u: u.select("session_id", "seq", S.provider_model("provider", "model", F.when(F.col("seq") % 2 == 0, F.concat(F.lit("r"), F.col("model")))).alias("name")))


def edit_pairs(c: DataFrame) -> DataFrame:
    return c.select("doc_id", F.col("text").alias("old"), F.concat(F.expr("left(text, 10)"), F.lit("¶"), F.expr("substring(text, 14)")).alias("new")).filter(F.length("old") > 20)


_PAIR = "e AS (SELECT doc_id, text AS o, left(text, 10) || '¶' || substr(text, 14) AS n FROM corpus WHERE length(text) > 20)"
query("b12_analyze_replacements", "corpus", sql=f"{_PAIR} SELECT doc_id, CAST(strlen(o) AS BIGINT) AS old_bytes, CAST(strlen(n) AS BIGINT) AS new_bytes, CAST(strlen(left(o, 10)) AS BIGINT) AS prefix_bytes, CAST(strlen(substr(o, 14)) AS BIGINT) AS suffix_bytes, CAST(strlen(substr(o, 11, 3)) + 2 AS BIGINT) AS core_bytes, CAST(strlen(o) + strlen(n) AS DOUBLE) / (strlen(substr(o, 11, 3)) + 2) AS inflation FROM e")(lambda c: A.analyze_replacements(edit_pairs(c)).select("doc_id", "old_bytes", "new_bytes", "prefix_bytes", "suffix_bytes", "core_bytes", "inflation"))
def document_edits(c: DataFrame) -> DataFrame:
    """For each document: two edits that overlap, one that it lacks, an empty one, a letter, one that is only found fuzzily (but in English), and one with CRLF."""
    piece = lambda at, n: F.substring("text", at, n)
    olds = [piece(11, 60), piece(51, 40), F.concat(F.lit("☃ none "), F.col("doc_id").cast("string")), F.lit(""), F.lit("e"), F.when(F.col("lang") != "en", F.replace(piece(101, 30), F.lit(" "), F.lit("\u00a0"))), F.replace(piece(201, 80), F.lit("\n"), F.lit("\r\n"))]
    return c.select("doc_id", F.posexplode(F.array(*olds)).alias("edit_no", "old"))


query(
    "d18_check_edits", "corpus",
    sql="e AS (SELECT doc_id, text, k AS edit_no, CASE k WHEN 0 THEN substr(text, 11, 60) WHEN 1 THEN substr(text, 51, 40) WHEN 2 THEN '☃ none ' || doc_id WHEN 3 THEN '' WHEN 4 THEN 'e' WHEN 5 THEN CASE WHEN lang != 'en' THEN replace(substr(text, 101, 30), ' ', chr(160)) END ELSE substr(text, 201, 80) END AS o FROM corpus, (SELECT unnest(range(7)) AS k)), "
    "f AS (SELECT *, regexp_replace(replace(o, chr(160), ' '), ' +(\n|$)', '\\1', 'g') AS l FROM e), "
    "m AS (SELECT *, strpos(text, o) AS a, CASE WHEN strpos(text, o) > 0 THEN strpos(text, o) ELSE strpos(text, l) END AS b, CASE WHEN strpos(text, o) > 0 THEN length(o) ELSE length(l) END AS n, (length(text) - length(replace(text, l, ''))) // length(l) AS times FROM f WHERE o != ''), "
    "g AS (SELECT *, bool_or(a = 0 AND b > 0) OVER (PARTITION BY doc_id) AS loose FROM m), "
    "s AS (SELECT doc_id, edit_no, times, n, CASE WHEN loose THEN b ELSE a END AS pos, CASE WHEN (CASE WHEN loose THEN b ELSE a END) = 0 THEN 'not_found' WHEN times > 1 THEN 'multiple' WHEN a > 0 THEN 'exact' ELSE 'fuzzy' END AS status FROM g), "
    "p AS (SELECT *, max(pos + n) FILTER (status IN ('exact', 'fuzzy')) OVER (PARTITION BY doc_id ORDER BY CASE WHEN status IN ('exact', 'fuzzy') THEN pos END NULLS FIRST, edit_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stop FROM s) "
    "SELECT doc_id, CAST(edit_no AS INTEGER) AS edit_no, status, CASE WHEN pos > 0 THEN pos - 1 END AS start, CASE WHEN pos > 0 THEN n END AS size, times AS occurrences, coalesce(status IN ('exact', 'fuzzy') AND pos < stop, false) AS overlaps FROM p UNION ALL SELECT doc_id, edit_no, 'empty', NULL, NULL, 0, false FROM e WHERE coalesce(o, '') = ''",
)(lambda c: E.check_edits(document_edits(c), c).drop("old"))

# catalog --------------------------------------------------------------------------------------------------------------

query("b20_normalize_catalog_prices", "catalog", sql="SELECT provider, model, round(input_rate / 1e8 * 1000000, 6) AS input, CASE WHEN p_partkey % 3 = 0 THEN 4096 ELSE context_window END AS context_window, CASE WHEN p_partkey % 2 = 0 THEN 'text,image' ELSE 'text' END AS modalities FROM catalog WHERE p_partkey % 5 != 0")(
    lambda k: K.normalize_catalog_prices(k.withColumns({"input": F.col("input_rate") / 1e8, "tools": F.col("p_partkey") % 5 != 0, "context_window": F.when(F.col("p_partkey") % 3 != 0, F.col("context_window")), "modalities": F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("image")))})).select("provider", "model", "input", "context_window", F.array_join("modalities", ",").alias("modalities"))
)
query("b21_long_context_tiers", "catalog", sql="SELECT provider, model, 200000 AS above, 2.0 * input_rate AS input, 1.5 * input_rate AS output FROM catalog")(lambda k: K.long_context_tiers(k.withColumns({"input": F.col("input_rate"), "output": F.col("input_rate")}), 200_000).select("provider", "model", F.col("tiers")[0]["above"].alias("above"), F.col("tiers")[0]["input"].alias("input"), F.col("tiers")[0]["output"].alias("output")))
query("d14_diff_catalogs", "catalog", sql="SELECT provider, model, CASE WHEN p_partkey % 7 = 0 THEN 'removed' WHEN p_partkey % 11 = 0 THEN 'added' ELSE 'changed' END AS change FROM catalog WHERE (p_partkey % 7 = 0) != (p_partkey % 11 = 0) OR (p_partkey % 13 = 0 AND p_partkey % 7 != 0 AND p_partkey % 11 != 0)")(
    lambda k: K.diff_catalogs(k.filter("p_partkey % 11 != 0"), k.filter("p_partkey % 7 != 0").withColumn("input_rate", F.when(F.col("p_partkey") % 13 == 0, F.col("input_rate") + 1).otherwise(F.col("input_rate"))))
)
query("d15_overlay_catalog", "catalog", sql="SELECT provider, model, CASE WHEN p_partkey % 2 = 0 THEN 7 ELSE input_rate END AS input_rate, context_window FROM catalog")(lambda k: K.overlay_catalog(k.select("provider", "model", "input_rate", "context_window"), k.filter("p_partkey % 2 = 0").select("provider", "model", F.lit(7).cast("long").alias("input_rate"))))


def shared_catalog(k: DataFrame) -> DataFrame:
    """The models; every third of a second provider too, and every fifth in a dated version."""
    second = k.filter("p_partkey % 3 = 0").select(F.lit("Brand#99").alias("provider"), "model")
    dated = k.filter("p_partkey % 5 = 0").select("provider", F.concat("model", F.lit("-20250101")).alias("model"))
    return k.select("provider", "model").unionByName(second).unionByName(dated)


def refs_of(k: DataFrame) -> DataFrame:
    """Every model by its full name, with blanks, levels, unknown levels; by its id; by parts of it, long and short; by globs; names that no model has; providers."""
    tens, key = F.floor(F.col("p_partkey") / 10).cast("string"), F.col("p_partkey").cast("string")
    full = F.concat_ws("/", "provider", "model")
    refs = [
        F.concat(full, F.lit(":high")), F.upper(full), F.concat(F.lit(" "), F.col("provider"), F.lit(" / "), F.col("model"), F.lit(" ")), F.concat(full, F.lit(":odd:low")), F.concat(F.col("model"), F.lit(":low:odd")), F.concat(F.col("model"), F.lit(":low:high")),
        F.col("model"), F.substring("model", 3, 5), F.substring("model", 2, 1), F.substring("model", 1, 3), F.lit(""), F.col("provider"), F.lower("provider"), F.concat(F.lit("*-"), tens, F.lit("?")), F.concat(F.lit("nothing-"), key), F.concat(F.lit("[a-z]*-"), tens, F.lit("7:max")), F.concat("provider", F.lit("/*9")),
    ]
    return k.select(F.explode(F.array(*refs)).alias("ref"))


query(
    "d16_resolve_model_refs", "catalog",
    sql="k AS (SELECT provider, model FROM catalog UNION SELECT 'Brand#99', model FROM catalog WHERE p_partkey % 3 = 0 UNION SELECT provider, model || '-20250101' FROM catalog WHERE p_partkey % 5 = 0), "
    "n AS (SELECT *, lower(model) AS id, lower(provider || '/' || model) AS f, NOT regexp_matches(model, '-[0-9]{8}$') AS undated FROM k), "
    "r AS (SELECT DISTINCT unnest([p || '/' || m || ':high', upper(p || '/' || m), ' ' || p || ' / ' || m || ' ', p || '/' || m || ':odd:low', m || ':low:odd', m || ':low:high', m, substr(m, 3, 5), substr(m, 2, 1), substr(m, 1, 3), '', p, lower(p), '*-' || t || '?', 'nothing-' || p_partkey, '[a-z]*-' || t || '7:max', p || '/*9']) AS ref FROM (SELECT provider AS p, model AS m, p_partkey // 10 AS t, p_partkey FROM catalog)), "
    "g AS (SELECT ref, CASE WHEN ref LIKE '%:max' THEN 'max' END AS level, lower(regexp_replace(ref, ':max$', '')) AS p FROM r WHERE regexp_matches(ref, '[*?]')), "
    "gm AS (SELECT ref, level, provider, model FROM g JOIN n ON f GLOB p OR id GLOB p), "
    "a AS (SELECT ref, i, array_to_string(s[1:len(s) - i], ':') AS t, s[len(s) - i + 1:] AS taken, s[-1] AS last FROM (SELECT ref, string_split(ref, ':') AS s, unnest(range(len(string_split(ref, ':')))) AS i FROM r WHERE NOT regexp_matches(ref, '[*?]'))), "
    "b AS (SELECT *, trim(lower(t)) AS w, trim(split_part(trim(lower(t)), '/', 1)) || '/' || trim(substr(trim(lower(t)), strpos(trim(lower(t)), '/') + 1)) AS w2, len(list_filter(taken, lambda x: x NOT IN ('off', 'minimal', 'low', 'medium', 'high', 'xhigh', 'max'))) > 0 AS odd FROM a), "
    "nf AS (SELECT f, count(*) AS c, any_value(provider) AS p, any_value(model) AS m FROM n GROUP BY f), ni AS (SELECT id, count(*) AS c, any_value(provider) AS p, any_value(model) AS m FROM n GROUP BY id), "
    "x AS (SELECT ref, i, CASE WHEN u.c IS NOT NULL THEN CASE WHEN u.c = 1 THEN u.p END WHEN v.c IS NOT NULL THEN CASE WHEN v.c = 1 THEN v.p END WHEN q.c = 1 THEN q.p END AS provider, CASE WHEN u.c IS NOT NULL THEN u.m WHEN v.c IS NOT NULL THEN v.m ELSE q.m END AS model FROM b LEFT JOIN nf u ON u.f = w LEFT JOIN nf v ON v.f = w2 AND strpos(w, '/') > 0 LEFT JOIN ni q ON q.id = w), "
    "todo AS (SELECT DISTINCT lower(t) AS t FROM b JOIN x USING (ref, i) WHERE x.provider IS NULL), "
    "c AS (SELECT t, provider, model, row_number() OVER (PARTITION BY t ORDER BY undated DESC, model DESC, provider) AS k FROM todo JOIN n ON contains(id, t)), "
    "h AS (SELECT ref, i, provider, model, 'exact' AS how FROM x WHERE provider IS NOT NULL UNION ALL SELECT ref, i, c.provider, c.model, 'contains' FROM b JOIN x USING (ref, i) JOIN c ON c.t = lower(b.t) AND c.k = 1 WHERE x.provider IS NULL), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY i) AS k FROM h JOIN b USING (ref, i)) "
    "SELECT ref, CASE WHEN i > 0 AND NOT odd THEN last END AS level, provider, model, how, odd AS unknown_level FROM o WHERE k = 1 UNION ALL SELECT ref, level, provider, model, 'glob', false FROM gm "
    "UNION ALL SELECT ref, CASE WHEN ref LIKE '%:max' THEN 'max' END, NULL, NULL, 'none', false FROM r WHERE ref NOT IN (SELECT ref FROM gm) AND ref NOT IN (SELECT ref FROM o)",
)(lambda k: K.resolve_model_refs(refs_of(k), shared_catalog(k)))
query("e22_validate_catalog", "catalog", sql="m AS (SELECT * FROM catalog WHERE p_partkey % 3 != 0 AND provider != 'Brand#11'), pr AS (SELECT DISTINCT provider FROM catalog WHERE provider != 'Brand#12') SELECT 'provider_without_models' AS rule, provider, '' AS detail FROM pr WHERE provider NOT IN (SELECT provider FROM m) UNION ALL SELECT DISTINCT 'unlisted_provider', provider, '' FROM m WHERE provider NOT IN (SELECT provider FROM pr) UNION ALL SELECT 'too_few_models', NULL, CAST(count(*) AS VARCHAR) FROM m HAVING count(*) < 1000000")(
    lambda k: K.validate_catalog(k.filter("p_partkey % 3 != 0 AND provider != 'Brand#11'"), k.filter("provider != 'Brand#12'").select("provider").distinct(), least=1_000_000)
)
query("h2_union_catalogs", "catalog", sql="SELECT provider, model, CASE WHEN p_partkey % 2 = 0 THEN input_rate ELSE input_rate + 1 END AS input_rate FROM catalog WHERE p_partkey % 9 != 0")(
    lambda k: K.union_catalogs([k.filter("p_partkey % 2 = 0").select("provider", "model", "input_rate"), k.select("provider", "model", (F.col("input_rate") + 1).alias("input_rate"))], "first", k.filter("p_partkey % 9 = 0").select("provider", "model"))
)

# windows of time ------------------------------------------------------------------------------------------------------

query("j10_windowed_usage", "usage", sql=f"SELECT CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS start_s, provider, count(*) AS requests, {TOKEN_SUMS}, {sums('cost_micro')} FROM usage GROUP BY 1, 2")(lambda u: live.windowed_usage(u.withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("start_s", F.unix_seconds("start")).drop("start", "end"))

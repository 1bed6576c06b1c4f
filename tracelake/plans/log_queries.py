"""Registered queries that write session logs out of the given tables, read them back, and report; and queries of scalars and hooks.

The lines of a log are the view ``loglines``: DuckDB reads their JSON itself, so the SQL says what readers and reports must find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import scalars as S
from tracelake.functions.storage import exists, new_path, written
from tracelake.operators import context as C
from tracelake.operators import corpus as D
from tracelake.operators import tools as A
from tracelake.operators import usage as U
from tracelake.plans import hooks
from tracelake.plans.registry import query
from tracelake.sources import logs as L

_WRITTEN: dict[tuple[str, str], str] = {}


def folder_of(lines: DataFrame) -> str:
    """The folder of the log files made of ``loglines``; written once for a session and input."""
    spark = lines.sparkSession
    key = (spark.sparkContext.applicationId, ",".join(sorted(lines.inputFiles())))
    if key not in _WRITTEN or not exists(spark, _WRITTEN[key]):
        _WRITTEN[key] = new_path(spark, "logs")
        L.write_lines(lines.select(F.col("file_name").alias("name"), F.col("line_no").alias("pos"), F.col("line").alias("value")), _WRITTEN[key])
    return _WRITTEN[key]


def sessions_of(lines: DataFrame) -> DataFrame:
    return L.read_session_logs(lines.sparkSession, folder_of(lines))[0]


def entries_of(lines: DataFrame) -> DataFrame:
    return L.read_session_logs(lines.sparkSession, folder_of(lines))[1]


def raw_lines(lines: DataFrame) -> DataFrame:
    return L.read_lines(lines.sparkSession, folder_of(lines))


# readers --------------------------------------------------------------------------------------------------------------

_OK = (
    "ok AS (SELECT *, CASE WHEN json_valid(line) THEN json_type(line) = 'OBJECT' ELSE false END AS good FROM loglines), f AS (SELECT session_id, file_name, min(line_no) AS head_no, arg_min(line, line_no) AS head FROM ok WHERE good GROUP BY 1, 2), "
    "inc AS (SELECT *, json_extract_string(head, '$.id') AS sid FROM f WHERE json_extract_string(head, '$.type') = 'session' AND json_extract_string(head, '$.id') IS NOT NULL)"
)
_ENT = f"{_OK}, ent AS (SELECT sid, CAST(row_number() OVER (PARTITION BY sid ORDER BY line_no) AS INTEGER) AS entry_seq, line FROM ok JOIN inc USING (session_id) WHERE good AND line_no > head_no), e AS (SELECT sid AS session_id, entry_seq, line, json_extract_string(line, '$.type') AS type, json_extract_string(line, '$.message.role') AS role FROM ent)"
query("a1_read_session_logs", "loglines", sql=f"{_ENT} SELECT session_id, entry_seq, json_extract_string(line, '$.id') AS entry_id, json_extract_string(line, '$.parentId') AS parent_id, type, CAST(json_extract_string(line, '$.timestamp') AS VARCHAR) AS entry_ts FROM e")(
    lambda n: entries_of(n).select("session_id", "entry_seq", "entry_id", "parent_id", "type", F.date_format("entry_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("entry_ts"))
)
query("a1_read_sessions", "loglines", sql=f"{_OK} SELECT sid AS session_id, CAST(json_extract_string(head, '$.version') AS INTEGER) AS version, json_extract_string(head, '$.cwd') AS cwd, json_extract_string(head, '$.timestamp') AS created FROM inc")(
    lambda n: sessions_of(n).select("session_id", "version", "cwd", F.date_format("created_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created"))
)
query("a2_read_session_headers", "loglines", sql=f"{_OK} SELECT sid AS session_id, json_extract_string(head, '$.cwd') AS cwd FROM inc")(lambda n: L.read_session_headers(n.sparkSession, folder_of(n)).select("session_id", "cwd"))
_KINDS = ", ".join(f"'{k}'" for k in L.KINDS)
_RULES = (
    "v AS (SELECT *, CASE WHEN good THEN line END AS j, row_number() OVER (PARTITION BY file_name ORDER BY line_no) AS n FROM ok WHERE trim(line) != ''), w AS (SELECT *, CASE WHEN NOT json_valid(line) THEN 'not JSON' WHEN NOT good THEN 'not an object' WHEN n = 1 THEN CASE WHEN json_extract_string(j, '$.type') != 'session' THEN 'first line is not a session header' WHEN json_extract_string(j, '$.version') IS DISTINCT FROM '3' THEN 'unsupported version' WHEN json_extract_string(j, '$.cwd') IS NULL THEN 'header has no cwd' END "
    f"WHEN json_extract_string(j, '$.type') NOT IN ({_KINDS}) THEN 'unknown entry type' WHEN json_extract_string(j, '$.id') IS NULL THEN 'entry has no id' WHEN NOT json_exists(j, '$.parentId') THEN 'entry has no parentId' END AS reason FROM v)"
)
query("a3_validate_session_logs", "loglines", sql=f"{_OK}, {_RULES}, x AS (SELECT *, coalesce(reason, CASE WHEN count(reason) OVER (PARTITION BY file_name ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 THEN 'after a rejected line' END) AS r FROM w) SELECT file_name, CAST(line_no AS BIGINT) AS line_no, r AS reason FROM x WHERE r IS NOT NULL")(
    lambda n: L.validate_session_logs(raw_lines(n))[1].select(F.element_at(F.split("file_path", "/"), -1).alias("file_name"), F.col("line_no").cast("long").alias("line_no"), "reason")
)
query("a3_validate_lenient", "loglines", sql=f"{_OK}, {_RULES} SELECT file_name, count(*) AS good FROM w WHERE reason IS NULL GROUP BY 1")(
    lambda n: L.validate_session_logs(raw_lines(n), "lenient")[0].groupBy("file_name").agg(F.count("*").alias("good"))
)
query("a4_malformed_line_report", "loglines", sql=f"{_OK} SELECT count(DISTINCT file_name) AS files, (SELECT count(*) FROM inc) AS included, count(DISTINCT file_name) - (SELECT count(*) FROM inc) AS skipped, count(*) AS lines, count(*) FILTER (trim(line) = '') AS blank_lines, count(*) FILTER (trim(line) != '' AND NOT good) AS malformed_lines FROM ok")(
    lambda n: L.malformed_line_report(raw_lines(n))
)
query("a5_with_file_timestamp", "loglines", sql="SELECT file_name, CAST(floor(epoch(min(ts))) AS BIGINT) AS file_s, count(*) AS lines FROM loglines GROUP BY 1 HAVING floor(epoch(min(ts))) >= epoch(TIMESTAMP '2024-01-01 08:00:00')")(
    lambda n: L.read_lines(n.sparkSession, folder_of(n), since="2024-01-01 08:00:00").groupBy("file_name").agg(F.unix_seconds(F.first("file_ts")).alias("file_s"), F.count("*").alias("lines"))
)
query("a6_cwd_to_dir", "loglines", sql=f"{_OK} SELECT sid AS session_id, '--' || regexp_replace(regexp_replace(json_extract_string(head, '$.cwd'), '^[/\\\\]', ''), '[/\\\\:]', '-', 'g') || '--' AS dir FROM inc")(lambda n: sessions_of(n).select("session_id", L.cwd_to_dir("cwd").alias("dir")))


def catalog_files(k: DataFrame) -> str:
    """Catalog files, one for each provider."""
    record = F.to_json(F.struct(F.concat(F.lit("N"), "model").alias("name"), F.lit("messages").alias("api"), (F.col("p_partkey") % 2 == 0).alias("reasoning"), F.col("context_window").alias("contextWindow"), F.struct(F.col("input_rate").cast("double").alias("input")).alias("cost")))
    one = k.groupBy("provider").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("model", F.from_json(record, "name string, api string, reasoning boolean, contextWindow bigint, cost struct<input:double>"))))).alias("m"))
    path = new_path(k.sparkSession, "catalogs")
    L.write_lines(one.select(F.concat(F.regexp_replace("provider", "[^A-Za-z0-9]", "-"), F.lit(".json")).alias("name"), F.lit(0).alias("pos"), F.concat(F.lit('{"'), "provider", F.lit('":'), "m", F.lit("}")).alias("value")), path)
    return path


query("a7_read_model_catalog", "catalog", sql="SELECT provider, model, 'N' || model AS name, 'messages' AS api, p_partkey % 2 = 0 AS reasoning, CAST(context_window AS BIGINT) AS context_window, CAST(input_rate AS DOUBLE) AS input FROM catalog")(
    lambda k: L.read_model_catalog(k.sparkSession, catalog_files(k)).select("provider", "model", "name", "api", "reasoning", "context_window", F.col("cost.input").alias("input"))
)


def session_tables(n: DataFrame) -> tuple:
    spark, path = n.sparkSession, new_path(n.sparkSession, "session-tables")
    L.write_session_tables(*L.read_session_logs(spark, folder_of(n)), path)
    return spark, path


def table_counts(n: DataFrame) -> DataFrame:
    spark, path = session_tables(n)
    dirs = spark.read.parquet(f"{path}/entries").groupBy("session_id").agg(F.first("cwd_dir").alias("cwd_dir"), F.count("*").alias("rows"))
    return L.SessionTables(spark, path).table("session_state").join(dirs, "session_id").select("session_id", "cwd_dir", "rows", "entries", F.col("last_seq").cast("long").alias("last_seq"))


query("a9_write_session_tables", "loglines", sql=f"{_ENT} SELECT e.session_id, '--w-' || CAST(any_value(inc.session_id) % 7 AS VARCHAR) || '--' AS cwd_dir, count(*) AS rows, count(*) AS entries, CAST(max(entry_seq) AS BIGINT) AS last_seq FROM e JOIN inc ON inc.sid = e.session_id GROUP BY 1")(table_counts)
_BRANCH = f"{_ENT}, t AS (SELECT c.session_id, c.entry_seq AS seq, p.entry_seq AS parent_seq, c.type FROM e c LEFT JOIN e p ON p.session_id = c.session_id AND json_extract_string(p.line, '$.id') = json_extract_string(c.line, '$.parentId')), b AS (SELECT session_id, max(seq) AS seq, 0 AS d FROM t GROUP BY 1 UNION ALL SELECT b.session_id, t.parent_seq, d + 1 FROM b JOIN t ON t.session_id = b.session_id AND t.seq = b.seq WHERE t.parent_seq IS NOT NULL)"


def exported(n: DataFrame) -> DataFrame:
    path = new_path(n.sparkSession, "branches")
    L.export_branch_jsonl(L.as_tree(entries_of(n)), path)
    back = L.read_lines(n.sparkSession, path)
    back = back.filter(L.get("$.type") != "session").select(F.regexp_replace("file_name", r"\.jsonl$", "").alias("session_id"), L.get("$.seq", "int").alias("seq"), L.get("$.parent_seq", "int").alias("parent_seq"), L.get("$.type").alias("type"))
    with L.many_small_files(n.sparkSession):
        return written(back, "exported")


query("a10_export_branch_jsonl", "loglines", sql=f"{_BRANCH}, k AS (SELECT b.session_id, b.seq, t.type, d FROM b JOIN t USING (session_id, seq)) SELECT session_id, seq, lag(seq) OVER (PARTITION BY session_id ORDER BY d DESC) AS parent_seq, type FROM k")(exported)


def transcript_files(c: DataFrame) -> DataFrame:
    chunks = written(C.transcript(c), "transcript-chunks")
    # a transcript's size is that of its chunks and the line feeds between them
    sizes = chunks.groupBy(F.col("session_id").alias("seq")).agg((F.sum(S.utf16_length("text")) + F.count("*") - 1).alias("size")).withColumn("cwd", (F.col("seq") % 4).cast("string"))
    bins = hooks.pack_transcripts(sizes, 4000).select(F.col("seq").alias("session_id"), F.concat_ws("-", "cwd", "bin").alias("bin"))
    packed = chunks.join(bins, "session_id").select("bin", F.struct("session_id", "chunk").alias("pos"), "text")
    path = new_path(c.sparkSession, "transcripts")
    L.write_transcripts(packed, path)
    return c.sparkSession.read.text(path).groupBy("value").agg(F.count("*").alias("lines"))


_TRANSCRIPTS = "t AS (SELECT session_id, '=== SESSION: ' || CAST(session_id AS VARCHAR) || ' ===' || chr(10) || string_agg('[' || upper(role) || ']' || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY seq) || chr(10) || '=== END SESSION ===' AS text FROM conv WHERE role IN ('user', 'assistant') AND trim(text) != '' GROUP BY session_id)"
query("a11_write_transcripts", "conv", sql=f"{_TRANSCRIPTS} SELECT value, count(*) AS lines FROM (SELECT unnest(string_split(text, chr(10))) AS value FROM t) GROUP BY 1")(transcript_files)


def report_file(u: DataFrame) -> DataFrame:
    path, spark = new_path(u.sparkSession, "report"), u.sparkSession
    L.write_report_json({"cost": U.usage_cost_breakdown(u), "days": U.usage_by_day_provider(u).filter("level = 0").groupBy("provider").agg(F.count("*").alias("days"))}, path)
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "cost array<struct<model:string,cost_micro:bigint,tokens:bigint>>, days array<struct<provider:string,days:bigint>>").alias("d"))
    return doc.select(F.explode("d.cost").alias("c")).select("c.model", "c.cost_micro", "c.tokens").unionByName(doc.select(F.explode("d.days").alias("x")).select(F.col("x.provider").alias("model"), F.col("x.days").alias("cost_micro"), F.lit(None).cast("long").alias("tokens")))


query("a12_write_report_json", "usage", sql="SELECT CASE WHEN type = 'message' THEN provider || '/' || model ELSE '[summaries and tools]' END AS model, CAST(sum(cost_micro) AS BIGINT) AS cost_micro, CAST(sum(input + output + cache_read + cache_write) AS BIGINT) AS tokens FROM usage GROUP BY 1 HAVING sum(cost_micro) > 0 OR sum(input + output + cache_read + cache_write) > 0 UNION ALL SELECT provider, count(DISTINCT CAST(ts AS DATE)), NULL FROM usage GROUP BY provider")(report_file)

# logs to reports ------------------------------------------------------------------------------------------------------

_USE = f"{_ENT}, u AS (SELECT session_id, entry_seq AS seq, to_timestamp(CAST(json_extract_string(line, '$.message.timestamp') AS BIGINT) / 1000) AS ts, json_extract_string(line, '$.message.provider') AS provider, json_extract_string(line, '$.message.model') AS model, type, json_extract_string(line, '$.message.stopReason') AS stop_reason, {', '.join(f'''CAST(coalesce(json_extract_string(line, '$.message.usage.{k}'), '0') AS BIGINT) AS {n}''' for n, k in (('input', 'input'), ('output', 'output'), ('cache_read', 'cacheRead'), ('cache_write', 'cacheWrite')))}, CAST(round(CAST(json_extract_string(line, '$.message.usage.cost.total') AS DOUBLE) * 1e6) AS BIGINT) AS cost_micro FROM e WHERE type = 'compaction' OR (type = 'message' AND role = 'assistant' AND json_exists(line, '$.message.usage')))"
query("logs_usage", "loglines", sql=f"{_USE} SELECT session_id, seq, provider, model, type, stop_reason, input, output, cache_read, cache_write, cost_micro FROM u")(lambda n: L.usage_of(entries_of(n)).drop("ts", "error_message"))
query("logs_cost_by_day_provider", "loglines", sql=f"{_USE}, d AS (SELECT *, CAST(CAST(ts AT TIME ZONE 'UTC' AS DATE) AS VARCHAR) AS day FROM u WHERE cost_micro IS NOT NULL) SELECT day, provider, CAST(sum(cost_micro) AS BIGINT) AS cost_micro, count(*) AS requests, CAST(GROUPING(day, provider) AS BIGINT) AS level FROM d GROUP BY CUBE (day, provider)")(
    lambda n: U.cost_by_day_provider(L.usage_of(entries_of(n)))
)
query("logs_session_stats", "loglines", sql=f"{_USE} SELECT session_id, count(*) FILTER (type = 'message') AS messages, count(*) FILTER (stop_reason = 'error') AS errors, count(*) FILTER (type = 'compaction') AS compactions, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write, CAST(coalesce(sum(cost_micro), 0) AS BIGINT) AS cost_micro FROM u GROUP BY 1")(
    lambda n: U.session_stats(L.usage_of(entries_of(n)))
)
_CALL = f"{_ENT}, c AS (SELECT session_id, entry_seq AS assistant_seq, json_extract_string(line, '$.message.content[1].id') AS call_id, json_extract_string(line, '$.message.content[1].name') AS tool, json_extract_string(line, '$.message.content[1].arguments.path') AS path, json_extract_string(line, '$.message.content[1].arguments.command') AS command FROM e WHERE role = 'assistant' AND json_extract_string(line, '$.message.content[1].type') = 'toolCall'), r AS (SELECT session_id, entry_seq AS seq, json_extract_string(line, '$.message.toolCallId') AS call_id, json_extract_string(line, '$.message.isError') = 'true' AS is_error, CAST(ceil(length(json_extract_string(line, '$.message.content[0].text')) / 4.0) AS BIGINT) AS tokens FROM e WHERE role = 'toolResult')"
query("logs_calls", "loglines", sql=f"{_CALL} SELECT session_id, assistant_seq, call_id, tool, path, command FROM c")(lambda n: L.calls_of(entries_of(n)).select("session_id", "assistant_seq", "call_id", "tool", "path", "command"))
query("logs_results", "loglines", sql=f"{_CALL} SELECT session_id, seq, call_id, is_error, tokens FROM r")(lambda n: L.results_of(entries_of(n)).drop("text"))


def tool_report(n: DataFrame) -> DataFrame:
    entries = entries_of(n)
    return A.tool_stats(L.calls_of(entries), L.results_of(entries))


query("logs_tool_stats", "loglines", sql=f"{_CALL} SELECT tool, count(*) AS calls, count(is_error) AS results, count(*) FILTER (is_error) AS errors, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, CAST(sum(tokens) AS DOUBLE) / nullif(count(is_error), 0) AS mean_tokens FROM c LEFT JOIN r USING (session_id, call_id) GROUP BY tool")(tool_report)


def bash_report(n: DataFrame) -> DataFrame:
    entries = entries_of(n)
    return A.bash_stats(L.calls_of(entries).filter("tool = 'bash'"), L.results_of(entries))


query("logs_bash_stats", "loglines", sql=f"{_CALL} SELECT command[:-4] AS tool, count(*) AS calls, count(is_error) AS results, count(*) FILTER (is_error) AS errors, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, CAST(sum(tokens) AS DOUBLE) / nullif(count(is_error), 0) AS mean_tokens FROM c LEFT JOIN r USING (session_id, call_id) WHERE tool = 'bash' GROUP BY command ORDER BY 5 DESC, 1 LIMIT 50")(bash_report)

# content --------------------------------------------------------------------------------------------------------------

_BLOCKS = f"{_ENT}, m AS (SELECT *, CASE WHEN json_type(line, '$.message.content') = 'ARRAY' THEN json_array_length(line, '$.message.content') ELSE 1 END AS n FROM e WHERE type = 'message'), x AS (SELECT *, unnest(range(0, CAST(n AS BIGINT))) AS k FROM m)"
_AT = "CASE WHEN json_type(line, '$.message.content') = 'ARRAY' THEN json_extract_string(line, '$.message.content[' || CAST(k AS VARCHAR) || '].{0}') ELSE {1} END"
query("b3_flatten_messages", "loglines", sql=f"{_ENT} SELECT session_id, entry_seq, role, json_extract_string(line, '$.message.provider') AS provider, json_extract_string(line, '$.message.stopReason') AS stop_reason, CAST(json_extract_string(line, '$.message.usage.totalTokens') AS BIGINT) AS total, CASE WHEN json_type(line, '$.message.content') = 'ARRAY' THEN CAST(json_array_length(line, '$.message.content') AS INTEGER) ELSE 1 END AS blocks FROM e WHERE type = 'message'")(
    lambda n: L.flatten_messages(entries_of(n)).select("session_id", "entry_seq", "role", "provider", "stop_reason", F.col("usage.totalTokens").alias("total"), F.size("content").alias("blocks"))
)
query("b3_explode_blocks", "loglines", sql=f"{_BLOCKS} SELECT session_id, entry_seq, role, CAST(k AS INTEGER) AS pos, {_AT.format('type', chr(39) + 'text' + chr(39))} AS type, {_AT.format('text', chr(39) + chr(39) + ' || json_extract_string(line, ' + chr(39) + '$.message.content' + chr(39) + ')')} AS text, {_AT.format('name', 'NULL')} AS name FROM x")(
    lambda n: L.explode_blocks(L.flatten_messages(entries_of(n))).select("session_id", "entry_seq", "role", "pos", "type", "text", "name")
)
query("b4_content_text", "loglines", sql=f"{_ENT} SELECT session_id, entry_seq, CASE WHEN json_type(line, '$.message.content') = 'ARRAY' THEN coalesce(json_extract_string(line, '$.message.content[0].text'), '') ELSE json_extract_string(line, '$.message.content') END AS text FROM e WHERE type = 'message'")(
    lambda n: L.flatten_messages(entries_of(n)).select("session_id", "entry_seq", S.content_text("content").alias("text"))
)


def harness_rows(t: DataFrame) -> DataFrame:
    tail = F.when(F.col("type") == "compaction", F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("t"), F.col("seq").cast("string")).alias("text")), F.struct(F.lit("assistant").alias("role"), F.lit("done").alias("text"))))
    rows = t.withColumns({"type": F.when(F.col("type") == "label", "custom").otherwise(F.col("type")), "custom_type": F.lit("note"), "role": F.lit("user"), "summary": F.lit("sum"), "text": F.when(F.col("type") == "message", F.col("c").cast("string")), "retained_tail": tail})
    return C.entries_to_context_harness(rows, {"note": lambda e: e.select("session_id", "seq", F.lit("custom").alias("role"), F.concat(F.lit("n"), F.col("c").cast("string")).alias("text"))})


query("b6_entries_to_context_harness", "tree", sql="SELECT session_id, seq, 0 AS part, 'user' AS role, CAST(c AS VARCHAR) AS text FROM tree WHERE type = 'message' UNION ALL SELECT session_id, seq, 0, 'compactionSummary', 'sum' FROM tree WHERE type = 'compaction' UNION ALL SELECT session_id, seq, 1, 'user', 't' || CAST(seq AS VARCHAR) FROM tree WHERE type = 'compaction' UNION ALL SELECT session_id, seq, 2, 'assistant', 'done' FROM tree WHERE type = 'compaction' UNION ALL SELECT session_id, seq, 0, 'custom', 'n' || CAST(c AS VARCHAR) FROM tree WHERE type = 'label'")(harness_rows)


def shell_rows(e: DataFrame) -> DataFrame:
    n = F.col("event_id")
    return C.to_llm_messages(e.withColumns({
        "role": F.when(n % 4 == 0, "bashExecution").when(n % 4 == 1, "compactionSummary").when(n % 4 == 2, "branchSummary").otherwise("assistant"), "text": F.col("event_type"), "summary": F.concat(F.lit("s"), F.col("c").cast("string")),
        "command": F.lit("ls"), "output": F.when(n % 3 == 0, "out"), "exit_code": F.when(n % 5 == 0, 2).otherwise(0), "cancelled": n % 7 == 0, "truncated": n % 8 == 0, "full_output_path": F.lit("/t"), "exclude_from_context": n % 20 == 0,
    })).select("session_id", "seq", "role", "text")


query(
    "b7_to_llm_messages", "ev",
    sql="SELECT session_id, seq, CASE WHEN event_id % 4 = 3 THEN 'assistant' ELSE 'user' END AS role, CASE event_id % 4 WHEN 0 THEN 'Ran `ls`' || chr(10) || CASE WHEN event_id % 3 = 0 THEN '```' || chr(10) || 'out' || chr(10) || '```' ELSE '(no output)' END || CASE WHEN event_id % 7 = 0 THEN chr(10) || chr(10) || '(command cancelled)' WHEN event_id % 5 = 0 THEN chr(10) || chr(10) || 'Command exited with code 2' ELSE '' END || CASE WHEN event_id % 8 = 0 THEN chr(10) || chr(10) || '[Output truncated. Full output: /t]' ELSE '' END "
    "WHEN 1 THEN 'The conversation history before this point was compacted into the following summary:' || chr(10) || chr(10) || '<summary>' || chr(10) || 's' || CAST(c AS VARCHAR) || chr(10) || '</summary>' WHEN 2 THEN 'The following is a summary of a branch that this conversation came back from:' || chr(10) || chr(10) || '<summary>' || chr(10) || 's' || CAST(c AS VARCHAR) || '</summary>' ELSE event_type END AS text FROM ev WHERE event_id % 20 != 0",
)(shell_rows)


def foreign_rows(e: DataFrame) -> DataFrame:
    n = F.col("event_id")
    block = lambda kind, text=None, thinking=None, redacted=False, signature=None: F.struct(F.lit(kind).alias("type"), F.lit(text).cast("string").alias("text"), F.lit(thinking).cast("string").alias("thinking"), F.lit(redacted).alias("redacted"), F.lit(signature).cast("string").alias("signature"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"))
    said = F.array(block("thinking", thinking="hm", signature="z"), block("thinking", thinking=" "), block("thinking", redacted=True, signature="r"), block("text", text="hi", signature="q"))
    asked = F.array(block("image"), block("image"), block("text", text="see"), block("image"))
    rows = e.withColumns({"provider": F.col("event_type"), "api": F.lit("a"), "model": F.lit("m"), "role": F.when(n % 3 == 0, "user").when(n % 3 == 1, "toolResult").otherwise("assistant"), "stop_reason": F.when(n % 5 == 0, "aborted").otherwise("stop")})
    rows = rows.withColumn("content", F.when(F.col("role") == "assistant", said).otherwise(asked))
    out = C.normalize_for_model(rows, "click", "a", "m", images=False)
    shown = F.transform("content", lambda b: F.concat_ws("/", b["type"], F.coalesce(b["text"], b["thinking"], F.lit("-")), F.coalesce(b["signature"], F.lit("-"))))
    return out.select("session_id", "seq", F.array_join(shown, ",").alias("content"))


query("b8_normalize_for_model", "ev", sql="SELECT session_id, seq, CASE event_id % 3 WHEN 0 THEN 'text/(image omitted: model does not support images)/-,text/see/-,text/(image omitted: model does not support images)/-' WHEN 1 THEN 'text/(tool image omitted: model does not support images)/-,text/see/-,text/(tool image omitted: model does not support images)/-' ELSE CASE WHEN event_type = 'click' THEN 'thinking/hm/z,thinking/-/r,text/hi/q' ELSE 'text/hm/-,text/hi/-' END END AS content FROM ev WHERE NOT (event_id % 3 = 2 AND event_id % 5 = 0)")(foreign_rows)
_APIS = "CASE event_id % 6 WHEN 0 THEN 'openai-completions' WHEN 1 THEN 'openai-responses' WHEN 2 THEN 'google' WHEN 3 THEN 'anthropic' WHEN 4 THEN 'bedrock' ELSE 'mistral' END"
_PAYLOAD = (
    "CASE event_id % 6 WHEN 0 THEN concat('{\"prompt_tokens\":', p, ',\"completion_tokens\":', o, ',\"prompt_tokens_details\":{\"cached_tokens\":', h, '}}') WHEN 1 THEN concat('{\"input_tokens\":', p, ',\"output_tokens\":', o, ',\"total_tokens\":7,\"input_tokens_details\":{\"cached_tokens\":', h, '}}') "
    "WHEN 2 THEN concat('{\"promptTokenCount\":', p, ',\"candidatesTokenCount\":', o, ',\"cachedContentTokenCount\":', h, ',\"thoughtsTokenCount\":5,\"totalTokenCount\":9}') WHEN 3 THEN concat('{\"input_tokens\":', p, ',\"output_tokens\":', o, ',\"cache_read_input_tokens\":', h, ',\"cache_creation_input_tokens\":3}') "
    "WHEN 4 THEN concat('{\"inputTokens\":', p, ',\"outputTokens\":', o, ',\"cacheReadInputTokens\":', h, ',\"totalTokens\":0}') ELSE concat('{\"promptTokens\":', p, ',\"completion_tokens\":', o, ',\"numCachedTokens\":', h, '}') END"
)


def payloads(e: DataFrame) -> DataFrame:
    rows = e.selectExpr("*", "CAST(c % 4096 AS STRING) AS p", "CAST(c % 997 AS STRING) AS o", "CAST(c % 5000 AS STRING) AS h")
    return rows.withColumns({"api": F.expr(_APIS), "payload": F.parse_json(F.expr(_PAYLOAD))})


_COUNTS = ("input", "output", "cache_read", "cache_write", "total_tokens")
query(
    "b10_normalize_usage", "ev",
    sql="x AS (SELECT session_id, seq, event_id % 6 AS k, c % 4096 AS p, c % 997 AS o, c % 5000 AS h FROM ev), y AS (SELECT *, CASE WHEN k = 5 THEN least(p, h) ELSE h END AS r FROM x), z AS (SELECT session_id, seq, k, CASE WHEN k IN (0, 1, 5) THEN greatest(0, p - r) WHEN k = 2 THEN p - r ELSE p END AS input, CASE WHEN k = 2 THEN o + 5 ELSE o END AS output, r AS cache_read, CASE WHEN k = 3 THEN 3 ELSE 0 END AS cache_write FROM y) SELECT session_id, seq, input, output, cache_read, CAST(cache_write AS BIGINT) AS cache_write, CAST(CASE k WHEN 1 THEN 7 WHEN 2 THEN 9 ELSE input + output + cache_read + cache_write END AS BIGINT) AS total_tokens FROM z",
)(lambda e: U.normalize_usage(payloads(e)).select("session_id", "seq", *_COUNTS))
query("k7_usage_parser", "ev", sql="SELECT session_id, seq, c % 4096 AS input, c % 997 AS output FROM ev WHERE event_id % 6 = 3")(
    lambda e: U.normalize_usage(payloads(e).withColumn("api", F.when(F.col("api") == "anthropic", "own")), parsers={"own": {"input": ["$.nothing", "$.input_tokens"], "output": ["$.output_tokens"], "less": ()}}).filter("api = 'own'").select("session_id", "seq", "input", "output")
)
query("b11_normalize_stop_reason", "ev", sql="SELECT session_id, seq, CASE event_type WHEN 'click' THEN CASE event_id % 3 WHEN 0 THEN 'toolUse' WHEN 1 THEN 'error' ELSE 'stop' END WHEN 'view' THEN CASE event_id % 3 WHEN 0 THEN 'stop' WHEN 1 THEN 'length' ELSE 'error' END ELSE CASE event_id % 3 WHEN 0 THEN 'toolUse' WHEN 1 THEN 'error' ELSE 'length' END END AS stop_reason, CASE WHEN event_type = 'click' AND event_id % 3 = 1 THEN 'Provider finish_reason: content_filter' WHEN event_type = 'view' AND event_id % 3 = 2 THEN 'SAFETY' WHEN event_type NOT IN ('click', 'view') AND event_id % 3 = 1 THEN 'The model refused to complete the request' END AS error_message FROM ev")(
    lambda e: U.normalize_stop_reason(e.selectExpr("session_id", "seq", "CASE event_type WHEN 'click' THEN 'openai-completions' WHEN 'view' THEN 'google' ELSE 'anthropic' END AS api", "CASE event_type WHEN 'click' THEN CASE event_id % 3 WHEN 0 THEN 'tool_calls' WHEN 1 THEN 'content_filter' END WHEN 'view' THEN CASE event_id % 3 WHEN 0 THEN 'STOP' WHEN 1 THEN 'MAX_TOKENS' ELSE 'SAFETY' END ELSE CASE event_id % 3 WHEN 0 THEN 'tool_use' WHEN 1 THEN 'refusal' ELSE 'max_tokens' END END AS code")).select("session_id", "seq", "stop_reason", "error_message")
)
query("b15_command_key", "calls", sql="SELECT session_id, seq, CASE call_id % 5 WHEN 0 THEN 'git ' || tool WHEN 1 THEN 'ls' WHEN 2 THEN 'python f' || CAST(call_id AS VARCHAR) || '.py' WHEN 3 THEN 'unknown' ELSE 'make ' || tool END AS key FROM calls")(
    lambda c: c.select("session_id", "seq", S.command_key(F.expr("CASE call_id % 5 WHEN 0 THEN concat('A=1 B=2 sudo git ', tool, ' -x') WHEN 1 THEN 'ls -la | wc' WHEN 2 THEN concat('python f', CAST(call_id AS STRING), '.py && rm x') WHEN 3 THEN '  ' ELSE concat('make ', tool, '\n', 'echo done') END")).alias("key"))
)
query("c7_named_sessions", "conv", sql="SELECT session_id FROM conv GROUP BY session_id HAVING session_id % 3 = 1")(lambda c: D.named_sessions(c.select("session_id").distinct().withColumn("name", F.expr("CASE session_id % 3 WHEN 0 THEN '  ' WHEN 1 THEN 'named' END"))).select("session_id"))
query("e21_timing_summary", "ev", sql="SELECT event_type AS label, count(*) AS n, min(c / 100.0) AS min_ms, max(c / 100.0) AS max_ms, round(avg(c / 100.0), 6) AS mean_ms, round(median(c / 100.0), 6) AS median_ms FROM ev WHERE seq % 20 > 1 AND seq % 20 < 12 AND seq % 20 != 5 GROUP BY 1")(
    lambda e: hooks.timing_summary(e.select(F.col("session_id").alias("run"), F.col("seq").alias("line_no"), F.expr("CASE WHEN seq % 20 = 1 THEN '--- Startup Timings ---' WHEN seq % 20 = 12 THEN '------------------------' WHEN seq % 20 = 5 THEN 'no timing' ELSE concat('  ', event_type, ': ', CAST(CAST(c / 100.0 AS DECIMAL(12, 2)) AS STRING), 'ms') END").alias("line"))).withColumns({k: F.round(k, 6) for k in ("mean_ms", "median_ms")})
)

# hooks ----------------------------------------------------------------------------------------------------------------

query("k3_context_hook", "conv", sql="SELECT session_id, max(seq) AS seq, 'user' AS role, count(*) || ' messages before' AS text FROM conv WHERE role != 'system' GROUP BY 1")(
    lambda c: hooks.apply_transforms(c.select("session_id", "seq", "role", "text"), [lambda d: d.filter("role != 'system'"), lambda d: d.groupBy("session_id").agg(F.max("seq").alias("seq"), F.lit("user").alias("role"), F.concat(F.count("*").cast("string"), F.lit(" messages before")).alias("text"))])
)


def balance(e: DataFrame) -> DataFrame:
    """A balance that may not fall below nothing: a fold that no window sum expresses."""
    rows = e.select("session_id", "seq", F.when(F.col("event_type") == "purchase", -F.col("c")).otherwise(F.col("c") % 1000).alias("step"))

    def step(left: int, r: dict) -> tuple[int, list[dict]]:
        left = max(0, left + r["step"])
        return left, [{"session_id": r["session_id"], "seq": r["seq"], "left": left}]

    return hooks.ordered_fold(rows, "session_id", ["seq"], 0, step, rows.select("session_id", "seq").schema.add("left", "long"))


query("k6_ordered_fold", "ev", sql="x AS (SELECT session_id, seq, CASE WHEN event_type = 'purchase' THEN -c ELSE c % 1000 END AS step FROM ev), y AS (SELECT *, sum(step) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT session_id, seq, CAST(s - least(0, min(s) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS \"left\" FROM y")(balance)

# scalars --------------------------------------------------------------------------------------------------------------

query("i1_lengths", "corpus", sql="SELECT doc_id, CAST(length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS BIGINT) AS utf16, CAST(strlen(text) AS BIGINT) AS utf8 FROM corpus")(lambda c: c.select("doc_id", S.utf16_length("text").alias("utf16"), S.utf8_bytes("text").alias("utf8")))
query("i2_normalise_text", "corpus", sql="SELECT doc_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS h FROM corpus")(lambda c: c.select("doc_id", F.md5(S.normalise_text("text")).alias("h")))
query("i3_truncate", "corpus", sql="SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '... [truncated]' ELSE text END AS line, md5(CASE WHEN length(text) > 2000 THEN left(text, 2000) || chr(10) || chr(10) || '[... ' || CAST(length(text) - 2000 AS VARCHAR) || ' more characters truncated]' ELSE text END) AS result FROM corpus")(
    lambda c: c.select("doc_id", S.truncate_line("text").alias("line"), F.md5(S.truncate_result("text")).alias("result"))
)
query("i4_time_labels", "ev", sql="x AS (SELECT event_id, ts + INTERVAL 2 HOUR AS t FROM ev) SELECT event_id, strftime(t, '%Y-%m-%d') AS day, strftime(date_trunc('week', t), '%Y-%m-%d') AS week, strftime(t, '%H') AS hour FROM x")(
    lambda e: e.select("event_id", S.day_label(F.col("ts").cast("timestamp"), "Etc/GMT-2").alias("day"), S.week_label(F.col("ts").cast("timestamp"), "Etc/GMT-2").alias("week"), S.hour_label(F.col("ts").cast("timestamp"), "Etc/GMT-2").alias("hour"))
)
query("i5_file_stamp", "loglines", sql="SELECT DISTINCT file_name, CAST(floor(epoch(min(ts) OVER (PARTITION BY session_id))) AS BIGINT) AS s FROM loglines")(lambda n: n.select("file_name").distinct().select("file_name", F.unix_seconds(S.file_stamp("file_name")).alias("s")))
query("i6_any_time", "ev", sql="SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1700000000 + event_id WHEN event_id % 3 = 0 THEN NULL ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS s FROM ev")(
    lambda e: e.select("event_id", F.unix_seconds(S.any_time(F.when(F.col("event_id") % 2 == 0, (F.lit(1700000000) + F.col("event_id")) * 1000), F.when(F.col("event_id") % 3 != 0, F.concat(F.regexp_replace(F.col("ts").cast("string"), " ", "T"), F.lit("Z"))).otherwise("never"))).alias("s"))
)
query("i7_quantile", "ev", sql="SELECT event_type, round(quantile_cont(c, 0.25), 6) AS q25, round(quantile_cont(CASE WHEN event_type != 'view' THEN c END, 0.5), 6) AS median FROM ev GROUP BY 1")(lambda e: e.groupBy("event_type").agg(F.round(S.quantile("c", 0.25), 6).alias("q25"), F.round(S.quantile(F.when(F.col("event_type") != "view", F.col("c")), 0.5), 6).alias("median")))
query("i8_ratio", "ev", sql="SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(c AS DOUBLE) / (event_id % 4) END AS r FROM ev")(lambda e: e.select("event_id", S.ratio(F.col("c"), F.col("event_id") % 4).alias("r")))
query("i9_is_alias", "catalog", sql="SELECT provider, model, p_partkey % 3 != 1 AS alias FROM catalog")(lambda k: k.select("provider", "model", S.is_alias(F.concat("model", F.expr("CASE p_partkey % 3 WHEN 0 THEN '-latest' WHEN 1 THEN '-20250101' ELSE '' END"))).alias("alias")))
query("i11_valid_session_id", "ev", sql="SELECT event_id, event_id % 4 IN (0, 1) AS valid FROM ev")(lambda e: e.select("event_id", S.valid_session_id(F.expr("CASE event_id % 4 WHEN 0 THEN CAST(event_id AS STRING) WHEN 1 THEN concat('a.b_', event_type, '-9') WHEN 2 THEN concat('-', event_type) ELSE concat(event_type, ' x') END")).alias("valid")))
query("i12_distinct_except", "conv", sql="w AS (SELECT session_id, seq, unnest(string_split(text, ' ')) AS w FROM conv), a AS (SELECT DISTINCT session_id, seq, w FROM w), s AS (SELECT c.session_id, c.seq, (SELECT string_agg(w, ' ' ORDER BY w) FROM a WHERE a.session_id = c.session_id AND a.seq = c.seq AND w NOT IN (SELECT b.w FROM a b WHERE b.session_id = c.session_id AND b.seq = c.parent_seq)) AS fresh FROM conv c) SELECT session_id, seq, coalesce(fresh, '') AS fresh FROM s")(
    lambda c: c.join(c.select("session_id", F.col("seq").alias("parent_seq"), F.split("text", " ").alias("b")), ["session_id", "parent_seq"], "left").select("session_id", "seq", F.array_join(S.distinct_except(F.split("text", " "), F.coalesce("b", F.array().cast("array<string>"))), " ").alias("fresh"))
)
query("i13_maps", "ev", sql="SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'own' WHEN event_id % 3 = 1 THEN 'unsupported' ELSE 'default' END AS level, CASE WHEN event_id % 2 = 0 THEN 'b' ELSE 'a' END AS merged, CAST(event_type AS VARCHAR) AS kept FROM ev")(
    lambda e: e.select(
        "event_id", S.level_state(F.expr("CASE event_id % 3 WHEN 0 THEN map('high', 'own') WHEN 1 THEN map('high', CAST(NULL AS STRING)) ELSE map('low', 'x') END"), "high").alias("level"),
        S.merge_maps(F.expr("map('k', 'a', 't', event_type)"), F.expr("CASE WHEN event_id % 2 = 0 THEN map('k', 'b') END"))["k"].alias("merged"), S.merge_maps(F.expr("map('t', event_type)"), F.expr("map('z', CAST(NULL AS STRING))"))["t"].alias("kept"),
    )
)
query("i14_json_value", "loglines", sql="SELECT session_id, line_no, CASE WHEN json_valid(line) THEN json_extract_string(line, '$.type') END AS type, CASE WHEN json_valid(line) THEN CAST(json_extract_string(line, '$.message.usage.input') AS BIGINT) END AS input FROM loglines")(
    lambda n: n.withColumn("raw", F.try_parse_json("line")).select("session_id", "line_no", S.json_value("raw", "$.type").alias("type"), S.json_value("raw", "$.message.usage.input", "long").alias("input"))
)
query("i15_labels", "corpus", sql="x AS (SELECT doc_id, CAST(strlen(text) AS BIGINT) * (1 + doc_id % 700) AS n, length(text) AS l FROM corpus) SELECT doc_id, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || 'B' WHEN n < 1048576 THEN format('{:,.1f}', n / 1024.0) || 'KB' ELSE format('{:,.1f}', n / 1048576.0) || 'MB' END AS size, CASE WHEN l = 0 THEN 'n/a' ELSE format('{:,.1f}', (doc_id % 8) * 12.5) || '%' END AS share FROM x")(
    lambda c: c.select("doc_id", S.size_label(S.utf8_bytes("text") * (1 + F.col("doc_id") % 700)).alias("size"), S.percent_label(S.ratio(F.when(F.length("text") > 0, F.col("doc_id") % 8), F.lit(8))).alias("share"))
)

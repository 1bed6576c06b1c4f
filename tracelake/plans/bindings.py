"""Views over the given tables on which the queries run. Each body runs unchanged in Spark SQL and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tracelake.functions.storage import read_table

VIEWS = {
    "conv": "SELECT conv_id AS session_id, turn AS seq, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_seq, role, text, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM conversations",
    "ev": "SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id, ts, event_type, CAST(round(value * 100) AS BIGINT) AS c FROM events",
    "usage": "SELECT session_id, seq, ts, event_type AS provider, concat('m', CAST(event_id % 4 AS STRING)) AS model, CASE WHEN event_type = 'signup' THEN 'compaction' ELSE 'message' END AS type, CASE WHEN event_type = 'error' THEN 'error' ELSE 'stop' END AS stop_reason, c % 4096 AS input, c % 997 AS output, CASE WHEN event_id % 3 = 0 THEN 0 ELSE c END AS cache_read, CASE WHEN event_id % 5 = 0 THEN c ELSE 0 END AS cache_write, c * 100 AS cost_micro FROM ev",
    "tree": "SELECT session_id, seq, CASE WHEN seq = 1 THEN NULL ELSE CAST(floor(seq / 2.0) AS BIGINT) END AS parent_seq, CASE event_type WHEN 'signup' THEN 'compaction' WHEN 'view' THEN 'label' ELSE 'message' END AS type, ts, c FROM ev",
    "calls": "SELECT session_id, CAST(floor(seq / 3.0) AS BIGINT) AS assistant_seq, seq, event_id AS call_id, event_type AS tool, concat('f', CAST(event_id % 13 AS STRING), CASE event_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.PY' ELSE '' END) AS path, CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id % 11 = 0 OR event_type = 'error') END AS is_error, ts, c AS tokens FROM ev",
    "corpus": "SELECT doc_id, concat(source, '/', CAST(doc_id AS STRING), '.', lang) AS path, text, lang FROM documents",
    "catalog": "SELECT p_brand AS provider, concat(p_name, '-', CAST(p_partkey AS STRING)) AS model, CAST(round(p_retailprice * 100) AS BIGINT) AS input_rate, p_size * 1000 AS context_window, p_partkey FROM part",
    # a session log of each user: header, messages with usage, calls and results, compactions; blank, broken and foreign lines
    "loglines": 'SELECT session_id, seq - 1 AS line_no, ts, concat(replace(replace(CAST(date_trunc(\'second\', min(ts) OVER (PARTITION BY session_id)) AS STRING), \' \', \'T\'), \':\', \'-\'), \'-000Z_s\', CAST(session_id AS STRING), \'.jsonl\') AS file_name, CASE WHEN seq = 1 AND session_id % 10 = 4 THEN \'junk\' WHEN session_id % 10 != 3 AND seq = CASE WHEN session_id % 10 = 4 THEN 2 ELSE 1 END THEN concat(\'{"type":"session","version":\', CASE WHEN session_id % 10 = 6 THEN \'2\' ELSE \'3\' END, \',"id":"s\', CAST(session_id AS STRING), \'","timestamp":"\', concat(replace(CAST(date_trunc(\'second\', ts) AS STRING), \' \', \'T\'), \'Z\'), \'","cwd":"/w/\', CAST(session_id % 7 AS STRING), \'"}\') WHEN event_id % 17 = 0 THEN \'\' WHEN event_id % 19 = 0 THEN \'{"type":"mess\' WHEN event_type = \'signup\' THEN concat(\'{"type":"compaction",\', \'"id":"e\', CAST(seq AS STRING), \'","parentId":\', CASE WHEN seq <= 2 THEN \'null\' WHEN seq % 7 = 0 AND seq > 9 THEN concat(\'"e\', CAST(seq - 3 AS STRING), \'"\') ELSE concat(\'"e\', CAST(seq - 1 AS STRING), \'"\') END, \',"timestamp":"\', concat(replace(CAST(date_trunc(\'second\', ts) AS STRING), \' \', \'T\'), \'Z\'), \'"\', \',"summary":"sum","tokensBefore":\', CAST(c AS STRING), \'}\') WHEN event_type = \'click\' THEN concat(\'{"type":"message",\', \'"id":"e\', CAST(seq AS STRING), \'","parentId":\', CASE WHEN seq <= 2 THEN \'null\' WHEN seq % 7 = 0 AND seq > 9 THEN concat(\'"e\', CAST(seq - 3 AS STRING), \'"\') ELSE concat(\'"e\', CAST(seq - 1 AS STRING), \'"\') END, \',"timestamp":"\', concat(replace(CAST(date_trunc(\'second\', ts) AS STRING), \' \', \'T\'), \'Z\'), \'"\', \',"message":{"role":"assistant","content":[{"type":"text","text":"a\', CAST(c AS STRING), \'"},{"type":"toolCall","id":"c\', CAST(seq AS STRING), \'","name":"\', CASE event_id % 3 WHEN 0 THEN \'read\' WHEN 1 THEN \'edit\' ELSE \'bash\' END, \'","arguments":\', CASE event_id % 3 WHEN 2 THEN concat(\'{"command":"git s\', CAST(event_id % 211 AS STRING), \' -s"}\') ELSE concat(\'{"path":"f\', CAST(event_id % 13 AS STRING), \'.ts"}\') END, \'}],"provider":"p\', CAST(event_id % 3 AS STRING), \'","model":"m\', CAST(event_id % 4 AS STRING), \'","stopReason":"toolUse"\', \',"usage":{"input":\', CAST(c % 4096 AS STRING), \',"output":\', CAST(c % 997 AS STRING), \',"cacheRead":\', CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE c END AS STRING), \',"cacheWrite":\', CAST(CASE WHEN event_id % 5 = 0 THEN c ELSE 0 END AS STRING), \',"totalTokens":\', CAST(c AS STRING), CASE WHEN event_id % 13 = 0 THEN \'\' ELSE concat(\',"cost":{"total":\', CAST(CASE WHEN event_id % 7 = 0 THEN 0 ELSE c END AS STRING), \'e-4}\') END, \'}\', \',"timestamp":\', CAST(1700000000000 + 1000 * event_id AS STRING), \'}}\') WHEN event_type = \'purchase\' AND lag(event_type) OVER (PARTITION BY session_id ORDER BY seq) = \'click\' THEN concat(\'{"type":"message",\', \'"id":"e\', CAST(seq AS STRING), \'","parentId":\', CASE WHEN seq <= 2 THEN \'null\' WHEN seq % 7 = 0 AND seq > 9 THEN concat(\'"e\', CAST(seq - 3 AS STRING), \'"\') ELSE concat(\'"e\', CAST(seq - 1 AS STRING), \'"\') END, \',"timestamp":"\', concat(replace(CAST(date_trunc(\'second\', ts) AS STRING), \' \', \'T\'), \'Z\'), \'"\', \',"message":{"role":"toolResult","toolCallId":"c\', CAST(seq - 1 AS STRING), \'","toolName":"x","isError":\', CASE WHEN event_id % 11 = 0 THEN \'true\' ELSE \'false\' END, \',"content":[{"type":"text","text":"result \', CAST(c AS STRING), \'"}]\', \',"timestamp":\', CAST(1700000000000 + 1000 * event_id AS STRING), \'}}\') WHEN event_type = \'error\' THEN concat(\'{"type":"message",\', \'"id":"e\', CAST(seq AS STRING), \'","parentId":\', CASE WHEN seq <= 2 THEN \'null\' WHEN seq % 7 = 0 AND seq > 9 THEN concat(\'"e\', CAST(seq - 3 AS STRING), \'"\') ELSE concat(\'"e\', CAST(seq - 1 AS STRING), \'"\') END, \',"timestamp":"\', concat(replace(CAST(date_trunc(\'second\', ts) AS STRING), \' \', \'T\'), \'Z\'), \'"\', \',"message":{"role":"assistant","content":[],"provider":"p\', CAST(event_id % 3 AS STRING), \'","model":"m\', CAST(event_id % 4 AS STRING), \'","stopReason":"error","errorMessage":"overloaded"\', \',"usage":{"input":\', CAST(c % 4096 AS STRING), \',"output":\', CAST(c % 997 AS STRING), \',"cacheRead":\', CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE c END AS STRING), \',"cacheWrite":\', CAST(CASE WHEN event_id % 5 = 0 THEN c ELSE 0 END AS STRING), \',"totalTokens":\', CAST(c AS STRING), CASE WHEN event_id % 13 = 0 THEN \'\' ELSE concat(\',"cost":{"total":\', CAST(CASE WHEN event_id % 7 = 0 THEN 0 ELSE c END AS STRING), \'e-4}\') END, \'}\', \',"timestamp":\', CAST(1700000000000 + 1000 * event_id AS STRING), \'}}\') ELSE concat(\'{"type":"\', CASE WHEN event_id % 23 = 0 THEN \'odd\' ELSE \'message\' END, \'",\', \'"id":"e\', CAST(seq AS STRING), \'","parentId":\', CASE WHEN seq <= 2 THEN \'null\' WHEN seq % 7 = 0 AND seq > 9 THEN concat(\'"e\', CAST(seq - 3 AS STRING), \'"\') ELSE concat(\'"e\', CAST(seq - 1 AS STRING), \'"\') END, \',"timestamp":"\', concat(replace(CAST(date_trunc(\'second\', ts) AS STRING), \' \', \'T\'), \'Z\'), \'"\', \',"message":{"role":"user","content":"u\', CAST(c AS STRING), \'"\', \',"timestamp":\', CAST(1700000000000 + 1000 * event_id AS STRING), \'}}\') END AS line FROM ev',
}
_FROM = re.compile(r"FROM (\w+)$")


def source_of(view: str) -> str:
    return _FROM.search(VIEWS[view])[1]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame, or the base table of that name."""
    if name not in VIEWS:
        return read_table(spark, sf_dir, name)
    source = source_of(name)
    body = VIEWS[name].replace("{", "{{").replace("}", "}}")  # braces of JSON are no parameters
    return spark.sql(_FROM.sub("FROM {source}", body), source=view(spark, sf_dir, source))


def with_clause(names: tuple[str, ...]) -> str:
    """``WITH ...`` of the views that the names need, for DuckDB, which has the base tables only."""
    need: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in need:
            add(source_of(name))
            need.append(name)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in need) if need else ""

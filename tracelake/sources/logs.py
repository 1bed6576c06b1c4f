"""Session logs as JSONL files: a header line and entries. Readers give one row a line, in order of (file_path, line_at)."""

from __future__ import annotations

import json
from collections.abc import Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracelake.functions.scalars import any_time, content_text, estimate, file_stamp, utf16_length
from tracelake.functions.storage import joins_by_rows, remove, written
from tracelake.functions.tables import BucketTable
from tracelake.operators.trees import branch_path, on_path

HEADER_BYTES = 1 << 20
#: What opening a log file costs, as bytes of reading.
OPEN_COST = 128 << 10
KINDS = ("message", "thinking_level_change", "model_change", "active_tools_change", "compaction", "branch_summary", "custom", "custom_message", "label", "session_info", "leaf")


def get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("raw", path, kind)


def cwd_to_dir(cwd: Column | str) -> Column:
    """The folder name of a working directory: ``--a-b--``."""
    c = F.col(cwd) if isinstance(cwd, str) else cwd
    return F.concat(F.lit("--"), F.regexp_replace(F.regexp_replace(c, r"^[/\\]", ""), r"[/\\:]", "-"), F.lit("--"))


def for_cwd(sessions: DataFrame, cwd: str) -> DataFrame:
    """Sessions whose header names the directory."""
    return sessions.filter(F.col("cwd") == cwd)


def read_lines(spark: SparkSession, path: str, since=None) -> DataFrame:
    """Lines of all ``*.jsonl`` files below a path. Files whose name has a time before ``since`` are not opened (A5).

    Files of any size are split among tasks; ``line_at`` (start of the split, row in it) orders a file's lines.
    """
    files = spark.read.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    if since is not None:
        stamp = file_stamp(F.col("_metadata.file_name"))
        files = files.filter(stamp.isNull() | (stamp >= F.lit(since)))
    lines = files.select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_modification_time").alias("file_mtime"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("line_at"), F.col("value").alias("line"),
        F.try_parse_json("value").alias("raw"),  # beside the rows' numbers, below which no filter goes: lines are parsed once
    )
    return with_file_timestamp(lines).withColumn("blank", F.trim("line") == "").select("file_path", "file_name", "file_mtime", "line_at", "line", "file_ts", "raw", "blank")


def with_file_timestamp(files: DataFrame, name: str = "file_name") -> DataFrame:
    """A5: ``file_ts``, the creation time that a file's name begins with; null where it has none."""
    return files.withColumn("file_ts", file_stamp(name))


def is_object(raw: str = "raw") -> Column:
    return F.coalesce(F.schema_of_variant(raw).startswith("OBJECT"), F.lit(False))


@contextmanager
def many_small_files(spark: SparkSession):
    """Splits hold some 1,000 small files, and not 32, while a pass over log files runs: what is written has so many fewer files."""
    name = "spark.sql.files.openCostInBytes"
    mine = spark.conf.get(name, None) is None  # a session that sets it keeps it
    if mine:
        spark.conf.set(name, str(OPEN_COST))
    try:
        yield
    finally:
        if mine:
            spark.conf.unset(name)


def by_block(lines: DataFrame, **summary: Column) -> DataFrame:
    """One row for each split of a file (file_path, block): aggregates of its lines; the first level of the scans over files.

    Both passes over the lines must see the same splits, which depend on the number of cores where spark.sql.files.minPartitionNum is
    unset; it is set here then, to the session's parallelism.
    """
    spark = lines.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return written(lines.groupBy("file_path", F.col("line_at.block").alias("block")).agg(*(c.alias(n) for n, c in summary.items())), "log-blocks")


def in_blocks() -> W:
    """The splits of a file in order: a few rows, whatever the file's size."""
    return W.partitionBy("file_path").orderBy("block")


def before(n: str) -> Column:
    """Sum over the splits before."""
    return F.coalesce(F.sum(n).over(in_blocks().rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def of_block(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lines with the columns of their split: no line is sorted, and one file's lines are spread over its splits."""
    return lines.withColumn("block", F.col("line_at.block")).join(blocks, ["file_path", "block"])


def read_session_logs(spark: SparkSession, path: str, since=None) -> tuple[DataFrame, DataFrame]:
    """A1: (sessions, entries). Blank and malformed lines are skipped; a file counts if its first parsed line is a session header with an id.

    Places come from a scan of two levels: rows and first line of each split, offsets over a file's splits, then place in the split. The files are
    opened and parsed once: what is read again are the parsed lines, written as a table.
    """
    # numbered after the filter: the rows of a split follow each other without gaps
    lines = read_lines(spark, path, since).filter(~F.col("blank") & is_object()).withColumn("row", F.monotonically_increasing_id())
    with many_small_files(spark):
        lines = written(lines.select("file_path", "file_mtime", "file_ts", F.struct("line_at.block").alias("line_at"), "raw", "row"), "log-lines")
    blocks = by_block(lines, n=F.count("*"), start=F.min("row"), head=F.min_by(F.struct(get("$.type").alias("type"), get("$.id").alias("id")), "row"))
    head = F.first("head").over(in_blocks().rowsBetween(W.unboundedPreceding, 0))
    blocks = written(blocks.select("file_path", "block", "start", before("n").alias("before"), head.alias("_head")).filter("_head.type = 'session' AND _head.id IS NOT NULL"), "log-places")
    rows = of_block(lines, blocks).withColumn("_n", F.col("row") - F.col("start") + F.col("before") + 1)
    sessions = rows.filter("_n = 1").select(
        F.col("_head.id").alias("session_id"), "file_path", F.coalesce(get("$.version", "int"), F.lit(1)).alias("version"), F.try_to_timestamp(get("$.timestamp")).alias("created_ts"), get("$.cwd").alias("cwd"), get("$.parentSession").alias("parent_path"), "file_ts", "file_mtime"
    )
    entries = rows.filter("_n > 1").select(
        F.col("_head.id").alias("session_id"),
        (F.col("_n") - 1).alias("entry_seq"),
        get("$.id").alias("entry_id"),
        get("$.parentId").alias("parent_id"),
        get("$.type").alias("type"),
        F.try_to_timestamp(get("$.timestamp")).alias("entry_ts"),
        "raw",
        "file_path",
    )
    return sessions, entries


def header_line(text: bytes, whole: bool) -> str | None:
    """The first line that is a JSON object, if it is a session header; of a text that is cut off, the last line doesn't count."""
    lines = text.decode("utf-8", "replace").split("\n")
    for line in lines if whole else lines[:-1]:
        try:
            found = json.loads(line)
        except (ValueError, RecursionError):
            continue
        if isinstance(found, dict):
            return line if found.get("type") == "session" and found.get("id") is not None else None
    return None


def read_session_headers(spark: SparkSession, path: str, max_bytes: int = HEADER_BYTES) -> DataFrame:
    """A2: headers only. No more than ``max_bytes`` of a file are read; files whose header doesn't fit, or that have none, give nothing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(path).select("path")

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            lines = []
            for p in batch.column("path").to_pylist():
                store, name = fs.FileSystem.from_uri(p)
                with store.open_input_stream(name, compression=None) as stream:
                    text = stream.read(max_bytes + 1)
                lines.append(header_line(text[:max_bytes], len(text) <= max_bytes))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(lines, pa.string())], names=["path", "line"])

    first = files.mapInArrow(run, "path string, line string").filter("line IS NOT NULL").withColumn("raw", F.try_parse_json("line"))
    return first.select(F.col("path").alias("file_path"), get("$.id").alias("session_id"), get("$.cwd").alias("cwd"), F.try_to_timestamp(get("$.timestamp")).alias("created_ts"), get("$.parentSession").alias("parent_path"))


def validate_session_logs(lines: DataFrame, mode: str = "strict") -> tuple[DataFrame, DataFrame]:
    """A3: (good lines, quarantined lines with ``reason``). Strict: the first wrong line of a file rejects what follows it too.

    ``lines``: read_lines. Blank lines are neither. A file's first line and first fault come from a scan of two levels, as in A1: a good
    header is a fault anywhere but in first place, so a split tells its first wrong line of either sort, and a file's splits the rest.
    """
    header = F.when(get("$.type") != "session", "first line is not a session header").when(get("$.type").isNull(), "header has no type").when(~get("$.version", "int").eqNullSafe(F.lit(3)), "unsupported version").when(get("$.id").isNull(), "header has no id").when(F.try_to_timestamp(get("$.timestamp")).isNull(), "header has no timestamp").when(get("$.cwd").isNull(), "header has no cwd")
    entry = F.when(get("$.type").isNull() | ~get("$.type").isin(*KINDS), "unknown entry type").when(get("$.id").isNull(), "entry has no id").when(~F.schema_of_variant("raw").contains("parentId:"), "entry has no parentId").when(F.try_to_timestamp(get("$.timestamp")).isNull(), "entry has no timestamp").when((get("$.type") == "leaf") & ~F.schema_of_variant("raw").contains("targetId:"), "leaf has no target")
    shape = F.when(F.col("raw").isNull(), "not JSON").when(~is_object(), "not an object")
    first_line, later_line = F.coalesce(shape, header), F.coalesce(shape, entry)
    # files are opened and parsed, and lines judged, once: what is read again is a table
    lines = written(lines.withColumns({"_first": first_line, "_later": later_line}), "judged-lines")
    first_line, later_line = F.col("_first"), F.col("_later")
    row, told = F.col("line_at.row"), ~F.col("blank")
    good_header = told & first_line.isNull()
    blocks = by_block(
        lines,
        n=F.count("*"),
        start=F.min(row),
        top=F.min(F.when(told, row)),
        top_is_good=F.min_by(first_line.isNull(), F.when(told, row)),
        wrong=F.min(F.when(told & later_line.isNotNull() & first_line.isNotNull(), row)),
        headers=F.sort_array(F.collect_list(F.when(good_header, row))),  # at most a split's lines, usually one
    )
    top = F.first(F.when(F.col("top").isNotNull(), F.struct("block", F.col("top").alias("row"))), ignorenulls=True).over(in_blocks().rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    blocks = blocks.withColumn("first", top)
    holds_top = F.col("first.block") == F.col("block")
    fault = F.when(holds_top & ~F.col("top_is_good"), F.col("top")).when(holds_top, F.least("wrong", F.get("headers", F.lit(1)))).otherwise(F.least("wrong", F.get("headers", F.lit(0))))
    fault = F.min(F.when(fault.isNotNull(), F.struct("block", fault.alias("row")))).over(W.partitionBy("file_path"))
    blocks = written(blocks.select("file_path", "block", "start", before("n").alias("before"), "first", fault.alias("fault")), "log-places")
    rows = of_block(lines, blocks).filter(~F.col("blank")).withColumn("line_no", row - F.col("start") + F.col("before"))
    reason = F.when(F.col("line_at") == F.col("first"), first_line).otherwise(later_line)
    if mode == "strict":
        reason = F.coalesce(reason, F.when(F.col("line_at") > F.col("fault"), "after a rejected line"))
    rows = rows.withColumn("reason", reason).drop("block", "start", "before", "first", "fault", "_first", "_later")
    return rows.filter("reason IS NULL").drop("reason"), rows.filter("reason IS NOT NULL").select("file_path", "line_no", "reason", F.col("line").alias("raw"))


def malformed_line_report(lines: DataFrame) -> DataFrame:
    """A4: one row: files, included and skipped files, lines, blank and malformed lines."""
    good = ~F.col("blank") & is_object()
    by_file = lines.groupBy("file_path").agg(F.count("*").alias("n"), F.count_if("blank").alias("blank"), F.count_if(~F.col("blank") & ~is_object()).alias("bad"), F.min_by("line", F.when(good, F.col("line_at"))).alias("line")).withColumn("raw", F.try_parse_json("line"))
    included = F.coalesce((get("$.type") == "session") & get("$.id").isNotNull(), F.lit(False))
    return by_file.agg(F.count("*").alias("files"), F.count_if(included).alias("included"), F.count_if(~included).alias("skipped"), F.coalesce(F.sum("n"), F.lit(0)).alias("lines"), F.coalesce(F.sum("blank"), F.lit(0)).alias("blank_lines"), F.coalesce(F.sum("bad"), F.lit(0)).alias("malformed_lines"))


BLOCK = "struct<type:string,text:string,thinking:string,redacted:boolean,data:string,mimeType:string,id:string,name:string,arguments:variant>"


def flatten_messages(entries: DataFrame) -> DataFrame:
    """One row a message entry, with its usage and ``content`` as an array of blocks (a plain text is one text block)."""
    text = get("$.message.content")
    blocks = F.try_variant_get("raw", "$.message.content", f"array<{BLOCK}>")
    one = F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (x.split(":") for x in BLOCK[7:-1].split(",")[2:]))))
    usage = {k: get(f"$.message.usage.{k}", "long") for k in ("input", "output", "cacheRead", "cacheWrite", "totalTokens")}
    return entries.filter("type = 'message'").select(
        "session_id",
        "entry_seq",
        *(get(f"$.message.{k}").alias(n) for k, n in (("role", "role"), ("api", "api"), ("provider", "provider"), ("model", "model"), ("responseModel", "response_model"), ("stopReason", "stop_reason"), ("errorMessage", "error_message"), ("toolCallId", "tool_call_id"), ("toolName", "tool_name"))),
        get("$.message.isError", "boolean").alias("is_error"),
        any_time(get("$.message.timestamp", "long"), get("$.timestamp")).alias("ts"),
        F.timestamp_millis(get("$.message.timestamp", "long")).alias("msg_ts"),
        F.struct(*(v.alias(k) for k, v in usage.items()), get("$.message.usage.cost.total", "double").alias("cost")).alias("usage"),
        F.when(F.schema_of_variant(F.try_variant_get("raw", "$.message.content", "variant")) == "STRING", one).otherwise(blocks).alias("content"),
    )


def explode_blocks(messages: DataFrame, *more: str) -> DataFrame:
    """One row a content block, with its place, and ``more`` columns of its message."""
    return messages.select("session_id", "entry_seq", "role", *more, F.posexplode("content").alias("pos", "b")).select("session_id", "entry_seq", "role", *more, "pos", "b.*")


def tool_calls(blocks: DataFrame, *more: str) -> DataFrame:
    """Calls: session_id, entry_seq, call_id, tool, arguments."""
    return blocks.filter("type = 'toolCall'").select("session_id", "entry_seq", "pos", F.col("id").alias("call_id"), F.col("name").alias("tool"), "arguments", *more)


def usage_of(entries: DataFrame) -> DataFrame:
    """The ``usage`` table of the reports, from entries (A1): assistant messages with usage, and compactions and branch summaries.

    ``cost_micro`` is null where a row has no cost object, and 0 where it cost nothing.
    """
    kept = entries.filter(((F.col("type") == "message") & (get("$.message.role") == "assistant") & F.try_variant_get("raw", "$.message.usage", "variant").isNotNull()) | F.col("type").isin("compaction", "branch_summary"))
    count = lambda k, kind="long": F.coalesce(get(f"$.message.usage.{k}", kind), get(f"$.usage.{k}", kind))
    tokens = {"input": "input", "output": "output", "cache_read": "cacheRead", "cache_write": "cacheWrite"}
    return kept.select(
        "session_id", F.col("entry_seq").alias("seq"), any_time(get("$.message.timestamp", "long"), get("$.timestamp")).alias("ts"), get("$.message.provider").alias("provider"),
        F.coalesce(get("$.message.responseModel"), get("$.message.model")).alias("model"), "type", get("$.message.stopReason").alias("stop_reason"), get("$.message.errorMessage").alias("error_message"),
        *(F.coalesce(count(k), F.lit(0)).alias(n) for n, k in tokens.items()), F.round(count("cost.total", "double") * 1e6).cast("long").alias("cost_micro"),
    )


def calls_of(entries: DataFrame) -> DataFrame:
    """The ``calls`` table of the reports, from entries (A1): one row a tool call, with the path and command of its arguments."""
    calls = tool_calls(explode_blocks(flatten_messages(entries).filter("role = 'assistant'"), "ts"), "ts")
    argument = lambda *names: F.coalesce(*(F.try_variant_get("arguments", f"$.{n}", "string") for n in names))
    return calls.select("session_id", F.col("entry_seq").alias("assistant_seq"), F.col("entry_seq").alias("seq"), "pos", "call_id", "tool", argument("path", "file_path").alias("path"), argument("command").alias("command"), "arguments", "ts")


def results_of(entries: DataFrame) -> DataFrame:
    """The ``results`` table of the reports, from entries (A1): one row a tool result, with its text and estimated tokens."""
    rows = flatten_messages(entries).filter("role = 'toolResult'").withColumn("text", content_text("content"))
    return rows.select("session_id", F.col("entry_seq").alias("seq"), F.col("tool_call_id").alias("call_id"), F.coalesce("is_error", F.lit(False)).alias("is_error"), estimate(utf16_length("text")).alias("tokens"), "text")


def write_lines(rows: DataFrame, path: str) -> DataFrame:
    """Writes one file for each ``name``, its ``value`` lines in order of ``pos``; returns the written files (name, lines).

    A task holds one line at a time. It writes under a name of its own and renames, so a repeated task does no harm.
    """

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        own, now, out, n, done = f".{TaskContext.get().taskAttemptId()}", None, None, 0, []

        def close():
            out.close()
            store.move(f"{folder}/{now}{own}", f"{folder}/{now}")
            done.append((now, n))

        for batch in batches:
            for name, value in zip(batch.column("name").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if name != now:
                    if out:
                        close()
                    now, n, out = name, 0, store.open_output_stream(f"{folder}/{name}{own}", compression=None)
                out.write(f"{value}\n".encode())
                n += 1
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["name", "lines"])

    return written(rows.select("name", "pos", "value").repartition("name").sortWithinPartitions("name", "pos").mapInArrow(run, "name string, lines long"), "files")


def read_model_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON file provider -> model -> record: provider, model, name, api, window, prices, tiers."""
    record = "struct<name:string,api:string,reasoning:boolean,input:array<string>,contextWindow:bigint,maxTokens:bigint,thinkingLevelMap:map<string,string>,cost:struct<input:double,output:double,cacheRead:double,cacheWrite:double,tiers:array<struct<inputTokensAbove:bigint,input:double,output:double,cacheRead:double,cacheWrite:double>>>>"
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", f"map<string,map<string,{record}>>")).alias("provider", "models")).select("provider", F.explode("models").alias("model", "m"))
    return rows.select("provider", "model", "m.name", "m.api", "m.reasoning", F.col("m.input").alias("modalities"), F.col("m.contextWindow").alias("context_window"), F.col("m.maxTokens").alias("max_tokens"), F.col("m.thinkingLevelMap").alias("levels"), "m.cost")


class SessionTables:
    """Sessions, entries, branch rows and session state under a path, loaded in increments.

    Entries, partitioned by working directory and sorted by (session, seq) in each load, are only ever added to: a load adds those whose (session, seq) isn't
    there yet. Their files hold Bloom filters of ``entry_id`` and ``parent_id``, so that a look-up by either reads few row groups. The other tables
    have rows of the sessions that a load touches replaced, in one commit each; a load that failed half-way is repeated as a whole.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, row_group_bytes: int = 16 << 20, ids_a_group: int = 50_000) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.options = {"parquet.block.size": row_group_bytes} | {f"parquet.bloom.filter.{x}#{c}": v for c in ("entry_id", "parent_id") for x, v in (("enabled", "true"), ("expected.ndv", ids_a_group))}
        self.parts = {n: BucketTable(spark, f"{self.path}/{n}") for n in ("sessions", "branch_entries", "session_state")}

    def has_entries(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/entries/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def entries(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/entries")

    def table(self, name: str) -> DataFrame:
        """``sessions``, ``branch_entries`` or ``session_state``."""
        return self.parts[name].table()

    def children_of(self, parent_ids: Sequence[str]) -> DataFrame:
        """Entries whose parent is one of a few ids."""
        return self.entries().filter(F.col("parent_id").isin(*parent_ids))

    def load(self, sessions: DataFrame, entries: DataFrame) -> None:
        """Adds what isn't there. ``sessions``, ``entries``: as read_session_logs gives them; a repeated (session, seq) keeps one row."""
        where = written(sessions.withColumn("cwd_dir", F.coalesce(cwd_to_dir("cwd"), F.lit("--unknown--"))), "load-sessions")
        rows = entries.withColumn("raw", F.to_json("raw")) if dict(entries.dtypes).get("raw") == "variant" else entries
        homes = where.select("session_id", "cwd_dir").dropDuplicates(["session_id"])
        rows = rows.join(homes, "session_id")
        if self.has_entries():
            # only the folders of the sessions at hand are read, and of them two columns
            there = self.entries().join(homes, ["session_id", "cwd_dir"], "left_semi").select("session_id", "entry_seq")
            rows = rows.join(there, ["session_id", "entry_seq"], "left_anti")
        # a session lies in one folder and bucket, so its repeated rows meet in the task that writes them: one exchange for both
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(self.buckets))).repartition("cwd_dir", "bucket").dropDuplicates(["cwd_dir", "bucket", "session_id", "entry_seq"])
        rows = rows.drop("bucket").sortWithinPartitions("cwd_dir", "session_id", "entry_seq")
        rows.write.mode("append").options(**self.options).partitionBy("cwd_dir").parquet(f"{self.path}/entries")
        mine = written(self.entries().join(homes, ["session_id", "cwd_dir"], "left_semi"), "load-entries")
        for name, made in (("sessions", where), ("branch_entries", branch_path(as_tree(mine))), ("session_state", session_state(mine))):
            table = self.parts[name]
            table.replace(made, max(table.commits(), default=-1) + 1, "session_id", buckets=self.buckets)
        remove(where, mine)


def session_state(entries: DataFrame) -> DataFrame:
    """A session's rows, last place and time, and what is in force at its end: model, thinking level, name, and labels by entry. Rows: entries with ``raw`` as JSON."""
    rows = entries.withColumn("raw", F.try_parse_json("raw"))
    at = lambda keep, value: F.max_by(value, F.when(keep & value.isNotNull(), F.col("entry_seq")))
    kind, is_ = F.col("type"), lambda t: F.col("type") == t
    provider, model = (F.when(kind == "model_change", get(f"$.{a}")).otherwise(get(f"$.message.{b}")) for a, b in (("provider", "provider"), ("modelId", "model")))
    labels = rows.filter(is_("label")).groupBy("session_id", get("$.targetId").alias("id")).agg(F.max_by(F.coalesce(get("$.label"), F.lit("")), "entry_seq").alias("label")).filter("id IS NOT NULL AND label != ''")
    labels = labels.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "label"))).alias("labels"))
    out = rows.groupBy("session_id").agg(
        F.count("*").alias("entries"), F.max("entry_seq").alias("last_seq"), F.max("entry_ts").alias("last_ts"),
        at(is_("model_change") | (get("$.message.role") == "assistant"), F.struct(provider.alias("provider"), model.alias("model"))).alias("m"),
        at(is_("thinking_level_change"), get("$.thinkingLevel")).alias("thinking_level"), at(is_("session_info"), get("$.name")).alias("name"),
    )
    out = out.select("session_id", "entries", "last_seq", "last_ts", "m.provider", "m.model", "thinking_level", F.nullif(F.trim("name"), F.lit("")).alias("name"))
    return out.join(labels, "session_id", "left").withColumn("labels", F.coalesce("labels", F.create_map().cast("map<string,string>")))


def write_session_tables(sessions: DataFrame, entries: DataFrame, path: str) -> SessionTables:
    """Loads sessions and entries into the tables under a path, new or not."""
    tables = SessionTables(sessions.sparkSession, path)
    tables.load(sessions, entries)
    return tables


def as_tree(entries: DataFrame) -> DataFrame:
    """Entries with ids as a tree over sequence numbers: session_id, seq, parent_seq, type."""
    ids = entries.select("session_id", F.col("entry_id").alias("parent_id"), F.col("entry_seq").alias("parent_seq"))
    return entries.join(ids, ["session_id", "parent_id"], "left").select("session_id", F.col("entry_seq").alias("seq"), F.col("parent_seq").cast("int").alias("parent_seq"), "type")


def export_branch_jsonl(entries: DataFrame, path: str, leaf: DataFrame | None = None) -> DataFrame:
    """A10: each session's branch as a file ``<session>.jsonl``, a header first, parents chained anew. Rows: session_id, seq, parent_seq, type, and more."""
    with joins_by_rows(entries.sparkSession):
        entries = written(entries, "branch-entries")
        rows = written(on_path(entries, branch_path(entries, leaf)), "branch-rows")
    chained = rows.withColumn("parent_seq", F.lag("seq").over(W.partitionBy("session_id").orderBy("pos")))
    body = chained.select("session_id", "pos", F.to_json(F.struct(*(c for c in chained.columns if c not in ("pos", "session_id"))), {"ignoreNullFields": "false"}).alias("value"))
    head = rows.select("session_id").distinct().select("session_id", F.lit(-1).cast("long").alias("pos"), F.to_json(F.struct(F.lit("session").alias("type"), F.lit(3).alias("version"), F.col("session_id").alias("id"))).alias("value"))
    return write_lines(head.unionByName(body).withColumn("name", F.concat(F.col("session_id").cast("string"), F.lit(".jsonl"))), path)


def write_transcripts(packed: DataFrame, path: str) -> DataFrame:
    """Packed transcripts (bin, pos, text) as a text file ``<bin>.txt`` for each bin."""
    return write_lines(packed.select(F.concat(F.col("bin").cast("string"), F.lit(".txt")).alias("name"), "pos", F.col("text").alias("value")), path)


def write_report_json(summaries: dict[str, DataFrame], path: str) -> None:
    """One JSON document with a list of rows for each (small) summary."""
    spark = next(iter(summaries.values())).sparkSession
    out = spark.range(1).select()
    for name, df in summaries.items():
        out = out.crossJoin(df.agg(F.sort_array(F.collect_list(F.to_json(F.struct("*")))).alias(name)))
    text = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{n}":['), F.array_join(n, ","), F.lit("]")) for n in summaries)), F.lit("}"))
    out.select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)

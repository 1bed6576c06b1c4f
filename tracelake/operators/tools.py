"""Tool-call reports. Grain of ``calls``: one row a call, key (session_id, call_id); of ``results``: one row a result."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tracelake.functions.scalars import command_key, ratio

KEY = ["session_id", "call_id"]


def filter_sessions_by_bash(df: DataFrame, calls: DataFrame, texts: Sequence[str], command: str = "command") -> DataFrame:
    """Rows of sessions in which a shell command contains any of the texts."""
    any_of = F.lit(False)
    for t in texts:
        any_of = any_of | F.col(command).contains(t)
    return df.join(calls.filter(any_of).select("session_id").distinct(), "session_id", "left_semi")


def filter_calls(calls: DataFrame, model: Column | None = None, extension: Column | None = None, failed_only: bool = False) -> DataFrame:
    """All given conditions hold; failed means that success is false, not unknown."""
    out = calls
    for keep in (model, extension):
        out = out if keep is None else out.filter(keep)
    return out.filter(F.col("success").eqNullSafe(F.lit(False))) if failed_only else out


def match_calls_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Each call with its first result, by session and call id; ``success`` is null without one."""
    first = results.groupBy(*KEY).agg(F.min_by(F.struct("is_error", *[c for c in results.columns if c not in (*KEY, "seq", "is_error")]), "seq").alias("r"))
    first = first.select(*KEY, F.col("r").alias("result"))
    out = calls.join(first, KEY, "left")
    return out.withColumn("success", F.when(F.col("result").isNotNull(), ~F.col("result.is_error")))


def unresolved_calls(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls without a result."""
    return calls.join(results, KEY, "left_anti")


def unmatched_results(results: DataFrame, calls: DataFrame) -> DataFrame:
    """D3: results without a call."""
    return results.join(calls, KEY, "left_anti")


def synthesize_missing_results(calls: DataFrame, results: DataFrame, messages: DataFrame) -> DataFrame:
    """Results, and an error result for each unanswered call, placed before the session's next user or assistant row.

    ``messages``: session_id, seq, role. Order within a session is (seq, tie); a made-up row has the seq of the row before
    which it stands, and tie -1.
    """
    stops = messages.filter("role IN ('user', 'assistant')").select("session_id", F.col("seq").alias("_stop"))
    missing = unresolved_calls(calls, results).select(*KEY, "tool", "seq")
    w = W.partitionBy("session_id").orderBy("_at", F.desc("_kind")).rowsBetween(1, W.unboundedFollowing)
    both = missing.select(*KEY, "tool", F.col("seq").alias("_at"), F.lit(0).alias("_kind")).unionByName(stops.select("session_id", F.col("_stop").alias("_at"), F.lit(1).alias("_kind")), allowMissingColumns=True)
    placed = both.withColumn("_next", F.min(F.when(F.col("_kind") == 1, F.col("_at"))).over(w)).filter("_kind = 0")
    made = placed.select(*KEY, "tool", F.coalesce("_next", F.lit(2**62)).alias("seq"), F.lit(-1).alias("tie"), F.lit("No result provided").alias("text"), F.lit(True).alias("is_error"))
    have = results.join(calls.select(*KEY, "tool"), KEY, "left").select(*KEY, "tool", "seq", F.lit(0).alias("tie"), "text" if "text" in results.columns else F.lit(None).cast("string").alias("text"), "is_error")
    return have.unionByName(made)


def tool_stats(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Per tool, calls, results, errors, result tokens and their mean, those with most tokens first."""
    joined = match_calls_results(calls, results)
    n = F.count_if(F.col("result").isNotNull())
    out = joined.groupBy("tool").agg(F.count("*").alias("calls"), n.alias("results"), F.count_if(F.col("result.is_error")).alias("errors"), F.coalesce(F.sum("result.tokens"), F.lit(0)).alias("tokens"))
    return out.withColumn("mean_tokens", ratio("tokens", "results")).orderBy(F.desc("tokens"), "tool")


def bash_stats(calls: DataFrame, results: DataFrame, command: str = "command", top: int = 50) -> DataFrame:
    """As tool_stats, by command, the ``top`` ones by tokens (ties: by command)."""
    return tool_stats(calls.withColumn("tool", command_key(command)), results).limit(top)


#: Upper bounds of the token buckets.
BUCKETS = (50, 100, 250, 500, 1000, 2000, 4000, 8000, 16000, 32000)


def token_histogram(results: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Results by tokens, in right-closed buckets; buckets without results too."""
    low = (0, *BUCKETS)
    labels = [f"{a}-{b}" for a, b in zip(low, BUCKETS, strict=False)] + [f"{BUCKETS[-1]}+"]
    return results.agg(*(F.count_if((F.col(tokens) > (a if a else -1)) & (F.col(tokens) <= b if b else F.lit(True))).alias(x) for a, b, x in zip(low, (*BUCKETS, None), labels, strict=True))).unpivot([], labels, "bucket", "results")


def edit_group_stats(calls: DataFrame, key: Column | str, approx: bool = False) -> DataFrame:
    """By a key, calls, resolved, succeeded, failed and unresolved ones, rates, median and 95th percentile of inflation.

    ``approx`` takes the percentiles from a bounded sketch, for groups too large to hold their distinct values.
    """
    quantile = F.percentile_approx if approx else F.percentile
    multi = F.col("mode") == "multi"
    out = calls.groupBy((F.col(key) if isinstance(key, str) else key).alias("key")).agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("success").isNotNull()).alias("resolved"),
        F.count_if(F.col("success")).alias("succeeded"),
        F.count_if(~F.col("success")).alias("failed"),
        F.count_if(F.col("success").isNull()).alias("unresolved"),
        F.count_if(multi).alias("multi"),
        quantile("inflation", 0.5).alias("median_inflation"),
        quantile("inflation", 0.95).alias("p95_inflation"),
    )
    return out.withColumn("multi_rate", ratio("multi", "calls")).withColumn("success_rate", ratio("succeeded", "resolved"))


def edit_summary(calls: DataFrame) -> DataFrame:
    """Counts by mode, by number of edits (1, 2, 3+), by argument style and by failure class, as (kind, value, calls, failed)."""
    size = F.when(F.col("edits_count") >= 3, "3+").otherwise(F.col("edits_count").cast("string"))
    parts = {"mode": F.col("mode"), "edits": size, "style": F.col("arg_style"), "failure": F.col("error_kind"), "all": F.lit("all")}
    long = calls.select("success", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")) for k, v in parts.items()))).alias("p")).select("success", "p.*")
    out = long.filter("value IS NOT NULL").groupBy("kind", "value").agg(F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("failed"), F.count_if(F.col("success").isNotNull()).alias("resolved"))
    return out.withColumn("failure_rate", ratio("failed", "resolved"))


def inflation_stats(edits: DataFrame, approx: bool = False) -> DataFrame:
    """Quantiles of inflation, counts at thresholds and sizes, one row. ``approx`` takes the quantiles from a bounded sketch."""
    q = [(F.percentile_approx if approx else F.percentile)("inflation", p).alias(f"p{int(p * 100)}") for p in (0.5, 0.9, 0.95, 0.99)]
    at = [F.count_if(F.col("inflation") >= n).alias(f"at_least_{n}") for n in (10, 25, 100)]
    over = [F.count_if(F.col("total_bytes") > n * 1024).alias(f"over_{n}k") for n in (1, 4, 16, 64)]
    return edits.agg(F.count("*").alias("edits"), *q, *at, *over)


def failure_by_inflation(calls: DataFrame) -> DataFrame:
    """Failure rate by bucket of inflation."""
    x = F.col("inflation")
    bucket = F.when(x.isNull(), "none").when(x < 4, "<4").when(x < 10, "4-10").when(x < 25, "10-25").otherwise("25+")
    out = calls.groupBy(bucket.alias("bucket")).agg(F.count_if(F.col("success").isNotNull()).alias("resolved"), F.count_if(~F.col("success")).alias("failed"))
    return out.withColumn("failure_rate", ratio("failed", "resolved"))


def same_file_clusters(calls: DataFrame) -> DataFrame:
    """Groups of two calls or more on one file by one assistant row: clusters, rows with one, calls inside, mean size."""
    groups = calls.groupBy("session_id", "assistant_seq", "path").agg(F.count("*").alias("n")).filter("n >= 2")
    rows = F.countDistinct("session_id", "assistant_seq")
    return groups.agg(F.count("*").alias("clusters"), rows.alias("messages"), F.coalesce(F.sum("n"), F.lit(0)).alias("calls"), F.avg("n").alias("mean_calls"))


def read_stats(reads: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Reads, assistant messages, full and partial counts and rate, by the keys."""
    message = F.struct("session_id", "assistant_seq")
    out = reads.groupBy(*(v.alias(k) for k, v in keys.items())).agg(
        F.count("*").alias("reads"), F.countDistinct(message).alias("messages"), F.count_if(F.col("mode") == "full").alias("full_reads"), F.count_if(F.col("mode") == "partial").alias("partial_reads")
    )
    return out.withColumn("partial_rate", ratio("partial_reads", "reads"))


def read_stats_per_session(reads: DataFrame, bucket: Column, approx: bool = False) -> DataFrame:
    """By bucket, sessions, reads a session, and the median of the sessions' partial rates (``approx``: from a bounded sketch)."""
    own = reads.groupBy(bucket.alias("bucket"), "session_id").agg(F.count("*").alias("n"), F.avg((F.col("mode") == "partial").cast("int")).alias("rate"))
    return own.groupBy("bucket").agg(F.count("*").alias("sessions"), F.avg("n").alias("reads_per_session"), (F.percentile_approx("rate", 0.5) if approx else F.median("rate")).alias("median_partial_rate"))


def extract_file_ops(calls: DataFrame, path: Column | str = "path") -> DataFrame:
    """(session_id, seq, op, path) of read, write and edit calls that name a path."""
    p = F.col(path) if isinstance(path, str) else path
    return calls.filter(F.col("tool").isin("read", "write", "edit")).select("session_id", "seq", F.col("tool").alias("op"), p.alias("path")).filter("path IS NOT NULL")


def file_lists(ops: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Sorted lists of modified files and of files only read. ``earlier``: session_id, read, modified lists of a past summary."""
    out = ops.groupBy("session_id").agg(F.collect_set(F.when(F.col("op") == "read", F.col("path"))).alias("r"), F.collect_set(F.when(F.col("op") != "read", F.col("path"))).alias("m"))
    if earlier is not None:
        e = earlier.select("session_id", F.col("read").alias("er"), F.col("modified").alias("em"))
        out = out.join(e, "session_id", "full")
        none = F.array().cast("array<string>")
        out = out.select("session_id", *(F.array_union(F.coalesce(a, none), F.coalesce(b, none)).alias(a) for a, b in (("r", "er"), ("m", "em"))))
    return out.select("session_id", F.array_sort("m").alias("modified"), F.array_sort(F.array_except("r", "m")).alias("read_only"))


def worst_edits(edits: DataFrame, top: int = 20) -> DataFrame:
    """the most inflated edits, those without a core first, then by size and path."""
    return edits.orderBy(F.desc_nulls_first("inflation"), F.desc("total_bytes"), F.asc("path")).limit(top)


def split_deferred_tools(added: DataFrame, used: DataFrame, tools: DataFrame) -> DataFrame:
    """H3: each session's tools with ``deferred``: added in its course and not used before."""
    a = added.groupBy("session_id", "tool").agg(F.min("seq").alias("added_at"))
    u = used.groupBy("session_id", "tool").agg(F.min("seq").alias("used_at"))
    out = tools.join(a, ["session_id", "tool"], "left").join(u, ["session_id", "tool"], "left")
    return out.select("session_id", "tool", F.coalesce(F.col("added_at").isNotNull() & (F.col("used_at").isNull() | (F.col("used_at") > F.col("added_at"))), F.lit(False)).alias("deferred"))


def normalize_tool_call_ids(calls: DataFrame, results: DataFrame, most: int = 64) -> tuple[DataFrame, DataFrame]:
    """Ids of letters, digits, _ and -, at most ``most``; piped ids at most 40, cut ones with a hash. Results follow."""
    safe = lambda x: F.regexp_replace(x, r"[^A-Za-z0-9_-]", "_")
    call, item = safe(F.substring_index("call_id", "|", 1)), safe(F.expr("substring(call_id, instr(call_id, '|') + 1)"))
    both = F.when(item != "", F.concat(call, F.lit("_"), item)).otherwise(call)
    piped = F.when(F.length(both) <= 40, both).otherwise(F.concat(F.substring(call, 1, 31), F.lit("_"), F.substring(F.sha2("call_id", 256), 1, 8)))
    new = F.when(F.col("call_id").contains("|"), piped).otherwise(F.substring(safe(F.col("call_id")), 1, most))
    mapping = calls.select(*KEY, new.alias("_new")).distinct()
    rename = lambda df: df.join(mapping, KEY, "left").withColumn("call_id", F.coalesce("_new", "call_id")).drop("_new")
    return rename(calls), rename(results)


def analyze_replacements(edits: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """Adds old_bytes, new_bytes, total_bytes, prefix_bytes, suffix_bytes, core_bytes, wrapper_bytes and inflation.

    Shared prefix and suffix are counted in characters and sized in UTF-8 bytes. inflation is null where nothing changed.
    """
    names = ["old_bytes", "new_bytes", "prefix_bytes", "suffix_bytes"]
    schema = T.StructType([*edits.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])

    def common(a: str, b: str) -> int:
        """Length of the shared prefix, by bisection over equal slices."""
        low, high = 0, min(len(a), len(b))
        while low < high:
            mid = (low + high + 1) // 2
            if a[:mid] == b[:mid]:
                low = mid
            else:
                high = mid - 1
        return low

    def run(batches):
        for batch in batches:
            rows = []
            for a, b in zip(batch.column(old).to_pylist(), batch.column(new).to_pylist(), strict=True):
                a, b = a or "", b or ""
                p = common(a, b)
                s = common(a[p:][::-1], b[p:][::-1])
                rows.append((len(a.encode()), len(b.encode()), len(a[:p].encode()), len(a[len(a) - s :].encode())))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in cols)], names=[*batch.schema.names, *names])

    out = edits.mapInArrow(run, schema)
    shared = F.col("prefix_bytes") + F.col("suffix_bytes")
    out = out.withColumn("total_bytes", F.col("old_bytes") + F.col("new_bytes")).withColumn("core_bytes", F.col("total_bytes") - 2 * shared).withColumn("wrapper_bytes", 2 * shared)
    return out.withColumn("inflation", ratio("total_bytes", "core_bytes"))


def analyze_calls(edits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per call, sums over its edits, and the median and largest inflation of them. Rows: analyze_replacements."""
    sums = ["old_bytes", "new_bytes", "total_bytes", "prefix_bytes", "suffix_bytes", "core_bytes", "wrapper_bytes"]
    out = edits.groupBy(*keys).agg(F.count("*").alias("edits"), *(F.sum(c).alias(c) for c in sums), F.count_if(F.col("core_bytes") == 0).alias("no_core_edits"), F.median("inflation").alias("median_inflation"), F.max("inflation").alias("max_inflation"))
    return out.withColumn("inflation", ratio("total_bytes", "core_bytes"))



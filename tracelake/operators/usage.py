"""Token and cost accounting. Grain of ``usage``: one row a usage-bearing entry, key (session_id, seq).

Columns: session_id, seq, ts, provider, model, type, stop_reason, input, output, cache_read, cache_write, cost_micro (integer
micro-dollars: sums are exact, dollars are made at the edge).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.scalars import provider_model
from tracelake.functions.scans import Scan, scanned

TOKENS = ("input", "output", "cache_read", "cache_write")

#: Error texts of context overflow, and of throttling that isn't one; matched without regard to case.
OVERFLOW = [
    r"prompt is too long",
    r"request_too_large",
    r"input is too long for requested model",
    r"exceeds the context window",
    r"exceeds (?:the )?(?:model'?s )?maximum context length(?: of [\d,]+ tokens?|\s*\([\d,]+\))",
    r"input token count.*exceeds the maximum",
    r"maximum prompt length is \d+",
    r"reduce the length of the messages",
    r"maximum context length is \d+ tokens",
    r"exceeds (?:the )?maximum allowed input length of [\d,]+ tokens?",
    r"input \(\d+ tokens\) is longer than the model'?s context length \(\d+ tokens\)",
    r"exceeds the limit of \d+",
    r"exceeds the available context size",
    r"greater than the context length",
    r"context window exceeds limit",
    r"exceeded model token limit",
    r"too large for model with \d+ maximum context length",
    r"prompt has [\d,]+ tokens?, but the configured context size is [\d,]+ tokens?",
    r"model_context_window_exceeded",
    r"prompt too long; exceeded (?:max )?context length",
    r"range of input length should be",
    r"context[_ ]length[_ ]exceeded",
    r"too many tokens",
    r"token limit exceeded",
    r"^4(?:00|13)\s*(?:status code)?\s*\(no body\)",
]
NOT_OVERFLOW = [r"^(Throttling error|Service unavailable):", r"rate limit", r"too many requests"]
#: Error texts of transient failures, and of limits that a retry doesn't lift.
RETRYABLE = [
    "overloaded", "rate.?limit", "too many requests", "429", "500", "502", "503", "504", "524", "service.?unavailable", "server.?error",
    "internal.?error", "provider.?returned.?error", "network.?error", "connection.?error", "connection.?refused", "connection.?lost",
    "other side closed", "fetch failed", "upstream.?connect", "reset before headers", "socket hang up", "socket connection was closed",
    "timed? out", "timeout", "terminated", "websocket.?closed", "websocket.?error", "ended without", "stream ended before message_stop",
    "stream ended before a terminal response event", "http2 request did not get a response", "retry delay", "you can retry your request",
    "try your request again", "please retry your request", "ResourceExhausted",
]
NOT_RETRYABLE = ["GoUsageLimitError", "FreeUsageLimitError", "Monthly usage limit reached", "available balance", "insufficient_quota", "out of budget", "quota exceeded", "billing"]


def matches_any(text: Column, patterns: Sequence[str]) -> Column:
    """One alternation, without regard to case; null text matches nothing."""
    return F.coalesce(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def filter_model(usage: DataFrame, contains: str | None = None, prefixes: Sequence[str] = ()) -> DataFrame:
    """Models whose provider/model name contains a text, or begins with any of the prefixes, in any case."""
    name = F.lower(provider_model("provider", "model"))
    keep = F.lit(True) if contains is None else name.contains(contains.lower())
    if prefixes:
        any_of = F.lit(False)
        for p in prefixes:
            any_of = any_of | name.startswith(p.lower())
        keep = keep & any_of
    return usage.filter(keep)


def since(df: DataFrame, start, column: str = "ts") -> DataFrame:
    """C4: rows at or after a timestamp."""
    return df.filter(F.col(column) >= F.lit(start))


def last_n_days(df: DataFrame, days: int, today, column: str = "ts") -> DataFrame:
    """C4: ``days`` calendar days of which ``today`` is the last, half-open."""
    day = F.lit(today).cast("date")
    return df.filter((F.col(column) >= F.date_sub(day, days - 1)) & (F.col(column) < F.date_add(day, 1)))


def is_context_overflow(stop: Column, error: Column, input_tokens: Column, cache_read: Column, output: Column, window: Column) -> Column:
    """An overflow error text; a stop with more input than the window; or a length stop without output at 99 % of it."""
    by_text = (stop == "error") & ~matches_any(error, NOT_OVERFLOW) & matches_any(error, OVERFLOW)
    sent = input_tokens + cache_read
    silent = (window > 0) & (((stop == "stop") & (sent > window)) | ((stop == "length") & (output == 0) & (sent >= window * 0.99)))
    return F.coalesce(by_text, F.lit(False)) | F.coalesce(silent, F.lit(False))


def is_retryable(stop: Column, error: Column, overflow: Column | None = None) -> Column:
    """A transient error; quota and billing errors and overflows are not."""
    out = F.coalesce((stop == "error") & ~matches_any(error, NOT_RETRYABLE) & matches_any(error, RETRYABLE), F.lit(False))
    return out if overflow is None else out & ~overflow


def context_tokens(total: Column | None = None) -> Column:
    """The provider's own total, else the sum of the parts."""
    parts = F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write")
    return parts if total is None else F.coalesce(F.nullif(total, F.lit(0)), parts)


def valid_usage(usage: DataFrame) -> DataFrame:
    """C11: requests that ended neither in error nor aborted and that used tokens."""
    return usage.filter(~F.col("stop_reason").isin("error", "aborted") & (context_tokens() > 0) & (F.col("type") == "message"))


def with_context_window(usage: DataFrame, catalog: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Adds context_window by provider and model; an override beats the catalog, and neither leaves null."""
    window = catalog.select("provider", "model", F.col("context_window").alias("_catalog"))
    out = usage.join(window, ["provider", "model"], "left")
    if overrides is None:
        return out.withColumnRenamed("_catalog", "context_window")
    own = overrides.select("provider", "model", F.col("context_window").alias("_own"))
    return out.join(own, ["provider", "model"], "left").withColumn("context_window", F.coalesce("_own", "_catalog")).drop("_own", "_catalog")


def price_tier(tokens: Column, tiers: Column) -> Column:
    """The tier of the highest threshold strictly below the tokens; null where base rates hold.

    ``tiers``: array of structs whose first field is the threshold. A range match without a join.
    """
    return F.array_max(F.filter(tiers, lambda t: t["above"] < tokens))


def price_usage(usage: DataFrame, tiers: Column, base: Column, hour_writes: Column | None = None) -> DataFrame:
    """Cost columns in micro-dollars, at rates in dollars a million tokens. The tier goes by all input of a request.

    ``base`` and each tier are structs with input, output, cache_read, cache_write. ``hour_writes``: tokens of cache_write that
    are kept an hour; they cost twice the input rate.
    """
    hours = F.lit(0) if hour_writes is None else F.coalesce(hour_writes, F.lit(0))
    asked = F.col("input") + F.col("cache_read") + F.col("cache_write")
    tier = price_tier(asked, tiers)
    rate = {k: F.coalesce(tier[k], base[k]) for k in TOKENS}
    out = usage
    for k in ("input", "output", "cache_read"):
        out = out.withColumn(f"cost_{k}", F.round(F.col(k) * rate[k]).cast("long"))
    out = out.withColumn("cost_cache_write", F.round((F.col("cache_write") - hours) * rate["cache_write"] + hours * 2 * rate["input"]).cast("long"))
    return out.withColumn("cost_total", sum((F.col(f"cost_{k}") for k in TOKENS), F.lit(0)))


def cost_by_day_provider(usage: DataFrame, costs: Sequence[str] = ("cost_micro",)) -> DataFrame:
    """Cost sums and requests by UTC day and provider, by day, by provider, and in all. Rows without a cost (null) don't count; those that cost nothing do."""
    paid = usage.filter(F.col(costs[-1]).isNotNull()).select(F.to_date("ts").cast("string").alias("day"), "provider", *costs)
    return paid.cube("day", "provider").agg(*(F.sum(c).alias(c) for c in costs), F.count("*").alias("requests"), F.grouping_id().cast("long").alias("level"))


def usage_by_day_provider(usage: DataFrame, day: Column | None = None, approx: bool = False) -> DataFrame:
    """Token and cost sums, messages and distinct sessions by day and provider, rolled up. ``approx`` counts sessions by sketch."""
    rows = usage.withColumn("day", day if day is not None else F.to_date("ts").cast("string"))
    sums = [F.sum(c).alias(c) for c in (*TOKENS, "cost_micro")]
    return rows.rollup("day", "provider").agg(*sums, F.count("*").alias("messages"), (F.approx_count_distinct("session_id") if approx else F.countDistinct("session_id")).alias("sessions"), F.grouping_id().cast("long").alias("level"))


def usage_cost_breakdown(usage: DataFrame) -> DataFrame:
    """Tokens and cost by provider/model; usage of tools and summaries in one group; groups without any are left out;
    the dearest first."""
    key = F.when(F.col("type") == "message", provider_model("provider", "model")).otherwise("[summaries and tools]")
    tokens = context_tokens()
    out = usage.groupBy(key.alias("model")).agg(F.sum("cost_micro").alias("cost_micro"), F.sum(tokens).alias("tokens"))
    return out.filter("cost_micro > 0 OR tokens > 0").orderBy(F.desc("cost_micro"), "model")


def session_stats(usage: DataFrame, include_tool_usage: bool = True) -> DataFrame:
    """A session's requests, errors, compactions, token sums and cost. Without tool usage, messages' own usage only."""
    counted = F.lit(True) if include_tool_usage else F.col("type") == "message"
    sums = [F.coalesce(F.sum(F.when(counted, F.col(c))), F.lit(0)).alias(c) for c in (*TOKENS, "cost_micro")]
    return usage.groupBy("session_id").agg(
        F.count_if(F.col("type") == "message").alias("messages"), F.count_if(F.col("stop_reason") == "error").alias("errors"), F.count_if(F.col("type") == "compaction").alias("compactions"), *sums
    )


def message_counts(messages: DataFrame) -> DataFrame:
    """A session's user, assistant, tool-result and all messages."""
    by = {"user": "user_messages", "assistant": "assistant_messages", "toolResult": "tool_results"}
    return messages.groupBy("session_id").agg(*(F.count_if(F.col("role") == r).alias(n) for r, n in by.items()), F.count("*").alias("messages"))


def session_stats_cached(usage: DataFrame) -> DataFrame:
    """E5: cached, uncached and all tokens, cost and messages; rows with a missing count are skipped."""
    whole = usage.dropna(subset=[*TOKENS, "cost_micro"]).filter("type = 'message'")
    return whole.groupBy("session_id").agg(
        F.sum("cache_read").alias("cached_tokens"),
        F.sum(F.col("input") + F.col("cache_write")).alias("uncached_tokens"),
        F.sum(context_tokens()).alias("total_tokens"),
        F.sum("cost_micro").alias("cost_micro"),
        F.count("*").alias("messages"),
    )


def combine_usage(usage: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Field-wise sums; a field that no row has stays null."""
    return usage.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in columns))


def last_usage(usage: DataFrame) -> DataFrame:
    """the last valid usage of each session."""
    last = valid_usage(usage).groupBy("session_id").agg(F.max_by(F.struct("seq", "provider", "model", context_tokens().alias("tokens")), "seq").alias("x"))
    return last.select("session_id", "x.*")


def latest_compaction(usage: DataFrame) -> DataFrame:
    """the sequence of each session's latest compaction."""
    return usage.filter("type = 'compaction'").groupBy("session_id").agg(F.max("seq").alias("seq"))


def last_assistant_text(messages: DataFrame) -> DataFrame:
    """the last assistant text of each session; aborted rows without text are passed over."""
    rows = messages.filter((F.col("role") == "assistant") & ~((F.coalesce(F.col("stop_reason"), F.lit("stop")) == "aborted") & (F.trim(F.coalesce("text", F.lit(""))) == "")))
    return rows.groupBy("session_id").agg(F.max_by("text", "seq").alias("text"))


def model_in_effect(entries: DataFrame, columns: Sequence[str] = ("provider", "model")) -> DataFrame:
    """At each row, the latest values set at or before it (null: not set there)."""
    rows = entries.select("session_id", "seq", *columns)
    return scanned(rows, **{f"{c}_in_effect": Scan("last", F.col(c)) for c in columns}).select("session_id", "seq", *(f"{c}_in_effect" for c in columns))


def model_level_configs(entries: DataFrame, columns: Sequence[str] = ("provider", "model")) -> DataFrame:
    """Distinct combinations that were in force in each session."""
    return model_in_effect(entries, columns).select("session_id", *(F.col(f"{c}_in_effect").alias(c) for c in columns)).dropna(how="all", subset=list(columns)).distinct()


#: Where each API keeps its counts. A list is tried in order; ``less`` is taken off the input, floor 0.
USAGE_FIELDS = {
    "openai-completions": {"input": ["$.prompt_tokens"], "output": ["$.completion_tokens"], "cache_read": ["$.prompt_tokens_details.cached_tokens", "$.prompt_cache_hit_tokens"], "cache_write": ["$.prompt_tokens_details.cache_write_tokens"], "reasoning": ["$.completion_tokens_details.reasoning_tokens"], "less": ("cache_read", "cache_write")},
    "openai-responses": {"input": ["$.input_tokens"], "output": ["$.output_tokens"], "cache_read": ["$.input_tokens_details.cached_tokens"], "cache_write": ["$.input_tokens_details.cache_write_tokens"], "reasoning": ["$.output_tokens_details.reasoning_tokens"], "total": ["$.total_tokens"], "less": ("cache_read", "cache_write")},
    "google": {"input": ["$.promptTokenCount"], "output": ["$.candidatesTokenCount"], "cache_read": ["$.cachedContentTokenCount"], "cache_write": [], "reasoning": ["$.thoughtsTokenCount"], "total": ["$.totalTokenCount"], "less": ("cache_read",), "add_reasoning": True},
    "anthropic": {"input": ["$.input_tokens"], "output": ["$.output_tokens"], "cache_read": ["$.cache_read_input_tokens"], "cache_write": ["$.cache_creation_input_tokens"], "reasoning": [], "less": ()},
    "bedrock": {"input": ["$.inputTokens"], "output": ["$.outputTokens"], "cache_read": ["$.cacheReadInputTokens"], "cache_write": ["$.cacheWriteInputTokens"], "reasoning": [], "total": ["$.totalTokens"], "less": ()},
    "mistral": {"input": ["$.promptTokens", "$.prompt_tokens"], "output": ["$.completionTokens", "$.completion_tokens"], "cache_read": ["$.promptTokensDetails.cachedTokens", "$.prompt_tokens_details.cached_tokens", "$.numCachedTokens", "$.num_cached_tokens"], "cache_write": [], "reasoning": [], "total": ["$.totalTokens", "$.total_tokens"], "less": ("cache_read",)},
}


def normalize_usage(raw: DataFrame, api: str = "api", payload: str = "payload", parsers: dict | None = None) -> DataFrame:
    """One schema of counts from each API's usage payload (a variant). ``parsers`` adds or replaces APIs."""
    fields = USAGE_FIELDS | (parsers or {})

    def read(spec: dict, name: str) -> Column:
        found = [F.try_variant_get(F.col(payload), p, "long") for p in spec.get(name, [])]
        return F.coalesce(*found, F.lit(0))

    out: dict[str, Column] = {}
    for name, spec in fields.items():
        parts = {k: read(spec, k) for k in ("input", "output", "cache_read", "cache_write", "reasoning")}
        if name == "mistral":
            parts["cache_read"] = F.least(parts["input"], F.greatest(F.lit(0), parts["cache_read"]))
        for k in spec["less"]:
            parts["input"] = parts["input"] - parts[k]
        if spec["less"] and name != "google":
            parts["input"] = F.greatest(F.lit(0), parts["input"])
        if spec.get("add_reasoning"):
            parts["output"] = parts["output"] + parts["reasoning"]
        sums = parts["input"] + parts["output"] + parts["cache_read"] + parts["cache_write"]
        total = read(spec, "total")
        parts["total_tokens"] = sums if "total" not in spec else F.coalesce(F.nullif(total, F.lit(0)), sums) if name in ("bedrock", "mistral") else total
        for k, v in parts.items():
            out[k] = F.when(F.col(api) == name, v) if k not in out else out[k].when(F.col(api) == name, v)
    return raw.withColumns(out)


#: Finish codes by API; * is the rest. ``error:`` marks codes whose text is kept.
STOP_REASONS = {
    "openai-completions": {None: "stop", "stop": "stop", "end": "stop", "length": "length", "function_call": "toolUse", "tool_calls": "toolUse", "*": "error"},
    "openai-responses": {None: "stop", "completed": "stop", "incomplete": "length", "failed": "error", "cancelled": "error", "in_progress": "stop", "queued": "stop", "*": "error"},
    "google": {"STOP": "stop", "MAX_TOKENS": "length", "*": "error"},
    "anthropic": {"end_turn": "stop", "max_tokens": "length", "tool_use": "toolUse", "refusal": "error", "pause_turn": "stop", "stop_sequence": "stop", "sensitive": "error", "*": "raise"},
    "bedrock": {"end_turn": "stop", "stop_sequence": "stop", "max_tokens": "length", "model_context_window_exceeded": "length", "tool_use": "toolUse", "*": "error"},
    "mistral": {None: "stop", "stop": "stop", "length": "length", "model_length": "length", "tool_calls": "toolUse", "error": "error", "*": "stop"},
}


def normalize_stop_reason(raw: DataFrame, api: str = "api", code: str = "code", strict: bool = False) -> DataFrame:
    """Adds stop_reason and error_message. A code that an API calls an error to meet fails the job if ``strict``, else is an error row."""
    reason, message = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, codes in STOP_REASONS.items():
        here = F.lit(None).cast("string")
        for given, meaning in codes.items():
            if given != "*":
                here = F.coalesce(here, F.when(F.col(code).isNull() if given is None else F.col(code) == given, meaning))
        rest = codes["*"]
        if rest == "raise":
            rest_col = F.raise_error(F.concat(F.lit("Unhandled stop reason: "), F.coalesce(F.col(code), F.lit("null")))) if strict else F.lit("error")
        else:
            rest_col = F.lit(rest)
        here = F.when(here.isNotNull(), here).otherwise(rest_col.cast("string"))
        reason = F.when(F.col(api) == name, here).otherwise(reason)
    out = raw.withColumn("stop_reason", reason)
    note = F.when(F.col(api) == "openai-completions", F.concat(F.lit("Provider finish_reason: "), F.col(code))).when((F.col(api) == "anthropic") & (F.col(code) == "refusal"), "The model refused to complete the request").otherwise(F.col(code))
    return out.withColumn("error_message", F.when(F.col("stop_reason") == "error", note).otherwise(message))

"""Context windows, compaction and caching. Grain: one row a message or entry, key (session_id, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.scalars import IMAGE_CHARS, estimate, truncate_result, utf16_length
from tracelake.functions.scans import Scan, scanned
from tracelake.operators.tools import extract_file_ops, file_lists
from tracelake.operators.usage import context_tokens, is_context_overflow


#: The defaults of compaction and of the cache.
RESERVE_TOKENS = 16_384
KEEP_RECENT_TOKENS = 20_000
CACHE_NOISE_TOKENS = 1_024
TURN_STARTS = ("user", "bashExecution", "custom", "branchSummary", "compactionSummary")
CUT_ROLES = (*TURN_STARTS, "assistant")
SUMMARY_MARKS = {
    "branchSummary": ("The following is a summary of a branch that this conversation came back from:\n\n<summary>\n", "</summary>"),
    "compactionSummary": ("The conversation history before this point was compacted into the following summary:\n\n<summary>\n", "\n</summary>"),
}


def entries_to_context(entries: DataFrame) -> DataFrame:
    """Entries that stand for a message, with the message's role; the other kinds give none."""
    summary = F.trim(F.coalesce(F.col("summary"), F.lit(""))) != ""
    role = F.when(F.col("type") == "message", F.col("role")).when(F.col("type") == "custom_message", "custom").when((F.col("type") == "branch_summary") & summary, "branchSummary").when(F.col("type") == "compaction", "compactionSummary")
    return entries.withColumn("role", role).filter("role IS NOT NULL")


def entries_to_context_harness(entries: DataFrame, projectors: dict | None = None) -> DataFrame:
    """As B5; a compaction is followed by the messages of its retained tail, and custom entries by what their projector makes.

    ``retained_tail``: array of structs (role, text). ``projectors``: custom type -> function of the entries to (session_id, seq, role, text).
    """
    base = entries_to_context(entries).select("session_id", "seq", F.lit(0).alias("part"), "role", F.coalesce("text", "summary").alias("text"))
    tail = entries.filter("type = 'compaction'").select("session_id", "seq", F.posexplode("retained_tail").alias("k", "m")).select("session_id", "seq", (F.col("k") + 1).alias("part"), F.col("m.role").alias("role"), F.col("m.text").alias("text"))
    out = base.unionByName(tail)
    for kind, project in (projectors or {}).items():
        made = project(entries.filter((F.col("type") == "custom") & (F.col("custom_type") == kind)))
        out = out.unionByName(made.select("session_id", "seq", F.lit(0).alias("part"), "role", "text"))
    return out


def shell_text(command: Column, output: Column, exit_code: Column, cancelled: Column, truncated: Column, full_path: Column) -> Column:
    """A shell run as the text a model is given. Its wording is fixed."""
    fence = "```"
    body = F.when(F.coalesce(output, F.lit("")) != "", F.concat(F.lit(fence + "\n"), output, F.lit("\n" + fence))).otherwise("(no output)")
    end = F.when(F.coalesce(cancelled, F.lit(False)), "\n\n(command cancelled)").when(F.coalesce(exit_code, F.lit(0)) != 0, F.concat(F.lit("\n\nCommand exited with code "), exit_code.cast("string"))).otherwise("")
    note = F.when(F.coalesce(truncated, F.lit(False)) & full_path.isNotNull(), F.concat(F.lit("\n\n[Output truncated. Full output: "), full_path, F.lit("]"))).otherwise("")
    return F.concat(F.lit("Ran `"), command, F.lit("`\n"), body, end, note)


def to_llm_messages(messages: DataFrame) -> DataFrame:
    """The roles that models don't know become user rows; shell runs kept out of context are dropped; summaries are wrapped."""
    role = F.col("role")
    rows = messages.filter(~((role == "bashExecution") & F.coalesce("exclude_from_context", F.lit(False))))
    text = F.when(role == "bashExecution", shell_text(*(F.col(c) for c in ("command", "output", "exit_code", "cancelled", "truncated", "full_output_path"))))
    for r, (head, end) in SUMMARY_MARKS.items():
        text = text.when(role == r, F.concat(F.lit(head), F.col("summary"), F.lit(end)))
    known = role.isin("user", "assistant", "toolResult")
    return rows.withColumn("text", text.otherwise(F.col("text"))).withColumn("role", F.when(known, role).otherwise("user"))


#: What stands for images that a model can't read.
IMAGE_NOTES = {"user": "(image omitted: model does not support images)", "toolResult": "(tool image omitted: model does not support images)"}


def images_as_note(content: Column, note: str) -> Column:
    """Blocks with each run of images, or of images after the same note, as one text note."""
    is_image = F.transform(content, lambda b: b["type"] == "image")
    noted = F.transform(content, lambda b: F.when(b["type"] == "image", b.withField("type", F.lit("text")).withField("text", F.lit(note))).otherwise(b))
    after_note = lambda i: F.coalesce((F.get(noted, i - 1)["type"] == "text") & (F.get(noted, i - 1)["text"] == note), F.lit(False))
    return F.filter(noted, lambda b, i: ~(F.get(is_image, i) & after_note(i)))


def normalize_for_model(messages: DataFrame, provider: str, api: str, model: str, images: bool) -> DataFrame:
    """History for another model. ``content``: array of structs (type, text, thinking, redacted, signature, id, name).

    Image runs become one note; redacted and empty thinking goes, other thinking becomes text; signatures go; rows that ended in
    error or aborted are dropped. Rows of the same model keep their thinking and signatures.
    """
    same = (F.col("provider") == provider) & (F.col("api") == api) & (F.col("model") == model)
    same = F.coalesce(same, F.lit(False))
    rows = messages.filter(~((F.col("role") == "assistant") & F.coalesce(F.col("stop_reason").isin("error", "aborted"), F.lit(False))))
    content = F.col("content")
    if not images:
        for role, note in IMAGE_NOTES.items():
            content = F.when(F.col("role") == role, images_as_note(F.col("content"), note)).otherwise(content)
        rows, content = rows.withColumn("content", content), F.col("content")
    thinking = lambda b: b["type"] == "thinking"
    redacted = lambda b: F.coalesce(b["redacted"], F.lit(False))
    empty = lambda b: F.trim(F.coalesce(b["thinking"], F.lit(""))) == ""
    kept = F.filter(content, lambda b: ~thinking(b) | F.when(redacted(b), same).otherwise((same & b["signature"].isNotNull()) | ~empty(b)))
    plain = lambda b: F.when(thinking(b), b.withField("type", F.lit("text")).withField("text", b["thinking"]).withField("thinking", F.lit(None).cast("string")).withField("signature", F.lit(None).cast("string"))).otherwise(b.withField("signature", F.lit(None).cast("string")))
    shaped = F.transform(kept, lambda b: F.when(same, b).otherwise(plain(b)))
    return rows.withColumn("content", F.when(F.col("role") == "assistant", shaped).otherwise(content))


def estimate_tokens(messages: DataFrame) -> Column:
    """Tokens of a message by role, a quarter of its UTF-16 units rounded up; an image counts as 4,800.

    Columns: role, content (blocks), and if there: command, output, summary.
    """
    has = set(messages.columns)
    zero = F.lit(0).cast("long")
    size = lambda x: F.coalesce(utf16_length(x), zero)
    block = lambda b: F.when(b["type"] == "text", size(b["text"])).when(b["type"] == "image", F.lit(IMAGE_CHARS).cast("long")).otherwise(zero)
    said = lambda b: F.when(b["type"] == "text", size(b["text"])).when(b["type"] == "thinking", size(b["thinking"])).when(b["type"] == "toolCall", size(b["name"]) + size(b["arguments"])).otherwise(zero)
    total = lambda f: F.aggregate(F.transform("content", f), zero, lambda a, x: a + x)
    role = F.col("role")
    out = F.when(role.isin("user", "custom", "toolResult"), total(block)).when(role == "assistant", total(said))
    if {"command", "output"} <= has:
        out = out.when(role == "bashExecution", size(F.col("command")) + size(F.col("output")))
    if "summary" in has:
        out = out.when(role.isin("branchSummary", "compactionSummary"), size(F.col("summary")))
    return estimate(F.coalesce(out, zero))


#: Characters of a session's text in one row.
CHUNK_CHARS = 1 << 20


def in_chunks(parts: DataFrame, separator: str, head: Column | None = None, tail: str = "") -> DataFrame:
    """(session_id, chunk, text): the ``part`` of each row in order, with a separator between, as rows of some ``CHUNK_CHARS`` characters.

    A session's chunks, joined by line feeds, are its whole text: chunks after the first begin with the rest of the separator, which begins
    with a line feed. A part is never cut, so a row holds ``CHUNK_CHARS`` and one part at most, whatever the session's length.
    """
    size = F.length("part").cast("long") + len(separator)
    rows = scanned(parts, before=Scan("sum", size, inclusive=False), after=Scan("sum", size, reverse=True, inclusive=False))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "part"))), lambda x: x["part"]), separator)
    out = rows.groupBy("session_id", F.floor(F.col("before") / CHUNK_CHARS).cast("long").alias("chunk")).agg(text.alias("text"), F.min("before").alias("before"), F.min("after").alias("after"))
    begin = F.when(F.col("before") > 0, F.lit(separator[1:])).otherwise(head if head is not None else F.lit(""))
    return out.select("session_id", "chunk", F.concat(begin, F.col("text"), F.when(F.col("after") == 0, F.lit(tail)).otherwise(F.lit(""))).alias("text"))


def serialize_conversation(messages: DataFrame) -> DataFrame:
    """Labelled plain text of each session, in chunks (session_id, chunk, text). Rows: session_id, seq, role, text, and if there: thinking, calls."""
    has, role = set(messages.columns), F.col("role")
    labelled = lambda label, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"[{label}]: "), x))
    own = {"user": [labelled("User", F.col("text"))], "toolResult": [labelled("Tool result", truncate_result("text"))]}
    own["assistant"] = [*([labelled("Assistant thinking", F.col("thinking"))] if "thinking" in has else []), labelled("Assistant", F.col("text")), *([labelled("Assistant tool calls", F.col("calls"))] if "calls" in has else [])]
    part = F.lit(None).cast("string")
    for r, parts in own.items():
        part = F.when(role == r, F.concat_ws("\n\n", *parts)).otherwise(part)
    return in_chunks(messages.select("session_id", "seq", part.alias("part")).filter("part != ''"), "\n\n")


def transcript(messages: DataFrame) -> DataFrame:
    """Each session's user and assistant texts with [ROLE] heads, between marks that name it, in chunks (session_id, chunk, text); blank ones are left out."""
    rows = messages.filter(F.col("role").isin("user", "assistant") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    part = F.concat(F.lit("["), F.upper("role"), F.lit("]\n"), F.col("text"))
    head = F.concat(F.lit("=== SESSION: "), F.coalesce(F.col("session_id").cast("string"), F.lit("")), F.lit(" ===\n"))
    return in_chunks(rows.select("session_id", "seq", part.alias("part")), "\n---\n", head, "\n=== END SESSION ===")


def should_compact(tokens: Column, window: Column, reserve: int = RESERVE_TOKENS, enabled: bool = True) -> Column:
    """More tokens than the window less the reserve."""
    return F.coalesce(tokens > window - reserve, F.lit(False)) if enabled else F.lit(False)


def turn_start(role: Column) -> Column:
    """C14: rows that a turn begins with."""
    return F.coalesce(role.isin(*TURN_STARTS), F.lit(False))


def cut_point(role: Column) -> Column:
    """C14: rows in front of which history may be cut: turn starts, summaries and assistant rows, never tool results."""
    return F.coalesce(role.isin(*CUT_ROLES), F.lit(False))


def requests_in_order(usage: DataFrame) -> DataFrame:
    """Requests with prompt tokens, with ``segment`` (running number of compactions and branch summaries: cached context doesn't reach
    across), the prompt, model and time of the request before in it, and ``reported``: one before it in its segment used the cache."""
    prompt = F.col("input") + F.col("cache_read") + F.col("cache_write")
    bound, asked = F.col("type").isin("compaction", "branch_summary"), (F.col("type") == "message") & (F.col("prompt") > 0)
    before = F.struct(bound.alias("bound"), "prompt", F.struct("provider", "model").alias("model"), "ts")
    rows = scanned(
        usage.withColumn("prompt", prompt),
        segment=Scan("sum", bound.cast("long")),
        before=Scan("last", F.when(bound | asked, before), inclusive=False),
        bound_seq=Scan("max", F.when(bound, F.col("seq"))),
        cached_seq=Scan("max", F.when(asked & (F.col("cache_read") + F.col("cache_write") > 0), F.col("seq")), inclusive=False),
    ).filter(asked)
    prev = F.when(~F.col("before.bound"), F.col("before"))
    out = rows.withColumn("before", prev).withColumns({"prev_prompt": F.col("before.prompt"), "prev_model": F.col("before.model"), "prev_ts": F.col("before.ts")})
    return out.withColumn("reported", F.coalesce(F.col("cached_seq") > F.coalesce("bound_seq", F.lit(-(2**62))), F.lit(False))).drop("before", "bound_seq", "cached_seq")


def previous_request(usage: DataFrame) -> DataFrame:
    """Each request with prompt tokens, with the prompt, model and time of the one before it in its segment."""
    return requests_in_order(usage).drop("reported")


def cache_misses(usage: DataFrame, rates: DataFrame | None = None, noise: int = CACHE_NOISE_TOKENS) -> DataFrame:
    """G1: requests that sent again what a cache had held: missed tokens, extra cost (micro-dollars), idle seconds, model change.

    A row counts if more than ``noise`` tokens were missed. Costs of parts: cost_input, cost_cache_write, cost_cache_read in
    micro-dollars; ``rates``: provider, model, cache_read_rate (micro-dollars a token) for rows that read nothing.
    """
    rows = requests_in_order(usage)
    cached = F.col("cache_read") + F.col("cache_write")
    missed = F.least("prev_prompt", "prompt") - F.col("cache_read")
    out = rows.filter(F.col("prev_prompt").isNotNull() & ((cached > 0) | F.col("reported"))).withColumn("missed", missed).filter(F.col("missed") > noise)
    out = out.withColumn("model_changed", F.col("prev_model") != F.struct("provider", "model")).withColumn("idle_s", F.greatest(F.lit(0).cast("double"), F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.unix_micros(F.col("prev_ts").cast("timestamp")) / 1e6))
    if "cost_input" not in usage.columns:
        return out
    if rates is not None:
        out = out.join(rates, ["provider", "model"], "left")
    listed = F.coalesce(F.col("cache_read_rate"), F.lit(0.0)) if rates is not None else F.lit(0.0)
    fresh = F.col("input") + F.col("cache_write")
    paid = F.when(fresh > 0, (F.col("cost_input") + F.col("cost_cache_write")) / fresh).otherwise(0.0)
    read = F.when(F.col("cache_read") > 0, F.col("cost_cache_read") / F.col("cache_read")).otherwise(listed)
    return out.withColumn("extra_micro", F.col("missed") * F.greatest(F.lit(0.0), paid - read))


def cache_waste(misses: DataFrame) -> DataFrame:
    """A session's missed tokens, misses and, if priced, extra cost. Rows: cache_misses."""
    cost = [F.sum("extra_micro").alias("extra_micro")] if "extra_micro" in misses.columns else []
    return misses.groupBy("session_id").agg(F.sum("missed").alias("missed_tokens"), F.count("*").alias("misses"), *cost)


def find_cut_point(entries: DataFrame, keep_tokens: int = KEEP_RECENT_TOKENS) -> DataFrame:
    """Where to cut each session's rows: cut, turn_start (-1: none) and split. Rows: session_id, seq, role, tokens (0: metadata), is_message.

    The last row from which ``keep_tokens`` follow sets the place; the cut is the next allowed row, moved back over metadata
    rows; a cut inside a turn names that turn's first row. Without an allowed row the cut is the first row. Rows of type compaction,
    if there is such a column, are neither cut at nor turn starts.
    """
    plain = F.col("type") != "compaction" if "type" in entries.columns else F.lit(True)
    allowed, starts = cut_point(F.col("role")) & plain, turn_start(F.col("role")) & plain
    rows = entries.select("session_id", "seq", "role", "tokens", allowed.alias("ok"), starts.alias("starts"), (F.col("is_message") if "is_message" in entries.columns else F.lit(True)).alias("shown"))
    seq = F.col("seq")
    rows = scanned(
        rows,
        suffix=Scan("sum", F.col("tokens"), reverse=True),
        prev=Scan("last", F.struct("seq", "shown"), inclusive=False),
        turn=Scan("max", F.when(F.col("starts"), seq)),
    )
    # where the metadata rows in front of a row begin: after the last shown row before it
    place = F.struct("seq", "starts", "turn")
    rows = scanned(rows, back=Scan("last", F.when(F.col("prev").isNull() | F.col("prev.shown"), place)))
    rows = scanned(rows, next=Scan("last", F.when(F.col("ok"), F.col("back")), reverse=True))
    enough = (F.col("tokens") > 0) & (F.col("suffix") >= keep_tokens)
    found = rows.groupBy("session_id").agg(F.max_by("next", F.when(enough, seq)).alias("at"), F.min_by("back", F.when(F.col("ok"), seq)).alias("ok"), F.min("seq").alias("first"))
    cut = F.coalesce("at", "ok")
    turn = F.when(cut.isNull() | cut["starts"], F.lit(-1)).otherwise(F.coalesce(cut["turn"], F.lit(-1))).cast("long")
    return found.select("session_id", F.coalesce(cut["seq"], "first").alias("cut"), turn.alias("turn_start"), (turn >= 0).alias("split"))


def prepare_compaction(path: DataFrame, keep_tokens: int = KEEP_RECENT_TOKENS) -> DataFrame:
    """Each path row's ``part``: summarise, turn_prefix, keep, or before (what an earlier summary covers). Nothing for sessions
    that end with a compaction or have nothing to summarise.

    Rows: session_id, seq, type, role, tokens, is_message and if there first_kept_seq.
    """
    kept = F.col("first_kept_seq") if "first_kept_seq" in path.columns else F.lit(None).cast("long")
    marks = path.groupBy("session_id").agg(F.max_by("type", "seq").alias("last_type"), F.max(F.when(F.col("type") == "compaction", F.col("seq"))).alias("c"), F.max_by(kept, F.when(F.col("type") == "compaction", F.col("seq"))).alias("k"), F.min("seq").alias("first"))
    there = path.select("session_id", F.col("seq").alias("k"), F.lit(True).alias("_there"))
    marks = marks.filter("last_type != 'compaction'").join(there, ["session_id", "k"], "left").select("session_id", F.coalesce(F.when(F.col("_there"), F.col("k")), F.col("c") + 1, F.col("first")).alias("start"))
    rows = path.join(marks, "session_id")
    cut = find_cut_point(rows.filter("seq >= start"), keep_tokens)
    rows = rows.join(cut, "session_id").withColumn("end", F.when(F.col("split"), F.col("turn_start")).otherwise(F.col("cut")))
    part = F.when(F.col("seq") < F.col("start"), "before").when(F.col("seq") < F.col("end"), "summarise").when(F.col("seq") < F.col("cut"), "turn_prefix").otherwise("keep")
    rows = rows.withColumn("part", part)
    some = rows.groupBy("session_id").agg(F.count_if(F.col("part").isin("summarise", "turn_prefix")).alias("n")).filter("n > 0")
    return rows.join(some, "session_id", "left_semi").select(*path.columns, "part")


def compaction_files(parts: DataFrame, calls: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """File lists of what a compaction summarises."""
    ops = extract_file_ops(calls).join(parts.filter("part IN ('summarise', 'turn_prefix')").select("session_id", "seq"), ["session_id", "seq"], "left_semi")
    return file_lists(ops, earlier)


def context_usage(messages: DataFrame, prefix_aware: bool = False, prefix_tokens: Column | None = None) -> DataFrame:
    """Tokens in each session's context: the last valid usage and estimates of the rows after it.

    Rows: session_id, seq, role, tokens (estimate), usage_tokens (null: none), stop_reason, and for ``prefix_aware`` ts: there a
    usage older than a row before it doesn't count, and without a usage ``prefix_tokens`` (system prompt, tools) are added.
    """
    ok = (F.col("role") == "assistant") & (F.coalesce("usage_tokens", F.lit(0)) > 0) & ~F.coalesce(F.col("stop_reason").isin("error", "aborted"), F.lit(False))
    rows = messages
    if prefix_aware:
        rows = scanned(rows, _newest=Scan("max", F.col("ts"), inclusive=False))
        ok = ok & (F.col("_newest").isNull() | (F.col("ts") >= F.col("_newest")))
    rows = rows.withColumn("_ok", ok)
    last = rows.groupBy("session_id").agg(F.max(F.when(F.col("_ok"), F.col("seq"))).alias("usage_seq"), F.max_by("usage_tokens", F.when(F.col("_ok"), F.col("seq"))).alias("usage_tokens"))
    after = rows.drop("usage_tokens").join(last, "session_id").groupBy("session_id", "usage_seq", "usage_tokens").agg(F.coalesce(F.sum(F.when(F.col("usage_seq").isNull() | (F.col("seq") > F.col("usage_seq")), F.col("tokens"))), F.lit(0)).alias("trailing"))
    extra = F.when(F.col("usage_seq").isNull(), prefix_tokens if prefix_tokens is not None else F.lit(0)).otherwise(0) if prefix_aware else F.lit(0)
    used = F.coalesce("usage_tokens", F.lit(0))
    trailing = (F.col("trailing") + extra).cast("long")
    return after.select("session_id", "usage_seq", used.cast("long").alias("usage_tokens"), trailing.alias("trailing_tokens"), (used + trailing).cast("long").alias("tokens"))


def select_branch_budget(entries: DataFrame, budget: int) -> DataFrame:
    """The newest rows within a token budget (0: all). The row that goes over stays if it is a summary and less than 90 % was used.

    Tool results take no part. Rows: session_id, seq, role, type, tokens.
    """
    rows = entries.filter("role IS NULL OR role != 'toolResult'")
    if budget == 0:
        return rows
    rows = scanned(rows, _sum=Scan("sum", F.col("tokens"), reverse=True))
    newer = F.col("_sum") - F.col("tokens")  # sums only grow towards older rows, so the first over the budget has all newer ones within
    summary = F.col("type").isin("compaction", "branch_summary") & (newer < 0.9 * budget)
    return rows.filter((F.col("_sum") <= budget) | ((newer <= budget) & summary)).drop("_sum")


def auto_compaction_decision(messages: DataFrame, reserve: int = RESERVE_TOKENS) -> DataFrame:
    """Per assistant row: overflow, overflow_retry, threshold or none.

    Rows of another model than the one in force, aborted ones, and rows older than the last compaction give none. Columns: usage's,
    context_window, error_message, compaction_ts (of the last compaction before, if any), current (is the model in force).
    """
    stop = F.col("stop_reason")
    overflow = is_context_overflow(stop, F.col("error_message"), F.col("input"), F.col("cache_read"), F.col("output"), F.col("context_window"))
    skip = (stop == "aborted") | ~F.coalesce("current", F.lit(True)) | F.coalesce(F.col("ts") <= F.col("compaction_ts"), F.lit(False))
    over = F.when(stop == "stop", "overflow").otherwise("overflow_retry")
    near = (stop != "error") & should_compact(context_tokens(), F.col("context_window"), reserve)
    return messages.withColumn("decision", F.when(skip, "none").when(overflow, over).when(near, "threshold").otherwise("none"))


def retry_episodes(messages: DataFrame, retryable: Column, base_s: float = 2.0, cap: int = 3) -> DataFrame:
    """Runs of consecutive retryable errors: first row, attempts, and the seconds that doubling waits take (at most ``cap`` retries)."""
    rows = messages.withColumn("_bad", retryable)
    rows = scanned(rows, _run=Scan("sum", (~F.col("_bad")).cast("long"))).filter("_bad")
    out = rows.groupBy("session_id", "_run").agg(F.min("seq").alias("first_seq"), F.count("*").alias("attempts"))
    return out.select("session_id", "first_seq", "attempts", (base_s * (F.pow(F.lit(2.0), F.least("attempts", F.lit(cap))) - 1)).alias("backoff_s"))


def context_pressure_sessions(usage: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Per session: largest prompt, tokens before the first compaction, window, percent, flags, duration, compactions.

    ``compaction_tokens`` is a compaction's own size if there is such a column, else its prompt. ``catalog``: provider, model, context_window.
    """
    prompt = F.col("input") + F.col("cache_read") + F.col("cache_write")
    compaction = F.when(F.col("type") == "compaction", F.col("seq"))
    rows = scanned(usage.withColumn("_prompt", prompt), _first=Scan("min", compaction))
    before = (F.col("type") == "message") & F.col("_first").isNull() & (F.col("_prompt") > 0)
    out = rows.groupBy("session_id").agg(
        F.max("_prompt").alias("max_tokens"),
        F.coalesce(F.max_by("_prompt", F.when(before, F.col("seq"))), F.min_by("_prompt", compaction)).alias("tokens_before"),
        F.max_by(F.struct("provider", "model"), F.when(F.col("type") == "message", F.col("seq"))).alias("_m"),
        F.min("ts").alias("start"),
        (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("_us"),
        F.count_if(F.col("type") == "compaction").alias("compactions"),
    )
    out = out.select("session_id", "max_tokens", "tokens_before", F.col("_m.provider").alias("provider"), F.col("_m.model").alias("model"), "start", F.floor(F.col("_us") / 1000000).cast("long").alias("duration_s"), "compactions")
    if catalog is None:
        return out
    out = out.join(catalog.select("provider", "model", "context_window"), ["provider", "model"], "left").withColumn("percent", 100 * F.col("max_tokens") / F.nullif("context_window", F.lit(0)))
    return out.withColumns({f"over_{n}": F.coalesce(F.col("percent") >= n, F.lit(False)) for n in (80, 90, 100)})


def context_pressure_groups(sessions: DataFrame, approx: bool = False) -> DataFrame:
    """In all, by start day, by model, and by both: sessions, means, medians (``approx``: from a bounded sketch), share with a compaction."""
    rows = sessions.withColumn("day", F.to_date("start").cast("string"))
    return rows.cube("day", "model").agg(
        F.count("*").alias("sessions"), F.avg("max_tokens").alias("mean_tokens"), (F.percentile_approx("max_tokens", 0.5) if approx else F.median("max_tokens")).alias("median_tokens"), F.avg((F.col("compactions") > 0).cast("int")).alias("compaction_rate"), F.grouping_id().cast("long").alias("level")
    )



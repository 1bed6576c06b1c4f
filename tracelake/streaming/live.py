"""Live operators. Inputs are streaming DataFrames with ``session_id``, ``seq`` and an event time; watermarks bound what is held.

Rows of a session are taken in order of ``seq`` within each micro-batch; a row that arrives after later ones of its session is
taken when it comes. Each operator gives on a finished stream what its batch form gives.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tracelake.functions.tables import BucketTable

NOISE_TOKENS = 1_024


#: Bytes that one task of the tail reads, and what opening a file counts for among them.
TAIL_BYTES, OPEN_BYTES = 16 << 20, 64 << 10
#: Files that are searched for their last whole line at a time, and bytes of text in a batch of lines.
TAIL_THREADS, BATCH_BYTES = 16, 4 << 20


class TailPartition(InputPartition):
    """Ranges of files (path, start, stop, end): the lines that begin in [start, stop), a line's end being at most ``end``."""

    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        self.ranges = ranges


class TailReader(DataSourceStreamReader):
    """Offsets are bytes read of each file. Only whole lines are read: a last line without its line feed waits.

    Files lie on any file system that an address names. Each trigger lists them; only files that have grown are opened. A task reads ranges of
    ``TAIL_BYTES`` in all: many small files, or a part of a large one.
    """

    def __init__(self, options: dict):
        self.top = options["path"]
        self.known: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, top = fs.FileSystem.from_uri(self.top)
        files = {i.path: i.size for i in store.get_file_info(fs.FileSelector(top, recursive=True)) if i.is_file and i.path.endswith(".jsonl")}
        grown = [p for p, size in files.items() if self.known.get(p, (-1, 0))[0] != size]
        with ThreadPoolExecutor(TAIL_THREADS) as pool:
            for p, end in zip(grown, pool.map(lambda p: whole_lines_end(store, p), grown), strict=True):
                self.known[p] = (files[p], end)
        return {p: self.known[p][1] for p in files if self.known[p][1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out, held, size = [], [], 0
        for path, last in sorted(end.items()):
            first = start.get(path, 0)
            for at in range(first, last, TAIL_BYTES):
                stop = min(at + TAIL_BYTES, last)
                cost = max(stop - at, OPEN_BYTES)
                if held and size + cost > TAIL_BYTES:
                    out.append(TailPartition(held))
                    held, size = [], 0
                # of a range that isn't its file's first, the place says nothing of where its first line begins
                held.append((path, at if at == first else -at, stop, last))
                size += cost
        return out + [TailPartition(held)] if held else out

    def read(self, partition: TailPartition) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.top)
        rows, size = [], 0
        for path, start, stop, end in partition.ranges:
            for at, line in lines_of(store, path, start, stop, end):
                rows.append((path, at, line.rstrip(b"\r").decode("utf-8", "replace")))
                size += len(line) + 100
                if size > BATCH_BYTES:
                    yield tail_batch(rows)
                    rows, size = [], 0
        if rows:
            yield tail_batch(rows)


def tail_batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["file_path", "at", "line"])


def lines_of(store: fs.FileSystem, path: str, start: int, stop: int, end: int, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(place, line) of a file's lines that begin in [start, stop). ``start`` below 0: at its amount or later, after a line feed."""
    with store.open_input_file(path) as f:
        place = start if start >= 0 else -start - 1
        f.seek(place)
        at, skip, held = place, start < 0, []
        while place < end and at < stop:
            text = f.read(min(chunk, end - place))
            if not text:
                raise OSError(f"{path} has become shorter than {end} bytes")
            place += len(text)
            first, *more = text.split(b"\n")
            held.append(first)
            if more:
                for line in (b"".join(held), *more[:-1]):
                    if not skip and at < stop:
                        yield at, line
                    skip, at = False, at + len(line) + 1
                held = more[-1:]


def whole_lines_end(store: fs.FileSystem, path: str, chunk: int = 1 << 16) -> int:
    """Place after a file's last line feed, searched from its end."""
    with store.open_input_file(path) as f:
        at = f.size()
        while at > 0:
            start = max(0, at - chunk)
            f.seek(start)
            k = f.read(at - start).rfind(b"\n")
            if k >= 0:
                return start + k + 1
            at = start
    return 0


class TailSource(DataSource):
    """Format ``tracelake_tail``: new lines of growing ``*.jsonl`` files under a path that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "tracelake_tail"

    def schema(self) -> str:
        return "file_path string, at long, line string"

    def streamReader(self, schema: StructType) -> TailReader:
        return TailReader(self.options)


def tail_sessions(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, at, line) of lines as they are appended. ``at``, the byte where a line begins, orders a file's lines."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tracelake_tail").option("path", path).load()


def landed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files that are complete when they appear."""
    return spark.readStream.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True).text(path)


def fold_message(events: list[dict]) -> dict:
    """One message out of its delta events, in order. A delta for another kind of block, and what follows a final event, don't count."""
    kinds = {"text": "text", "thinking": "thinking", "toolcall": "toolCall"}
    blocks: dict[int, dict] = {}
    out = {"status": "open", "stop_reason": None, "error": None, "faults": 0}
    for e in events:
        kind, _, step = e["type"].partition("_")
        if out["status"] != "open":
            break
        if e["type"] in ("done", "error"):
            out |= {"status": e["type"], "stop_reason": e.get("reason"), "error": e.get("error_message")}
        elif kind in kinds:
            own = blocks.get(e["content_index"])
            if step == "start":
                blocks[e["content_index"]] = {"type": kinds[kind], "body": "", "id": e.get("tool_call_id"), "name": e.get("tool_name"), "signature": None}
            elif own is None or own["type"] != kinds[kind]:
                out["faults"] += 1
            elif step == "delta":
                own["body"] += e.get("delta") or ""
            else:
                own["signature"] = e.get("content_signature")
    return out | {"content": [blocks[k] for k in sorted(blocks)]}


FOLDED = "session_id string, message_no long, status string, stop_reason string, error string, faults int, n_events long, content string"


#: Neighbouring messages of a session that share a group, and so a call, and a state; milliseconds after which an open one is abandoned.
FOLD_BLOCK, FOLD_MS = 64, 600_000
FOLD_FIELDS = ("seq", "type", "content_index", "delta", "content_signature", "tool_call_id", "tool_name", "reason", "error_message")


def plain_lists(b: pd.DataFrame, columns: Sequence[str]) -> list[list]:
    """Columns as lists, with None for what is null."""
    return [[None if x is None or x != x else x for x in b[c].tolist()] for c in columns]


def fold_deltas(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Final messages of delta events, when their last event is in; those left open come as ``abandoned`` after the watermark.

    Rows: session_id, message_no, seq (from 0), event_ts, type, content_index, delta, content_signature, tool_call_id, tool_name,
    reason, error_message. Events out of order are held until those before them are in. ``content`` is JSON. ``FOLD_BLOCK`` neighbouring messages of a
    session are one group, each with its own time-out; a call for every message costs far more than what it does.
    """

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # message to [time-out, sent, events held]; of a message that is sent, only that is kept
        messages = {m: x for m, *x in json.loads(state.get[0])} if state.exists else {}
        now, out, newest = state.getCurrentWatermarkMs(), [], {}
        for b in [] if state.hasTimedOut else batches:
            for m, ms, *event in zip(*plain_lists(b, ("message_no", "ms", *FOLD_FIELDS)), strict=True):
                m = None if m is None else int(m)
                newest[m] = max(newest.get(m, 0), int(ms or 0))
                own = messages.setdefault(m, [0, False, []])
                if not own[1]:
                    own[2].append(event)
        for m, ms in newest.items():
            own = messages[m]
            own[0] = max(now, ms) + FOLD_MS
            by_seq = {e[0]: e for e in own[2]}
            ready = []
            while len(ready) in by_seq:
                ready.append(by_seq[len(ready)])
            if any(e[1] in ("done", "error") for e in ready):
                out.append(row(key, m, ready, None))
                own[1:] = [True, []]
        for m in [m for m, own in messages.items() if own[0] < now]:
            _, sent, held = messages.pop(m)
            if not sent:
                out.append(row(key, m, held, "abandoned"))
        if messages:
            state.update((json.dumps([[m, *x] for m, x in messages.items()]),))
            state.setTimeoutTimestamp(min(x[0] for x in messages.values()))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[x.split(" ")[0] for x in FOLDED.split(", ")])

    def row(key, number: int | None, found: list[list], status: str | None) -> tuple:
        m = fold_message([dict(zip(FOLD_FIELDS, e, strict=True)) for e in sorted(found, key=lambda e: e[0])])
        return key[0], number, status or m["status"], m["stop_reason"], m["error"], m["faults"], len(found), json.dumps(m["content"], sort_keys=True)

    rows = events.withWatermark("event_ts", delay).select("session_id", F.floor(F.col("message_no") / FOLD_BLOCK).alias("block"), "message_no", "event_ts", F.unix_millis("event_ts").alias("ms"), *FOLD_FIELDS)
    return rows.groupBy("session_id", "block").applyInPandasWithState(fold, FOLDED, "messages string", "append", GroupStateTimeout.EventTimeTimeout)


def tool_durations(events: DataFrame, delay: str = "10 minutes", most: str = "1 hour") -> DataFrame:
    """Starts paired with ends by session and call: seconds and error; a start without an end comes after the watermark with nulls.

    Rows: session_id, call_id, tool, event_ts, type (tool_start, tool_end), is_error.
    """
    start = events.filter("type = 'tool_start'").select("session_id", "call_id", "tool", F.col("event_ts").alias("start_ts")).withWatermark("start_ts", delay)
    end = events.filter("type = 'tool_end'").select(F.col("session_id").alias("s"), F.col("call_id").alias("c"), F.col("event_ts").alias("end_ts"), "is_error").withWatermark("end_ts", delay)
    on = (F.col("session_id") == F.col("s")) & (F.col("call_id") == F.col("c")) & F.expr(f"end_ts >= start_ts AND end_ts <= start_ts + INTERVAL {most}")
    out = start.join(end, on, "left")
    return out.select("session_id", "call_id", "tool", "start_ts", ((F.unix_millis("end_ts") - F.unix_millis("start_ts")) / 1000.0).alias("seconds"), "is_error")


STATE_COLUMNS = ("input", "output", "cache_read", "cache_write", "cost_micro")
LIVE = "session_id long, messages long, compactions long, input long, output long, cache_read long, cache_write long, cost_micro long, last_seq long, provider string, model string, name string, name_seq long, thinking_level string, level_seq long, labels string"


def live_session_state(usage: DataFrame) -> DataFrame:
    """Each session's counts, token and cost sums, current model, name, thinking level and labels, updated with every
    micro-batch; equals the batch result.

    Columns used if there: name, thinking_level (null: the row sets none), label_target with label (empty: clears it). ``labels``
    is JSON, target to label.
    """

    marks_used = [c for c in ("name", "thinking_level", "label_target", "label") if c in usage.columns]
    used = ["seq", "type", "provider", "model", *STATE_COLUMNS, *marks_used]
    columns = [x.split(" ")[0] for x in LIVE.split(", ")]
    names, has = columns[1:], set(marks_used)

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = dict(zip(names, state.get, strict=True)) if state.exists else dict.fromkeys(names, 0) | {"last_seq": -1, "provider": None, "model": None, "name": None, "name_seq": -1, "thinking_level": None, "level_seq": -1, "labels": "{}"}
        marks = json.loads(s["labels"])
        for b in batches:
            # lists, not frames: most sessions have few rows in a batch, and a frame's every step costs more than those
            rows = dict(zip(used, plain_lists(b, used), strict=True))
            s["messages"] += rows["type"].count("message")
            s["compactions"] += rows["type"].count("compaction")
            for c in STATE_COLUMNS:
                s[c] += int(sum(x for x in rows[c] if x is not None))
            own = max(((q, k) for k, (q, t) in enumerate(zip(rows["seq"], rows["type"], strict=True)) if t == "message" and q is not None), default=None)
            if own and own[0] > s["last_seq"]:
                s |= {"last_seq": int(own[0]), "provider": rows["provider"][own[1]], "model": rows["model"][own[1]]}
            for column, place in (("name", "name_seq"), ("thinking_level", "level_seq")):
                given = max(((q, k) for k, (q, x) in enumerate(zip(rows["seq"], rows[column], strict=True)) if x is not None and q is not None), default=None) if column in has else None
                if given and given[0] > s[place]:
                    s |= {column: rows[column][given[1]], place: int(given[0])}
            for q, target, label in sorted(zip(rows["seq"], rows["label_target"], rows["label"], strict=True), key=lambda r: -1 if r[0] is None else r[0]) if "label_target" in has else ():
                if target is not None and q is not None and q > marks.get(target, ["", -1])[1]:
                    marks[target] = [label or "", int(q)]
        s["labels"] = json.dumps(marks)
        state.update(tuple(s.values()))
        shown = json.dumps({k: v for k, (v, _) in sorted(marks.items()) if v})
        yield pd.DataFrame([(key[0], *(s | {"labels": shown}).values())], columns=columns)

    # only what is folded goes to Python: each column costs as much as a session's rows
    return usage.select("session_id", *used).groupBy("session_id").applyInPandasWithState(fold, LIVE, LIVE.split(", ", 1)[1], "update", GroupStateTimeout.NoTimeout)


MISS = "session_id long, seq long, missed long, idle_s double, model_changed boolean"


def live_cache_misses(usage: DataFrame, noise: int = NOISE_TOKENS) -> DataFrame:
    """What each arriving request missed in the cache, against the one before it: as ``cache_misses`` in batch."""

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        prev, model, ts, reported = state.get if state.exists else (None, None, None, False)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for r in rows.itertuples():
            if r.type in ("compaction", "branch_summary"):
                prev, model, ts, reported = None, None, None, False
                continue
            prompt, cached, at = int(r.input + r.cache_read + r.cache_write), int(r.cache_read + r.cache_write), r.ts.timestamp()
            if prompt <= 0:
                continue
            own = f"{r.provider}/{r.model}"
            if prev is not None and (cached or reported) and (missed := min(prev, prompt) - int(r.cache_read)) > noise:
                out.append((key[0], int(r.seq), missed, max(0.0, at - ts), own != model))
            prev, model, ts, reported = prompt, own, at, bool(reported or cached)
        state.update((prev, model, ts, reported))
        yield pd.DataFrame(out, columns=[x.split(" ")[0] for x in MISS.split(", ")])

    return usage.groupBy("session_id").applyInPandasWithState(fold, MISS, "prev long, model string, ts double, reported boolean", "update", GroupStateTimeout.NoTimeout)


ALERT = "session_id long, seq long, decision string"


def live_compaction_alerts(messages: DataFrame, reserve: int = 16_384) -> DataFrame:
    """Overflow or threshold for each arriving assistant row; after an overflow none more until a row succeeds.

    Rows: session_id, seq, type, stop_reason, overflow (boolean), tokens, context_window.
    """

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recovering = state.get[0] if state.exists else False
        out = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            if r.type != "message" or r.stop_reason == "aborted":
                continue
            if r.overflow:
                if not recovering:
                    out.append((key[0], int(r.seq), "overflow"))
                recovering = True
            else:
                if r.stop_reason != "error":
                    recovering = False
                    if r.tokens > r.context_window - reserve:
                        out.append((key[0], int(r.seq), "threshold"))
        state.update((recovering,))
        yield pd.DataFrame(out, columns=["session_id", "seq", "decision"])

    return messages.groupBy("session_id").applyInPandasWithState(fold, ALERT, "recovering boolean", "update", GroupStateTimeout.NoTimeout)


EPISODE = "session_id string, kind string, start_ts timestamp, end_ts timestamp, outcome string"


def episodes(events: DataFrame, kinds: tuple[str, ...] = ("agent", "turn", "compaction", "auto_retry"), delay: str = "10 minutes", most_ms: int = 3_600_000) -> DataFrame:
    """Pairs of ``<kind>_start`` and ``<kind>_end`` of a session, nested ones innermost first; open ones come as ``open`` when they are too old."""
    pattern = "^(" + "|".join(kinds) + ")_(start|end)$"
    marked = events.filter(F.col("type").rlike(pattern)).select("session_id", F.regexp_extract("type", pattern, 1).alias("kind"), F.regexp_extract("type", pattern, 2).alias("edge"), "seq", "event_ts", F.col("reason").alias("outcome"))

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        out = []
        if state.hasTimedOut:
            out = [(key[0], key[1], pd.Timestamp(t, unit="us"), pd.NaT, "open") for t in held]
            state.remove()
        else:
            for r in pd.concat(list(batches)).sort_values("seq").itertuples():
                if r.edge == "start":
                    held.append(r.event_ts.value // 1000)
                elif held:
                    out.append((key[0], key[1], pd.Timestamp(held.pop(), unit="us"), r.event_ts, r.outcome))
            if held:
                state.update((json.dumps(held),))
                state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), held[-1] // 1000) + most_ms)
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=[x.split(" ")[0] for x in EPISODE.split(", ")])

    return marked.withWatermark("event_ts", delay).groupBy("session_id", "kind").applyInPandasWithState(fold, EPISODE, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def dedup_entries(entries: DataFrame, ts: str = "ts", delay: str = "1 hour", keys: tuple[str, ...] = ("session_id", "seq")) -> DataFrame:
    """Each entry once, within the watermark."""
    return entries.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def upsert_session_state(stream: DataFrame, path: str, checkpoint: str, key: str = "session_id", order: str = "last_seq", buckets: int = 16, trigger: dict | None = None):
    """A table with one row a session, the latest. Each micro-batch replaces the buckets of the sessions that it has rows of, in one commit.

    Readers, and a batch that is repeated after a failure at any step, see all of a batch or nothing of it.
    """

    def write(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy(key).agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*")
        BucketTable(batch.sparkSession, path).replace(latest, number, key, order, buckets)

    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def session_state_table(spark: SparkSession, path: str) -> DataFrame:
    """The table that upsert_session_state keeps, as of its last commit. What is read stays for one more batch."""
    return BucketTable(spark, path).table()


def windowed_usage(usage: DataFrame, window: str = "1 day", slide: str | None = None, gap: str | None = None, delay: str = "1 hour", ts: str = "ts", by: tuple[str, ...] = ("provider",)) -> DataFrame:
    """Sums by tumbling or sliding windows, or by session windows that end after a ``gap``. For streams and for tables."""
    span = F.session_window(ts, gap) if gap else F.window(ts, window, slide) if slide else F.window(ts, window)
    rows = usage.withWatermark(ts, delay) if usage.isStreaming else usage
    out = rows.groupBy(span.alias("w"), *by).agg(F.count("*").alias("requests"), *(F.sum(c).alias(c) for c in STATE_COLUMNS))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "requests", *STATE_COLUMNS)


def latest_queue(events: DataFrame) -> DataFrame:
    """The latest queue snapshot of each session."""
    return events.filter("type = 'queue_update'").groupBy("session_id").agg(F.max_by("queue", "seq").alias("queue"), F.max("seq").alias("seq"))


"""Streams over landed files against the batch operators."""

import json

import pytest
from pyspark.sql import functions as F

from tracelake.functions import tables
from tracelake.operators import context as C
from tracelake.operators import usage as U
from tracelake.plans.bindings import view
from tracelake.streaming import live

DATA = "/root/testdata/sf0.001"


def run(stream, tmp_path, mode="append", name="out"):
    """All rows that a stream gives, in batches until nothing is left."""
    got = []
    q = stream.writeStream.outputMode(mode).foreachBatch(lambda df, k: got.append((k, df.collect()))).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return [r for _, rows in sorted(got, key=lambda x: x[0]) for r in rows]


@pytest.fixture
def usage(spark):
    return view(spark, DATA, "usage").withColumn("ts", F.col("ts").cast("timestamp"))


def landed(spark, df, tmp_path, files=3, name="in"):
    """The rows as a stream of files, in order of time."""
    for k in range(files):
        part = df.filter(F.pmod(F.col("seq"), F.lit(files)) == k) if name == "mixed" else df.filter((F.col("seq") > k * 20) & ((F.col("seq") <= (k + 1) * 20) | F.lit(k == files - 1)))
        part.coalesce(1).write.parquet(str(tmp_path / name / f"{k}"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / name))


def test_state_and_upsert(spark, usage, tmp_path):
    stream = live.live_session_state(landed(spark, usage, tmp_path))
    live.upsert_session_state(stream, str(tmp_path / "table"), str(tmp_path / "cp")).awaitTermination()
    got = {r["session_id"]: (r["messages"], r["compactions"], r["input"], r["cost_micro"]) for r in live.session_state_table(spark, str(tmp_path / "table")).collect()}
    want = {r["session_id"]: (r["messages"], r["compactions"], r["input"], r["cost_micro"]) for r in U.session_stats(usage).collect()}
    assert got == want


def test_cache_misses(spark, usage, tmp_path):
    got = run(live.live_cache_misses(landed(spark, usage, tmp_path)), tmp_path, "update")
    want = C.cache_misses(usage).collect()
    key = lambda r: (r["session_id"], r["seq"], r["missed"], r["model_changed"], round(r["idle_s"], 3))
    assert sorted(map(key, got)) == sorted(map(key, want)) and want


def test_windows_and_dedup(spark, usage, tmp_path):
    twice = usage.unionByName(usage)
    stream = live.dedup_entries(landed(spark, twice, tmp_path, 1), delay="3650 days")
    assert len(run(stream, tmp_path)) == usage.count()
    batch = live.windowed_usage(usage, "1 day")
    stream = live.windowed_usage(landed(spark, usage, tmp_path, 1, "w"), "1 day")
    got = {(r["start"], r["provider"]): r["cost_micro"] for r in run(stream, tmp_path, "complete", "w")}
    assert got == {(r["start"], r["provider"]): r["cost_micro"] for r in batch.collect()}
    assert live.windowed_usage(usage, "1 day", "12 hours").count() > batch.count()
    assert live.windowed_usage(usage, gap="5 minutes", by=("session_id",)).agg(F.sum("requests")).first()[0] == usage.count()


DELTAS = "session_id string, message_no long, seq long, event_ts timestamp, type string, content_index int, delta string, content_signature string, tool_call_id string, tool_name string, reason string, error_message string"


def delta(spark, rows):
    data = [("s", m, q, None, t, i, d, None, None, None, r, None) for m, q, t, i, d, r in rows]
    return spark.createDataFrame(data, DELTAS).withColumn("event_ts", F.expr("timestamp'2025-01-01 00:00:00' + make_dt_interval(0, 0, 0, seq)"))


def test_fold_deltas(spark, tmp_path):
    rows = [
        (1, 0, "text_start", 0, None, None), (1, 2, "text_delta", 0, "lo", None), (1, 1, "text_delta", 0, "hel", None), (1, 3, "thinking_delta", 0, "x", None), (1, 4, "text_end", 0, None, None),
        (1, 5, "done", None, None, "stop"), (1, 6, "text_delta", 0, "late", None), (2, 0, "thinking_start", 0, None, None), (2, 1, "thinking_delta", 0, "hm", None), (2, 2, "error", None, None, "error"), (3, 0, "text_start", 0, None, None),
    ]
    df = delta(spark, rows)
    got = {r["message_no"]: r for r in run(live.fold_deltas(landed(spark, df, tmp_path, 2, "mixed")), tmp_path)}
    assert json.loads(got[1]["content"])[0]["body"] == "hello" and (got[1]["status"], got[1]["stop_reason"], got[1]["faults"]) == ("done", "stop", 1)
    assert json.loads(got[2]["content"])[0] == {"type": "thinking", "body": "hm", "id": None, "name": None, "signature": None} and got[2]["status"] == "error"
    assert 3 not in got


EVENTS = "session_id string, seq long, event_ts timestamp, type string, call_id string, tool string, is_error boolean, reason string, queue string"


def events(spark, rows):
    df = spark.createDataFrame([("s", q, s, t, c, "read", e, r, u) for q, s, t, c, e, r, u in rows], "session_id string, seq long, s long, type string, call_id string, tool string, is_error boolean, reason string, queue string")
    return df.withColumn("event_ts", F.expr("timestamp'2025-01-01 00:00:00' + make_dt_interval(0, 0, 0, s)")).select(*[x.split(" ")[0] for x in EVENTS.split(", ")])


def test_durations_episodes_queue(spark, tmp_path):
    rows = [
        (1, 0, "tool_start", "a", None, None, None), (2, 5, "tool_end", "a", True, None, None), (3, 6, "agent_start", None, None, None, None), (4, 7, "turn_start", None, None, None, None),
        (5, 9, "turn_end", None, None, "ok", None), (6, 12, "agent_end", None, None, "done", None), (7, 13, "queue_update", None, None, None, "x"), (8, 14, "queue_update", None, None, None, "y"),
    ]
    df = events(spark, rows)
    tools = run(live.tool_durations(landed(spark, df, tmp_path, 1, "t")), tmp_path, "append", "t")
    assert [(r["call_id"], r["seconds"], r["is_error"]) for r in tools] == [("a", 5.0, True)]
    got = run(live.episodes(landed(spark, df, tmp_path, 1, "e")), tmp_path, "append", "e")
    assert sorted((r["kind"], (r["end_ts"] - r["start_ts"]).seconds, r["outcome"]) for r in got) == [("agent", 6, "done"), ("turn", 2, "ok")]
    queue = run(live.latest_queue(landed(spark, df, tmp_path, 1, "q")), tmp_path, "update", "q")
    assert [(r["queue"], r["seq"]) for r in queue] == [("y", 8)]


def test_alerts(spark, tmp_path):
    rows = [(1, 1, "stop", False, 100), (1, 2, "error", True, 0), (1, 3, "error", True, 0), (1, 4, "stop", False, 990), (1, 5, "error", True, 0)]
    df = spark.createDataFrame([(s, q, "message", x, o, t, 1000) for s, q, x, o, t in rows], "session_id long, seq long, type string, stop_reason string, overflow boolean, tokens long, context_window long")
    got = run(live.live_compaction_alerts(landed(spark, df, tmp_path, 1), 50), tmp_path, "update")
    assert [(r["seq"], r["decision"]) for r in got] == [(2, "overflow"), (4, "threshold"), (5, "overflow")]


def test_tail(spark, tmp_path):
    top = tmp_path / "logs"
    top.mkdir()
    log = top / "a.jsonl"
    log.write_text('{"a":1}\n{"a":2}\n{"a":')
    checkpoint = str(tmp_path / "cp-tail")

    def step():
        got = []
        q = live.tail_sessions(spark, str(top)).writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", checkpoint).start()
        q.processAllAvailable()
        q.stop()
        return [r["line"] for r in got]

    assert step() == ['{"a":1}', '{"a":2}']
    with log.open("a") as f:
        f.write("3}\n")
    (top / "b.jsonl").write_text("x\n")
    assert sorted(step()) == ["x", '{"a":3}']


def test_state_table_commits(spark, tmp_path, monkeypatch):
    """A failure at any step, and a reader at any time, leave all of a batch or nothing of it; a repeated batch does no harm."""
    path, source = str(tmp_path / "table"), tmp_path / "in"
    schema = "session_id long, last_seq long, x string"

    def lot(n, ids):
        spark.createDataFrame([(i, n, f"{n}-{i}") for i in ids], schema).coalesce(1).write.parquet(str(source / f"lot{n}"))

    def start():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(source))
        live.upsert_session_state(stream, path, str(tmp_path / "cp"), buckets=5).awaitTermination()

    def rows():
        return {r["session_id"]: r["x"] for r in live.session_state_table(spark, path).collect()}

    with pytest.raises(ValueError):
        live.session_state_table(spark, path)
    state, steps = {}, []
    lot(0, range(30))
    start()
    state |= {i: f"0-{i}" for i in range(30)}
    assert rows() == state
    for n, step in enumerate(("written", "commit", "clean", "after_commit"), 1):
        before, held = dict(state), live.session_state_table(spark, path)
        ids = range(n, 30 + n, 3)
        lot(n, ids)
        with monkeypatch.context() as m:
            def fail(*a, **k):
                steps.append(step)
                raise OSError("lost")

            if step == "written":
                m.setattr(tables, "written", fail)
            elif step == "after_commit":
                real = tables.BucketTable.commit
                m.setattr(tables.BucketTable, "commit", lambda self, *a, real=real: (real(self, *a), fail()))
            else:
                m.setattr(tables.BucketTable, step, fail)
            with pytest.raises(Exception, match="lost"):
                start()
        after = before | {i: f"{n}-{i}" for i in ids}
        assert rows() == (after if step in ("clean", "after_commit") else before)
        start()  # the batch runs again, or only its cleaning does
        assert rows() == after and {r["session_id"]: r["x"] for r in held.collect()} == before  # one who began to read before still can
        state = after
    assert len(steps) == 4
    table = tables.BucketTable(spark, path)
    assert len(table.commits()) == tables.COMMITS_KEPT
    kept = {(v, b) for n in table.commits() for b, v in table.live(n).items()}
    assert kept == {(int(f[2:]), int(b[7:])) for f in table.names("") if f.startswith("v=") for b in table.names(f) if b.startswith("bucket=")}


def test_tail_ranges(tmp_path, monkeypatch):
    """Many small files are one task's, a large file is several tasks', and each line is read once, whatever the cuts."""
    from pyarrow import fs

    (tmp_path / "logs").mkdir()
    for k in range(300):
        (tmp_path / "logs" / f"{k:03}.jsonl").write_text("a\nbb\n")
    reader = live.TailReader({"path": str(tmp_path / "logs")})
    assert len(reader.partitions({}, reader.latestOffset())) <= 2
    texts = ["".join("x" * (n % 23) + "\r" * (n % 5 == 0) + "\n" for n in range(200)), "\n" * 90, "y" * 500 + "\n", "z\n" * 64 + "open"]
    for k, text in enumerate(texts):
        (tmp_path / "logs" / f"long{k}.jsonl").write_bytes(text.encode())
    before = {p: n for p, n in reader.latestOffset().items() if "long" not in p} | {str(tmp_path / "logs" / "long1.jsonl"): 7}
    for size in (1, 2, 7, 64, 1000):
        monkeypatch.setattr(live, "TAIL_BYTES", size)
        monkeypatch.setattr(live, "OPEN_BYTES", 1)
        parts = reader.partitions(before, reader.latestOffset())
        got = sorted((r["file_path"][-7], r["at"], r["line"]) for p in parts for b in reader.read(p) for r in b.to_pylist())
        want = []
        for k, text in enumerate(texts):
            at = 0
            for line in text.split("\n")[:-1]:
                want += [(str(k), at, line.rstrip("\r"))] if k != 1 or at >= 7 else []
                at += len(line) + 1
        assert got == sorted(want)
    store, _ = fs.FileSystem.from_uri(str(tmp_path))
    for chunk in (1, 3, 50):
        assert [x for _, x in live.lines_of(store, str(tmp_path / "logs" / "long0.jsonl"), 0, 10**6, len(texts[0]), chunk)] == [x.encode() for x in texts[0].split("\n")[:-1]]


def test_fold_groups(spark, tmp_path):
    """Messages share groups, each with its own time-out: of one group some are sent, some abandoned, and some are still open."""
    rows = [(n, k, t, 0, f"{n}" if k == 1 else None, None) for n in range(200) for k, t in enumerate(("text_start", "text_delta", "done")) if n % 4 or k < 2]
    late = [(200, 0, "text_start", 0, None, None), (0, 2, "done", None, None, "stop")]
    times = lambda df, s: df.withColumn("event_ts", F.expr(f"timestamp'2025-01-01 00:00:00' + make_dt_interval(0, 0, {s}, 0)"))
    source = tmp_path / "in"
    checkpoint, got = str(tmp_path / "cp"), []
    # 0: all but every fourth; 5 minutes: 0 ends; 1 day: the open ones are too old, and the last is open
    lots = (times(delta(spark, rows), 0), times(delta(spark, late[1:]), 5), times(delta(spark, late[:1]), 1440), times(delta(spark, [(201, 0, "text_start", 0, None, None)]), 1441))
    for k, lot in enumerate(lots):
        lot.coalesce(1).write.parquet(str(source / f"{k}"))
        stream = live.fold_deltas(spark.readStream.schema(lot.schema).option("recursiveFileLookup", True).parquet(str(source)))
        stream.writeStream.outputMode("append").foreachBatch(lambda df, n: got.extend(df.collect())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    found = {r["message_no"]: (r["status"], r["n_events"]) for r in got}
    assert len(found) == len(got)
    assert found == {n: ("done", 3) if n % 4 or n == 0 else ("abandoned", 2) for n in range(200)}
    assert live.FOLD_BLOCK > 1 and all(json.loads(r["content"])[0]["body"] == str(r["message_no"]) for r in got)


def test_state_takes_its_columns_only(usage):
    """What isn't folded doesn't go to Python."""
    wide = usage.withColumn("payload", F.concat(F.lit("x"), F.col("seq").cast("string")))
    plan = live.live_session_state(wide)._jdf.queryExecution().optimizedPlan().toString()
    assert "payload" not in plan and "cost_micro" in plan

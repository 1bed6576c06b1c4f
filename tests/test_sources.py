"""Readers and writers of session logs, on files made here."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import corpus as D
from tracelake.plans import hooks
from tracelake.sources import logs as L

HEAD = {"type": "session", "version": 3, "id": "s1", "timestamp": "2025-01-31T10:20:30.000Z", "cwd": "/home/u/work"}


def message(k, parent, role, content, **more):
    return {"type": "message", "id": f"e{k}", "parentId": parent, "timestamp": "2025-01-31T10:21:00.000Z", "message": {"role": role, "content": content, "timestamp": 1738318860000, **more}}


@pytest.fixture
def folder(tmp_path):
    top = tmp_path / "--home-u-work--"
    top.mkdir()
    lines = [
        json.dumps(HEAD),
        json.dumps(message(1, None, "user", "hello")),
        "",
        "{broken",
        json.dumps(message(2, "e1", "assistant", [{"type": "text", "text": "hi"}, {"type": "toolCall", "id": "c1", "name": "read", "arguments": {"path": "a.ts", "limit": 3}}], provider="p", model="m", stopReason="toolUse", usage={"input": 5, "output": 2, "cacheRead": 0, "cacheWrite": 0, "totalTokens": 7, "cost": {"total": 0.25}})),
        json.dumps({"type": "label", "id": "e3", "parentId": "e2", "timestamp": "2025-01-31T10:22:00.000Z", "targetId": "e1", "label": "x"}),
    ]
    (top / "2025-01-31T10-20-30-000Z_s1.jsonl").write_text("\n".join(lines) + "\n")
    (top / "2024-01-01T00-00-00-000Z_old.jsonl").write_text(json.dumps(HEAD | {"id": "old"}) + "\n")
    (top / "noheader.jsonl").write_text(json.dumps(message(1, None, "user", "x")) + "\n")
    (top / "late.jsonl").write_text("junk\n\n" + json.dumps(HEAD | {"id": "late", "cwd": "/other"}) + "\n")
    return str(tmp_path)


def test_read(spark, folder):
    sessions, entries = L.read_session_logs(spark, folder)
    assert {r["session_id"]: r["cwd"] for r in sessions.collect()} == {"s1": "/home/u/work", "old": "/home/u/work", "late": "/other"}
    got = entries.orderBy("session_id", "entry_seq").collect()
    assert [(r["entry_id"], r["parent_id"], r["type"]) for r in got] == [("e1", None, "message"), ("e2", "e1", "message"), ("e3", "e2", "label")]
    recent, _ = L.read_session_logs(spark, folder, since="2025-01-01")
    assert {r["session_id"] for r in recent.collect()} == {"s1", "late"}
    assert L.for_cwd(sessions, "/other").count() == 1
    assert sessions.filter("session_id = 's1'").select(L.cwd_to_dir("cwd").alias("d")).first()["d"] == "--home-u-work--"


def test_headers(spark, folder):
    assert {r["session_id"] for r in L.read_session_headers(spark, folder).collect()} == {"s1", "old", "late"}
    assert {r["session_id"] for r in L.read_session_headers(spark, folder, 20).collect()} == set()


def test_malformed_report(spark, folder):
    r = L.malformed_line_report(L.read_lines(spark, folder)).first()
    assert (r["files"], r["included"], r["skipped"], r["malformed_lines"]) == (4, 3, 1, 2)


def test_validate(spark, folder):
    good, bad = L.validate_session_logs(L.read_lines(spark, folder))
    reasons = {(r["file_path"].rsplit("/", 1)[1], r["line_no"]): r["reason"] for r in bad.collect()}
    assert reasons[("2025-01-31T10-20-30-000Z_s1.jsonl", 3)] == "not JSON" and reasons[("2025-01-31T10-20-30-000Z_s1.jsonl", 4)] == "after a rejected line"
    assert reasons[("noheader.jsonl", 0)] == "first line is not a session header"
    loose, few = L.validate_session_logs(L.read_lines(spark, folder), "lenient")
    assert few.count() == 4 and loose.count() == 5


def test_flatten(spark, folder):
    _, entries = L.read_session_logs(spark, folder)
    messages = L.flatten_messages(entries).orderBy("entry_seq").collect()
    assert [r["role"] for r in messages] == ["user", "assistant"] and messages[1]["usage"]["totalTokens"] == 7 and messages[0]["content"][0]["text"] == "hello"
    calls = L.tool_calls(L.explode_blocks(L.flatten_messages(entries)))
    row = calls.select("call_id", "tool", F.try_variant_get("arguments", "$.path", "string").alias("path")).first()
    assert tuple(row) == ("c1", "read", "a.ts")


def test_tables_and_export(spark, folder, tmp_path):
    sessions, entries = L.read_session_logs(spark, folder)
    L.write_session_tables(sessions, entries, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t/entries"))
    assert back.count() == 3 and {r["cwd_dir"] for r in back.select("cwd_dir").distinct().collect()} == {"--home-u-work--"}
    assert L.SessionTables(spark, str(tmp_path / "t")).table("branch_entries").count() == 3
    L.export_branch_jsonl(L.as_tree(entries), str(tmp_path / "b"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "b")).collect()]
    assert lines[0]["type"] == "session" and [x["parent_seq"] for x in lines[1:]] == [None, 1, 2]


def test_reports_and_transcripts(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "n int, t string")
    L.write_report_json({"rows": a, "none": a.limit(0)}, str(tmp_path / "r"))
    assert json.loads(spark.read.text(str(tmp_path / "r")).first()["value"]) == {"rows": [{"n": 1, "t": "x"}, {"n": 2, "t": "y"}], "none": []}
    texts = spark.createDataFrame([("d", k, "x" * 40) for k in range(5)], "cwd string, seq int, text string")
    packed = hooks.pack_transcripts(texts, 100, keep_text=True).withColumnRenamed("seq", "pos")
    L.write_transcripts(packed, str(tmp_path / "p"))
    assert spark.read.text(str(tmp_path / "p")).count() == 5


def test_catalog_file(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"p": {"m": {"name": "M", "contextWindow": 10, "input": ["text"], "thinkingLevelMap": {"low": None}, "cost": {"input": 1.5, "tiers": [{"inputTokensAbove": 5, "input": 3}]}}}}))
    r = L.read_model_catalog(spark, str(tmp_path / "c.json")).first()
    assert (r["provider"], r["model"], r["context_window"], r["cost"]["tiers"][0]["inputTokensAbove"], r["levels"]) == ("p", "m", 10, 5, {"low": None})


def test_named(spark):
    df = spark.createDataFrame([(1, " "), (2, None), (3, "n")], "session_id int, name string")
    assert [r["session_id"] for r in D.named_sessions(df).collect()] == [3]


def test_files_of_many_splits(spark, tmp_path):
    """Places, first lines and first faults of files that are cut into many splits, against plain reading; no window over the lines."""
    rng, want, good_lines, bad_lines = random.Random(5), {}, {}, {}
    stamp = "2025-01-01T00:00:00Z"
    head = lambda k: json.dumps({"type": "session", "version": 3, "id": f"s{k}", "timestamp": stamp, "cwd": "/w"})
    entry = lambda n: json.dumps({"type": "message", "id": f"e{n}", "parentId": None, "timestamp": stamp, "pad": "x" * rng.randrange(300)})
    for k in range(6):
        lines = ["", "  "] * (k % 2) + ([head(k)] if k != 3 else [entry(0), head(k)])
        for n in range(900):
            lines += [entry(n)] + [""] * (rng.random() < 0.05)
        if k == 1:
            lines.insert(700, "broken")
        if k == 2:
            lines[500:500] = [head(9), entry(901)]  # a header in the middle is no entry
        if k == 5:
            lines = ["[1]"] + lines
        (tmp_path / f"f{k}.jsonl").write_text("\n".join(lines) + "\n")
        parsed = []
        for x in lines:
            try:
                parsed.append(json.loads(x))
            except ValueError:
                parsed.append(None)
        objects = [x for x in parsed if isinstance(x, dict)]
        if objects[0]["type"] == "session":
            want[f"s{k}"] = [x["id"] for x in objects[1:]]
        first, fault = next(n for n, x in enumerate(lines) if x.strip()), None
        for n, (x, o) in enumerate(zip(lines, parsed, strict=True)):
            if x.strip() and fault is None and not (isinstance(o, dict) and (o["type"] == "session") == (n == first)):
                fault = n
        told = [n for n, x in enumerate(lines) if x.strip()]
        good_lines[f"f{k}.jsonl"] = [n for n in told if fault is None or n < fault]
        bad_lines[f"f{k}.jsonl"] = [n for n in told if fault is not None and n >= fault]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        lines = L.read_lines(spark, str(tmp_path))
        assert lines.select("file_path", "line_at.block").distinct().count() > 60
        sessions, entries = L.read_session_logs(spark, str(tmp_path))
        got = {}
        for r in entries.select("session_id", "entry_seq", "entry_id").orderBy("session_id", "entry_seq").collect():
            got.setdefault(r["session_id"], []).append(r["entry_id"])
            assert r["entry_seq"] == len(got[r["session_id"]])
        assert got == want and {r["session_id"] for r in sessions.collect()} == set(want)
        good, bad = L.validate_session_logs(lines)
        for df, numbers in ((good, good_lines), (bad, bad_lines)):
            found = {f: [] for f in numbers}
            for r in df.select("file_path", "line_no").collect():
                found[r["file_path"].rsplit("/", 1)[1]].append(r["line_no"])
            assert {f: sorted(n) for f, n in found.items()} == numbers
        lenient, _ = L.validate_session_logs(lines, "lenient")
        assert lenient.count() > sum(map(len, good_lines.values()))
        for df in (entries, good, bad):
            assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_tables_in_increments(spark, tmp_path):
    """A second load of overlapping logs adds only what is new; sessions that it touches get a new state; a look-up by parent reads few row groups."""
    stamp = "2025-01-01T00:00:00Z"

    def log(k, n, folder, *more):
        lines = [{"type": "session", "version": 3, "id": f"s{k}", "timestamp": stamp, "cwd": f"/w/{k % 2}"}]
        lines += [{"type": "message", "id": f"id-{k}-{i}-{i * 7919 % 1000}", "parentId": f"id-{k}-{i - 1}-{(i - 1) * 7919 % 1000}" if i else None, "timestamp": stamp, "message": {"role": "assistant", "provider": "p", "model": f"m{i % 3}", "pad": "y" * 40}} for i in range(n)]
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"s{k}.jsonl").write_text("".join(json.dumps(x) + "\n" for x in [*lines, *more]))

    tables = L.SessionTables(spark, str(tmp_path / "t"), buckets=4, row_group_bytes=4096, ids_a_group=100)
    for k in range(6):
        log(k, 300, "one")
    tables.load(*L.read_session_logs(spark, str(tmp_path / "one")))
    first = {(r["session_id"], r["entry_seq"], r["entry_id"]) for r in tables.entries().collect()}
    assert len(first) == 1800
    for k in (1, 2, 7):  # two sessions have grown, one is new
        log(k, 300, "two", {"type": "label", "id": f"l{k}", "parentId": None, "timestamp": stamp, "targetId": "a", "label": "old"}, {"type": "label", "id": f"l{k}b", "parentId": None, "timestamp": stamp, "targetId": "a", "label": "new"}, {"type": "label", "id": f"l{k}c", "parentId": None, "timestamp": stamp, "targetId": "b", "label": ""}, {"type": "session_info", "id": f"n{k}", "parentId": None, "timestamp": stamp, "name": " named "}, {"type": "model_change", "id": f"c{k}", "parentId": None, "timestamp": stamp, "provider": "q", "modelId": "z"}, {"type": "thinking_level_change", "id": f"t{k}", "parentId": None, "timestamp": stamp, "thinkingLevel": "high"})
    for _ in range(2):  # loading it again adds nothing
        tables.load(*L.read_session_logs(spark, str(tmp_path / "two")))
        rows = [(r["session_id"], r["entry_seq"], r["entry_id"]) for r in tables.entries().collect()]
        assert len(rows) == len(set(rows)) == 1800 + 12 + 306 and first <= set(rows)
        state = {r["session_id"]: r for r in tables.table("session_state").collect()}
        assert len(state) == 7 and state["s1"]["entries"] == 306 and state["s0"]["entries"] == 300 and tables.table("sessions").count() == 7
        s = state["s7"]
        assert (s["provider"], s["model"], s["thinking_level"], s["name"], s["labels"]) == ("q", "z", "high", "named", {"a": "new"}) and (state["s0"]["model"], state["s0"]["labels"], state["s0"]["name"]) == ("m2", {}, None)
    found = tables.children_of(["id-4-100-900"])
    assert [(r["session_id"], r["entry_seq"]) for r in found.collect()] == [("s4", 102)]
    leaf = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert leaf.metrics().apply("numOutputRows").value() < 400


def test_files_are_opened_once(spark, folder, tmp_path):
    """What is read more than once is the table of parsed lines, not the files; calls need no join for their times, and an exported branch's tree is worked out once."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    sessions, entries = L.read_session_logs(spark, folder)
    calls = L.calls_of(entries)
    for df in (sessions, entries, calls, L.results_of(entries), *L.validate_session_logs(L.read_lines(spark, folder))):
        assert "FileScan text" not in plan(df) and "Scan text" not in plan(df)
    assert plan(calls).count("Join") == plan(entries).count("Join")
    assert calls.filter("ts IS NULL").count() == 0 and calls.count() == 1
    rows = L.export_branch_jsonl(L.as_tree(entries), str(tmp_path / "b"))
    assert rows.count() == 1


def test_log_lines_are_parsed_once(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"type":"session","id":"s"}\n{"a":\n[1]\n\n{"type":"message"}\n')
    lines = L.read_lines(spark, str(tmp_path)).filter(~F.col("blank") & L.is_object())
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("parse_json") <= 1
    assert [r["line"] for r in lines.orderBy("line_at").collect()] == ['{"type":"session","id":"s"}', '{"type":"message"}']
    name, old = "spark.sql.files.openCostInBytes", spark.conf.get("spark.sql.files.openCostInBytes")
    with L.many_small_files(spark):
        assert spark.conf.get(name) != old
    assert spark.conf.get(name) == old

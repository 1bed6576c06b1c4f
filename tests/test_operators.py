"""Known cases and properties of the operators."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.functions import scalars as S
from tracelake.functions import scans
from tracelake.operators import catalog as K
from tracelake.operators import context as C
from tracelake.operators import corpus as D
from tracelake.operators import edits as E
from tracelake.operators import tools as A
from tracelake.operators import trees as R
from tracelake.operators import usage as U
from tracelake.plans import hooks


def one(spark, **columns):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items()))


USAGE = "session_id long, seq long, ts timestamp, provider string, model string, type string, stop_reason string, input long, output long, cache_read long, cache_write long, cost_input double, cost_cache_read double, cost_cache_write double"


def usage(spark, *rows):
    """Rows (seconds, model, type, input, cache_read, cache_write, costs in dollars of input, read, write)."""
    data = [(1, k, f"2025-01-01 00:{t // 60:02d}:{t % 60:02d}", "p", m, kind, "stop", i, 1, r, w, ci * 1e6, cr * 1e6, cw * 1e6) for k, (t, m, kind, i, r, w, ci, cr, cw) in enumerate(rows)]
    return spark.createDataFrame(data, USAGE.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))


FIRST = (0, "m", "message", 0, 0, 100_000, 0, 0, 0.375)


def test_cache_waste(spark):
    rates = spark.createDataFrame([("p", "m", 0.3), ("p", "n", 0.3)], "provider string, model string, cache_read_rate double")
    second = (60, "m", "message", 0, 100_000, 5_000, 0, 0.03, 0.019)
    misses = C.cache_misses(usage(spark, FIRST, second, (120, "m", "message", 0, 0, 110_000, 0, 0, 0.4125)), rates)
    row = C.cache_waste(misses).first()
    assert row["missed_tokens"] == 105_000 and round(row["extra_micro"] / 1e6, 5) == 0.36225
    late = C.cache_misses(usage(spark, FIRST, second, (600, "m", "message", 0, 0, 110_000, 0, 0, 0.4125)), rates).first()
    assert late["idle_s"] == 540 and not late["model_changed"]
    assert C.cache_misses(usage(spark, FIRST, second), rates).count() == 0
    assert C.cache_misses(usage(spark, FIRST, (1, "m", "compaction", 0, 0, 0, 0, 0, 0), (2, "m", "message", 0, 0, 20_000, 0, 0, 0)), rates).count() == 0
    other = C.cache_misses(usage(spark, FIRST, (60, "n", "message", 0, 0, 100_000, 0, 0, 0.375)), rates).collect()
    assert [(r["missed"], r["model_changed"]) for r in other] == [(100_000, True)]
    never = C.cache_misses(usage(spark, (0, "m", "message", 100_000, 0, 0, 0, 0, 0), (60, "m", "message", 110_000, 0, 0, 0, 0, 0)), rates)
    assert never.count() == 0


def cut_loop(rows, keep):
    """A loop over one session's (role, tokens, is_message) that finds the cut point."""
    ok = [k for k, r in enumerate(rows) if r[0] in C.CUT_ROLES]
    if not ok:
        return 0, -1, False
    cut, total = ok[0], 0
    for k in range(len(rows) - 1, -1, -1):
        if rows[k][1] <= 0:
            continue
        total += rows[k][1]
        if total >= keep:
            later = [x for x in ok if x >= k]
            cut = later[0] if later else cut
            break
    while cut > 0 and not rows[cut - 1][2]:
        cut -= 1
    if rows[cut][0] in C.TURN_STARTS:
        return cut, -1, False
    turn = max((k for k in range(cut + 1) if rows[k][0] in C.TURN_STARTS), default=-1)
    return cut, turn, turn >= 0


def test_cut_point(spark):
    known = [("user", 1, True), ("assistant", 2, True), ("custom", 1000, True), ("assistant", 1, True)]
    assert cut_loop(known, 1) == (3, 2, True) and cut_loop(known, 2) == (2, -1, False)
    rng, cases = random.Random(5), [known, [("user", 1, True)] * 4]
    for _ in range(60):
        cases.append([(r := rng.choice(["user", "assistant", "toolResult", "custom", None]), rng.randrange(0, 9) if r else 0, r is not None) for _ in range(rng.randrange(1, 12))])
    for keep in (1, 2, 12, 50_000):
        rows = [(s, k, *r) for s, c in enumerate(cases) for k, r in enumerate(c)]
        df = spark.createDataFrame(rows, "session_id long, seq long, role string, tokens long, is_message boolean")
        got = {r["session_id"]: (r["cut"], r["turn_start"], r["split"]) for r in C.find_cut_point(df, keep).collect()}
        assert got == {s: cut_loop(c, keep) for s, c in enumerate(cases)}


def test_context_usage_variants(spark):
    def run(rows, prefix):
        df = spark.createDataFrame([(1, k, r, t, u, tok, "stop") for k, (r, t, u, tok) in enumerate(rows)], "session_id long, seq long, role string, ts long, usage_tokens long, tokens long, stop_reason string")
        r = C.context_usage(df, True, F.lit(prefix)).first()
        return r["tokens"], r["usage_tokens"], r["trailing_tokens"], r["usage_seq"]

    assert run([("user", 200, None, 2), ("assistant", 100, 9_500, 1), ("user", 300, None, 1_000)], 2) == (1_005, 0, 1_005, None)
    assert run([("user", 200, None, 2), ("assistant", 100, 9_500, 1), ("user", 300, None, 5), ("assistant", 400, 2_000, 9), ("user", 500, None, 1)], 2) == (2_001, 2_000, 1, 3)


TREE = [(1, None, "message"), (2, 1, "message"), (3, 2, "message"), (4, 3, "message"), (5, 4, "compaction"), (6, 5, "message"), (7, 6, "message"), (8, 3, "message"), (9, 8, "message"), (10, 3, "branch_summary"), (11, 10, "message")]


def test_context_entries(spark):
    tree = spark.createDataFrame([(1, s, p, t, 3 if s == 5 else None) for s, p, t in TREE], "session_id long, seq long, parent_seq long, type string, first_kept_seq long")
    leaf = lambda k: spark.createDataFrame([(1, k)], "session_id long, seq long")
    shown = lambda k: [r["seq"] for r in R.context_entries(tree, leaf(k)).orderBy("context_pos").collect()]
    assert shown(7) == [5, 3, 4, 6, 7]
    assert shown(11) == [1, 2, 3, 10, 11]
    assert R.branch_path(tree, leaf(99)).count() == 0
    _, last = R.session_context(tree.withColumn("thinking_level", F.lit(None).cast("string")), leaf(7), ("thinking_level",))
    assert last.first()["thinking_level"] == "off"


def test_deep_chain_and_odd_parents(spark):
    n = 5_000
    chain = spark.range(1, n + 1).select(F.lit(1).cast("long").alias("session_id"), F.col("id").alias("seq"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent_seq"), F.lit("message").alias("type"))
    path = R.branch_path(chain)
    assert path.count() == n and path.agg(F.max("pos")).first()[0] == n - 1
    odd = spark.createDataFrame([(1, 1, 1, "message"), (1, 2, 77, "message"), (1, 3, 2, "message")], "session_id long, seq long, parent_seq long, type string")
    assert [r["seq"] for r in R.branch_path(odd).orderBy("pos").collect()] == [2, 3]
    with pytest.raises(Exception, match="parent is missing"):
        R.path_to_root_or_compaction(odd).collect()


def test_extract_branch_reads_the_same(spark):
    tree = spark.createDataFrame([(1, s, p, t) for s, p, t in TREE], "session_id long, seq long, parent_seq long, type string")
    branch = R.extract_branch(tree)
    assert [r["seq"] for r in R.branch_path(branch).orderBy("pos").collect()] == [r["seq"] for r in branch.orderBy("pos").collect()]


def test_migrations_twice(spark):
    rows = spark.createDataFrame([(1, 1, "hookMessage", 2), (1, 2, "user", 3)], "session_id long, seq long, role string, version int")
    once = R.migrate_v2_to_v3(rows)
    assert once.collect() == R.migrate_v2_to_v3(once).collect() and [r["role"] for r in once.orderBy("seq").collect()] == ["custom", "user"]


def test_prices(spark):
    base = F.struct(F.lit(5.0).alias("input"), F.lit(25.0).alias("output"), F.lit(0.5).alias("cache_read"), F.lit(6.25).alias("cache_write"))
    none = F.array().cast("array<struct<above:bigint,input:double,output:double,cache_read:double,cache_write:double>>")
    rows = one(spark, input=0, output=0, cache_read=0, cache_write=1_000_000)
    assert U.price_usage(rows, none, base, F.lit(400_000)).first()["cost_cache_write"] == 7_750_000
    assert U.price_usage(rows, none, base).first()["cost_cache_write"] == 6_250_000


def test_fuzzy_score():
    assert D.fuzzy_score("", "anything") == 0 and D.fuzzy_score("longquery", "short") is None
    assert D.fuzzy_score("abc", "aXbXc") is not None and D.fuzzy_score("abc", "cba") is None
    assert D.fuzzy_score("codex52", "gpt-5.2-codex") is not None
    assert D.fuzzy_score("foo", "foobar") < D.fuzzy_score("foo", "f_o_o_bar") and D.fuzzy_score("ab", "ab") < D.fuzzy_score("ab", "abc")


def test_search_order(spark):
    df = spark.createDataFrame([(1, "xxxx brave", 1), (2, "brave xxxx", 2), (3, "brave xxxx", 3)], "session_id long, text string, modified long")
    assert [r["session_id"] for r in D.search_sessions(df, '"brave"').collect()] == [3, 2, 1]
    assert D.search_sessions(df, "re:(").count() == 0 and D.search_sessions(df, "re:X+ B", "recent").count() == 1
    assert D.parse_query('a "b c" d') == ("tokens", [("fuzzy", "a"), ("phrase", "b c"), ("fuzzy", "d")]) and D.parse_query('a "b')[1] == [("fuzzy", "a"), ("fuzzy", '"b')]


def test_scalars(spark):
    r = one(spark, a="a\U0001f600").select(S.utf16_length("a").alias("u"), S.utf8_bytes("a").alias("b"), F.length("a").alias("n")).first()
    assert tuple(r) == (3, 5, 2)
    names = ["src/a.TS", ".gitignore", "Makefile", "", None, "a/.b.c", "x.tar.gz", "a.b/c"]
    got = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, p string").select("k", S.path_extension("p").alias("e")).orderBy("k").collect()
    assert [r["e"] for r in got] == [".ts", ".gitignore", "[no_ext]", "[unknown]", "[unknown]", ".c", ".gz", "[no_ext]"]
    commands = ["FOO=1 sudo git status | cat", "ls -la", "  ", "npm run x && y"]
    got = spark.createDataFrame([(k, n) for k, n in enumerate(commands)], "k int, c string").select("k", S.command_key("c").alias("e")).orderBy("k").collect()
    assert [r["e"] for r in got] == ["git status", "ls", "unknown", "npm run"]
    t = one(spark, n="2025-01-31T10-20-30-123Z_abc.jsonl", m="abc.jsonl").select(S.file_stamp("n").cast("string").alias("a"), S.file_stamp("m").alias("b")).first()
    assert tuple(t) == ("2025-01-31 10:20:30.123", None)
    assert one(spark, x="abcdef").select(S.truncate_result("x", 4).alias("t")).first()["t"] == "abcd\n\n[... 2 more characters truncated]"
    sizes = one(spark, a=10, b=2048, c=3 * 1048576).select(S.size_label("a").alias("a"), S.size_label("b").alias("b"), S.size_label("c").alias("c")).first()
    assert tuple(sizes) == ("10B", "2.0KB", "3.0MB")
    ids = spark.createDataFrame([("ab-1",), ("-a",), ("a/b",), (None,)], "x string").select(S.valid_session_id("x").alias("v")).collect()
    assert [r["v"] for r in ids] == [True, False, False, False]
    m = one(spark, z=1).select(F.expr("map('low', null, 'high', 'h')").alias("m")).select(*(S.level_state("m", k).alias(k) for k in ("low", "high", "max"))).first()
    assert tuple(m) == ("unsupported", "h", "default")


def test_overflow_and_retry(spark):
    rows = [("error", "prompt is too long: 1 > 0", True, False), ("error", "Throttling error: Too many tokens", False, False), ("error", "503 Service Unavailable", False, True), ("error", "429 insufficient_quota", False, False), ("stop", None, False, False), ("error", "400 (no body)", True, False)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, stop string, error string, overflow boolean, retry boolean")
    zero = F.lit(0)
    got = df.select("*", U.is_context_overflow(F.col("stop"), F.col("error"), zero, zero, zero, F.lit(100)).alias("o"), U.is_retryable(F.col("stop"), F.col("error")).alias("r")).collect()
    assert all(x["o"] == x["overflow"] and x["r"] == x["retry"] for x in got), got
    full = one(spark, x=99).select(U.is_context_overflow(F.lit("length"), F.lit(None).cast("string"), F.col("x"), zero, zero, F.lit(100)).alias("a"), U.is_context_overflow(F.lit("stop"), F.lit(None).cast("string"), F.lit(101), zero, zero, F.lit(100)).alias("b"), U.is_context_overflow(F.lit("stop"), F.lit(None).cast("string"), F.lit(100), zero, zero, F.lit(100)).alias("c")).first()
    assert tuple(full) == (True, True, False)


def test_normalize_usage_and_stops(spark):
    rows = [
        ("openai-completions", '{"prompt_tokens":100,"completion_tokens":7,"prompt_tokens_details":{"cached_tokens":60,"cache_write_tokens":10}}', (30, 7, 60, 10, 107)),
        ("openai-responses", '{"input_tokens":50,"output_tokens":5,"total_tokens":55,"input_tokens_details":{"cached_tokens":80}}', (0, 5, 80, 0, 55)),
        ("google", '{"promptTokenCount":9,"candidatesTokenCount":2,"thoughtsTokenCount":3,"cachedContentTokenCount":4,"totalTokenCount":14}', (5, 5, 4, 0, 14)),
        ("anthropic", '{"input_tokens":1,"output_tokens":2,"cache_read_input_tokens":3,"cache_creation_input_tokens":4}', (1, 2, 3, 4, 10)),
        ("bedrock", '{"inputTokens":1,"outputTokens":2}', (1, 2, 0, 0, 3)),
        ("mistral", '{"promptTokens":10,"completionTokens":1,"totalTokens":11,"promptTokensDetails":{"cachedTokens":99}}', (0, 1, 10, 0, 11)),
    ]
    df = spark.createDataFrame([(a, p) for a, p, _ in rows], "api string, p string").withColumn("payload", F.parse_json("p"))
    got = {r["api"]: tuple(r[k] for k in ("input", "output", "cache_read", "cache_write", "total_tokens")) for r in U.normalize_usage(df).collect()}
    assert got == {a: x for a, _, x in rows}
    codes = [("openai-completions", "tool_calls", "toolUse"), ("openai-completions", None, "stop"), ("openai-completions", "odd", "error"), ("mistral", "odd", "stop"), ("google", "MAX_TOKENS", "length"), ("bedrock", "end_turn", "stop"), ("anthropic", "odd", "error")]
    df = spark.createDataFrame(codes, "api string, code string, want string")
    assert all(r["stop_reason"] == r["want"] for r in U.normalize_stop_reason(df).collect())
    with pytest.raises(Exception, match="Unhandled stop reason"):
        U.normalize_stop_reason(df, strict=True).collect()


BLOCKS = "array<struct<type:string,text:string,thinking:string,redacted:boolean,signature:string,id:string,name:string>>"


def test_normalize_for_model(spark):
    b = lambda kind, text=None, thinking=None, redacted=None, signature=None: (kind, text, thinking, redacted, signature, None, None)
    rows = [
        (0, "user", None, None, None, None, [b("image"), b("image"), b("text", "hi"), b("image")]),
        (1, "assistant", "p", "a", "m", "stop", [b("thinking", thinking="why"), b("thinking", thinking=" "), b("thinking", thinking="x", redacted=True), b("text", "yes", signature="s")]),
        (2, "assistant", "p", "a", "m", "error", [b("text", "lost")]),
    ]
    df = spark.createDataFrame(rows, f"seq int, role string, provider string, api string, model string, stop_reason string, content {BLOCKS}")
    got = {r["seq"]: [(x["type"], x["text"], x["signature"]) for x in r["content"]] for r in C.normalize_for_model(df, "q", "a", "n", False).collect()}
    note = C.IMAGE_NOTES["user"]
    assert got == {0: [("text", note, None), ("text", "hi", None), ("text", note, None)], 1: [("text", "why", None), ("text", "yes", None)]}
    same = {r["seq"]: len(r["content"]) for r in C.normalize_for_model(df, "p", "a", "m", True).collect()}
    assert same == {0: 4, 1: 3}


def test_llm_messages(spark):
    df = spark.createDataFrame(
        [(0, "bashExecution", None, "ls", "a", 1, False, True, "/t", None, False), (1, "bashExecution", None, "x", "", None, True, False, None, None, False), (2, "bashExecution", None, "x", "", 0, False, False, None, None, True), (3, "compactionSummary", None, None, None, None, None, None, None, "S", None), (4, "assistant", "t", None, None, None, None, None, None, None, None)],
        "seq int, role string, text string, command string, output string, exit_code int, cancelled boolean, truncated boolean, full_output_path string, summary string, exclude_from_context boolean",
    )
    got = {r["seq"]: (r["role"], r["text"]) for r in C.to_llm_messages(df).collect()}
    assert got[0] == ("user", "Ran `ls`\n```\na\n```\n\nCommand exited with code 1\n\n[Output truncated. Full output: /t]")
    assert got[1] == ("user", "Ran `x`\n(no output)\n\n(command cancelled)") and 2 not in got
    assert got[3][0] == "user" and "<summary>\nS\n</summary>" in got[3][1] and got[4] == ("assistant", "t")


def test_context_harness(spark):
    df = spark.createDataFrame([(1, 1, "message", "user", "hi", None, None, None), (1, 2, "compaction", None, None, "sum", [("user", "kept")], None), (1, 3, "custom", None, "note", None, None, "n"), (1, 4, "label", None, None, None, None, None)], "session_id long, seq long, type string, role string, text string, summary string, retained_tail array<struct<role:string,text:string>>, custom_type string")
    got = C.entries_to_context_harness(df, {"n": lambda e: e.select("session_id", "seq", F.lit("custom").alias("role"), "text")}).orderBy("seq", "part").collect()
    assert [(r["seq"], r["role"], r["text"]) for r in got] == [(1, "user", "hi"), (2, "compactionSummary", "sum"), (2, "user", "kept"), (3, "custom", "note")]


def test_replacements(spark):
    rows = [("abcXdef", "abcYYdef"), ("same", "same"), ("é", "éé"), (None, "new"), ("aa", "aaa")]
    got = A.analyze_replacements(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, old string, new string")).orderBy("k").collect()
    assert [(r["prefix_bytes"], r["suffix_bytes"], r["core_bytes"]) for r in got] == [(3, 3, 3), (4, 0, 0), (2, 0, 2), (0, 0, 3), (2, 0, 1)]
    assert got[1]["inflation"] is None and got[0]["inflation"] == 5.0
    sums = A.analyze_calls(A.analyze_replacements(spark.createDataFrame([(1, "ab", "ac"), (1, "x", "x")], "call int, old string, new string")), ["call"]).first()
    assert (sums["edits"], sums["no_core_edits"], sums["core_bytes"], sums["median_inflation"]) == (2, 1, 2, 2.0)


def brute_edits(stored, olds):
    """[(status, place in the form matched, size there, overlaps)] of a document's edits, by the rule, with plain string methods."""
    feeds = lambda s: s.replace("\r\n", "\n").replace("\r", "\n")
    plain = feeds(stored.removeprefix("\ufeff"))
    loose, olds = E.fuzzy_form(plain), [feeds(o) for o in olds]
    batch_loose = any(o and o not in plain and E.fuzzy_form(o) in loose for o in olds)
    base, out = loose if batch_loose else plain, []
    for o in olds:
        lo = E.fuzzy_form(o)
        at, size = (base.find(o), len(o)) if o in base else (E.fuzzy_form(base).find(lo), len(lo))
        times = loose.count(lo) if lo else len(loose.encode("utf-16-le")) // 2 - 1
        out.append(("empty" if not o else "not_found" if at < 0 else "multiple" if times > 1 else "exact" if o in plain else "fuzzy", at, size))
    ends, overlap = -1, {}
    for k in sorted((k for k, x in enumerate(out) if x[0] in ("exact", "fuzzy")), key=lambda k: (out[k][1], k)):
        overlap[k] = out[k][1] < ends
        ends = max(ends, out[k][1] + out[k][2])
    return [(*x, overlap.get(k, False)) for k, x in enumerate(out)]


def test_check_edits(spark):
    """Known cases: CRLF, ligatures, exact and fuzzy edits of one document in one space, a byte order mark, nulls."""
    corpus = spark.createDataFrame(
        [(1, "say “hi” – ok\nend  \n"), (2, "aXbXc"), (4, "\ufeffone\r\ntwo\r\nthree"), (5, "ﬁrst  \nof “all” ﬁne\nlast"), (6, None), (7, "aaa"), (8, "e\u0301x e\u0301y")], "doc_id int, text string"
    )
    edits = [
        (1, 0, 'say "hi" - ok'), (1, 1, "end"), (2, 0, "X"), (2, 1, "aXb"), (2, 2, "bXc"), (3, 0, "q"), (4, 0, "one\r\ntwo"), (4, 1, "two\nth"), (4, 2, ""), (4, 3, None), (5, 0, "first\nof"), (5, 1, "of “all”"), (5, 2, "last"), (5, 3, "rst\no"),
        (6, 0, "x"), (7, 0, "aa"), (None, 0, "x"), (8, 0, "éy"), (8, 1, "\u0301x"),
    ]
    got = {(r["doc_id"], r["edit_no"]): (r["status"], r["start"], r["size"], r["overlaps"]) for r in E.check_edits(spark.createDataFrame(edits, "doc_id int, edit_no int, old string"), corpus).collect()}
    none = ("not_found", None, None, False)
    assert got == {
        (1, 0): ("fuzzy", 0, 13, False), (1, 1): ("exact", 14, 3, False), (2, 0): ("multiple", 1, 1, False), (2, 1): ("exact", 0, 3, False), (2, 2): ("exact", 2, 3, True), (3, 0): none,
        (4, 0): ("exact", 1, 8, False), (4, 1): ("exact", 6, 7, True), (4, 2): ("empty", None, None, False), (4, 3): ("empty", None, None, False),
        (5, 0): ("fuzzy", 0, 9, False), (5, 1): ("exact", 7, 8, True), (5, 2): ("exact", 20, 4, False), (5, 3): ("fuzzy", 1, 7, True), (6, 0): none, (7, 0): ("exact", 0, 2, False), (None, 0): none,
        (8, 0): ("fuzzy", 4, 3, False), (8, 1): none,
    }


def test_check_edits_in_batches(spark):
    # many documents come to Python in a batch; no group is handed over by itself
    corpus = spark.createDataFrame([(k, f"text {k}") for k in range(50)] + [(60, None)], "doc_id int, text string")
    edits = spark.createDataFrame([(k, 0, f"t {k}") for k in range(50)] + [(60, 0, "t"), (61, 0, "t"), (None, 0, "t")], "doc_id int, edit_no int, old string")
    out = E.check_edits(edits, corpus)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CoGroups" not in plan
    got = {r["doc_id"]: (r["status"], r["start"]) for r in out.collect()}
    assert got == {k: ("exact", 3) for k in range(50)} | dict.fromkeys((60, 61, None), ("not_found", None))
    assert E.check_edits(edits.limit(0), corpus).count() == 0


def test_check_edits_brute(spark, monkeypatch):
    """Random documents and edits; edits in several lots give the same; spans hold the text found, and no less would."""
    rng = random.Random(12)
    signs = ["a", "b", "c", " ", "\u00a0", "ﬁ", "“", "–", "\r\n", "\n", "  \n", "e\u0301", "é", "①", "\u2003", "x", "y", "z", "\u1100\u1161", "\u3000\n"]
    docs, edits = [], []
    for k in range(150):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(60)))
        docs.append((k, text))
        for n in range(rng.randrange(1, 6)):
            at = rng.randrange(len(text) + 1)
            old = text[at : at + rng.randrange(1, 12)]
            edits.append((k, n, rng.choice([old, old, E.fuzzy_form(old), old.replace("\n", "\r\n").replace("\r\r", "\r"), old + "!", old.replace(" ", "\u00a0")])))
    corpus, asked = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(edits, "doc_id int, edit_no int, old string")
    for lot in (10_000, 2):
        monkeypatch.setattr(E, "PER_TASK", lot)
        got = {(r["doc_id"], r["edit_no"]): r for r in E.check_edits(asked, corpus).collect()}
        assert len(got) == len(edits)
        seen = set()
        for k, text in docs:
            own = [o for d, _, o in edits if d == k]
            for n, (status, _, _, overlaps) in enumerate(brute_edits(text, own)):
                r = got[k, n]
                assert (r["status"], r["overlaps"]) == (status, overlaps), (text, own, n)
                seen.add((status, overlaps))
                if status in ("exact", "fuzzy") and E.fuzzy_form(E.line_feeds(own[n])):
                    inside = lambda a, b, text=text: E.fuzzy_form(E.line_feeds(text[a:b]))
                    a, b, want = r["start"], r["start"] + r["size"], E.fuzzy_form(E.line_feeds(own[n]))
                    assert want in inside(a, b) and want not in inside(a + 1 + text.startswith("\r\n", a), b) or E.line_feeds(text[a:b]) == E.line_feeds(own[n]), (text, own[n], a, b)
        assert len(seen) > 6



def brute_tail(text, max_lines, max_bytes):
    """(lines, text, truncated_by) of the end of a text."""
    size, lines = len(text.encode()), text.split("\n")
    if len(lines) > 1 and not lines[-1]:
        lines.pop()
    if len(lines) <= max_lines and size <= max_bytes:
        return len(lines), text, "none"
    best = next((k for k in range(min(max_lines, len(lines)), 0, -1) if len("\n".join(lines[-k:]).encode()) <= max_bytes), 0)
    if not best:
        part = next(lines[-1][k:] for k in range(len(lines[-1]) + 1) if len(lines[-1][k:].encode()) <= max_bytes)
        return 1, part, "bytes"
    return best, "\n".join(lines[-best:]), "lines" if best >= min(max_lines, len(lines)) else "bytes"


def test_truncate_and_slice(spark):
    docs = spark.createDataFrame([(1, "a\nbb\nccc"), (2, "x" * 50), (3, ""), (4, None)], "doc_id int, text string")
    head = {r["doc_id"]: (r["text"], r["truncated_by"], r["first_too_long"]) for r in D.truncate_lines(docs, 2, 10).collect()}
    assert head == {1: ("a\nbb", "lines", False), 2: ("", "bytes", True), 3: ("", "none", False)}
    tail = {r["doc_id"]: r["text"] for r in D.truncate_lines(docs, 2, 10, "tail").collect()}
    assert tail == {1: "bb\nccc", 2: "x" * 10, 3: ""}
    part = {r["doc_id"]: (r["past_end"], r["next_offset"], r["text"]) for r in D.read_slice(docs, 2, 1).collect()}
    assert part == {1: (False, 3, "bb"), 2: (True, None, None), 3: (True, None, None)}
    for df in (D.truncate_lines(docs), D.truncate_lines(docs, side="tail"), D.read_slice(docs, 2, 1), D.grep_corpus(docs, "b", 1, None)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_truncate_tail_of_any_characters(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "é", "€", "😀", "\n", "\r\n", "́"]) for _ in range(rng.randrange(40))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for lines, size in ((2, 5), (3, 17), (1, 1), (50, 30)):
        got = {r["doc_id"]: r for r in D.truncate_lines(docs, lines, size, "tail").collect()}
        for k, t in enumerate(texts):
            n, text, by = brute_tail(t.replace("\r\n", "\n"), lines, size)
            assert (got[k]["lines"], got[k]["text"], got[k]["truncated_by"], got[k]["bytes"]) == (n, text, by, len(text.encode())), (t, lines, size)


def test_grep_limit_and_context(spark):
    rng = random.Random(9)
    texts = ["\n".join(rng.choice(["hit", "miss", "a hit", ""]) for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for context, limit in ((0, None), (2, None), (1, 25), (3, 1)):
        hits = [(k, p) for k, t in enumerate(texts) for p, x in enumerate(t.split("\n")) if "hit" in x][:limit]
        want = sorted({(k, q, texts[k].split("\n")[q], (k, q) in set(hits)) for k, p in hits for q in range(max(p - context, 0), min(p + context + 1, len(texts[k].split("\n"))))})
        assert sorted(tuple(r) for r in D.grep_corpus(docs, "hit", context, limit).collect()) == want


def test_reports_are_ordered(spark):
    """The top commands of 400, and the lists that promise an order."""
    rng = random.Random(10)
    calls = spark.createDataFrame([(1, k, "bash", f"cmd{k % 400}") for k in range(1200)], "session_id int, call_id int, tool string, command string").repartition(7)
    tokens = {k: rng.randrange(10**6) for k in range(1200)}
    results = spark.createDataFrame([(1, k, k, False, n) for k, n in tokens.items()], "session_id int, call_id int, seq int, is_error boolean, tokens long").repartition(5)
    want = sorted(((-sum(tokens[k] for k in range(c, 1200, 400)), f"cmd{c}") for c in range(400)))[:50]
    assert [(-r["tokens"], r["tool"]) for r in A.bash_stats(calls, results).collect()] == want
    assert len(A.tool_stats(calls, results).collect()) == 1
    rows = [(k % 5, k, "compaction" if k % 3 else "message", "user", f"t{k}") for k in range(200)]
    entries = spark.createDataFrame(rng.sample(rows, 200), "session_id int, seq int, type string, role string, text string").repartition(6)
    assert [(r["session_id"], r["seq"]) for r in R.entries_of_type(entries, "compaction").collect()] == sorted((r[0], r[1]) for r in rows if r[2] == "compaction")
    assert [(r["session_id"], r["seq"]) for r in D.user_messages(entries).collect()] == sorted((r[0], r[1]) for r in rows)
    assert [(r["session_id"], r["seq"]) for r in R.last_n_per_session(entries, 3).collect()] == [(s, k) for s in range(5) for k in sorted(r[1] for r in rows if r[0] == s)[-3:]]
    listed = spark.createDataFrame([(k, k * 7 % 40) for k in range(80)], "session_id int, modified int").repartition(4)
    assert [(r["modified"], r["session_id"]) for r in D.list_sessions(listed).collect()] == sorted(((k * 7 % 40, k) for k in range(80)), key=lambda x: (-x[0], x[1]))
    usage = spark.createDataFrame([(f"p{k % 4}", "m", "message", k, 0, 0, 0, k * k) for k in range(20)], "provider string, model string, type string, input long, output long, cache_read long, cache_write long, cost_micro long").repartition(3)
    costs = [r["cost_micro"] for r in U.usage_cost_breakdown(usage).collect()]
    assert costs == sorted(costs, reverse=True) and len(costs) == 4



def test_globs():
    import re

    hits = lambda g, *paths: [bool(re.match(D.glob_pattern(g), p)) for p in paths]
    assert hits("*.ts", "a.ts", "x/a.ts", "a.tsx") == [True, True, False]
    assert hits("src/**/*.{ts,js}", "src/a.ts", "src/x/y/b.js", "lib/a.ts") == [True, True, False]
    assert hits("a[0-9]?.md", "a1x.md", "ab.md") == [True, False]


def test_packing_next_fit(spark):
    rows = [("d", k, "x" * n) for k, n in enumerate([40, 40, 10, 200, 50, 60])]
    got = hooks.pack_transcripts(spark.createDataFrame(rows, "cwd string, seq int, text string"), 100).orderBy("seq").collect()
    assert [r["bin"] for r in got] == [0, 0, 0, 1, 2, 3]
    rng = random.Random(7)
    rows = [(d, k, rng.choice(["x", "é", "😀"]) * rng.choice([0, 1, 5, 30, 49, 50, 51, 70])) for d in ("a", "b", None) for k in range(300)]
    packed = hooks.pack_transcripts(spark.createDataFrame(rng.sample(rows, len(rows)), "cwd string, seq int, text string").repartition(5), 100, keep_text=False).collect()
    found = {(r["cwd"], r["seq"]): (r["bin"], r["size"]) for r in packed}
    for d in ("a", "b", None):
        number, used = -1, None
        for _, k, text in [r for r in rows if r[0] == d]:
            size = len(text.encode("utf-16-le")) // 2
            fits = used is not None and used + 2 + size <= 100
            number, used = (number, used + 2 + size) if fits else (number + 1, size)
            assert found[d, k] == (number, size)
            used = None if size > 100 else used


def test_audit_timing_and_catalog_hash(spark):
    lines = spark.createDataFrame([("r", 0, "x: 5ms"), ("r", 1, "--- Startup Timings ---"), ("r", 2, "  load: 10ms"), ("r", 3, "load: 20ms"), ("r", 4, "------------------------"), ("r", 5, "load: 99ms")], "run string, line_no int, line string")
    r = hooks.timing_summary(lines).first()
    assert (r["label"], r["n"], r["min_ms"], r["max_ms"], r["median_ms"]) == ("load", 2, 10.0, 20.0, 15.0)
    models = spark.createDataFrame([("p", "a", 1), ("p", "b", 2)], "provider string, model string, x int")
    assert K.catalog_revision(models, models.columns).first() == K.catalog_revision(models.orderBy(F.desc("x")), models.columns).first()


def test_overlay_maps(spark):
    base = spark.createDataFrame([("p", "m", {"a": "1", "b": None}, 5)], "provider string, model string, levels map<string,string>, x int")
    over = spark.createDataFrame([("p", "m", {"b": "2"}, None)], "provider string, model string, levels map<string,string>, x int")
    r = K.overlay_catalog(base, over, maps=["levels"]).first()
    assert r["levels"] == {"a": "1", "b": "2"} and r["x"] == 5


def test_budget_and_empty(spark):
    df = spark.createDataFrame([(1, 1, "user", "message", 50), (1, 2, None, "branch_summary", 60), (1, 3, "user", "message", 50), (1, 4, "toolResult", "message", 500)], "session_id long, seq long, role string, type string, tokens long")
    assert [r["seq"] for r in C.select_branch_budget(df, 100).orderBy("seq").collect()] == [2, 3]
    assert [r["seq"] for r in C.select_branch_budget(df, 55).orderBy("seq").collect()] == [3]
    assert C.select_branch_budget(df, 0).count() == 3
    assert R.branch_path(df.limit(0).withColumn("parent_seq", F.lit(None).cast("long"))).count() == 0


def test_more_scalars(spark):
    blocks = spark.sql("select array(named_struct('type','text','text','a','data',cast(null as string)), named_struct('type','image','text',null,'data','D'), named_struct('type','text','text','b','data',null)) as c")
    r = blocks.select(S.content_text("c").alias("a"), S.content_text("c", " ").alias("b"), S.content_text("c", "|", "all").alias("d")).first()
    assert tuple(r) == ("a\nb", "a b", "a|D|b")
    t = spark.sql("select cast(1738318860000 as bigint) as ms, '2025-01-01T00:00:00Z' as iso, cast(null as bigint) as none, 'bad' as bad").select(S.any_time("ms", "iso").cast("string").alias("a"), S.any_time("none", "iso").cast("string").alias("b"), S.any_time("none", "bad").alias("c")).first()
    assert tuple(t) == ("2025-01-31 10:21:00", "2025-01-01 00:00:00", None)
    names = spark.createDataFrame([("m-latest",), ("m-20250101",), ("m",)], "m string").select(S.is_alias("m").alias("a")).collect()
    assert [r["a"] for r in names] == [True, False, True]
    r = spark.sql("select array('b','a','c') as x, array('c') as y, 0.1234 as p, cast(null as double) as q").select(S.distinct_except("x", "y").alias("a"), S.percent_label("p").alias("b"), S.percent_label("q").alias("c"), S.ratio(F.lit(1), F.lit(0)).alias("d")).first()
    assert tuple(r) == (["a", "b"], "12.3%", "n/a", None)
    r = spark.sql("select timestamp'2025-03-30 23:30:00' as t").select(S.day_label("t", "Europe/Berlin").alias("a"), S.week_label("t").alias("b"), S.hour_label("t", "Europe/Berlin").alias("c")).first()
    assert tuple(r) == ("2025-03-31", "2025-03-24", "01")
    long_line = one(spark, x="y" * 501).select(S.truncate_line("x").alias("t")).first()["t"]
    assert long_line == "y" * 500 + "... [truncated]"


def test_forks_and_harness_context(spark):
    tree = spark.createDataFrame([(1, s, p, t, "user" if s in (2, 6) else "assistant", 3 if s == 5 else None) for s, p, t in TREE], "session_id long, seq long, parent_seq long, type string, role string, first_kept_seq long")
    at = spark.createDataFrame([(1, 6)], "session_id long, seq long")
    heads, rows = R.fork_session(tree, at, "before")
    assert [r["seq"] for r in rows.orderBy("seq").collect()] == [1, 2, 3, 4, 5] and tuple(heads.first()) == ("1-fork", 1)
    with pytest.raises(Exception):  # noqa: B017
        R.fork_session(tree, at.withColumn("seq", F.lit(7).cast("long")), "before")[1].collect()
    assert R.fork_session(tree)[1].count() == len(TREE)
    assert [r["seq"] for r in R.context_entries(tree, at, harness=True).orderBy("context_pos").collect()] == [5, 6]
    labels = spark.createDataFrame([(1, 90, 2, "old", 1), (1, 91, 2, "new", 2), (1, 92, 3, "x", 3), (1, 93, 3, "", 4)], "session_id long, seq long, target long, label string, ts int")
    got = R.extract_branch(tree, at, labels).filter("type = 'label'").collect()
    assert [(r["target"], r["label"], r["pos"]) for r in got] == [(2, "new", 6)]


def test_approximate_forms(spark):
    calls = spark.createDataFrame([("m", k, True, k / 2.0) for k in range(100)], "mode string, n int, success boolean, inflation double")
    exact, near = (A.edit_group_stats(calls, "mode", a).first()["median_inflation"] for a in (False, True))
    assert abs(exact - near) <= 0.5


def test_scan_reads_only_what_it_needs(spark):
    from tracelake.plans.queries import QUERIES

    plan = QUERIES["e1_cost_by_day_provider"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan


def test_resolve_model_refs(spark):
    """By the rule: exact before partial, an id of two providers is partial, the provider's name is no name, parts come off one by one."""
    models = [
        ("openai", "gpt-5", "GPT 5"), ("openai", "gpt-5-mini", "GPT 5 Mini"), ("azure", "gpt-5", "GPT 5"), ("anthropic", "claude-x-20250101", "Claude X"), ("anthropic", "claude-x-20250301", "Claude X"), ("anthropic", "claude-y", "Claude Y"),
        ("anthropic", "claude-y-20250909", "Claude Y"), ("router", "meta/llama:free", "Llama (free)"), ("router", "meta/llama", "Llama"), ("z", "q", None), ("z", "-latest-20250101-latest", None),
    ]
    refs = {
        "openai/gpt-5": ("openai", "gpt-5", None, "exact", False), " OpenAI / GPT-5 ": ("openai", "gpt-5", None, "exact", False), "gpt-5": ("openai", "gpt-5-mini", None, "contains", False), "gpt-5-mini:high": ("openai", "gpt-5-mini", "high", "exact", False),
        "openai": (None, None, None, "none", False), "claude-x": ("anthropic", "claude-x-20250301", None, "contains", False), "claude-y": ("anthropic", "claude-y", None, "exact", False), "CLAUDE": ("anthropic", "claude-y", None, "contains", False),
        "mini": ("openai", "gpt-5-mini", None, "contains", False), "GPT 5 M": ("openai", "gpt-5-mini", None, "contains", False), "meta/llama:free": ("router", "meta/llama:free", None, "exact", False), "meta/llama:free:low": ("router", "meta/llama:free", "low", "exact", False),
        "meta/llama:paid": ("router", "meta/llama", None, "exact", True), "gpt-5-mini:odd:high": ("openai", "gpt-5-mini", None, "exact", True), "gpt-5-mini:low:high": ("openai", "gpt-5-mini", "high", "exact", False), "q": ("z", "q", None, "exact", False),
        "y": ("anthropic", "claude-y", None, "contains", False), "(f": ("router", "meta/llama:free", None, "contains", False), "": ("z", "q", None, "contains", False), "nope": (None, None, None, "none", False), "nope:high": (None, None, None, "none", False),
        "zz*": (None, None, None, "none", False), "i/gpt": (None, None, None, "none", False),
    }
    globs = {
        "openai/*:low": {("openai", "gpt-5"), ("openai", "gpt-5-mini")}, "*5": {("openai", "gpt-5"), ("azure", "gpt-5")}, "claude-?-2025*": {("anthropic", "claude-x-20250101"), ("anthropic", "claude-x-20250301"), ("anthropic", "claude-y-20250909")},
        "meta/*": {("router", "meta/llama:free"), ("router", "meta/llama")}, "router/*": set(), "router/**": {("router", "meta/llama:free"), ("router", "meta/llama")}, "[!a-y]": set(), "?": {("z", "q")}, "*Q": {("z", "q")},
    }
    catalog = spark.createDataFrame([(p, m, n, 1) for p, m, n in models], "provider string, model string, name string, gram int")
    asked = spark.createDataFrame([(r,) for r in [*refs, *globs, *refs, None]], "ref string")
    got = {}
    for r in K.resolve_model_refs(asked, catalog).collect():
        got.setdefault(r["ref"], []).append((r["provider"], r["model"], r["level"], r["how"], r["unknown_level"]))
    assert {k: v for k, v in got.items() if k in refs} == {k: [v] for k, v in refs.items()}
    for g, want in globs.items():
        rows = got[g]
        assert {(p, m) for p, m, *_ in rows if p} == want and all(r[3] == ("glob" if want else "none") and r[2] == ("low" if g.endswith(":low") else None) for r in rows), g
    plan = K.resolve_model_refs(asked, catalog)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    rng = random.Random(3)
    names = [("p", "".join(rng.choice("ab-") for _ in range(rng.randrange(1, 9)))) for _ in range(60)]
    texts = sorted({"".join(rng.choice("ab-") for _ in range(rng.randrange(1, 7))) for _ in range(200)})
    ids = sorted({m for _, m in names})
    found = {r["ref"]: r["model"] for r in K.resolve_model_refs(spark.createDataFrame([(t,) for t in texts], "ref string"), spark.createDataFrame(names, "provider string, model string")).collect()}
    assert found == {t: t if t in ids else max((m for m in ids if t in m), default=None) for t in texts}


def test_model_candidates(spark):
    """Texts and globs meet few more models than they mean: candidates grow with the texts, not with texts times models."""

    def candidates(n):
        models = [(k, p, f"ring-{k:07}", f"{p}/ring-{k:07}", f"ring-{k:07}", 3, "") for p in "pq" for k in range(n)]
        models = spark.createDataFrame(models, "no long, provider string, model string, full string, id string, id_at int, name string").withColumn("no", F.col("no") * 2 + (F.col("provider") == "q").cast("int"))
        counts = K.gram_counts(models)
        rare = K.rare_runs(spark.createDataFrame([(f"ring-{k:07}",) * 2 for k in range(n)], "text string, low string"), counts)
        globs = K.glob_runs(spark.createDataFrame([(f"*-{k:06}?",) * 2 for k in range(n // 10)], "ref string, text string"), counts)
        postings = K.postings_of(models, rare, globs)
        assert K.glob_models(globs, models, postings).count() == 2 * n and K.long_models(rare, models, postings).count() == n
        return rare.join(postings, "gram").count() / n, globs.join(postings, "gram").count() / (n // 10)

    few, many = candidates(300), candidates(3000)
    assert max(many) <= 200 and all(b <= 2 * a for a, b in zip(few, many, strict=True))


def test_scans_over_chunks(spark, monkeypatch):
    """Sessions of many chunks give what one chunk gives: running values, and the operators on them; no window holds a session."""
    rng = random.Random(21)
    rows = []
    for s, n in ((1, 400), (2, 3), (3, 1), (None, 40), (4, 90)):
        for q in sorted(rng.sample(range(n * 3), n)):
            kind = rng.choices(["message", "compaction", "branch_summary", "label"], [20, 1, 1, 3])[0]
            role = rng.choice(["user", "assistant", "toolResult", None]) if kind == "message" else None
            rows.append((s, q, kind, role, rng.choice([0, 5, 90, 400]), rng.random() < 0.8, rng.choice(["p", "q", None]), "m", rng.randrange(3) * 900, rng.randrange(3) * 1500, rng.choice([0, 0, 700]), q * 60, rng.random() < 0.5, 10))
    names = "session_id int, seq long, type string, role string, tokens long, is_message boolean, provider string, model string, input long, cache_read long, cache_write long, ts long, bad boolean, output long"
    df = spark.createDataFrame(rng.sample(rows, len(rows)), names)
    usage = df.withColumn("ts", F.timestamp_seconds("ts"))
    made = {
        "scan": lambda: scans.scanned(df, a=scans.Scan("sum", F.col("tokens")), b=scans.Scan("last", F.col("provider"), inclusive=False), c=scans.Scan("last", F.col("role"), reverse=True), d=scans.Scan("max", F.col("tokens"), reverse=True, inclusive=False), e=scans.Scan("min", F.when(F.col("tokens") > 0, F.col("seq")))),
        "cut": lambda: C.find_cut_point(df, 3000),
        "cut_early": lambda: C.find_cut_point(df, 10**9),
        "misses": lambda: C.cache_misses(usage, noise=100).select("session_id", "seq", "missed", "idle_s", "model_changed", "segment"),
        "pressure": lambda: C.context_pressure_sessions(usage),
        "budget": lambda: C.select_branch_budget(df, 2500).select("session_id", "seq"),
        "retries": lambda: C.retry_episodes(df, F.col("bad")),
        "model": lambda: U.model_in_effect(df),
    }
    got = {}
    for size in (10**9, 7, 1):
        monkeypatch.setattr(scans, "CHUNK", size)
        for name, make in made.items():
            got.setdefault(name, []).append(sorted(str(r) for r in make().collect()))
    assert all(a == b == c and a for a, b, c in got.values())
    whole = {}
    for s, q, *rest in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        whole.setdefault(s, []).append((q, *rest))
    want = []
    for s, own in whole.items():
        for k, (q, _, _, _, _, provider, *_) in enumerate(own):
            later = [x[3] for x in own[k + 1 :]]
            want.append((s, q, sum(x[3] for x in own[: k + 1]), next((x[5] for x in own[:k][::-1] if x[5]), None), next((x[2] for x in own[k:] if x[2]), None), max(later, default=None), next((x[0] for x in own[: k + 1] if x[3] > 0), None)))
    found = [(r["session_id"], r["seq"], r["a"], r["b"], r["c"], r["d"], r["e"]) for r in made["scan"]().collect()]
    assert sorted(map(str, found)) == sorted(map(str, want))


def test_session_listing(spark):
    """Position in the tree walked from the top, of forests with many roots, deep chains, ties, missing parents and cycles."""
    rng = random.Random(6)
    rows = [(k, rng.choice([None, k, 999, *range(max(k - 6, 0), k)]), rng.randrange(12)) for k in range(120)] + [(200, 201, 5), (201, 200, 1), (202, 201, 3)]
    rows += [(300 + k, 299 + k if k else None, 0) for k in range(40)]
    got = {r["session_id"]: r for r in R.session_lineage(spark.createDataFrame(rng.sample(rows, len(rows)), "session_id long, parent_id long, ts long")).collect()}
    ids, kids = {r[0]: r for r in rows}, {}
    for k, up, _ in rows:
        kids.setdefault(up if up in ids and up != k else None, []).append(k)

    def under(k):
        return [k, *(x for c in kids.get(k, []) for x in under(c))]

    latest = {k: max(ids[x][2] for x in under(k)) for k in ids if k not in (200, 201, 202)}
    order, last = [], set()

    def walk(up, depth):
        own = sorted(kids.get(up, []), key=lambda k: (-latest[k], k))
        last.update(own[-1:])
        for k in own:
            order.append((k, depth))
            walk(k, depth + 1)

    walk(None, 0)
    assert [(k, got[k]["depth"]) for k in sorted((k for k in got if got[k]["position"] is not None), key=lambda k: got[k]["position"])] == order
    assert [got[k]["position"] for k, _ in order] == list(range(len(order))) and {k for k, _ in order if got[k]["is_last"]} == last
    assert all(got[k]["latest"] == latest[k] and got[k]["size"] == len(under(k)) for k, _ in order)
    assert all(got[k]["position"] is None for k in (200, 201, 202))


def test_projectors(spark):
    """All types in one pass: functions and columns, several messages of an entry, types that nobody registered, null data."""
    p = hooks.Projectors()
    p.register("a", lambda d: [("user", d), ("assistant", d * 2)])
    p.register("b", lambda d: [])
    p.register_column("c", F.array(F.struct(F.lit("custom").alias("role"), F.concat("data", F.lit("!")).alias("text"))))
    rows = [(1, 1, "custom", "a", "x"), (1, 2, "custom", "b", "y"), (1, 3, "custom", "c", "z"), (1, 4, "custom", "d", "w"), (1, 5, "message", "a", "v"), (2, 1, "custom", "a", None), (2, 2, "custom", None, "u"), (2, 3, "custom", "c", None)]
    entries = spark.createDataFrame(rows, "session_id int, seq int, type string, custom_type string, data string")
    made = p.project(entries)
    assert sorted(map(tuple, made.collect()), key=str) == [(1, 1, 0, "user", "x"), (1, 1, 1, "assistant", "xx"), (1, 3, 0, "custom", "z!"), (2, 3, 0, "custom", None)]
    assert made._jdf.queryExecution().executedPlan().toString().count("Scan ") == 1
    p.register_column("a", F.array(F.struct(F.lit("user").alias("role"), F.col("data").alias("text"))))
    p.register_column("b", F.lit(None).cast("array<struct<role:string,text:string>>"))
    assert len(p.project(entries).collect()) == 4 and hooks.Projectors().project(entries).count() == 0


def test_texts_in_chunks(spark, monkeypatch):
    """Chunks joined by line feeds are the whole text, whatever the size of a chunk."""
    rng = random.Random(15)
    rows = [(s, q, rng.choice(["user", "assistant", "toolResult"]), rng.choice(["", " ", "some text", "é" * rng.randrange(60), "a\nb"])) for s in (1, 2, None) for q in range(40)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "session_id int, seq int, role string, text string")
    whole = {}
    for size in (10**9, 200, 1):
        monkeypatch.setattr(C, "CHUNK_CHARS", size)
        for name, make in (("b23", C.serialize_conversation), ("b24", C.transcript)):
            found = make(df).collect()
            text = {s: "\n".join(r["text"] for r in sorted((r for r in found if r["session_id"] == s), key=lambda r: r["chunk"])) for s in (1, 2, None)}
            assert whole.setdefault(name, text) == text and all(len(r["text"]) < size + 90 for r in found)
            assert len(found) == 3 if size > 1000 else len(found) > 9
    said = [t for s, q, r, t in rows if s == 1 and r != "toolResult" and t.strip()]
    assert whole["b24"][1].startswith("=== SESSION: 1 ===\n[") and whole["b24"][1].endswith("\n=== END SESSION ===") and whole["b24"][1].count("\n---\n") == len(said) - 1


def test_paths_are_not_broadcast_by_file_size(spark, monkeypatch):
    """Files of narrow rows are a hundredth of the rows: joins of paths are planned by rows counted in shuffles, so the driver holds no whole table."""
    plans, real, before = [], R.written, {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}

    def recorded(df, name):
        plans.append((name, df._jdf.queryExecution().sparkPlan().toString()))
        return real(df, name)

    monkeypatch.setattr(R, "written", recorded)
    entries = real(spark.range(600).select((F.col("id") % 3).alias("session_id"), F.col("id").alias("seq"), F.when(F.col("id") >= 3, F.col("id") - 3).alias("parent_seq")), "test-entries")
    found = R.branch_path(entries).collect()
    assert sorted((r["session_id"], r["seq"], r["pos"]) for r in found) == sorted((k % 3, k, k // 3) for k in range(600))
    joined = [(name, p) for name, p in plans if "Join" in p]
    assert {name for name, _ in joined} == {"path", "paths", "jumps"} and not [name for name, p in joined if "BroadcastHashJoin" in p]
    assert before == {k: spark.conf.get(k, None) for k in before}

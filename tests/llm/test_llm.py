"""The training-data operators against brute force, and their defined cases."""

import base64
import binascii
import bisect
import difflib
import hashlib
import json
import math
import os
import random
import re
import tempfile
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelake.llm import common, decontamination, exact_substrings, induced_sort, jaccard_join, licenses, packing, passages, quality_classifier, quality_rules, tool_calls, warc
from tracelake.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{k}" for k in range(30_000))
PASSAGE = " ".join(f"p{k}" for k in range(70))
EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d e f g h i j"), (5, "a b c d e f g h i j"), (6, LONG), (7, LONG),
    (8, "start here " + PASSAGE + " and the end of it"), (9, "another text " + PASSAGE + " closes"), (10, "é" * 300), (11, "x" * 500), (None, "no id " + PASSAGE), (12, "line one\nline one\nline two\n\n\n"),
    (13, "A!! B!! " * 40), (14, "word### other$$$ " * 30), (15, "😀 emoji\r\nand crlf " * 20),
]


@pytest.fixture(scope="module")
def edge(spark):
    """Odd documents, with more columns, of names that the operators use inside."""
    rows = [(i, t, "en", "s", len(t) if t is not None else None, "k", 1, "r") for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, copies int, rep string")


@pytest.fixture(scope="module")
def small(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def words(t):
    return WORD.findall(t or "")


def brute_rules(t):
    w = words(t)
    grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    hit = {p for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark, edge, small):
    for docs, rows in ((edge, EDGE), (spark.read.parquet(f"{SF}/documents.parquet"), small)):
        got = quality_rules.judge(docs).collect()
        cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert Counter((r["doc_id"], *(r[c] for c in cols)) for r in got) == Counter((i, *brute_rules(t)) for i, t in rows)
        assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in got)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(labels[r["doc_id"]], r["kept"]) for r in got if r["doc_id"] in labels and not r["base_failed"]]
    assert sum(k for q, k in judged if q) >= 0.97 * sum(q for q, _ in judged) and sum(not k for q, k in judged if not q) >= 0.7 * sum(not q for q, _ in judged)
    assert quality_rules.judge(edge.limit(0)).count() == 0


def test_quality_rules_model(spark):
    """EM in the one expression against a loop, and the posterior against its Python form."""
    names = ["a", "b", "c"]
    rows = [(1, 1, 1, 800), (1, None, 1, 50), (0, 0, 1, 60), (0, 0, 0, 40), (1, 0, None, 5)]
    patterns = spark.createDataFrame(rows, "a int, b int, c int, rows long")
    model = quality_rules.fit(patterns, names, rounds=7)
    prior, good, bad, n = 0.85, [0.97] * 3, [0.4] * 3, sum(r[3] for r in rows)
    w = 0.02 * n + 1
    for _ in range(7):
        post = [quality_rules.score_pattern({"prior": prior, "right": {1: dict(zip(names, good, strict=True)), 0: dict(zip(names, bad, strict=True))}}, dict(zip(names, r, strict=False))) for r in rows]
        g = [p * r[3] for p, r in zip(post, rows, strict=True)]
        b = [(1 - p) * r[3] for p, r in zip(post, rows, strict=True)]
        prior = (sum(g) + 0.85 * w) / (n + w)
        good = [(sum(x for x, r in zip(g, rows, strict=True) if r[k] == 1) + 0.97 * w) / (sum(x for x, r in zip(g, rows, strict=True) if r[k] is not None) + w) for k in range(3)]
        bad = [(sum(x for x, r in zip(b, rows, strict=True) if r[k] == 0) + 0.4 * w) / (sum(x for x, r in zip(b, rows, strict=True) if r[k] is not None) + w) for k in range(3)]
    assert model["prior"] == pytest.approx(prior, abs=1e-7) and list(model["right"][1].values()) == pytest.approx(good, abs=1e-7) and list(model["right"][0].values()) == pytest.approx(bad, abs=1e-7)
    for r in patterns.withColumn("p", quality_rules.posterior(model)).collect():
        assert r["p"] == pytest.approx(quality_rules.score_pattern(model, {k: r[k] for k in names}))


def test_classifier(spark, edge):
    got = QUERIES["op2_quality_classifier"](spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r["held_out"] == (binascii.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [(labels[r["doc_id"]], r["score"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for q, s in held if q], [s for q, s in held if not q]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.95
    table = quality_classifier.features(edge)
    model = quality_classifier.train(table, spark.createDataFrame([(5, 1, 0), (6, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int"))
    assert quality_classifier.score(table, model).count() == len(EDGE)
    none = quality_classifier.train(table, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality_classifier.score(table, none).collect()} == {0.5}
    assert quality_classifier.score(table.limit(0), none).count() == 0


def brute_features(t):
    t, white = t or "", str.maketrans("", "", " \t\n\x0b\x0c\r")
    w, lines, chars = words(t), [x for x in t.split("\n") if x.translate(white)], len(t.translate(white))
    n, of = max(len(w), 1), lambda marks: sum(c in marks for c in t)
    return {
        "log_words": math.log1p(len(w)), "word_size": chars / n, "symbols": of("#*$%&<>") / n, "digits": of("0123456789") / max(chars, 1), "capitals": of("ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ") / max(chars, 1), "shouts": of("!") / n, "bars": of("|") / n,
        "sentences": of(".?") / n, "dup_lines": (len(lines) - len(set(lines))) / max(len(lines), 1), "line_size": math.log1p(len(w) / max(len(lines), 1)), "distinct_words": len(set(w)) / n,
    }


def brute_score(model, x):
    """Every table's value for the bin of a feature, or of a pair of them, one by one."""
    f = model["base"] + sum(t[bisect.bisect_left(c.tolist(), x[k])] for k, (c, t) in enumerate(zip(model["cuts"], model["tables"], strict=True)))
    for p in model["pairs"]:
        i, j = (bisect.bisect_left(c.tolist(), x[k]) for k, c in zip(p["of"], p["cuts"], strict=True))
        f += p["table"][i][j]
    return 1 / (1 + math.exp(-f))


def test_classifier_brute_force(spark, edge, small):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality_classifier.train(quality_classifier.features(docs), labels)
    assert model["pairs"] and any(t.any() for t in model["tables"])
    for table, rows in ((docs, small), (edge, EDGE)):
        got = quality_classifier.features(table, ("doc_id", "text"))
        want = {(i, t): brute_features(t) for i, t in rows}
        for r in got.collect():
            own = want[r["doc_id"], r["text"] if r["text"] is not None else None]
            assert {k: r[k] for k in quality_classifier.FEATURES} == pytest.approx(own, abs=1e-9), r["doc_id"]
        for r in quality_classifier.score(got, model, ("doc_id", "text")).collect():
            own = want[r["doc_id"], r["text"]]
            assert r["score"] == pytest.approx(brute_score(model, [own[k] for k in quality_classifier.FEATURES]), abs=1e-6)


def test_classifier_learns_interactions():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_classifier.fit(x, y)
    assert model["pairs"][0]["of"] == (0, 1) and ((quality_classifier.scores(model, x) > 0.5) == y).mean() > 0.9


def brute_links(rows, threshold=0.8):
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for _, t in rows]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                n[a] += 1
                n[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(k)
    return n, [sorted(groups[find(k)]) for k in range(len(rows))]


def near_copies(n=60, seed=4):
    rng = random.Random(seed)
    base = [f"b{rng.randrange(400)}" for _ in range(120)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        out.append((100 + k, " ".join(w)))
    return out


def test_jaccard_join(spark, edge, small):
    rows = small + near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    n, groups = brute_links(rows)
    for block in (512, 8):  # blocks smaller than a cluster give the same
        got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in jaccard_join.near_duplicates(docs if block == 8 else docs, block=block).collect()}
        by_id = {i: k for k, (i, _) in enumerate(rows)}
        if len(by_id) == len(rows):
            assert got == {i: (n[k], min(rows[j][0] for j in groups[k])) for i, k in by_id.items()}
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.near_duplicates(edge).collect())
    n, groups = brute_links(EDGE)
    assert got == Counter((i, i if not words(t) else min((EDGE[j][0] for j in g if EDGE[j][0] is not None), default=None), c) for (i, t), c, g in zip(EDGE, n, groups, strict=True))
    assert jaccard_join.near_duplicates(edge.limit(0)).count() == 0
    assert 1 - (1 - 0.8 ** jaccard_join.least_depth()) ** 24 >= 0.999


def test_forest_recall(spark):
    """Candidates alone, before verification: the share of brute force's links that the forest ties, by similarity."""
    rng = random.Random(9)
    sets, pairs = [], []
    for k in range(1500):
        w = np.array([rng.randrange(2**63) for _ in range(120)], np.uint64)
        other = w.copy()
        for j in rng.sample(range(120), rng.choice([1, 2])):
            other[j] = rng.randrange(2**63)
        a, b = jaccard_join.shingles(w), jaccard_join.shingles(other)
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        pairs.append((2 * k, 2 * k + 1, j))
        sets += [a, b]
    least = jaccard_join.least_depth()
    names = [f"p{d}" for d in range(jaccard_join.DEPTH, least - 1, -1)]
    rows = [(k, *(r.tolist() for r in jaccard_join.prefixes(s, jaccard_join.TREES, jaccard_join.DEPTH, least))) for k, s in enumerate(sets)]
    texts = common.written(spark.createDataFrame(rows, "c long, " + ", ".join(f"{n} array<long>" for n in names)), "forest-texts")
    found = {(min(r), max(r)) for r in jaccard_join.candidates(texts, least=least).collect()}
    close = [(a, b) for a, b, j in pairs if 0.8 <= j < 0.9]
    assert len(close) > 500 and np.mean([p in found for p in close]) >= 0.995 and np.mean([(a, b) in found for a, b, j in pairs if j >= 0.9]) >= 0.999
    assert len(found) < 1.05 * len(pairs)


def test_components(spark):
    rng = random.Random(2)
    for n, m in ((0, 0), (40, 30), (200, 190)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(1000, 1000 + n)]
        root = {}

        def find(k):
            root.setdefault(k, k)
            while root[k] != k:
                k = root[k]
            return k

        for a, b in edges:
            if a != b:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
        got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {k: find(k) for k in root}


def test_packing(spark, edge):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    files = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json"))
    marks = [(70, "a<|endoftext|>b"), (71, "<|endoftext|><|endoftext|> x"), (72, "<|endoftext |> <|end")]
    for docs, rows in ((edge, EDGE), (spark.createDataFrame(marks, "doc_id long, text string"), marks), (spark.read.parquet(f"{SF}/documents.parquet"), None)):
        rows = rows or [(r["doc_id"], r["text"]) for r in docs.collect()]
        texts = defaultdict(list)
        for i, t in rows:
            texts[i].append([*tok.encode(t or "", add_special_tokens=False).ids, 1])
        got = packing.pack(docs, *files).collect()
        assert sum(r["length"] for r in got) == sum(len(x) for v in texts.values() for x in v)
        used, covered = defaultdict(list), Counter()
        for r in got:
            body = np.array(texts[r["doc_id"]][0][r["start"] : r["start"] + r["length"]], "<u4")
            assert r["length"] > 0 and r["doc_tokens"] == len(texts[r["doc_id"]][0]) and r["ids_crc32"] == zlib.crc32(body.tobytes())
            used[r["sequence_id"]].append((r["offset"], r["length"]))
            covered[r["doc_id"]] += r["length"]
        assert covered == {i: sum(map(len, v)) for i, v in texts.items()}
        for spans in used.values():
            at = 0
            for offset, n in sorted(spans):
                assert offset == at
                at += n
            assert at <= 2048
        assert len(used) * 2048 - sum(n for s in used.values() for _, n in s) <= 2048 * docs.rdd.getNumPartitions()
    assert packing.pack(edge.limit(0), *files).count() == 0


def test_packing_balance():
    rng = random.Random(1)
    lengths = [rng.randrange(1, 1500) for _ in range(2000)]
    plan = packing.assign(lengths)
    assert all(sum(n for _, _, n in s) == 2048 for s in plan[:-1])
    cost = lambda s: sum(n + n * n / 2048 for _, _, n in s)
    costs = [cost(s) for s in plan[:-1]]
    order = sorted(range(2000), key=lambda k: k)
    plain, used = [[]], 0  # documents in the order they come, cut at the ends
    for d in order:
        n = lengths[d]
        while n:
            take = min(n, 2048 - used)
            plain[-1].append((d, 0, take))
            used, n = used + take, n - take
            if used == 2048:
                plain.append([])
                used = 0
    assert np.std(costs) < np.std([cost(s) for s in plain[:-1]])


def test_packing_cuts_only_what_fits_nowhere():
    rng = random.Random(3)
    for draw in (lambda: min(2047, int(rng.lognormvariate(6, 1)) + 1), lambda: rng.choice([rng.randrange(1200, 1500), rng.randrange(300, 900)]), lambda: rng.randrange(1, 2048)):
        lengths = [draw() for _ in range(1200)]
        plan = packing.assign(lengths)
        assert len(plan) == -(-sum(lengths) // 2048) and all(sum(n for _, _, n in s) == 2048 for s in plan[:-1])
        pieces = defaultdict(list)
        for k, s in enumerate(plan):
            for d, start, n in s:
                pieces[d].append((start, n, k))
        room = [2048] * len(plan)
        room[-1] = sum(lengths) - 2048 * (len(plan) - 1)
        cost = [0.0] * len(plan)
        for d in sorted(range(len(lengths)), key=lambda d: (-lengths[d], d)):
            left = lengths[d]
            for start, n, k in sorted(pieces[d]):
                fits = [(cost[s], s) for s in range(len(plan)) if room[s] >= left]
                # whole to the cheapest sequence with room, and cut only where there is none, to fill the emptiest
                assert start == lengths[d] - left and ((n == left and k == min(fits)[1]) if fits else n == room[k] == max(room))
                room[k] -= n
                cost[k] += n + n * n / 2048
                left -= n
            assert not left
    assert packing.assign([]) == [] and packing.assign([2048, 5]) == [[(0, 0, 2048)], [(1, 0, 5)]]


CALLS = [
    (1, "a", 1, "ask", '{"text":"x","turn":0}', None), (1, "b", 2, "ask", '{"turn":-1,"text":""}', "a"), (1, "b", 3, "ask", "{}", "a"), (1, "c", 4, "none", "{}", "b"), (1, "d", 5, "ask", "not json", "zz"),
    (1, "e", 6, "ask", '{"text":"é","turn":1,"x":2}', "f"), (1, "f", 7, "ask", '{"text":"x","turn":1}', "e"), (2, "a", 1, "ask", '{"turn":true,"text":"x"}', None), (None, None, 1, "ask", "{}", None),
]


def test_tool_calls(spark):
    calls = spark.createDataFrame([(*c, "more") for c in CALLS], "conv_id long, call_id string, seq long, name string, arguments string, parent_id string, answered string")
    results = spark.createDataFrame([(1, "a", 9, "later"), (1, "a", 2, "first"), (1, "q", 3, "lost"), (2, "a", 2, None)], "conv_id long, call_id string, seq long, content string")
    got = {(r["conv_id"], r["call_id"]): r for r in tool_calls.link(calls, results, tool_calls.TURN_SCHEMAS).collect()}
    assert {k: (r["status"], r["level"], r["valid"]) for k, r in got.items()} == {
        (1, "a"): ("linked", 0, True), (1, "b"): ("pending", 1, False), (1, "c"): ("pending", 2, False), (1, "d"): ("pending", 0, False), (1, "e"): ("cycle", None, False), (1, "f"): ("cycle", None, True),
        (1, "q"): ("orphan", None, False), (2, "a"): ("linked", 0, False), (None, None): ("pending", 0, False),
    }
    assert got[(1, "a")]["record"] == '{"arguments":{"text":"x","turn":0},"id":"a","level":0,"name":"ask","result":"first","status":"linked"}'
    assert got[(1, "b")]["errors"] == ["$.text: too short", "$.turn: out of range"] and got[(1, "e")]["errors"] == ["$.x: unknown"]
    assert tool_calls.link(calls.limit(0), results.limit(0), {}).count() == 0
    chain = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").cast("string").alias("call_id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_id"))
    assert all(int(r["call_id"]) == r["level"] for r in tool_calls.levels(chain).collect())


def test_tool_calls_keep_every_row(spark):
    ask = '{"text":"%s","turn":0}'
    calls = [(1, "a", 1, "ask", ask % "x", None), (1, "a", 2, "ask", ask % "y", None), (1, "a", 2, "ask", ask % "y", None), (1, None, 1, "ask", ask % "n1", None), (1, None, 2, "ask", ask % "n2", "a"), (None, "a", 1, "ask", ask % "n3", None), (None, "a", 1, "ask", ask % "n4", None)]
    results = [(1, "a", 5, "second"), (1, "a", 4, "first"), (1, "z", 1, "o1"), (1, "z", 2, "o2"), (1, None, 1, "n5"), (1, None, 1, "n6"), (None, "a", 1, "n7"), (None, None, 1, "n8")]
    got = tool_calls.link(spark.createDataFrame(calls, "conv_id long, call_id string, seq long, name string, arguments string, parent_id string"), spark.createDataFrame(results, "conv_id long, call_id string, seq long, content string"), tool_calls.TURN_SCHEMAS).collect()
    seen = Counter()
    for r in got:
        record = json.loads(r["record"])
        seen[(r["conv_id"], r["call_id"], r["status"], r["level"], (record["arguments"] or {}).get("text"), record["result"])] += 1
    assert seen == Counter({
        (1, "a", "linked", 0, "x", "first"): 1, (1, "a", "duplicate", None, "y", None): 2, (1, "a", "duplicate", None, None, "second"): 1, (1, "z", "orphan", None, None, "o1"): 1, (1, "z", "duplicate", None, None, "o2"): 1,
        (1, None, "pending", 0, "n1", None): 1, (1, None, "pending", 0, "n2", None): 1, (None, "a", "pending", 0, "n3", None): 1, (None, "a", "pending", 0, "n4", None): 1,
        (1, None, "orphan", None, None, "n5"): 1, (1, None, "orphan", None, None, "n6"): 1, (None, "a", "orphan", None, None, "n7"): 1, (None, None, "orphan", None, None, "n8"): 1,
    })


def test_tool_calls_odd_json(spark):
    bad = ["[" * 100_000, '{"a":' * 50_000, '{"text":"\\ud800","turn":1}', '{"\\udc00":1,"text":"x","turn":1}', '{"text":"x","turn":NaN}', '{"text":"x","turn":1e999}', '{"text":"x","turn":-Infinity}', None, "", "[1]", "9" * 5000]
    calls = spark.createDataFrame([(1, str(k), k, "ask", a, None) for k, a in enumerate(bad)], "conv_id long, call_id string, seq long, name string, arguments string, parent_id string")
    results = spark.createDataFrame([], "conv_id long, call_id string, seq long, content string")
    got = {r["seq"]: r for r in tool_calls.link(calls, results, tool_calls.TURN_SCHEMAS).collect()}
    assert len(got) == len(bad) and [k for k, r in got.items() if r["valid"]] == [2]
    assert got[0]["errors"] == got[1]["errors"] == ["$: nested too deeply"] and got[3]["errors"] == ["$.\\udc00: unknown"] and got[9]["errors"] == ["$: not object"]
    assert all(got[k]["errors"] == ["$: not JSON"] for k in (4, 5, 6, 7, 8, 10)) and '"text":"\\ud800"' in got[2]["record"]
    assert all(isinstance(json.loads(r["record"]), dict) for r in got.values())


def test_tool_schemas():
    """Keywords of JSON Schema: values that fit, and values that don't."""
    tree = {"$defs": {"node": {"type": "object", "properties": {"kids": {"type": "array", "items": {"$ref": "#/$defs/node"}}}, "required": ["kids"]}}, "$ref": "#/$defs/node"}
    cases = [
        ({"type": ["string", "null"]}, ["a", None], [1, True, []]), ({"type": "null"}, [None], [0, "", False]), ({"type": "integer"}, [1, 1.0, -3], [1.5, True, "1"]), ({"type": "number"}, [1, 1.5], [True, "1"]), ({"enum": [1, "a", None, [1]]}, [1, 1.0, "a", None, [1.0]], [True, "1", [True], []]),
        ({"const": {"a": [1, False]}}, [{"a": [1.0, False]}], [{"a": [1, 0]}, {}]), ({"pattern": "^a+$"}, ["aa", 3], ["b", ""]), ({"pattern": "("}, [1], ["x"]), ({"maxLength": 2, "minLength": 1}, ["é", "😀😀", 5], ["", "abc"]), ({"exclusiveMinimum": 0, "maximum": 2, "multipleOf": 0.5}, [0.5, 2, "x"], [0, 2.5, 0.3]),
        ({"minItems": 1, "maxItems": 2, "uniqueItems": True}, [[1], [1, True], [1, 2], {}], [[], [1, 1.0], [1, 2, 3]]), ({"items": {"type": "string"}, "prefixItems": [{"type": "integer"}]}, [[1, "a", "b"], [], [2]], [["a"], [1, 2]]), ({"items": [{"type": "integer"}]}, [[1, "x"]], [["x"]]), ({"contains": {"const": 1}}, [[0, 1], {}], [[], [2]]),
        ({"properties": {"a": {"type": "integer"}}, "required": ["a"], "additionalProperties": False}, [{"a": 1}], [{}, {"a": "x"}, {"a": 1, "b": 2}]), ({"additionalProperties": {"type": "integer"}, "patternProperties": {"^s": {"type": "string"}}}, [{"x": 1, "s1": "a"}], [{"x": "a"}, {"s": 1}]),
        ({"propertyNames": {"maxLength": 2}, "minProperties": 1, "maxProperties": 2}, [{"ab": 1}], [{"abc": 1}, {}, {"a": 1, "b": 2, "c": 3}]), ({"dependentRequired": {"a": ["b"]}}, [{}, {"b": 1}, {"a": 1, "b": 1}], [{"a": 1}]),
        ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ["a", 7, None], [3]), ({"oneOf": [{"type": "integer"}, {"minimum": 2}]}, [1, 2.5], [3, 0.5]), ({"allOf": [{"minimum": 1}, {"maximum": 2}]}, [1, 2], [0, 3]), ({"not": {"type": "string"}}, [1], ["a"]), ({"if": {"type": "string"}, "then": {"minLength": 2}, "else": {"minimum": 0}}, ["ab", 1], ["a", -1]),
        (tree, [{"kids": [{"kids": []}]}], [{"kids": [{}]}, {"kids": [{"kids": [1]}]}]), ({"$ref": "#/none"}, [], [1]), ({"$ref": "other.json"}, [], [1]), ({"$ref": "#"}, [], [1]), (True, [1], []), (False, [], [1]), ({"title": "t", "description": "d", "format": "uri"}, [1], []), ({"minimun": 3}, [], [1]), ({"type": "text"}, [], ["a"]),
        ({"required": 5}, [], [1, {}]), ({"enum": 5}, [], [1]), ([], [], [1]), (None, [], [1]), ({"multipleOf": 0}, [], [1]),
    ]
    for schema, good, bad in cases:
        assert all(tool_calls.checked(v, schema) == [] for v in good), (schema, [tool_calls.checked(v, schema) for v in good])
        assert all(tool_calls.checked(v, schema) for v in bad), (schema, bad)


def test_tool_calls_repeated_very_often(spark):
    """An identifier on very many rows: one counts, each other one is a row; and no window over identifiers."""
    n = 3000
    calls = spark.createDataFrame([(1, "c", k % 7, "ask", json.dumps({"text": "x", "turn": k % 11}), None, "q") for k in range(n)] + [(1, "d", 1, "ask", "{}", "c", "q")], "conv_id long, call_id string, seq long, name string, arguments string, parent_id string, status string")
    results = spark.createDataFrame([(1, "c", 1 + k % 3, f"r{k % 5}", 0) for k in range(n)], "conv_id long, call_id string, seq long, content string, level int")
    got = tool_calls.link(calls, results, tool_calls.TURN_SCHEMAS)
    rows = got.collect()
    assert Counter(r["status"] for r in rows) == {"linked": 1, "pending": 1, "duplicate": 2 * n - 2}
    first = next(r for r in rows if r["status"] == "linked")
    assert first["seq"] == 0 and json.loads(first["record"])["arguments"] == {"text": "x", "turn": 0} and json.loads(first["record"])["result"] == "r0"
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_tool_calls_with_several_parents(spark):
    rng = random.Random(5)
    waits = {(c, k): [f"c{j}" for j in {rng.randrange(k) for _ in range(rng.randrange(4))}] if k else [] for c in range(4) for k in range(60)}
    waits |= {(4, k): [f"c{k - 1}"] if k else [] for k in range(300)} | {(5, 0): ["c1", "c2"], (5, 1): ["c0"], (5, 2): [], (5, 3): ["c1"], (5, 4): ["c2", "zz", None]}
    calls = spark.createDataFrame([(c, f"c{k}", v) for (c, k), v in waits.items()], "conv_id long, call_id string, parents array<string>")
    want = {}
    for (c, k), v in waits.items():
        if c < 5:
            want[c, f"c{k}"] = max((want[c, j] + 1 for j in v), default=0)
    want |= {(5, "c0"): None, (5, "c1"): None, (5, "c2"): 0, (5, "c3"): None, (5, "c4"): 1}
    assert {(r["conv_id"], r["call_id"]): r["level"] for r in tool_calls.levels(calls).collect()} == want


def test_tool_calls_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    answers = {(c, t): x for c, t, r, x in rows if r == "assistant"}
    asks = {(c, t): (r, x) for c, t, r, x in rows if r != "assistant"}

    def level(c, t):
        return 0 if (c, t - 2) not in asks else 1 + level(c, t - 2)

    want = {}
    for (c, t), (r, x) in asks.items():
        name, status = "ask" if r == "user" else "configure", "linked" if (c, t + 1) in answers else "pending"
        record = {"id": f"call_{t}", "level": level(c, t), "name": name, "arguments": {"text": x, "turn": t}, "result": answers.get((c, t + 1)), "status": status}
        want[(c, f"call_{t}")] = hashlib.sha256(json.dumps(record, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    for c, t in answers:
        if (c, t - 1) not in asks:
            record = {"id": f"call_{t - 1}", "level": None, "name": None, "arguments": None, "result": answers[(c, t)], "status": "orphan"}
            want[(c, f"call_{t - 1}")] = hashlib.sha256(json.dumps(record, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert {(r["conv_id"], r["call_id"]): r["record_sha256"] for r in QUERIES["op5_tool_calls"](spark, SF).collect()} == want


def test_licenses(spark, edge, small):
    def bigrams(text):
        w = "".join(c if c.isalnum() else " " for c in text.lower()).split()
        return Counter(zip(w, w[1:], strict=False)) if len(w) > 1 else Counter((x,) for x in w)

    given = {k: bigrams(t) for k, t in licenses.templates().items()}

    def brute(text):
        """Every passage against every template."""
        lines, out, block = (text or "").split("\n"), [], []
        for k, line in enumerate([*lines, ""]):
            if bigrams(line):
                block.append(k)
                out.append((k, 0, "line", line))
            elif block:
                if len(block) > 1:
                    out.append((k, 1, "paragraph", "\n".join(lines[block[0] : k])))
                block = []
        if sum(not bigrams(a) and bool(bigrams(b)) for a, b in zip(["", *lines], lines, strict=False)) > 1:
            out.append((len(lines) + 1, 2, "text", text))
        found = []
        for end, _, kind, passage in sorted(out, key=lambda x: (x[0], x[1])):
            own, line = bigrams(passage), end if kind == "line" else 0
            if kind == "paragraph":
                line = end - passage.count("\n") - 1
            score, name = min((-2 * sum((own & g).values()) / (sum(own.values()) + sum(g.values())), k) for k, g in given.items())
            if -score >= licenses.THRESHOLD:
                found.append((name, kind, line, -score))
        return found

    mit = licenses.TEMPLATES["MIT"]
    more = [(50, "intro\n\n" + mit.replace(", ", ",\n") + "\n\nend"), (51, mit), (52, "Released  under the MIT-License!"), (53, "Released under the MIT License with many more words that make it another text")]
    bodies = {60: "BSD-3-Clause", 61: "GPL-3.0", 62: "Apache-2.0", 63: "LGPL-2.1"}
    more += [(i, "Copyright 2020 Somebody\n\n" + licenses.templates()[n]) for i, n in bodies.items()]
    docs = spark.createDataFrame([*small, *more, *((i, t) for i, t in EDGE)], "doc_id long, text string")
    got = [[tuple(x) for x in r["found"]] for r in licenses.scan(docs).collect()]
    assert got == [brute(r["text"]) for r in docs.collect()]
    by_id = {i: g for (i, _), g in zip([*small, *more, *EDGE], got, strict=True)}
    assert [x[:2] for x in by_id[50]] == [("MIT", "paragraph"), ("MIT", "text")] and [x[0] for x in by_id[52]] == ["MIT/notice"] and not by_id[53]
    assert all(("text" in [x[1] for x in by_id[i]]) and {x[0] for x in by_id[i] if x[1] == "text"} == {n} for i, n in bodies.items())
    assert licenses.scan(edge.limit(0)).count() == 0 and licenses.scan(edge).count() == len(EDGE)


def brute_hits(docs, items):
    wins = defaultdict(set)
    for i, t in items:
        w = decontamination.words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[k : k + 10])].add(None if i is None else str(i))
    sizes = {len(x) for x in wins}
    out = []
    for i, t in docs:
        w, hit, found = decontamination.words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[g]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found - {None})).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def test_decontamination(spark, edge, small):
    items = [(1, "a b c d e f g h i j"), (2, None), (3, ""), (4, "W1 w2, W3"), (4, PASSAGE), (5, "one"), (6, "missing entirely"), (None, "line two"), (None, "line one line")]
    bench = spark.createDataFrame([(*x, "e") for x in items], "item_id long, text string, doc_id string")
    got = Counter(tuple(r) for r in decontamination.decontaminate(edge, bench).collect())
    assert got == brute_hits(EDGE, items)
    several = decontamination.digest(decontamination.find(edge, bench, block_bytes=5).drop("at"))
    index = common.written(decontamination.build_index(edge, shard_words=50), "index")  # many shards; one stored index serves every benchmark
    assert Counter(tuple(r) for r in decontamination.digest(decontamination.find(edge, bench, index=index)).collect()) == got
    assert Counter(tuple(r) for r in several.collect()) == got
    assert decontamination.decontaminate(edge.limit(0), bench).count() == 0 and not decontamination.decontaminate(edge, bench.limit(0)).filter("contaminated").count()
    near = decontamination.find(spark.createDataFrame([(1, "q a x b c q"), (2, "a b c"), (3, "a q q q b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "item_id long, text string"), slop=1)
    assert {r["doc_id"] for r in near.filter(F.size("spans") > 0).collect()} == {1, 2}


def test_decontamination_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.sql(ORACLE_SQL["op7_decontamination"])
    df = QUERIES["op7_decontamination"](spark, SF)
    order = [want.columns.index(c) for c in df.columns]
    assert Counter(tuple(r) for r in df.collect()) == Counter(tuple(r[k] for k in order) for r in want.fetchall())


def brute_cut(rows, window=200):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[k : k + window] for t in texts for k in range(len(t) - window + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - window + 1):
            if count[t[k : k + window]] > 1:
                gone[k : k + window] = True
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=False) if not g)).hexdigest()))
    return Counter(out)


def test_exact_substrings(spark, edge, small, tmp_path, monkeypatch):
    rng = random.Random(8)
    part = "".join(rng.choice("ab cdé") for _ in range(900))
    more = [(60, part), (61, "x" + part[100:400] + "y" + part[350:700]), (62, part[:199]), (63, "ab" * 400), (64, part[5:204] + part[5:205])]
    rows = [r for r in EDGE if r[1] != LONG] + more + small[:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(exact_substrings, "BLOCK", 600)
    got = Counter(tuple(r) for r in exact_substrings.op8_exact_substrings(spark, str(tmp_path)).collect())
    assert got == brute_cut(rows)
    assert exact_substrings.remove_repeats(edge.limit(0)).count() == 0


def test_exact_substrings_heavy_anchors(spark, monkeypatch):
    """Many different texts around one rare string, dealt again; texts of one letter or a short period; little memory."""
    rng = random.Random(2)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    core = some(60)
    both = [some(150) for _ in range(4)]
    rows = [(k, some(300) + rng.choice(both) + core + rng.choice(both) + some(300)) for k in range(60)]
    rows += [(100, "x" * 9000), (101, "ab" * 3000), (102, "y" * 350), (103, some(100) + "x" * 230 + some(90)), (104, "z" * 199), (105, "abc" * 100 + some(40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = []
    again = exact_substrings.dealt_again
    monkeypatch.setattr(exact_substrings, "dealt_again", lambda *a: dealt.append(1) or again(*a))
    for shard_bytes, memory_bytes in ((1500, 1 << 20), (1 << 20, 300)):
        monkeypatch.setattr(exact_substrings, "read_table", lambda *a: docs)
        monkeypatch.setattr(exact_substrings.remove_repeats, "__defaults__", (200, shard_bytes, memory_bytes))
        assert Counter(tuple(r) for r in exact_substrings.op8_exact_substrings(spark, "").collect()) == brute_cut(rows)
    assert len(dealt) >= 1


def test_shard_larger_than_memory(tmp_path, monkeypatch):
    """A shard of ten times the memory given spills its queues, and gives what one in memory gives."""
    rng = random.Random(4)
    chunks = [bytes(rng.randrange(97, 103) for _ in range(rng.randrange(200, 400))) for _ in range(60)]
    chunks += [c[20:] + d[:250] for c, d in zip(chunks, chunks[1:], strict=False)]
    spills = []
    spill = induced_sort.Queues.spill
    monkeypatch.setattr(induced_sort.Queues, "spill", lambda self: spills.append(1) or spill(self))
    whole = exact_substrings.repeats_in(chunks, 200, str(tmp_path))
    assert not spills
    small = tempfile.mkdtemp(dir=tmp_path)
    found = exact_substrings.repeats_in(chunks, 200, small, sum(map(len, chunks)) // 10)
    assert len(spills) > 5 and (found == whole).all() and whole.any() and len(os.listdir(small)) > 5


def test_induced_sort():
    rng = random.Random(1)
    for _ in range(150):
        text = bytes(rng.randrange(rng.choice([1, 2, 3, 200])) for _ in range(rng.randrange(0, 120)))
        with tempfile.TemporaryDirectory() as folder:  # 8 bytes of memory: the queues are on disk
            got = np.concatenate(list(induced_sort.sorted_suffixes(np.frombuffer(text, np.uint8), folder, 10**6, rng.choice([8, 1 << 20])))).tolist()
        assert got == sorted(range(len(text)), key=lambda k: text[k:])


def test_warc_ids_of_any_characters(spark):
    ids = ["a\r\nWARC-Type: revisit", "x\ty", "é😀", " ", "<>%+&", "", None, "a b", "line\nfeed", "0"]
    rows = [(i, f"page {k % 5}") for k, i in enumerate(ids)]
    pages = spark.createDataFrame([(i, "u", h, "w", 1) for i, h in rows], "page_id string, url string, html string, refers_to string, size int")
    got = {(r["page_id"], bytes(r["payload"]).decode() if r["payload"] is not None else None, r["refers_to"]) for r in warc.read_records(warc.archive(pages)[0]).collect()}
    first = {h: min(i for i, x in rows if x == h and i is not None) for _, h in rows}
    assert got == {(i, h if i is None or i == first[h] else None, None if i is None or i == first[h] else first[h]) for i, h in rows}


def test_warc(spark, tmp_path):
    rows = [(3, "http://a", "x"), (1, None, "x"), (2, "http://b c", None), (4, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n"), (6, "u", "y" * 3_000_000), (7, "u", "é\r\n\r\nWARC/1.1\r\n"), (7, "u", "é\r\n\r\nWARC/1.1\r\n"), (8, "u", " ")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, sha1 string").repartition(3)
    first = {}
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        first.setdefault(h or "", i)
    want = Counter((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), *(("response", None) if first[h or ""] == i else ("revisit", first[h or ""]))) for i, _, h in rows)
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    assert Counter(tuple(r) for r in warc.op9_warc(spark, str(tmp_path)).collect()) == want
    index, folder = warc.archive(pages, least_bytes=2)
    got = {r["page_id"]: r for r in warc.read_records(index).collect()}
    assert got["3"]["record_type"] == "response" and got["7"]["refers_to"] == "5" and bytes(got["6"]["payload"]) == b"y" * 3_000_000 and got["2"]["url"] == "http://b%20c"
    files = spark.read.format("binaryFile").load(folder).collect()
    for f in (f for f in files if f["path"].endswith(".gz")):
        body, members = bytes(f["content"]), 0
        lines = next(bytes(x["content"]) for x in files if x["path"] == f["path"] + ".idx").decode().splitlines()
        for line in lines:  # each record is a member of its own where the index says
            name, at, size = line.split("\t")
            assert name.encode() in zlib.decompress(body[int(at) : int(at) + int(size)], 31)
            members += int(size)
        assert members == len(body)
    assert warc.read_records(warc.archive(pages.limit(0))[0]).count() == 0


def test_passages(spark, edge):
    rng = random.Random(6)
    text = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    shared, rows = text(90), []
    for k in range(12):
        body = list(shared)
        for _ in range(k % 5):  # up to four words of the passage differ
            body[rng.randrange(90)] = f"n{rng.randrange(10**6)}"
        rows.append((k, " ".join(text(200) + body + text(150))))
    rows += [(20 + k, " ".join(text(300))) for k in range(10)] + [(40, " ".join(shared)), (41, " ".join(shared)), (42, " ".join(shared[:20] + text(100)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in passages.repeated(docs).collect()}
    for k in range(12):
        inside = set(range(200, 290))
        hit = {p for s in got[k]["repeats"] for p in range(s["start"], s["start"] + s["length"])}
        assert len(inside & hit) >= 80 and len(hit - inside) <= 4, k
    assert not any(got[k]["repeats"] for k in [*range(20, 30), 42])
    kept = [k for k in [*range(12), 40, 41] if sum(s["length"] for s in got[k]["later"]) < 60]
    assert len(kept) == 1  # one text keeps the passage
    assert passages.repeated(edge.limit(0)).count() == 0
    odd = passages.repeated(edge).collect()
    assert Counter(r["doc_id"] for r in odd) == Counter(i for i, _ in EDGE)
    assert {r["doc_id"] for r in odd if r["repeats"]} >= {6, 7, 8, 9, None}


def test_chains_and_alignment():
    x, y = np.array([0, 10, 20, 30, 40, 25]), np.array([5, 15, 25, 35, 500, 3])
    best = passages.chains(x, y)[0]
    assert [int(v) for v in x[best]] == [0, 10, 20, 30]
    assert passages.runs([1, 2, 3], [1, 2, 3], 3) == [(3, 0, 3, 0, 3)]
    assert passages.runs([9, *range(20), 8], [7, 7, *range(10), 99, *range(10, 20)], 20) == [(20, 1, 21, 2, 23)]
    assert passages.without("a  b c\nd e", [{"start": 1, "length": 2}]) == "a  d e" and passages.without("a b", [{"start": 1, "length": 1}]) == "a " and passages.without(None, [{"start": 0, "length": 1}]) is None


def brute_runs(a, b, least=40, similarity=0.8):
    """Words of ``a`` in any run of matching blocks that is long and similar enough, and those in such a run of which no end has fewer words than the gap beside it."""
    blocks = [m for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
    loose, tight = set(), set()
    for i in range(len(blocks)):
        for j in range(i, len(blocks)):
            part, p, q = blocks[i : j + 1], blocks[i], blocks[j]
            n = sum(m.size for m in part)
            if n >= least and n >= similarity * max(q.a + q.size - p.a, q.b + q.size - p.b):
                loose |= set(range(p.a, q.a + q.size))
                gaps = [max(y.a - x.a - x.size, y.b - x.b - x.size) for x, y in zip(part, part[1:], strict=False)]
                if all(sum(m.size for m in part[: k + 1]) >= g <= sum(m.size for m in part[k + 1 :]) for k, g in enumerate(gaps)):
                    tight |= set(range(p.a, q.a + q.size))
    return loose, tight


def test_passage_runs():
    rng = random.Random(11)
    other = lambda n: [rng.randrange(10**6, 10**9) for _ in range(n)]
    found = 0
    for _ in range(150):
        a, b = other(rng.randrange(30)), other(rng.randrange(30))
        for _ in range(rng.randrange(1, 5)):
            body = [rng.randrange(300 if rng.random() < 0.3 else 10**6) for _ in range(rng.randrange(20, 90))]
            edited = [w if rng.random() > 0.06 else -w - 1 for w in body]
            a += body + other(rng.randrange(25))
            b += edited + other(rng.randrange(25))
        got = set()
        for n, a0, a1, b0, b1 in passages.runs(a, b):
            assert n >= 40 and n >= 0.8 * max(a1 - a0, b1 - b0)
            got |= set(range(a0, a1))
        loose, tight = brute_runs(a, b)
        assert tight <= got <= loose
        found += len(passages.runs(a, b)) > 1
    assert found > 20
    assert passages.runs([], [1]) == [] and passages.runs([1], [2]) == [] and passages.runs([1], [1]) == []


def test_seed_runs_leave_the_task_once(spark):
    # a word repeated: each place is a seed with six runs and pairs, of which one in REACH words is enough
    places = 400
    rows = [(c, k, 7, k, 2 * places, (1, 0)) for c in (1, 2) for k in range(places)] + [(3, 0, 8, 0, 9, None), (3, 1, 9, 12, 9, None), (3, 2, 7, 40, 9, (1, 0))]
    marked = spark.createDataFrame(rows, "c long, k int, h long, at int, n long, f struct<c: long, at: int>")
    grams = passages.grams_of(marked)
    assert "Generate" not in grams._jdf.queryExecution().executedPlan().toString()
    got = grams.collect()
    assert {(r["at"], r["end"], r["run"]) for r in got if r["c"] == 3} == {(0, 40, True), (0, 12, False), (12, 40, False)}
    for c in (1, 2):
        own = [r for r in got if r["c"] == c]
        assert len({r["g"] for r in own}) == 6 and 50 <= len(own) <= 60 and len(own) == len({(r["g"], r["at"] // passages.REACH) for r in own})
    assert len({r["g"] for r in got}) == 9 and passages.grams_of(marked.limit(0)).count() == 0


def test_equal_gaps_are_not_searched(monkeypatch):
    a = [1000, 1, 2, 1, 1001, 1, 2, 2, *range(2000, 2040), 1, 1, 2, 1002]
    b = [*a[:20], 5, *a[21:]]
    before = passages.runs(a, b)
    assert before == [(len(a) - 1, 0, len(a), 0, len(a))]
    monkeypatch.setattr(passages.difflib, "SequenceMatcher", None)
    assert passages.runs(a, b) == before and passages.runs([1, 2, 1, 2] * 9, [2, 1, 3] * 12) == []


def test_passages_of_one_chain(spark):
    rng = random.Random(12)
    text = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    one, two, three = text(60), text(60), text(50)
    near = text(120)
    docs = [text(30) + one + text(40) + two + text(40) + three + text(30), text(20) + one + text(30) + two + text(35) + three + text(10), text(20) + near + text(20), near[:70] + text(12) + near[70:] + text(30)]
    got = {r["doc_id"]: r["repeats"] for r in passages.repeated(spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id long, text string")).collect()}
    assert [(s["start"], s["length"]) for s in got[0]] == [(30, 60), (130, 60), (230, 50)]
    assert [(s["start"], s["length"]) for s in got[1]] == [(20, 60), (110, 60), (205, 50)]
    assert [(s["start"], s["length"]) for s in got[2]] == [(20, 120)] and [(s["start"], s["length"]) for s in got[3]] == [(0, 132)]


def test_passages_leave_little_on_disk(spark, edge):
    """No step's shuffle files stay until the driver's collector runs, and no written table with all seeds stays to the end."""
    tops = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    shuffled = lambda: {f for top in tops for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}
    tables = lambda: {f"{top}/{x}" for top in [common.shared_dir(spark).removeprefix("file:") + "/tracelake"] if os.path.isdir(top) for x in os.listdir(top)}
    cleanup = spark.conf.get(common.CLEANUP, None)
    files, before = shuffled(), tables()
    rows, found = passages.find_passages(edge)
    end = time.time() + 10
    while shuffled() - files and time.time() < end:  # deleted in the background
        time.sleep(0.2)
    assert not shuffled() - files and spark.conf.get(common.CLEANUP, None) == cleanup
    left = {x: set(spark.read.parquet(x).columns) for x in tables() - before}
    assert len(left) == 3 and not any(columns & {"h", "at", "s"} for columns in left.values())
    assert rows.count() == len(EDGE) and found.count() >= 3


def planted(rng, n, words, changed, crowd=0, snippet=25):
    """Pairs of texts with a passage of so many words, a share of which is replaced in the second, and texts with snippets of it."""
    text = lambda k: [f"w{rng.randrange(50_000)}" for _ in range(k)]
    rows, where = [], []
    for _ in range(n):
        passage = text(words)
        other = list(passage)
        for k in rng.sample(range(words), round(changed * words)):
            other[k] = f"x{rng.randrange(10**9)}"
        low, high = rng.randrange(10, 200), rng.randrange(10, 200)
        where.append((len(rows), low, len(rows) + 1, high))
        rows += [text(low) + passage + text(80), text(high) + other + text(90)]
        for _ in range(crowd):
            at = rng.randrange(words - snippet + 1)
            rows.append(text(60) + passage[at : at + snippet] + text(40))
    return [(k, " ".join(w)) for k, w in enumerate(rows)], where


def share_whole(got, base, where, words):
    """Share of the planted passages of which both texts report nine tenths, and the words reported outside of them."""
    inside = [(len(got[base + i] & set(range(at, at + words))), len(got[base + i] - set(range(at, at + words)))) for a, low, b, high in where for i, at in ((a, low), (b, high))]
    return np.mean([n >= 0.9 * words for n, _ in inside]), sum(n for _, n in inside)


def reported(spark, cases):
    """The words of each text that the operator reports, for all cases' texts in one table."""
    rows = [(1000 * n + i, t) for n, (texts, _) in enumerate(cases) for i, t in texts]
    return {r["doc_id"]: {p for s in r["repeats"] for p in range(s["start"], s["start"] + s["length"])} for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_passage_recall(spark):
    asked = [(45, 0.0, 1.0), (50, 0.1, 0.9), (60, 0.1, 0.9), (100, 0.1, 0.9), (100, 0.15, 0.9), (200, 0.15, 0.9), (100, 0.19, 0.8)]
    cases = [planted(random.Random(n), 60, words, changed) for n, (words, changed, _) in enumerate(asked)]
    got = reported(spark, cases)
    for n, ((words, changed, least), (_, where)) in enumerate(zip(asked, cases, strict=True)):
        share, outside = share_whole(got, 1000 * n, where, words)
        assert share >= least and outside <= 60, (words, changed, share, outside)


def test_passage_among_snippets(spark):
    """Texts with short snippets of a passage don't hide those that share all of it."""
    asked = [(90, 80, 25), (60, 40, 20), (120, 300, 35)]
    cases = [planted(random.Random(crowd), 3, words, 0.0, crowd, snippet) for words, crowd, snippet in asked]
    got = reported(spark, cases)
    for n, ((words, _, _), (texts, where)) in enumerate(zip(asked, cases, strict=True)):
        share, outside = share_whole(got, 1000 * n, where, words)
        assert share == 1.0 and outside <= 3
        whole = {i for a, _, b, _ in where for i in (a, b)}
        assert not any(got[1000 * n + i] for i, _ in texts if i not in whole)


def test_edited_passage_among_snippets(spark):
    """Texts that share a passage with edits find each other although short snippets of it, in many other texts, hold all of its seeds."""
    asked = [(100, 0.1, 30, 12, 0.95), (100, 0.15, 30, 12, 0.85), (60, 0.1, 30, 12, 0.9), (100, 0.1, 30, 20, 0.95), (100, 0.15, 30, 20, 0.85), (60, 0.1, 30, 20, 0.9), (60, 0.15, 30, 12, 0.75), (100, 0.1, 200, 20, 0.9)]
    cases = [planted(random.Random(n), 10, words, changed, crowd, snippet) for n, (words, changed, crowd, snippet, _) in enumerate(asked)]
    got = {}
    rows = [(10_000 * n + i, t) for n, (texts, _) in enumerate(cases) for i, t in texts]
    for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]] = {p for s in r["repeats"] for p in range(s["start"], s["start"] + s["length"])}
    for n, ((words, changed, crowd, snippet, least), (_, where)) in enumerate(zip(asked, cases, strict=True)):
        share, outside = share_whole(got, 10_000 * n, where, words)
        assert share >= least and outside <= 20, (words, changed, crowd, snippet, share, outside)


def test_no_seed_is_too_frequent(spark):
    """A passage whose seeds are all frequent, each with another first text, and one with a single seed, are found as without the crowd."""
    asked = [(60, 0.15, 30, 20), (60, 0.15, 30, 12), (50, 0.1, 60, 14)]
    cases = [planted(random.Random(70 + n), 12, words, changed, crowd, snippet) for n, (words, changed, crowd, snippet) in enumerate(asked)]
    got = reported(spark, cases)
    alone = reported(spark, [([t for t in texts if t[0] in {i for a, _, b, _ in where for i in (a, b)}], where) for texts, where in cases])
    for n, ((words, *_), (_, where)) in enumerate(zip(asked, cases, strict=True)):
        (share, outside), (least, _) = (share_whole(g, 1000 * n, where, words) for g in (got, alone))
        assert share >= least >= 0.9 and outside <= 20, (asked[n], share, least, outside)


def test_one_seed_is_enough(spark):
    rng = random.Random(71)
    text = lambda n: [f"z{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for k in range(8):
        passage = text(50)
        # 12 words hold a seed; elsewhere every fifth word differs, so that no other five are equal
        other = [w if 19 <= i < 31 or (i - 31 if i >= 31 else 18 - i) % 5 != 0 else f"y{rng.randrange(10**9)}" for i, w in enumerate(passage)]
        rows += [(2 * k, " ".join(text(30 + k) + passage + text(60))), (2 * k + 1, " ".join(text(50) + other + text(40 + k)))]
    got = {r["doc_id"]: [(s["start"], s["length"]) for s in r["repeats"]] for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(8):
        for found, at in ((got[2 * k], 30 + k), (got[2 * k + 1], 50)):
            assert len(found) == 1 and at <= found[0][0] and found[0][0] + found[0][1] <= at + 50 and found[0][1] >= 45, (k, found)


def test_places_meet_as_all_pairs_do(monkeypatch):
    """Groups of any size, blocks, and bounds drop no pair of places that holds a passage about the seed."""
    rng = random.Random(72)
    seed = [7, 8, 9, 10, 11]
    bodies = [[rng.randrange(100, 400) for _ in range(95)] for _ in range(9)]
    rows = []
    for c in range(70):
        body = [w if rng.random() > rng.choice([0.02, 0.12, 0.3]) else rng.randrange(1000, 10**6) for w in rng.choice(bodies)]
        cut = rng.randrange(20)
        rows.append((1, c, 60, 15 + cut, [*body[cut:45], *seed, *body[45:]], rng.randrange(2), False, False, False))
    names = ["g", "c", "at", "low", "words", "own", "covered", "later", "apart"]

    def met(rows, few):
        monkeypatch.setattr(passages, "FEW", few)
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int32(), *[pa.bool_()] * 3]
        batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        return {(r["c"], r["o"]) for b in passages.comparing(40, 0.8)([batch]) for r in b.to_pylist()}

    near = lambda r: np.array(r[4][max(0, r[2] - r[3] - 45) : r[2] - r[3] + 50])
    want = {(a[1], b[1]) for a in rows for b in rows if b[1] < a[1] and passages.runs(near(a), near(b), 40, 0.8, passages.matching_in_order)}
    assert len(want) > 50
    # each place is explained by the first pair that holds it; every place that has a partner is
    for few in (100, 5):
        got = met(rows, few)
        assert got <= want and {x for p in got for x in p} == {x for p in want for x in p} and {c for c, _ in got} == {c for c, _ in want}
        apart = met([(*r[:8], True) for r in rows], few)
        own = {r[1]: r[5] for r in rows}
        wanted = {p for p in want if own[p[0]] != own[p[1]]}
        assert apart <= wanted and {c for c, _ in apart} == {c for c, _ in wanted}

"""Embedding near-dedup, conversation prefix trie and Merkle manifest against brute force, and their defined cases."""

import hashlib
import random
import re
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import common, embeddings, merkle, prefix_trie

EMPTY = hashlib.sha256().hexdigest()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- embeddings

def brute_vectors(rows, threshold=0.98):
    """(vec_id, n_links, component_id, kept) of rows (vec_id, embedding, label)."""
    ok = [e is not None and label is not None and len(e) > 0 and all(v is not None and np.isfinite(v) for v in e) and any(e) for _, e, label in rows]
    near = defaultdict(set)
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float64), np.array(rows[j][1], np.float64)
                if (a / np.abs(a).max()) @ (b / np.abs(b).max()) / np.linalg.norm(a / np.abs(a).max()) / np.linalg.norm(b / np.abs(b).max()) >= threshold:
                    near[i].add(j)
                    near[j].add(i)
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, stack = {i}, [i]
        while stack:
            new = near[stack.pop()] - seen
            seen |= new
            stack += new
        least = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        out.append((vec_id, len(near[i]), least, vec_id == least))
    return Counter(out)


def around(rng, base, angle):
    """A vector at an angle from another one."""
    side = rng.normal(size=len(base))
    side -= side @ base / (base @ base) * base
    return np.cos(angle) * base / np.linalg.norm(base) + np.sin(angle) * side / np.linalg.norm(side)


def cloud(seed, n=700, d=12):
    """Vectors with chains of near copies, a dense group, a loose group at the threshold, exact copies and scaled ones."""
    rng = np.random.default_rng(seed)
    dense, loose = rng.normal(size=d), rng.normal(size=d)
    rows = [(k, rng.normal(size=d), k % 2) for k in range(n // 3)]
    rows += [(1000 + k, around(rng, dense, 0.02 * rng.random()), 0) for k in range(n // 4)]
    rows += [(2000 + k, around(rng, loose, 0.24 * rng.random()), 0) for k in range(n // 4)]
    rows += [(3000 + k, 3.0 * around(rng, rows[k][1], 0.19), k % 2) for k in range(60)]
    rows += [(4000 + k, rows[1][1] * (k % 3 + 1), 1) for k in range(40)]
    return [(i, [float(x) for x in v], label) for i, v, label in rows]


@pytest.mark.parametrize("limits", [{}, {"aim": 8, "cells": 6, "sample": 64, "most": 40}])
def test_vectors(spark, limits):
    """Equal to brute force, also where cells are split again and again."""
    rows = cloud(5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = Counter(tuple(r) for r in embeddings.near_duplicates(df, **limits).drop("label").collect())
    want = brute_vectors(rows)
    assert got == want
    assert max(n for _, n, _, _ in want) > 150 and sum(k for _, _, _, k in want) < len(rows) - 200


def test_vectors_visit_in_rounds(spark, monkeypatch):
    """What vectors without clusters visit is made a part at a time: no written table holds all of it, and nothing is lost or counted twice."""
    rng = np.random.default_rng(9)
    rows = [(k, rng.normal(size=5), k % 2) for k in range(400)]
    rows += [(1000 + k, around(rng, rows[k][1], 0.19), k % 2) for k in range(120)]
    rows = [(i, [float(x) for x in v], label) for i, v, label in rows]
    cells = []

    def counted(real):
        def run(df, name):
            out = real(df, name)
            if name == "cells":
                cells.append(out.count())
            return out

        return run

    for name in ("written", "written_clean"):
        monkeypatch.setattr(embeddings, name, counted(getattr(embeddings, name, common.written)), raising=False)
    monkeypatch.setattr(embeddings, "SHARE", 0.5, raising=False)
    monkeypatch.setattr(embeddings, "ROUND", 100, raising=False)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = Counter(tuple(r) for r in embeddings.near_duplicates(df, aim=16, cells=16, most=300).drop("label").collect())
    assert got == brute_vectors(rows)
    assert max(cells) <= len(rows) < sum(cells), cells


def test_vector_blocks(spark):
    """Cells of several blocks: compact ones with visitors, and others."""
    rows = cloud(6, 500)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    classes = df.select(F.col("vec_id").alias("c"), F.lit(1).cast("long").alias("copies"), F.col("embedding").alias("x"), F.col("label").cast("string").alias("path"))
    cells = embeddings.cells_of(classes, aim=8, cells=6, most=40)
    kinds = {(r["compact"], r["resident"]) for r in cells.select("compact", "resident").distinct().collect()}
    assert kinds == {(True, True), (True, False), (False, True), (False, False)}
    ids = {i: n for i, n, _, _ in brute_vectors(rows)}
    for block in (7, 1024):
        found = embeddings.links_of(cells, block=block).collect()
        got = Counter()
        for r in found:
            if r["b"] is None:
                got[r["a"]] += r["n"]
        assert {i: got[i] for i in ids} == ids


def test_vector_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [nan, 1.0], 0), (5, [inf, 1.0], 0), (6, [None, 1.0], 0), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 0), (8, [1.0, 0.0], 0), (9, [2.0, 0.1], 0),
        (10, [1.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 0), (None, [3.0, 0.0], 0), (None, [-3.0, 0.0], 0), (12, [1e200, 0.0], 0), (13, [1e-200, 0.0], 0), (14, [-0.0, 1.0], 1), (15, [0.0, 1.0], 1), (7, [1.0, 0.0], None),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, path string, c int")
    got = [tuple(r) for r in embeddings.near_duplicates(df).drop("label").collect()]
    assert Counter((i, n, c) for i, n, c, _ in got) == Counter((i, n, c) for (i, n, c, _), times in brute_vectors(rows).items() for _ in range(times))
    assert all(k == (i == c) for i, _, c, k in got)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    floats = spark.createDataFrame([(1, [0.5, 0.25], 0), (2, [0.5, 0.25], 0)], "vec_id long, embedding array<float>, label int")
    assert Counter(r["component_id"] for r in embeddings.near_duplicates(floats).collect()) == {1: 2}


def test_forest():
    rng = np.random.default_rng(3)
    for _ in range(30):
        linked = rng.random((20, 25)) < 0.06
        edges = embeddings.forest(linked)
        assert all(linked[i, j] for i, j in edges)

        def groups(pairs):
            parent = list(range(45))
            def top(k):
                while parent[k] != k:
                    k = parent[k]
                return k
            for i, j in pairs:
                parent[top(i)] = top(20 + j)
            return [frozenset(k for k in range(45) if top(k) == top(x)) for x in range(45)]

        assert groups(edges) == groups(zip(*np.nonzero(linked), strict=True)) and len(edges) < 45


# --- conversation trie

def brute_trie(paths):
    """Nodes of conversations {conv_id: [(key, words), ...]}."""
    nodes = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes[tuple(k for k, _ in p[:d])].append(c)
    words = {tuple(k for k, _ in p[:d]): p[d - 1][1] for p in paths.values() for d in range(1, len(p) + 1)}
    kids = Counter(n[:-1] for n in nodes if n)
    out = []
    for n, members in nodes.items():
        below = [m for m in nodes if m[: len(n)] == n]
        ends = ",".join(str(c) for c in sorted(c for c in members if len(paths[c]) == len(n)))
        saved = sum((len(nodes[m]) - 1) * words.get(m, 0) for m in below)
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), kids[n], sum(not kids[m] for m in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize(("seed", "shards", "sample"), [(1, 1, 1 << 20), (2, 5, 1 << 20), (3, 40, 1 << 20), (4, 16, 16 * 128)])
def test_trie(spark, seed, shards, sample):
    """A common conversation over several shards, deep shared paths, and splitters cut short."""
    rng = random.Random(seed)
    key = lambda k: hashlib.md5(str(k).encode()).digest()
    turn = lambda k: (key(k), k % 7)
    hot, deep = [turn(k) for k in (1, 2, 3)], [turn(100 + k) for k in range(60)]
    paths = {}
    for c in range(400):
        kind = rng.randrange(5)
        paths[c] = hot if kind < 2 else deep[: rng.randrange(61)] + [turn(rng.randrange(3)) for _ in range(rng.randrange(2))] if kind == 2 else [turn(rng.randrange(4)) for _ in range(rng.randrange(7))]
    rows = [(c, bytearray(b"".join(k for k, _ in p)), [w for _, w in p]) for c, p in paths.items()]
    df = spark.createDataFrame(rows, "conv_id long, path binary, words array<long>")
    nodes = prefix_trie.prefix_trie(df, shards, sample)
    got = nodes.collect()
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got) == brute_trie(paths)
    parents = {r["node"]: r["parent"] for r in got}  # nodes hang together by their digests too
    assert len(parents) == len(got) and sum(p is None for p in parents.values()) == 1 and all(p is None or p in parents for p in parents.values())


def test_trie_cases(spark, tmp_path):
    rows = [
        (0, 0, "user", "a b"), (0, 1, "assistant", "c"), (0, 2, "user", "d"), (0, 3, "user", "e"), (5, None, None, None), (5, 0, "user", "x y z"), (5, 0, "user", "x y z"), (7, 4, "", ""), (None, 0, "user", "lost"),
        (21, 0, "user", "only"), (-3, 1, "user", "neg"), (-20, 0, "user", "base"), (40, 0, "user", "w " * 30_000), (41, 2, "user", "own"), (41, 1, "a", "b"), (61, 0, "q", "one"),
        *((c, 0, "user", f"without a base {c}") for c in range(101, 109)),
    ]
    df = spark.createDataFrame([(*r, "k", 3) for r in rows], "conv_id long, turn long, role string, text string, path string, words int")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    turns = defaultdict(list)
    for c, t, role, text in rows:
        role, text = role or "", text or ""
        turns[c].append(((t is not None, t or 0), hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest(), len(WORD.findall(text))))
    turns = {c: [x[1:] for x in sorted(v)] for c, v in turns.items() if c is not None}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        paths[c] = turns.get(base, [])[:h] + own[h:]
    assert any(not p for p in paths.values())
    got = prefix_trie.op12_conversation_trie(spark, str(tmp_path))
    assert got.columns == list(COLUMNS)
    assert Counter(tuple(r) for r in got.collect()) == brute_trie(paths)
    df.limit(0).write.parquet(str(tmp_path / "none/conversations.parquet"))
    assert prefix_trie.op12_conversation_trie(spark, str(tmp_path / "none")).count() == 0


def test_ends_in_blocks(spark, monkeypatch):
    """Ids of a skeleton node come in several texts from several shards."""
    key = hashlib.md5(b"x").digest()
    df = spark.range(30_000).select(F.col("id").alias("conv_id"), F.lit(bytearray(key)).alias("path"), F.array(F.lit(2).cast("long")).alias("words"))
    got = {r["depth"]: r for r in prefix_trie.prefix_trie(df, 3).collect()}
    assert got[1]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(30_000))).encode()).hexdigest() and got[0]["ends_sha256"] == EMPTY
    assert got[1]["saved_tokens"] == 2 * 29_999 == got[0]["saved_tokens"] and got[0]["n_leaves"] == 1 and got[1]["parent_conv_id"] == 0


def test_shared_turns():
    rng = random.Random(2)
    for _ in range(200):
        a = [rng.randrange(3) for _ in range(rng.randrange(20))]
        b = a[: rng.randrange(20)] + [rng.randrange(3) for _ in range(rng.randrange(4))]
        want = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert prefix_trie.shared_turns(bytes(x for x in a for _ in range(16)), bytes(x for x in b for _ in range(16))) == want


# --- Merkle manifest

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_levels(seq):
    levels = [list(seq)]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h(*now[k : k + 2]) for k in range(0, len(now), 2)])
    return levels


def brute_proof(levels, at):
    out = []
    for now in levels[:-1]:
        out.append("-" if (at ^ 1) >= len(now) else ("L" if at & 1 else "R") + now[at ^ 1])
        at >>= 1
    return out


def brute_manifest(leaves):
    """(key, digest) pairs in order: {(key, place): (subroot, root, proof)}."""
    by_key = defaultdict(list)
    for key, digest in leaves:
        by_key[key].append(digest)
    keys = sorted(by_key, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: brute_levels(by_key[k]) for k in keys}
    top = brute_levels([trees[k][-1][0] for k in keys])
    return {(k, i): (trees[k][-1][0], top[-1][0], brute_proof(trees[k], i) + brute_proof(top, n)) for n, k in enumerate(keys) for i in range(len(by_key[k]))}


@pytest.mark.parametrize("levels", [1, 2, 3, 12])
def test_manifest(spark, levels):
    """Keys of all sizes around powers of two, in shards of two nodes and more."""
    rng, rows = random.Random(levels), []
    for key, n in [(None, 5), ("", 3), ("a", 1), ("b", 2), ("é", 17), ("z", 33), ("\U00010000", 64), ("￿", 7), ("w", 0)] + [(f"k{k}", 1) for k in range(9)]:
        rows += [(key, k, h(str(rng.random()))) for k in range(n)]
    want = brute_manifest([(k, d) for k, _, d in rows])
    shuffled = rng.sample(rows, len(rows))
    df = spark.createDataFrame([(*r, "x", 1) for r in shuffled], "key string, n long, digest string, part string, start int")
    made = merkle.manifest(df, ["n"], levels).withColumn("folded", merkle.folded(F.col("digest"), F.col("proof"))).withColumn("hash", merkle.siblings_digest(F.col("proof"))).collect()
    assert {(r["key"], r["n"]): (r["subroot"], r["root"], list(r["proof"])) for r in made} == want and len(made) == len(want)
    assert all(r["folded"] == r["root"] and r["hash"] == h(*[s[1:] for s in r["proof"]]) for r in made)


def test_manifest_query(spark, tmp_path):
    """Nulls in all columns, repeated rows and ids, one lone row, tampered rows, long texts."""
    long = "é" * 400_000
    rows = [
        (1, "t", "en", "s", 3), (2, None, "en", None, None), (None, "", None, "", 0), (None, None, None, None, None), (3, long, "en", "s", 2**63 - 1), (3, long, "en", "s", 2**63 - 1), (3, "other", "en", "s", 9), (4, "x", "", "s", -1),
        *((k, f"text {k}", "fr", "s", k) for k in range(10, 40)),
    ]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, digest string")
    df.write.parquet(str(tmp_path / "documents.parquet"))

    def leaf(i, text, lang, source, n):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))

    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    whole = brute_manifest([(r[2], leaf(*r)) for r in order])
    place, want = Counter(), []
    for r in order:
        subroot, root, proof = whole[r[2], place[r[2]]]
        place[r[2]] += 1
        bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
        now = leaf(*r[:4], r[4] + 1) if bad else leaf(*r)
        for s in proof:
            now = h(s[1:], now) if s[0] == "L" else h(now, s[1:]) if s[0] == "R" else h(now)
        want.append((r[0], leaf(*r), subroot, root, h(*[s[1:] for s in proof]), now, now == root))
    got = [tuple(r) for r in merkle.op13_merkle_manifest(spark, str(tmp_path)).collect()]
    assert Counter(got) == Counter(want)
    assert {r[-1] for r in got} == {True, False}
    df.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert merkle.op13_merkle_manifest(spark, str(tmp_path / "none")).count() == 0
    df.limit(1).write.parquet(str(tmp_path / "one/documents.parquet"))
    one = merkle.op13_merkle_manifest(spark, str(tmp_path / "one")).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == EMPTY


def test_label_queue_beyond_memory():
    """The queue and both sweeps with nearly no memory: everything goes through files."""
    rng = random.Random(4)
    for most in (0, 500, 1 << 20):
        queue, labels = merkle.LabelQueue(most), []
        for _ in range(300):
            label = rng.randrange(-(1 << 50), 1 << 50)
            queue.push(label, str(label).encode())
            labels.append(label)
            if rng.random() < 0.4:
                least = min(labels)
                labels.remove(least)
                assert queue.first() == least and queue.pop() == (least, str(least).encode())
        assert [queue.pop()[0] for _ in labels] == sorted(labels) and queue.first() is None
    for n in (1, 2, 5, 64, 77):
        leaves = [h(str(k)) for k in range(n)]
        levels = brute_levels(leaves)
        for most in (200, 1 << 20):
            top, tape = merkle.climb(iter(bytes.fromhex(x) for x in leaves), len(levels) - 1, most)
            assert top.hex() == levels[-1][0]
            assert {k: merkle.steps_of(p) for k, p in merkle.descend(tape, n, len(levels) - 1, b"", most)} == {k: brute_proof(levels, k) for k in range(n)}

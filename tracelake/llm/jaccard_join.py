"""N-gram Jaccard self-join: a MinHash LSH forest for candidates, exact verification of shingle sets.

1. Texts of equal words form a class; its smallest id stands for it. Copies are never paired with one another.
2. Each class has a MinHash signature of ``depth`` labels for each of ``trees`` tries; a trie's node at some depth is the set of
   texts with equal prefixes of that many labels. All texts begin with their deepest prefixes. A text that shares one in m of the tries
   has found such partners with a chance of 1 - (1 - m / trees) ** trees: where that reaches ``target`` the text stops, else its
   prefixes are shortened by one label, down to ``least_depth``, where a pair at the threshold meets with that chance even if the text
   has met nothing yet. Nodes with a text that still asks tie their members to their smallest one: n members, n - 1 candidate edges.
3. Connected candidates form clusters. Inside a cluster, members are dealt into blocks, and each pair of blocks is verified by
   one task: intersection sizes come from products of 0/1 matrices, so exact counts leave the task, not pairs.
4. Verified links give each class its number of links, and, over a spanning forest of the links, its component.

Inside a cluster all pairs are verified, also those that share no prefix, so recall is at least the forest's.

Defined cases: shingles are five words; a text of fewer words, but not none, is one shingle; a text without words (null,
empty) has no links and is its own class. Repeated rows of an id and text count as copies. Links of a row count the rows,
other than itself, of similarity ``threshold`` or more. Null ids take part; their class is named by other members' ids if
there are any, else null. Texts and words of any length are taken whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, read_table, words_of, written

SHINGLE = 5
THRESHOLD = 0.8
#: The forest: tries, labels in each, and the chance at which a text has found enough.
TREES, DEPTH, TARGET = 24, 8, 0.999
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: well-spread bits from structured ones."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word windows of a document, given as 64-bit word hashes."""
    if not len(words):
        return np.empty(0, np.uint64)
    w = words.astype(np.uint64, copy=False)
    n = max(1, len(w) - size + 1)
    h = np.full(n, min(len(w), size), np.uint64)
    for k in range(min(len(w), size)):
        h = mix(h * MULTIPLIER + w[k : k + n])
    return np.unique(h)


def least_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, target: float = TARGET) -> int:
    """The longest prefix at which a pair at the threshold meets in some trie with chance ``target``."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def prefixes(sets: np.ndarray, trees: int, depth: int, least: int, block: int = 2048) -> np.ndarray:
    """For each depth, the deepest first, and each trie: the hash of the signature's prefix. Labels are minima of 32-bit permutations."""
    seeds = mix(np.arange(1, trees * depth + 1, dtype=np.uint64) * MULTIPLIER)
    flips, factors = (seeds >> np.uint64(32)).astype(np.uint32)[:, None], (seeds.astype(np.uint32) | np.uint32(1))[:, None]
    values, labels = (sets >> np.uint64(32)).astype(np.uint32), np.full(trees * depth, 2**32 - 1, np.uint32)
    for k in range(0, len(values), block):
        x = values[None, k : k + block] ^ flips
        x *= factors
        np.minimum(labels, x.min(1), out=labels)
    labels, at, out = labels.astype(np.uint64).reshape(trees, depth), np.arange(trees, dtype=np.uint64), []
    for k in range(depth):
        at = mix(at * MULTIPLIER + labels[:, k])
        if k + 1 >= least:
            out.append(at)
    return np.stack(out[::-1]).astype(np.int64)


def signed(docs: DataFrame, trees: int, depth: int, least: int, size: int) -> DataFrame:
    """(doc_id, raw, key, p<depth> ...) per row: ``raw`` is the digest of the text, ``key`` that of its words, null without words."""
    source = docs.select("doc_id", F.unhex(F.md5("text")).alias("raw"), words_of(F.col("text")).alias("w"))
    source = source.select("doc_id", "raw", F.when(F.size("w") > 0, F.unhex(F.md5(F.array_join("w", " ")))).alias("key"), F.transform("w", lambda x: F.xxhash64(x)).alias("w"))
    schema, names = source.select("doc_id", "raw", "key").schema, [f"p{d}" for d in range(depth, least - 1, -1)]
    for n in names:
        schema = schema.add(n, T.ArrayType(T.LongType()))

    def run(batches):
        for b in batches:
            w = b.column("w")
            flat, at = w.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(w.value_lengths().to_numpy(zero_copy_only=False))]
            rows = [prefixes(shingles(flat[at[k] : at[k + 1]], size), trees, depth, least) if at[k + 1] > at[k] else None for k in range(b.num_rows)]
            columns = [pa.array([None if r is None else r[k] for r in rows], pa.list_(pa.int64())) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "raw", "key")), *columns], names=["doc_id", "raw", "key", *names])

    return source.mapInArrow(run, schema)


def candidates(texts: DataFrame, trees: int = TREES, depth: int = DEPTH, least: int = 1, target: float = TARGET) -> DataFrame:
    """Candidate edges (a, b) of the forest. Rows: c and its prefixes p<depth> ... p<least>."""
    edges, asking = None, None
    for d in range(depth, least - 1, -1):
        inside = texts.select("c", F.posexplode(f"p{d}").alias("tree", "prefix"))
        if asking is not None:
            inside = inside.join(asking, "c", "left")
        asks = F.lit(True) if asking is None else F.coalesce("asks", F.lit(False))
        nodes = inside.groupBy("tree", "prefix").agg(F.min("c").alias("hub"), F.max("c").alias("last"), F.max(asks).alias("asked")).filter("hub != last AND asked")
        # written, so that a large node's members come to the join straight from their exchange, where Spark can split them
        nodes = written(nodes.select("tree", "prefix", "hub"), "nodes")
        met = inside.select("c", "tree", "prefix").join(nodes, ["tree", "prefix"])
        met = written(met.groupBy("c").agg(F.collect_set("hub").alias("hubs"), F.countDistinct("tree").alias("met")), "met")
        found = met.select(F.col("c").alias("a"), F.explode("hubs").alias("b")).filter("a != b")
        edges = found if edges is None else edges.unionByName(found)
        if d > least:
            enough = next(m for m in range(1, trees + 1) if 1 - (1 - m / trees) ** trees >= target)
            done = met.filter(F.col("met") >= enough).select("c")
            asking = written((texts if asking is None else asking).select("c").join(done, "c", "left_anti").withColumn("asks", F.lit(True)), "asking")
    return edges.distinct()


def verify(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None, threshold: float, columns: int = 4096) -> np.ndarray:
    """Which pairs are at the threshold. ``sets_b`` None: the pairs within ``sets_a``."""
    every = sets_a if sets_b is None else sets_a + sets_b
    values, number, times = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    rows = np.repeat(np.arange(len(every)), [len(s) for s in every])
    rows, cols = rows[shared[number]], place[number[shared[number]]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    n = len(sets_a)
    m = n if sets_b is None else len(sets_b)
    both = np.zeros((n, m), np.float32)
    for low in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(cols, [low, low + columns])
        x = np.zeros((len(every), min(columns, int(shared.sum()) - low)), np.float32)
        x[rows[a:b], cols[a:b] - low] = 1
        both += x[:n] @ (x[:n].T if sets_b is None else x[n:].T)
    sizes = np.array([len(s) for s in every], np.float64)
    union = sizes[:n, None] + sizes[None, n if sets_b is not None else 0 : None if sets_b is not None else n] - both
    linked = both >= threshold * union - 1e-9
    if sets_b is None:
        np.fill_diagonal(linked, False)
    return linked


def spanning(linked: np.ndarray, ids_a: list, ids_b: list) -> list[tuple]:
    """Edges that tie together what ``linked`` ties together, at most one per member."""
    if ids_a is ids_b:
        left, out = set(range(len(ids_a))), []
        while left:
            stack = [left.pop()]
            while stack:
                k = stack.pop()
                new = left.intersection(np.flatnonzero(linked[k]).tolist())
                left -= new
                out += [(ids_a[k], ids_a[x]) for x in new]
                stack += new
        return out
    left_a, left_b, out = set(range(len(ids_a))), set(range(len(ids_b))), []
    while left_a:
        stack = [(0, left_a.pop())]
        while stack:
            side, k = stack.pop()
            near = np.flatnonzero(linked[k] if side == 0 else linked[:, k]).tolist()
            new = (left_b if side == 0 else left_a).intersection(near)
            (left_b if side == 0 else left_a).difference_update(new)
            out += [(ids_a[k], ids_b[x]) if side == 0 else (ids_a[x], ids_b[k]) for x in new]
            stack += [(1 - side, x) for x in new]
    return out


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, trees: int = TREES, depth: int = DEPTH, target: float = TARGET, block: int = 512) -> DataFrame:
    """Each row's ``doc_id``, ``raw`` (digest of its text), ``text_class`` (digest of its words), ``component`` (a number; null without
    words), ``class_id`` (smallest id of its component) and ``n_links``."""
    least = least_depth(threshold, trees, depth, target)
    names = [f"p{d}" for d in range(depth, least - 1, -1)]
    rows = written(signed(docs, trees, depth, least, size), "signatures")
    classes = written(rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first(F.struct(*names)).alias("p")), "classes")
    # classes get a number of their own, so that ids may be null or repeated
    classes_n = classes.select(F.xxhash64("key").alias("c"), "key", "rep", "copies", "p.*")
    edges = candidates(classes_n.select("c", *names), trees, depth, least, target)
    clusters = components(edges)
    members = clusters.select(F.col("node").alias("c"), F.col("root").alias("cluster")).join(classes_n.select("c", "key", "rep", "copies"), "c")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    members = members.join(sizes, "cluster").select("cluster", "c", "key", "copies", blocks.alias("blocks"), F.pmod(F.xxhash64("c", F.lit(1)), blocks).cast("int").alias("own"))
    members = written(members, "members")
    # one text a class: that of the row of smallest id and digest; both join, so that rows without an id don't meet each other
    first = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("doc_id", "raw")).alias("r")).select("key", F.col("r.doc_id").alias("rep_id"), F.col("r.raw").alias("raw"))
    chosen = members.join(first, "key").select("rep_id", "raw", "cluster", "c", "copies", "blocks", "own")
    texts = docs.select("doc_id", "text", F.unhex(F.md5("text")).alias("digest"))
    dealt = texts.join(chosen, (texts["digest"] == chosen["raw"]) & texts["doc_id"].eqNullSafe(chosen["rep_id"])).select("cluster", "c", "copies", "blocks", "own", F.transform(words_of(F.col("text")), lambda x: F.xxhash64(x)).alias("w"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "c", "copies", "w")

    def run(table: pa.Table) -> pa.Table:
        own, x, y = table["own"].to_pylist(), table["x"][0].as_py(), table["y"][0].as_py()
        seen: dict[int, int] = {}
        for k, c in enumerate(table["c"].to_pylist()):
            seen.setdefault(c, k)  # repeated rows of an id and text come more than once
        c, copies = table["c"].to_pylist(), table["copies"].to_numpy()
        sets = {k: shingles(np.array(table["w"][k].values.to_numpy(zero_copy_only=False)), size) for k in seen.values()}
        a = [k for k in sorted(seen.values()) if own[k] == x]
        b = a if x == y else [k for k in sorted(seen.values()) if own[k] == y]
        out: list[tuple] = []
        if a and b:
            linked = verify([sets[k] for k in a], None if a is b else [sets[k] for k in b], threshold)
            ids_a = [c[k] for k in a]
            ids_b = ids_a if a is b else [c[k] for k in b]
            counts = linked @ copies[b]
            out += [(i, None, int(n)) for i, n in zip(ids_a, counts, strict=True) if n]
            if a is not b:
                out += [(i, None, int(n)) for i, n in zip(ids_b, linked.T @ copies[a], strict=True) if n]
            out += [(i, j, 0) for i, j in spanning(linked, ids_a, ids_b)]
        cols = list(zip(*out, strict=True)) if out else [(), (), ()]
        return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64()), "n": pa.array(cols[2], pa.int64())})

    found = written(dealt.groupBy("cluster", "x", "y").applyInArrow(run, "a long, b long, n long"), "links")
    links = found.groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("links"))
    roots = components(found.filter("b IS NOT NULL").select("a", "b"))
    named = classes_n.select("c", "key", "rep", "copies").join(roots.select(F.col("node").alias("c"), F.col("root").alias("r")), "c", "left").withColumn("r", F.coalesce("r", "c"))
    tops = named.groupBy("r").agg(F.min("rep").alias("class_id"))
    named = named.join(tops, "r").join(links, "c", "left").select("key", F.col("r").alias("component"), "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    named = written(named, "named-classes")
    return rows.select("doc_id", "raw", "key").join(named, "key", "left").select(
        "doc_id", "raw", F.hex("key").alias("text_class"), "component", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).drop("raw", "component")

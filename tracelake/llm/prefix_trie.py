"""Prefix trie of conversations by a splitter skeleton: shared beginnings, counted once for all conversations that have them.

1. A conversation is a path: the digests of its turns, 16 bytes each, one after the other. Byte order of paths is an order of the
   trie's branches, so the conversations below a node are neighbours.
2. Splitters out of a sample of (path, id) cut that order into as many shards as the session has shuffle partitions; ids take part,
   so that copies of one path, however many, spread over shards.
3. The splitters are broadcast. A node whose members may lie in more than one shard is a prefix of a splitter's path: these nodes are the
   skeleton. All other nodes lie in one shard, where one pass over its sorted paths, with a stack as deep as the path, finishes them.
4. Of a skeleton node each shard gives a partial aggregate; these are reduced by node. Sums over whole subtrees then climb the
   skeleton by doubling: log2(depth) joins of the skeleton, which has at most one path a shard.
5. The ids of conversations that end in a node are hashed as they pass, in order. Where a skeleton node has them in several shards,
   those give the ids as texts of 64 KB, and one task, which holds one text at a time, hashes them in order.

Bounds: the sample holds eight splitters a shard, and at most ``SAMPLE_BYTES``; where paths are longer than that allows, splitters are cut to
fewer turns, which is still a right order of shards, and the skeleton is no deeper than that. A conversation is one row of 32 bytes a turn
(its texts are not in it). In a shard, the finished children of open nodes wait in memory until their parent's smallest id is known.

Defined cases: a row without conv_id belongs to no conversation. Turns stand in order of ``turn``, null first; equal turns in that
of their digests, repeated rows as turns of their own. Null roles and texts are empty ones. Conversations without turns are members of
the root, and end there. An empty table has no nodes, no root either. Further columns, of whatever name, are ignored.
"""

from __future__ import annotations

import bisect
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SEPARATOR, read_table, remove, written

#: Bytes of a turn in a path.
TURN = 16
SAMPLE_BYTES = 64 << 20
ENDS_BYTES = 1 << 16
FIELDS = ("kind", "node", "parent", "depth", "words", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "shard", "block")
SHARD_SCHEMA = (
    "kind int, node string, parent string, depth long, words long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, shard long, block long"
)
WHOLE, PART, ENDS = 0, 1, 2


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (turn, digest, words)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    words = F.size(F.filter(F.split(text, WORD_SEPARATOR), lambda w: w != "")).cast("long")
    rows = conversations.filter("conv_id IS NOT NULL").select("conv_id", F.struct("turn", digest.alias("digest"), words.alias("words")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def path_columns(turns: Column) -> list[Column]:
    """``path`` and ``words`` of an array of turns."""
    return [F.unhex(F.array_join(F.transform(turns, lambda t: F.hex(t["digest"])), "")).alias("path"), F.transform(turns, lambda t: t["words"]).alias("words")]


def shared_turns(a: bytes, b: bytes) -> int:
    """How many turns two paths have in common at their beginning."""
    n = min(len(a), len(b)) // TURN
    if a[: n * TURN] == b[: n * TURN]:
        return n
    low, high = 0, 1
    while a[: high * TURN] == b[: high * TURN]:
        low, high = high, min(2 * high, n)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[: mid * TURN] == b[: mid * TURN] else (low, mid)
    return low


def splitters_of(paths: DataFrame, shards: int, sample_bytes: int) -> list[tuple[bytes, int]]:
    """At most ``shards - 1`` ascending (path, conv_id), out of a sample bounded in rows and bytes."""
    n = paths.count()
    most = 8 * shards
    turns = max(1, sample_bytes // (most * TURN))
    rows = paths.filter(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, most / max(n, 1))))
    found = sorted((bytes(p), c) for p, c in rows.select(F.substring("path", 1, turns * TURN), "conv_id").limit(2 * most).collect())
    return sorted({found[k * len(found) // shards] for k in range(1, shards)}) if found else []


class Open:
    """A node on the way to the conversation that is read."""

    __slots__ = ("block", "children", "conv", "convs", "ends", "hasher", "kids", "leaves", "name", "prefix", "saved", "size", "split", "words")

    def __init__(self, prefix, words: int, split: bool):
        self.prefix, self.name, self.words, self.split = prefix, prefix.hexdigest(), words, split
        self.conv, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.kids: list[tuple] = []
        self.ends: list[str] = []
        self.hasher, self.size, self.block = None, 0, 0


def nodes_of_shards(splitters: list[tuple[bytes, int]]):
    """For sorted partitions (shard, path, conv_id, words): finished nodes, partial skeleton nodes and the latter's ends."""

    def run(batches):
        out: list[tuple] = []
        stack: list[Open] = []
        now, last = None, b""

        def ended(node: Open, conv: int) -> None:
            text = str(conv)
            if node.split:
                node.ends.append(text)
                node.size += len(text) + 1
                if node.size > ENDS_BYTES:
                    flush(node)
            elif node.hasher is None:
                node.hasher = hashlib.sha256(text.encode())
            else:
                node.hasher.update(b"," + text.encode())
            node.convs += 1
            node.conv = conv if node.conv is None else min(node.conv, conv)

        def flush(node: Open) -> None:
            if node.ends:
                out.append((ENDS, node.name, None, None, None, None, None, None, None, None, None, ",".join(node.ends), now, node.block))
                node.ends, node.size, node.block = [], 0, node.block + 1

        def close() -> None:
            node, depth = stack.pop(), len(stack)
            above = stack[-1] if stack else None
            if above:
                above.convs += node.convs
                above.conv = node.conv if above.conv is None else min(above.conv, node.conv)
            if node.split:
                flush(node)
                out.append((PART, node.name, above and above.name, depth, node.words, node.conv, None, node.convs, node.children, node.leaves, node.saved, None, now, None))
                return
            saved, leaves = node.saved + (node.convs - 1) * node.words, node.leaves or 1
            out.extend((*kid[:6], node.conv, *kid[7:]) for kid in node.kids)
            row = (WHOLE, node.name, above.name, depth, node.words, node.conv, None, node.convs, node.children, leaves, saved, (node.hasher or hashlib.sha256()).hexdigest(), now, None)
            above.children += 1
            above.leaves += leaves
            above.saved += saved
            (out if above.split else above.kids).append(row)

        def ready() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * len(FIELDS)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], names=list(FIELDS))
            out.clear()
            return batch

        for b in batches:
            for shard, path, conv, words in zip(*(b.column(c).to_pylist() for c in ("shard", "path", "conv_id", "words")), strict=True):
                if shard != now:
                    while stack:
                        close()
                    now, last = shard, b""
                    lower = splitters[shard - 1][0] if shard else b""
                    upper = splitters[shard][0] if shard < len(splitters) else b""
                    stack.append(Open(hashlib.md5(), 0, True))
                common = shared_turns(path, last)
                while len(stack) > common + 1:
                    close()
                depth = len(path) // TURN
                if depth > common:
                    skeleton = max(shared_turns(path, lower), shared_turns(path, upper))
                    for d in range(common, depth):
                        prefix = stack[-1].prefix.copy()
                        prefix.update(path[d * TURN : (d + 1) * TURN])
                        stack.append(Open(prefix, words[d], d < skeleton))
                ended(stack[-1], conv)
                last = path
                if len(out) >= 10_000:
                    yield ready()
        while stack:
            close()
        yield ready()

    return run


TYPES = [pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 8, pa.string(), pa.int64(), pa.int64()]


def hashed(batches):
    """SHA-256 of the comma-joined texts of each node, of partitions sorted by (node, shard, block)."""
    now, hasher = None, None
    for b in batches:
        done: list[tuple[str, str]] = []
        for node, text in zip(b.column("node").to_pylist(), b.column("ends").to_pylist(), strict=True):
            if node == now:
                hasher.update(b"," + text.encode())
                continue
            if now is not None:
                done.append((now, hasher.hexdigest()))
            now, hasher = node, hashlib.sha256(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.string()) for k in (0, 1)], names=["node", "hash"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([hasher.hexdigest()])], names=["node", "hash"])


def subtree_sums(skeleton: DataFrame) -> DataFrame:
    """(node, n_leaves, saved_tokens) over the skeleton below each node, itself included: what is ``2 ** k`` levels below adds its sum in round k."""
    now = written(skeleton.select("node", F.col("parent").alias("jump"), "n_leaves", "saved_tokens"), "trie-sums")
    while now.filter("jump IS NOT NULL").limit(1).count():
        given = now.filter("jump IS NOT NULL").groupBy(F.col("jump").alias("node")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        far = now.select(F.col("node").alias("jump"), F.col("jump").alias("next"))
        step = now.join(given, "node", "left").join(far, "jump", "left")
        step = written(step.select("node", F.col("next").alias("jump"), *((F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("n_leaves", "more_leaves"), ("saved_tokens", "more_saved")))), "trie-sums")
        remove(now)
        now = step
    return now.drop("jump")


def prefix_trie(paths: DataFrame, shards: int | None = None, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """The nodes of conversations ``paths`` (conv_id, path, words), each conv_id once: ``node`` and ``parent`` are digests of the prefixes."""
    spark = paths.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths = written(paths.select("conv_id", "path", "words"), "trie-paths")
    splitters = splitters_of(paths, shards, sample_bytes)

    def dealt(batches):
        for b in batches:
            at = [bisect.bisect_right(splitters, x) for x in zip(b.column("path").to_pylist(), b.column("conv_id").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], names=[*b.schema.names, "shard"])

    rows = paths.mapInArrow(dealt, "conv_id long, path binary, words array<long>, shard int")
    rows = rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "path", "conv_id")
    found = written(rows.mapInArrow(nodes_of_shards(splitters), SHARD_SCHEMA), "trie-shards")

    part = found.filter(F.col("kind") == PART).groupBy("node").agg(
        *(F.first(c).alias(c) for c in ("parent", "depth", "words")), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))
    )
    part = written(part, "trie-skeleton")
    inner = part.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("more"))
    part = part.join(inner, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    part = part.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves"))).withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words"))
    sums = subtree_sums(part)
    blocks = found.filter(F.col("kind") == ENDS).select("node", "shard", "block", "ends").repartition("node").sortWithinPartitions("node", "shard", "block")
    hashes = blocks.mapInArrow(hashed, "node string, hash string")
    nothing = hashlib.sha256().hexdigest()
    skeleton = part.drop("n_leaves", "saved_tokens").join(sums, "node").join(hashes, "node", "left").withColumn("ends_sha256", F.coalesce("hash", F.lit(nothing)))
    skeleton = written(skeleton.select("node", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"), "trie-skeleton-nodes")

    whole = found.filter(F.col("kind") == WHOLE).withColumnRenamed("ends", "ends_sha256").select(*skeleton.columns, "parent_conv_id")
    every = whole.unionByName(skeleton.withColumn("parent_conv_id", F.lit(None).cast("long")))
    # only children of skeleton nodes still lack their parent's id, and the skeleton is small
    above = skeleton.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    return every.join(above, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).drop("above")


def op12_conversation_trie(spark, sf_dir: str) -> DataFrame:
    convs = written(turns_of(read_table(spark, sf_dir, "conversations")), "trie-turns")
    heads = convs.filter("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    rows = convs.withColumn("base", F.expr("conv_id - conv_id % 20")).join(heads, "base", "left")
    none = F.array().cast(convs.schema["turns"].dataType)
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    rows = rows.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), own).alias("turns"))
    nodes = prefix_trie(rows.select("conv_id", *path_columns(F.col("turns"))))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")

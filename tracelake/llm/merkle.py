"""Merkle manifest of a dataset by time-forward processing: a digest for every row, subtree, partition value and the whole, with proofs.

1. Rows become leaves: the SHA-256 of their length-prefixed values, in the JVM. Leaves are written as narrow rows.
2. A range sort over (key, order columns) and the counts of each (partition, key) give every leaf its place in its key's sequence. No
   task needs a whole key: a key with a third of all rows spreads over as many range partitions as its rows fill.
3. Upwards, a shard of ``2 ** levels`` neighbouring nodes of a key is one task's group. An external priority queue ordered by node
   label (level, then place) delivers child digests to their parent; nodes leave it in label order, are written to a tape, and send
   their own digest forward. The shards' tops are the next round's nodes, so n leaves take log(n) / levels rounds.
4. The keys' tops, ordered by key, are the leaves of one more tree, built in the same way.
5. Downwards, the rounds run in reverse. Each shard reads its tape backwards and the queue, now by descending label, delivers to each
   node the proof suffix of its parent: the siblings from there to the root. What reaches the leaves is their whole proof.

A proof is an array of steps from the leaf to the root: ``L`` and the digest of a sibling to the left, ``R`` and that of one to the
right, or ``-`` where the last node of a level is alone and is hashed by itself. ``folded`` recomputes a root from a digest and a proof.

Defined cases: a null value is ``-`` in a leaf, an empty one ``0:``; a null key is a key of its own, before all others, different
from the empty text; null order values come first; rows of equal key and order values are ordered by their digests, and equal
digests may take either place: the tree is the same. Repeated rows are leaves of their own. A lone leaf is its key's top, a lone top is the root.
No rows give no rows. Texts of any length are hashed whole. Further columns, of whatever name, are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, remove, written

#: Levels of one shard: 4,096 nodes.
LEVELS = 12
#: Bits for the place in a node's label; the level stands above them.
PLACE = 44
ALONE = b"-" + bytes(32)


class LabelQueue:
    """A priority queue of (label, message): a heap in memory, sorted runs in task-local files beyond ``memory_bytes``."""

    def __init__(self, memory_bytes: int = 32 << 20):
        self.most, self.held, self.heap, self.heads = memory_bytes, 0, [], []

    def push(self, label: int, message: bytes) -> None:
        heapq.heappush(self.heap, (label, message))
        self.held += len(message) + 120
        if self.held > self.most:
            self.spill()

    def spill(self) -> None:
        run = tempfile.TemporaryFile()
        for label, message in sorted(self.heap):
            run.write(struct.pack("<qi", label, len(message)) + message)
        run.seek(0)
        self.heap, self.held = [], 0
        self.advance(run, len(self.heads))

    def advance(self, run, number: int) -> None:
        if head := run.read(12):
            label, size = struct.unpack("<qi", head)
            heapq.heappush(self.heads, (label, run.read(size), number, run))
        else:
            run.close()

    def first(self) -> int | None:
        """The least label, None if there is nothing."""
        return min((q[0][0] for q in (self.heap, self.heads) if q), default=None)

    def pop(self) -> tuple[int, bytes]:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0][0]):
            label, message, number, run = heapq.heappop(self.heads)
            self.advance(run, number)
            return label, message
        label, message = heapq.heappop(self.heap)
        self.held -= len(message) + 120
        return label, message


def joined(*digests: bytes) -> bytes:
    """The parent's digest: SHA-256 over the children's digests as hexadecimal text."""
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


def climb(leaves: Iterator[bytes], levels: int, memory_bytes: int = 32 << 20):
    """The top of a shard, ``levels`` above its leaves, and the tape of all its digests in label order."""
    queue, tape = LabelQueue(memory_bytes), tempfile.SpooledTemporaryFile(memory_bytes)
    for place, digest in enumerate(leaves):
        queue.push(place, digest)
    while (queue.first() >> PLACE) < levels:
        label, left = queue.pop()
        tape.write(left)
        children = [left]
        if queue.first() == label + 1:
            children.append(queue.pop()[1])
            tape.write(children[1])
        level, place = (label >> PLACE) + 1, (label & ((1 << PLACE) - 1)) >> 1
        queue.push(level << PLACE | place, joined(*children))
    top = queue.pop()[1]
    return top, tape


def descend(tape, size: int, levels: int, suffix: bytes, memory_bytes: int = 32 << 20) -> Iterator[tuple[int, bytes]]:
    """(place, proof) of each of ``size`` leaves, the last first; ``suffix`` is the proof of the shard's top."""
    sizes = [(size + (1 << k) - 1) >> k for k in range(levels + 1)]
    at, queue = tape.tell(), LabelQueue(memory_bytes)
    queue.push(-(levels << PLACE), suffix)
    block, low = b"", at

    def back(n: int) -> bytes:
        nonlocal at, block, low
        at -= 32 * n
        if at < low:
            end, low = at + 32 * n, max(0, at - (1 << 16))
            tape.seek(low)
            block = tape.read(end - low)
        return block[at - low : at - low + 32 * n]

    while queue.first() is not None:
        label, proof = queue.pop()
        level, place = -label >> PLACE, -label & ((1 << PLACE) - 1)
        if level == 0:
            yield place, proof
        elif 2 * place + 1 < sizes[level - 1]:
            both = back(2)
            queue.push(-((level - 1) << PLACE | 2 * place + 1), b"L" + both[:32] + proof)
            queue.push(-((level - 1) << PLACE | 2 * place), b"R" + both[32:] + proof)
        else:
            back(1)
            queue.push(-((level - 1) << PLACE | 2 * place), ALONE + proof)


def steps_of(proof: bytes) -> list[str]:
    return [(proof[k : k + 1].decode() + proof[k + 1 : k + 33].hex()) if proof[k : k + 1] != b"-" else "-" for k in range(0, len(proof), 33)]


def proof_of(steps: list[str]) -> bytes:
    return b"".join(ALONE if s == "-" else s[0].encode() + bytes.fromhex(s[1:]) for s in steps)


def row_digest(*values: Column) -> Column:
    """SHA-256 of a row in hexadecimal: each value as its UTF-8 byte count, a colon and itself, or ``-`` for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def folded(digest: Column, proof: Column) -> Column:
    """The root that a digest and a proof lead to, both in hexadecimal; in the JVM."""
    step = lambda now, s: F.sha2(F.when(s.startswith("L"), F.concat(F.substring(s, 2, 64), now)).when(s.startswith("R"), F.concat(now, F.substring(s, 2, 64))).otherwise(now), 256)
    return F.aggregate(proof, digest, step)


def siblings_digest(proof: Column) -> Column:
    """SHA-256 over a proof's siblings, from the leaf to the root."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.when(s == "-", F.lit("")).otherwise(F.substring(s, 2, 64))), ""), 256)


def placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` with ``pos``, the place in the sequence of ``key``, and ``size``, that sequence's length."""
    rows = written(leaves.repartitionByRange("key", *order).sortWithinPartitions("key", *order).withColumn("at", F.monotonically_increasing_id()), "merkle-sorted")
    part = F.shiftright("at", 33)
    starts = rows.groupBy("key", part.alias("part")).agg(F.min("at").alias("start"), F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("key", "part", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy("key")).alias("size"))
    out = written(rows.withColumn("part", part).join(starts, ["key", "part"]).withColumn("pos", F.col("at") - F.col("start") + F.col("offset")).drop("at", "part", "start", "offset"), "merkle-placed")
    remove(rows)
    return out


def height(size: int) -> int:
    """Levels above ``size`` leaves until one node remains."""
    return (size - 1).bit_length()


def sharded(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("shard", F.shiftright("pos", levels))


def sweep_up(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each round (``key, pos, size, digest``, the first as given), and the tops (``key, digest, round``)."""
    rounds, tops = [nodes], None

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        size = table["size"][0].as_py()
        top, tape = climb(iter(table["digest"].to_pylist()), min(levels, height(size)))
        tape.close()
        return pa.table({"key": table["key"][:1], "pos": table["shard"][:1], "size": pa.array([(size + (1 << levels) - 1) >> levels], pa.int64()), "digest": pa.array([top], pa.binary())})

    while True:
        made = sharded(rounds[-1].select("key", "pos", "size", "digest"), levels).groupBy("key", "shard").applyInArrow(run, "key string, pos long, size long, digest binary")
        made = written(made, "merkle-round")
        done = made.filter("size = 1").select("key", "digest", F.lit(len(rounds) - 1).alias("round"))
        tops = done if tops is None else tops.unionByName(done)
        if (made.agg(F.max("size")).first()[0] or 0) <= 1:
            return rounds, tops
        rounds.append(made.filter("size > 1"))


def proving(kept: list[str], levels: int):
    """The function of one shard: its nodes with their proofs, given those nodes and the proof of the shard's top."""

    def run(nodes: pa.Table, head: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("pos")
        size, n = nodes["size"][0].as_py(), nodes.num_rows
        up = min(levels, height(size))
        _, tape = climb(iter(nodes["digest"].to_pylist()), up)
        proofs: list = [None] * n
        for place, proof in descend(tape, n, up, proof_of(head["suffix"][0].as_py())):
            proofs[place] = steps_of(proof)
        tape.close()
        out = {c: nodes[c] for c in kept} | {"proof": pa.array(proofs, pa.list_(pa.string()))}
        return pa.table(out | {c: pa.array([head[c][0].as_py()] * n, pa.string()) for c in ("subroot", "root")})

    return run


def sweep_down(rounds: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """The first round's rows with ``proof`` and, of their key's top, ``subroot`` and ``root``. ``tops``: key, round, suffix, subroot, root."""
    below = None
    for k in range(len(rounds) - 1, -1, -1):
        heads = tops.filter(F.col("round") == k).select("key", F.lit(0).cast("long").alias("shard"), "suffix", "subroot", "root")
        if below is not None:
            heads = heads.unionByName(below.select("key", F.col("pos").alias("shard"), F.col("proof").alias("suffix"), "subroot", "root"))
        rows = rounds[k] if k == 0 else rounds[k].select("key", "pos", "size", "digest")
        schema = T.StructType([*rows.schema, T.StructField("proof", T.ArrayType(T.StringType())), T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType())])

        below = sharded(rows, levels).groupBy("key", "shard").cogroup(heads.groupBy("key", "shard")).applyInArrow(proving(rows.columns, levels), schema)
        if k:
            below = written(below, "merkle-proofs")
    return below


def manifest(leaves: DataFrame, order: list[str], levels: int = LEVELS) -> DataFrame:
    """Leaves (``key`` string or null, ``digest`` in hexadecimal, order columns, others) with ``proof``, ``subroot`` and ``root``, and their
    place ``pos`` among the ``size`` leaves of their key. Given columns of these five names are replaced."""
    given = [c for c in leaves.columns if c not in ("pos", "size", "proof", "subroot", "root")]
    own = [F.col(c).alias(f"order{k}") for k, c in enumerate(order)]
    # a text for every key: null before all others, the empty one next. Written, so that the range sort samples narrow rows, not texts
    narrow = written(leaves.select(F.coalesce(F.concat(F.lit("="), F.col("key")), F.lit("")).alias("key"), F.unhex("digest").alias("digest"), *own, F.struct(*given).alias("leaf")), "merkle-leaves")
    rounds, tops = sweep_up(placed(narrow, [*(f"order{k}" for k in range(len(order))), "digest"]), levels)
    remove(narrow)
    second = placed(tops.select(F.lit("").alias("key"), F.col("key").alias("name"), "digest", "round"), ["name"])
    over, root = sweep_up(second, levels)
    root = root.select("key", "round", F.array().cast("array<string>").alias("suffix"), F.lit("").alias("subroot"), F.lower(F.hex("digest")).alias("root"))
    joined_up = sweep_down(over, root, levels)
    tops = written(joined_up.select(F.col("name").alias("key"), "round", F.col("proof").alias("suffix"), F.lower(F.hex("digest")).alias("subroot"), "root"), "merkle-tops")
    return sweep_down(rounds, tops, levels).select("leaf.*", "pos", "size", "proof", "subroot", "root")


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    one_more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    leaf = lambda n: row_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    leaves = docs.select(F.col("lang").alias("key"), "doc_id", leaf(F.col("n_chars")).alias("digest"), F.when(tampered, leaf(one_more)).alias("changed"))
    made = manifest(leaves, ["doc_id"])
    made = made.withColumn("folded_root", folded(F.coalesce("changed", "digest"), F.col("proof")))
    return made.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", siblings_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))

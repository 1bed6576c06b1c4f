"""Cost-balanced packing of tokenised documents into fixed-length sequences.

A sequence costs ``linear * tokens + quadratic * sum(piece length ** 2)``, the share of attention within pieces. Documents go
in descending order to the lowest-cost sequence that still has room; a document that fits nowhere whole is cut. Each task packs
windows of ``window_tokens`` tokens of its own rows, so nothing is shuffled, memory is bounded and a lost task is redone alone.

Defined cases: a null or empty text is one end token; a null id is packed like any other; repeated rows are packed one by
one; a text of any length is cut into whole sequences first; strings of the vocabulary's special tokens in a text are those tokens,
as its tokenizer reads them. Of documents of equal length the earlier row goes first, of sequences of equal cost the one of smaller
number. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import read_table

SEQUENCE = 2048
END = 1
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoder(ranks_path: str, pattern: str, special_path: str | None = None):
    """A function from a text to its ids by a byte-level BPE. ``special_path``: a ``tokenizers`` file whose added tokens are split off first."""
    import tiktoken

    special = {}
    if special_path:
        with open(special_path, encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: coder.encode_to_numpy(text, allowed_special="all")


def assign(lengths: list[int], size: int = SEQUENCE, linear: float = 1.0, quadratic: float = 1.0 / SEQUENCE) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length): all full but the last.

    As few sequences as hold all tokens. Whole chunks of ``size`` are sequences of their own. The rest, longest first, goes to
    the lowest-cost sequence with room for it, of all; where none has room, it fills the emptiest one, and what is left goes on so.
    """
    sequences: list[list[tuple[int, int, int]]] = []
    rest = []
    for d, n in enumerate(lengths):
        whole = n // size
        sequences += [[(d, k * size, size)] for k in range(whole)]
        if n > whole * size:
            rest.append((n - whole * size, d, whole * size))
    count = -(-sum(n for n, _, _ in rest) // size)
    room = [size] * count
    if count:
        room[-1] = sum(n for n, _, _ in rest) - size * (count - 1)
    own: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
    # a heap of (cost, sequence) for each room, and over the rooms a tree of the heaps' least
    none = (float("inf"), -1)
    open_with: list[list[tuple[float, int]]] = [[] for _ in range(size + 1)]
    for s in range(count):
        open_with[room[s]].append((0.0, s))
    tree = [none] * (size + 1) + [h[0] if h else none for h in open_with]
    for k in range(size, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def renew(r: int) -> None:
        k = r + size + 1
        tree[k] = open_with[r][0] if open_with[r] else none
        while k > 1:
            k //= 2
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def lowest(n: int) -> tuple[float, int]:
        """The lowest-cost sequence with room for n, or ``none``."""
        best, low, high = none, n + size + 1, 2 * size + 2
        while low < high:
            if low & 1:
                best = min(best, tree[low])
                low += 1
            if high & 1:
                high -= 1
                best = min(best, tree[high])
            low, high = low // 2, high // 2
        return best

    most = size
    rest.sort(key=lambda x: (-x[0], x[1]))
    for n, d, start in rest:
        while n:
            cost, s = lowest(n)
            take = n
            if s < 0:
                while not open_with[most]:
                    most -= 1
                (cost, s), take = open_with[most][0], most
            heapq.heappop(open_with[room[s]])
            renew(room[s])
            own[s].append((d, start, take))
            room[s] -= take
            start += take
            n -= take
            if room[s]:
                heapq.heappush(open_with[room[s]], (cost + linear * take + quadratic * take * take, s))
                renew(room[s])
    return sequences + own


def pack(docs: DataFrame, ranks_path: str, pattern: str, special_path: str | None = None, keep: tuple[str, ...] = ("doc_id",), size: int = SEQUENCE, window_tokens: int = 8_000_000, linear: float = 1.0, quadratic: float = 1.0 / SEQUENCE) -> DataFrame:
    """One row a piece: ``keep``, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    source = docs.select(*keep, "text")
    schema = source.select(*keep).schema
    for field in SCHEMA.split(", "):
        schema = schema.add(*field.split(" "))
    names = [f.name for f in schema]

    def run(batches):
        from pyspark import TaskContext

        encode = encoder(ranks_path, pattern, special_path)
        task, made, held, ids, total = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            nonlocal made
            lengths = [len(x) for x in ids]
            rows: list[list[int]] = [[] for _ in range(7)]
            for sequence in assign(lengths, size, linear, quadratic):
                offset = 0
                for d, start, n in sequence:
                    for col, v in zip(rows, (d, start, n, zlib.crc32(ids[d][start : start + n].tobytes()), lengths[d], task * 2**33 + made, offset), strict=True):
                        col.append(v)
                    offset += n
                made += 1
            table = pa.Table.from_batches(held)
            out = table.take(pa.array(rows[0], pa.int64())).combine_chunks()
            out = [*out.columns, *(pa.array(c, pa.int64()) for c in rows[1:])]
            return pa.table(out, names=names).to_batches()

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                for text in part.column("text").to_pylist():
                    body = encode(text).astype("<u4", copy=False) if text else np.empty(0, "<u4")
                    ids.append(np.append(body, np.uint32(END)).astype("<u4", copy=False))
                    total += len(ids[-1])
                held.append(part.select(list(keep)))
                if total >= window_tokens:
                    yield from flush()
                    held, ids, total = [], [], 0
        if ids:
            yield from flush()

    return source.mapInArrow(run, schema)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json"))

"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` reads the training texts once and stores the postings of every term: texts are dealt into shards of bounded size, a
shard's words lie on one line of positions with a gap after each document, and its row holds the hashes of its terms, each term's
sorted positions, and where documents begin. The index knows nothing of any benchmark and serves every one.

``search`` takes a benchmark in blocks of bounded size. In each shard, windows with a term that the shard lacks are dropped; for the
others, the offset-adjusted position lists of their terms are intersected, the rarest term's first, for all windows of the block at
once. What is left are exact occurrences. With ``slop`` above 0 a term may lie up to so many words from its place (proximity matches).

Defined cases: a null or empty text has no words and no hits; an item without words matches nothing; repeated items and documents
are each reported; a document word is counted once however many windows cover it. Ids may be of any type; an item without an id
counts as an item, hits words, and adds nothing to the list of names; items that share an id are one item. Terms are compared by
64-bit hashes. A text longer than a shard is a shard of its own; words of any length are terms.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import read_table, written

WINDOW = 10
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Benchmark texts of up to so many bytes go to the tasks at once, as some 20 bytes a word; larger ones are asked block by block.
BLOCK_BYTES = 8_000_000
SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("item", T.StringType())]))


def words(text: str | None) -> list[str]:
    return WORDS.findall(text.translate(LOWER)) if text else []


def term_hashes(terms) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in terms), np.uint64).view(np.int64)


def build_index(docs: DataFrame, gap: int = WINDOW, shard_words: int = 1_000_000) -> DataFrame:
    """The index, one row a shard: its term hashes in order, how many positions each has, all positions by term, and its documents'
    ids, first positions and word counts. Numbers are little-endian, of 64 bits (terms) and 32 bits.

    A shard has some ``shard_words`` words, or one document that is longer.
    """
    schema = T.StructType([T.StructField("shard", T.StringType()), *(T.StructField(n, T.BinaryType()) for n in ("terms", "counts", "positions", "starts", "sizes")), T.StructField("ids", T.ArrayType(docs.schema["doc_id"].dataType))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        terms, held, ids, starts, sizes, at = {}, [], [], [], [], 0

        def flush():
            nonlocal made
            line = np.concatenate(held) if held else np.empty(0, np.int32)
            where = np.flatnonzero(line >= 0).astype("<i4")
            hashes = term_hashes(terms)
            rank = np.empty(len(hashes), np.int32)
            order = np.argsort(hashes)
            rank[order] = np.arange(len(hashes))
            numbers = rank[line[where]] if len(where) else np.empty(0, np.int32)
            positions = where[np.argsort(numbers, kind="stable")]
            parts = [hashes[order].astype("<i8"), np.bincount(numbers, minlength=len(hashes)).astype("<i4"), positions, np.array(starts, "<i4"), np.array(sizes, "<i4")]
            yield pa.RecordBatch.from_arrays([pa.array([f"{task}-{made}"]), *(pa.array([x.tobytes()], pa.binary()) for x in parts), pa.array([ids], arrow.field("ids").type)], schema=arrow)
            made += 1

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                w = words(text.as_py())
                ids.append(doc)
                starts.append(at)
                sizes.append(len(w))
                held += [np.fromiter((terms.setdefault(x, len(terms)) for x in w), np.int32, len(w)), np.full(gap, -1, np.int32)]
                at += len(w) + gap
                if at >= shard_words:
                    yield from flush()
                    terms, held, ids, starts, sizes, at = {}, [], [], [], [], 0
        if ids:
            yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Phrases:
    """The windows of a block of items, as term numbers on one line: window k begins at ``at[k]``, has ``size[k]`` terms and belongs to ``item[k]``."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        terms: dict[str, int] = {}
        names: dict[str | None, int] = {}
        line, at, size, item, place = [], [], [], [], 0
        for name, text in items:
            w = np.array([terms.setdefault(x, len(terms)) for x in words(text)], np.int32)
            if len(w):
                n = max(1, len(w) - window + 1)
                line.append(w)
                at.append(place + np.arange(n))
                size.append(np.full(n, min(window, len(w)), np.int32))
                item.append(np.full(n, names.setdefault(name, len(names)), np.int32))
                place += len(w)
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
        self.line, self.at, self.size, self.item = join(line, np.int32), join(at, np.int64), join(size, np.int32), join(item, np.int32)
        self.hashes, self.names = term_hashes(terms), list(names)


def occurrences(asked: Phrases, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, slop: int = 0, most: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(window, first position) of each occurrence in a shard: offset-adjusted lists intersected from the rarest term on."""
    none = np.empty(0, np.int64)
    if not len(terms) or not len(asked.at):
        return none, none
    own = np.minimum(np.searchsorted(terms, asked.hashes), len(terms) - 1)
    own = np.where(terms[own] == asked.hashes, own, -1)
    begins = np.r_[0, np.cumsum(counts)].astype(np.int64)
    keys = (np.repeat(np.arange(len(terms), dtype=np.int64), counts) << 32) | positions
    line = own[asked.line]
    lost = np.r_[0, np.cumsum(line < 0)]
    left = np.flatnonzero(lost[asked.at + asked.size] == lost[asked.at])
    out_w, out_p = [none], [none]
    for size in np.unique(asked.size[left]).tolist():
        mine = left[asked.size[left] == size]
        numbers = line[asked.at[mine][:, None] + np.arange(size)]
        order = np.argsort(counts[numbers], axis=1, kind="stable")  # a window's terms, the rarest first
        rare = np.take_along_axis(numbers, order[:, :1], 1)[:, 0]
        load = np.cumsum(counts[rare].astype(np.int64))
        for part in np.split(np.arange(len(mine)), np.searchsorted(load, np.arange(most, int(load[-1]), most))) if len(mine) else []:
            if not len(part):
                continue
            n = counts[rare[part]].astype(np.int64)
            which = np.repeat(part, n)
            inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            first = positions[begins[rare[which]] + inside].astype(np.int64) - order[which, 0]
            for step in range(1, size):
                k = order[which, step]
                term = numbers[which, k].astype(np.int64)
                want = (term << 32) | np.maximum(first + k, 0)
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                ok = keys[at] == want
                if slop:
                    before = np.maximum(at - 1, 0)
                    ok = ((keys[at] >> 32 == term) & (np.abs(keys[at] - want) <= slop)) | ((keys[before] >> 32 == term) & (np.abs(keys[before] - want) <= slop))
                which, first = which[ok], first[ok]
                if not len(which):
                    break
            ok = first >= 0
            out_w.append(mine[which[ok]])
            out_p.append(first[ok])
    return np.concatenate(out_w), np.concatenate(out_p)


def search(index: DataFrame, asked: Phrases, slop: int = 0) -> DataFrame:
    """Every document of the index: shard, at (its place there), doc_id, n_words, and spans (first word, words, item) of the windows in it."""
    schema = T.StructType([T.StructField("shard", T.StringType()), T.StructField("at", T.IntegerType()), T.StructField("doc_id", index.schema["ids"].dataType.elementType), T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS)])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                numbers = lambda n, kind: np.frombuffer(batch.column(n)[k].as_py(), kind)  # noqa: B023, E731
                starts, sizes, ids = numbers("starts", "<i4"), numbers("sizes", "<i4"), batch.column("ids").slice(k, 1).flatten()
                window, first = occurrences(asked, numbers("terms", "<i8"), numbers("counts", "<i4"), numbers("positions", "<i4"), slop)
                doc = np.searchsorted(starts, first, "right") - 1
                ok = (doc >= 0) & (first - starts[doc] + asked.size[window] <= sizes[doc]) if len(first) else np.empty(0, bool)
                window, first, doc = window[ok], first[ok], doc[ok]
                order = np.lexsort((window, first, doc))
                window, first, doc = window[order], first[order], doc[order]
                cut = np.searchsorted(doc, np.arange(len(starts) + 1)).astype(np.int32)
                names = pa.array(asked.names, pa.string()).take(pa.array(asked.item[window]))
                spans = pa.StructArray.from_arrays([pa.array((first - starts[doc]).astype(np.int32)), pa.array(asked.size[window]), names], fields=list(arrow.field("spans").type.value_type))
                shard = batch.column("shard")[k].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(starts), pa.string()), pa.array(np.arange(len(starts), dtype=np.int32)), ids, pa.array(sizes.astype(np.int64)), pa.ListArray.from_arrays(pa.array(cut), spans, type=arrow.field("spans").type)], schema=arrow)

    return index.mapInArrow(run, schema)


def blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The benchmark in blocks of some ``block_bytes`` of text: a stated query set, asked block by block."""
    held, size = [], 0
    for r in items.select(F.col("item_id").cast("string").alias("item"), "text").toLocalIterator():
        held.append((r["item"], r["text"]))
        size += len((r["text"] or "").encode())
        if size >= block_bytes:
            yield held
            held, size = [], 0
    yield held


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, block_bytes: int = BLOCK_BYTES, index: DataFrame | None = None) -> DataFrame:
    """``search`` of all benchmark windows, one row a document. ``index``: a stored index of these documents, if there is one."""
    index = written(build_index(docs, window + slop), "positions") if index is None else index
    out, several = None, False
    for block in blocks(items, block_bytes):
        part = search(index, Phrases(block, window), slop)
        out, several = (part, False) if out is None else (out.unionByName(part), True)
    if several:
        out = out.groupBy("shard", "at").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"))
    return out


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""

    def run(batches):
        for b in batches:
            hits, items, shas = [], [], []
            for spans in b.column("spans").to_pylist():
                at, n, names = 0, 0, set()
                for s in sorted(spans, key=lambda s: s["first"]):
                    end = s["first"] + s["size"]
                    n += max(0, end - max(at, s["first"]))
                    at = max(at, end)
                    names.add(s["item"])
                hits.append(n)
                items.append(len(names))
                shas.append(hashlib.sha256(",".join(sorted(names - {None})).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("n_words"), pa.array(hits, pa.int64()), pa.array(items, pa.int64()), pa.array(shas, pa.string()), pa.array([h > 0 for h in hits], pa.bool_())], names=[key, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    schema = found.select(key, "n_words").schema.add("n_hit", "long").add("n_items", "long").add("items_sha256", "string").add("contaminated", "boolean")
    return found.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    return digest(find(docs, items, window))


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))

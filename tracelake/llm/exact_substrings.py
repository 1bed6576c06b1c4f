"""Suffix-array removal of repeated byte strings, exact over the whole corpus.

Every window of ``window`` bytes has an anchor: the place of its smallest ``gram``-byte hash. Equal windows have equal anchors
at equal places, so text around an anchor that occurs once in the corpus can't repeat and never moves. What remains is dealt
into shards by anchor; in each shard the distinct pieces are put on one line, suffixes are sorted by external induced sorting,
and windows that share ``window`` bytes with a neighbour in suffix order, compared byte by byte, are repeats.

Pieces that recur byte for byte are sorted once and carry their number of copies, so a passage that a third of all documents
share is one piece. Equal texts are one text with a number of copies. The number of shards follows the bytes to sort. Windows of an
anchor with more different text around it than a shard holds are dealt again, by the smallest hash besides it, up to four times. Neighbouring
windows with equal anchors are one piece, also where the anchor's bytes recur, as in a text of one letter.

Defined cases: null counts as empty; texts shorter than the window lose nothing; repeated rows are copies of each other, so
each loses all if it has ``window`` bytes; ids may be null or repeat; texts of any length are cut into blocks for hashing.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, release, remove, written
from .induced_sort import disk_array, prefix_hashes, sorted_suffixes, substring_hashes

WINDOW = 200
GRAM = 40
#: Bytes that are sorted as one shard. Arrays and queues beyond MEMORY_BYTES each lie on disk.
SHARD_BYTES = 4 << 20
MEMORY_BYTES = 48 << 20
#: How often an anchor with too much text is dealt again.
SPLITS = 4
BLOCK = 8 << 20


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours: prefix and suffix minima of blocks of that width."""
    n = len(x) - width + 1
    pad = -len(x) % width
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(y, 1).ravel()
    behind = np.minimum.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Each window's anchor place and, by place, the hash of the bytes there. For texts of ``window`` bytes or more."""
    sums, inverse = prefix_hashes(data, np.empty(len(data) + 1, np.uint64))
    at = np.arange(len(data) - gram + 1)
    h = substring_hashes(sums, inverse, at, at + gram)
    low = np.uint64(0xFFFFFF)
    least = sliding_min((h & ~low) | (low - at.astype(np.uint64)), window - gram + 1)
    return (low - (least & low)).astype(np.int64), h


def runs_of(data: np.ndarray, limits: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of windows with one anchor hash, over texts that lie end to end: text number, first window, windows, hash, and
    whether the anchor's bytes lie at several places in it."""
    texts, starts, counts, hashes, several = [], [], [], [], []
    lengths = np.diff(limits)
    k = 0
    while k < len(lengths):
        # texts are hashed together up to a block; a longer text alone, in overlapping blocks
        j = k + 1
        while j < len(lengths) and limits[j + 1] - limits[k] <= BLOCK:
            j += 1
        first, end = int(limits[k]), int(limits[j])
        for low in range(first, max(first + 1, end - window + 1), BLOCK):
            part = data[low : min(end, low + BLOCK + window - 1)]
            if len(part) < window:
                continue
            place, h = anchors(part, window, gram)
            number = np.searchsorted(limits[k : j + 1], low + np.arange(len(place)), "right") - 1 if j > k + 1 else np.zeros(len(place), np.int64)
            inside = low + np.arange(len(place)) + window <= limits[k : j + 1][number + 1]
            found = h[place]
            moved = np.cumsum(np.r_[False, place[1:] != place[:-1]])
            new = np.flatnonzero(np.r_[True, (found[1:] != found[:-1]) | (number[1:] != number[:-1]) | (inside[1:] != inside[:-1])])
            size = np.diff(np.r_[new, len(place)])
            ok = inside[new]
            new, size = new[ok], size[ok]
            texts.append(number[new] + k)
            starts.append(low + new - limits[number[new] + k])
            counts.append(size)
            hashes.append(found[new])
            several.append(moved[new + size - 1] > moved[new])
        k = j
    join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
    return join(texts, np.int64), join(starts, np.int64), join(counts, np.int32), join(hashes, np.uint64), join(several, np.bool_)


def scan(docs: DataFrame, window: int) -> DataFrame:
    """Per row: doc_id, key (digest of the text), n_bytes, sha, and the anchor runs as hash, start and count arrays."""
    source = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    schema = docs.select("doc_id").schema.add("key", "binary").add("n_bytes", "long").add("sha", "string").add("m", T.ArrayType(T.LongType())).add("start", T.ArrayType(T.LongType())).add("count", T.ArrayType(T.IntegerType())).add("several", T.ArrayType(T.BooleanType()))

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                b = batch.slice(low, 1000)
                texts = [x.as_buffer() for x in b.column("text")]
                limits = np.r_[0, np.cumsum([len(x) for x in texts])].astype(np.int64)
                data = np.concatenate([np.frombuffer(x, np.uint8) for x in texts]) if texts else np.empty(0, np.uint8)
                number, start, count, m, several = runs_of(data, limits, window)
                cut = np.searchsorted(number, np.arange(len(texts) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in (m.view(np.int64), start, count, several)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array([hashlib.md5(x).digest() for x in texts], pa.binary()), pa.array(np.diff(limits)), pa.array([hashlib.sha256(x).hexdigest() for x in texts]), *lists],
                    names=["doc_id", "key", "n_bytes", "sha", "m", "start", "count", "several"],
                )

    return source.mapInArrow(run, schema)


def places(texts: DataFrame, window: int) -> DataFrame:
    """Where each candidate run lies, and the digest of its bytes: key, start, count, m, digest. Rows: key, text, runs."""
    schema = "key binary, start long, count int, m long, digest binary"

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                rows = [
                    (key, r["start"], r["count"], r["m"], hashlib.md5(text[r["start"] : r["start"] + r["count"] + window - 1]).digest())
                    for key, text, runs in zip(part.column("key").to_pylist(), part.column("text").to_pylist(), part.column("runs").to_pylist(), strict=True)
                    for r in runs
                ]
                if rows:
                    kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "start", "count", "m", "digest"])

    return texts.mapInArrow(run, schema)


def dealt_again(texts: DataFrame, window: int, gram: int = GRAM) -> DataFrame:
    """The windows of chosen runs by the smallest hash besides those they were dealt by: rows of ``places``. Rows: key, text, and runs
    (start, count, used: the hashes so far)."""
    schema = "key binary, start long, count int, m long, used array<long>, digest binary"
    most = np.uint64(2**64 - 1)

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part, rows = b.slice(k, 256), []
                for key, text, runs in zip(part.column("key").to_pylist(), part.column("text").to_pylist(), part.column("runs").to_pylist(), strict=True):
                    for r in runs:
                        data = np.frombuffer(text, np.uint8)[r["start"] : r["start"] + r["count"] + window - 1]
                        sums, inverse = prefix_hashes(data, np.empty(len(data) + 1, np.uint64))
                        at = np.arange(len(data) - gram + 1)
                        h = substring_hashes(sums, inverse, at, at + gram)
                        least = sliding_min(np.where(np.isin(h, np.array(r["used"], np.int64).view(np.uint64)), most, h), window - gram + 1)
                        new = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
                        for a, n, value in zip(new.tolist(), np.diff(np.r_[new, len(least)]).tolist(), least[new].view(np.int64).tolist(), strict=True):
                            used = [*r["used"], value]
                            name = hashlib.md5(np.array(used, "<i8").tobytes()).digest()
                            rows.append((key, r["start"] + a, n, int.from_bytes(name[:8], "little", signed=True), used, hashlib.md5(data[a : a + n + window - 1].tobytes()).digest()))
                if rows:
                    kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "start", "count", "m", "used", "digest"])

    return texts.mapInArrow(run, schema)


def pieces(texts: DataFrame, window: int) -> DataFrame:
    """The bytes of chosen runs: m, digest, copies, piece. Rows: text and ``own``, an array of (start, count, m, digest, copies)."""
    schema = "m long, digest binary, copies long, piece binary"

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                rows = [
                    (r["m"], r["digest"], r["copies"], text[r["start"] : r["start"] + r["count"] + window - 1])
                    for text, own in zip(part.column("text").to_pylist(), part.column("own").to_pylist(), strict=True)
                    for r in own
                ]
                if rows:
                    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["m", "digest", "copies", "piece"])

    return texts.select("text", "own").mapInArrow(run, schema)


def repeats_in(chunks: list[bytes], window: int, folder: str, memory_bytes: int = MEMORY_BYTES) -> np.ndarray:
    """Over the pieces end to end: True at each place where a window starts that also starts elsewhere among them."""
    text = disk_array(folder, "text", np.uint8, sum(map(len, chunks)), memory_bytes)
    limits = np.r_[0, np.cumsum([len(c) for c in chunks])]
    for c, at in zip(chunks, limits, strict=False):
        text[at : at + len(c)] = np.frombuffer(c, np.uint8)
    starts = disk_array(folder, "starts", np.bool_, len(text), memory_bytes)
    starts[:] = False
    for a, b in zip(limits, limits[1:], strict=False):
        starts[a : b - window + 1] = True
    sums, inverse = prefix_hashes(text, disk_array(folder, "window-sums", np.uint64, len(text) + 1, memory_bytes))
    found = np.zeros(len(text), np.bool_)
    last = np.empty(0, np.int64)
    reach = np.arange(window)
    for bucket in sorted_suffixes(text, folder, window, memory_bytes):
        line = np.concatenate([last, bucket[starts[bucket]]])
        if len(line) > 1:
            h = substring_hashes(sums, inverse, line, line + window)
            near = np.flatnonzero(h[1:] == h[:-1])
            for k in range(0, len(near), 20_000):
                at = near[k : k + 20_000]
                same = (text[line[at][:, None] + reach] == text[line[at + 1][:, None] + reach]).all(1)
                found[line[at[same]]] = True
                found[line[at[same] + 1]] = True
        last = line[-1:]
    return found


def intervals(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return edges[::2], edges[1::2]


def repeated_windows(distinct: DataFrame, window: int, shards: int, memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """(digest, first, last): runs of repeated windows of each distinct piece. Rows: m, digest, piece, copies."""
    schema = "digest binary, first int, last int"

    def run(batches):
        digests, chunks, copies = [], [], []
        for b in batches:
            digests += b.column("digest").to_pylist()
            chunks += b.column("piece").to_pylist()
            copies += b.column("copies").to_pylist()
        if not chunks:
            return
        with tempfile.TemporaryDirectory() as folder:
            found = repeats_in(chunks, window, folder, memory_bytes)
            at, rows = 0, []
            for d, c, n in zip(digests, chunks, copies, strict=True):
                own = found[at : at + len(c) - window + 1]
                if n > 1:
                    own = np.ones(len(own), np.bool_)
                rows += [(d, int(a), int(b)) for a, b in zip(*intervals(own), strict=True)]
                at += len(c)
        if rows:
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], names=["digest", "first", "last"])

    return distinct.repartition(shards, "m").mapInArrow(run, schema)


def cut(texts: DataFrame, window: int) -> DataFrame:
    """(key, kept, spans): texts without the bytes of their repeated windows. Rows: key, text, found (array of start, stop windows)."""
    schema = "key binary, kept binary, spans array<struct<start:long,stop:long>>"

    def run(batches):
        for b in batches:
            kept, spans = [], []
            for text, found in zip(b.column("text").to_pylist(), b.column("found").to_pylist(), strict=True):
                merged: list[list[int]] = []
                for x in sorted((f["start"], f["stop"] + window - 1) for f in found or []):
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x[1])
                    else:
                        merged.append(list(x))
                at, parts = 0, []
                for a, z in merged:
                    parts.append(text[at:a])
                    at = z
                kept.append(b"".join([*parts, text[at:]]))
                spans.append([{"start": a, "stop": z} for a, z in merged])
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], names=["key", "kept", "spans"])

    return texts.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """Per row: doc_id, n_bytes, sha, copies of its text, and kept and spans (null: nothing removed by windows of other texts)."""
    spark = docs.sparkSession
    rows = written(scan(docs, window), "anchor-runs")
    copies = rows.groupBy("key").agg(F.count("*").alias("copies"))
    runs = rows.select("doc_id", "key", F.explode(F.arrays_zip("m", "start", "count", "several")).alias("r")).select("doc_id", "key", "r.*")
    place = F.xxhash64("key", "start")
    twice = written(runs.groupBy("m").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.max("several").alias("several")).filter("a != b OR several").select("m"), "anchors-twice")
    release(spark)
    wanted = written(runs.join(twice, "m", "left_semi").groupBy("key").agg(F.min("doc_id").alias("rep"), F.collect_set(F.struct("start", "count", "m")).alias("runs")), "candidate-runs")
    release(spark)
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    source = docs.select(F.col("doc_id").alias("rep_id"), text.alias("text"), F.unhex(F.md5(text)).alias("text_key"))
    chosen = source.join(wanted, (source["text_key"] == wanted["key"]) & source["rep_id"].eqNullSafe(wanted["rep"])).select("key", "rep", "text", "runs")
    chosen = written(chosen.dropDuplicates(["key", "rep"]).select("key", "text", "runs"), "candidate-texts")
    remove(twice, wanted)
    release(spark)
    every = written(places(chosen, window).withColumn("used", F.array("m")), "places")

    def distinct() -> DataFrame:
        one = every.groupBy("digest").agg(F.min(F.struct("key", "start", "count", "m")).alias("r"), F.count("*").alias("copies"))
        return written(one.select("r.*", "digest", "copies"), "distinct-pieces")

    one = distinct()
    release(spark)
    for _ in range(SPLITS):
        # fewer rows than the bytes of all pieces by those of a shard
        heavy = one.groupBy("m").agg(F.sum(F.col("count") + window - 1).alias("bytes"), F.count("*").alias("n")).filter((F.col("bytes") > shard_bytes) & (F.col("n") > 1)).select("m")
        heavy = written(heavy, "heavy-anchors")
        if heavy.isEmpty():
            break
        runs = every.join(heavy, "m", "left_semi").groupBy("key").agg(F.collect_list(F.struct("start", "count", "used")).alias("runs"))
        finer = dealt_again(chosen.select("key", "text").join(runs, "key"), window)
        whole = written(every.join(heavy, "m", "left_anti").unionByName(finer), "places")
        remove(every, one)
        every = whole
        one = distinct()
        release(spark)
    total = one.agg(F.sum(F.col("count") + window - 1)).first()[0] or 0
    own = one.groupBy("key").agg(F.collect_list(F.struct("start", "count", "m", "digest", "copies")).alias("own"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = written(repeated_windows(pieces(chosen.select("key", "text").join(own, "key"), window), window, max(least, -(-total // shard_bytes)), memory_bytes), "repeats")
    release(spark)
    spans = every.select("key", "start", "digest").join(found, "digest").groupBy("key").agg(F.collect_list(F.struct((F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("last")).alias("stop"))).alias("found"))
    done = written(cut(chosen.select("key", "text").join(spans, "key"), window), "cut-texts")
    remove(every, one, found, chosen)
    release(spark)
    return rows.select("doc_id", "key", "n_bytes", "sha").join(copies.join(done, "key", "left"), "key")


def op8_exact_substrings(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= WINDOW)
    removed = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"]), F.lit(0))
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(removed).cast("long").alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce(F.size("spans"), F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce(F.sha2("kept", 256), F.col("sha"))).alias("kept_sha256"),
    )

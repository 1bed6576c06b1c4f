"""WARC: write record archives, normalise monolithic gzip streams, read them back by offset.

Spark's text writer makes the archives: each file is one gzip stream over many records. The normaliser inflates such a file
once, as a stream, writes every record again as a gzip member of its own, and a sidecar index of (record, offset, length)
beside it. Files are read and written through the file system that the folder's address names, in chunks, so memory doesn't
grow with a file. A task writes its output under a name of its own and renames it, so a repeated task does no harm.

Defined cases: a null html is an empty payload. Of records with equal payloads, those of ``least_bytes`` bytes or more refer to
the one with the smallest page_id; rows of that same id are responses too, and so are rows without an id, which come back
without one. Ids hold any characters: they are percent-encoded in headers and index, and decoded when read. Repeated rows are written one by one. A null url
is left out of the record; white space and control characters in it are percent-encoded. Payloads of any length are streamed. An empty table gives an
empty archive and no rows. Further columns, of whatever name, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path, read_table, written

CHUNK = 1 << 20


def with_types(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, size, sha1 (hex), refers_to (null: a response)."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("sha1", F.sha1("html")).withColumn("size", F.octet_length("html").cast("long"))
    first = p.groupBy("sha1", "size").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter((F.col("size") >= least_bytes) & (F.col("first") != F.col("last"))).select("sha1", "first")
    first = written(first, "first-pages")
    # digests join narrow rows. The last join is by row: payloads stay where they are read while the revisits can be broadcast, and
    # are shuffled once by (page_id, sha1), so that a payload on very many pages is no hot key, where there are more of them
    refers = p.select("page_id", "sha1").join(first, "sha1").filter("page_id > first").select("page_id", F.col("first").alias("refers_to"), "sha1").distinct()
    refers = written(refers, "revisits")
    return p.join(refers, ["page_id", "sha1"], "left")


def identifier(page_id: str) -> Column:
    """An id as a header may hold it: all but plain letters and digits percent-encoded, so line breaks too."""
    return F.url_encode(F.col(page_id).cast("string"))


def page_of(urn: str | None) -> str | None:
    """The id that ``identifier`` encoded, out of ``<urn:page:...>``."""
    return None if urn is None else unquote_plus(urn[10:-1])


def records(typed: DataFrame) -> DataFrame:
    """One string a record, without its last line feed, which the writer adds."""
    end = "\r\n"
    is_response = F.col("refers_to").isNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{end}Content-Type: text/html; charset=utf-8{end}{end}"))
    body = F.when(is_response, F.concat(http, F.col("html"))).otherwise(F.lit(""))
    url = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7F]", "%20")
    head = F.concat_ws(
        end,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(is_response, "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), identifier("page_id"), F.lit(">")),
        F.concat(F.lit("WARC-Refers-To: <urn:page:"), identifier("refers_to"), F.lit(">")),
        F.when(~is_response, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.concat(F.lit("X-Payload-Length: "), F.col("size")),
        F.concat(F.lit("Content-Length: "), F.octet_length(body)),
    )
    return typed.select(F.concat(head, F.lit(end + end), body, F.lit(end + "\r")).alias("value"))


def write_archives(typed: DataFrame, path: str, records_per_file: int = 200_000) -> None:
    """Archives of one gzip stream each, as plain tools would make them."""
    records(typed).write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", records_per_file).text(path)


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, header to closing blank lines, from inflated chunks of any size."""
    held, need = bytearray(), 0
    for chunk in chunks:
        held += chunk
        while True:
            if not need:
                at = held.find(b"\r\n\r\n")
                if at < 0:
                    break
                need = at + 4 + content_length(bytes(held[:at])) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held.strip():
        raise ValueError("the archive ends inside a record")


def headers(head: bytes) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode("utf-8").split("\r\n")[1:])}


def content_length(head: bytes) -> int:
    return int(headers(head)["content-length"])


def inflated(stream) -> Iterator[bytes]:
    """The contents of a gzip file of one or more members, read as a stream."""
    unzip = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            yield unzip.decompress(data, CHUNK)
            while unzip.unconsumed_tail:
                yield unzip.decompress(unzip.unconsumed_tail, CHUNK)
            data = b""
            if unzip.eof:
                data, unzip = unzip.unused_data, zlib.decompressobj(31)


def normalise(spark, source: str, target: str, level: int = 3) -> DataFrame:
    """Rewrites every archive under ``source`` into ``target``; returns the index (archive, record_id, offset, length).

    Each archive's own part of the index is also written beside it, as ``<archive>.idx``.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path", "length")
    n = max(1, files.count())
    schema = "archive string, record_id string, offset long, length long"

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                _, folder = fs.FileSystem.from_uri(target)
                store.create_dir(folder, recursive=True)
                out_name = f"{folder}/{name.rsplit('/', 1)[1].split('.')[0]}.warc.gz"
                from pyspark import TaskContext

                own = f".{TaskContext.get().taskAttemptId()}"
                rows, at = [], 0
                with store.open_input_stream(name, compression=None) as stream, store.open_output_stream(out_name + own, compression=None) as out:
                    for record in split_records(inflated(stream)):
                        zipper = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = zipper.compress(record) + zipper.flush()
                        out.write(member)
                        head = record[: record.index(b"\r\n\r\n")]
                        rows.append((headers(head).get("warc-record-id"), at, len(member)))
                        at += len(member)
                with store.open_output_stream(out_name + ".idx" + own, compression=None) as out:
                    out.write("".join(f"{i or '-'}\t{o}\t{k}\n" for i, o, k in rows).encode())
                store.move(out_name + own, out_name)
                store.move(out_name + ".idx" + own, out_name + ".idx")
                uri = target.rstrip("/") + "/" + out_name.rsplit("/", 1)[1]
                for k in range(0, len(rows), 5000):
                    part = list(zip(*rows[k : k + 5000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([uri] * len(part[0])), pa.array(part[0], pa.string()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.int64())], names=["archive", "record_id", "offset", "length"])

    return files.select("path").repartition(n, "path").mapInArrow(run, schema)


def read_records(index: DataFrame, part_bytes: int = 8 << 20) -> DataFrame:
    """The records that the index names: headers and body, by seeking to each member; a task reads some ``part_bytes`` of the archives."""

    def run(batches):
        from pyarrow import fs

        opened, at = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(batch.column(k).to_pylist() for k in ("archive", "offset", "length")), strict=True):
                if archive != at:
                    if opened:
                        opened.close()
                    store, name = fs.FileSystem.from_uri(archive)
                    opened, at = store.open_input_file(name), archive
                opened.seek(offset)
                record = zlib.decompress(opened.read(length), 31)
                end = record.index(b"\r\n\r\n")
                head, body = headers(record[:end]), record[end + 4 : -4]
                payload = body[body.index(b"\r\n\r\n") + 4 :] if head["warc-type"] == "response" else None
                digest = hashlib.sha1(payload).digest() if payload is not None else bytes.fromhex(head["warc-payload-digest"][5:])
                refers = head.get("warc-refers-to")
                rows.append((page_of(head.get("warc-record-id")), len(payload) if payload is not None else int(head["x-payload-length"]), base64.b32encode(digest).decode(), head["warc-type"], page_of(refers), head.get("warc-target-uri"), payload))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])

    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, payload binary"
    size = index.agg(F.sum("length")).first()[0] or 0
    parts = max(index.sparkSession.sparkContext.defaultParallelism, -(-size // part_bytes))
    # the index is small and the archives are not: the number of parts follows the archives' bytes
    return index.repartition(parts, "archive", F.floor(F.col("offset") / (part_bytes // 4))).sortWithinPartitions("archive", "offset").mapInArrow(run, schema)


def archive(pages: DataFrame, least_bytes: int = 0) -> tuple[DataFrame, str]:
    """Writes, normalises; returns the index table and the folder of the normalised archives."""
    spark = pages.sparkSession
    mono, target = new_path(spark, "warc-mono"), new_path(spark, "warc")
    write_archives(with_types(pages, least_bytes), mono)
    return written(normalise(spark, mono, target), "warc-index"), target


def op9_warc(spark, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    index, _ = archive(pages)
    out = read_records(index)
    return out.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))

"""WARC archives written and read as chunked record tables.

A record's payload travels as rows (record, chunk number, bytes), each row with the
digest of the payload so far, so neither writing nor reading ever holds a whole
large payload. The digests of all records come first, in a pass of their own, and decide
what is a revisit. Archives are gzip members, one for each record, in one file for each
task, in a folder that all executors reach.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

#: Payload bytes in a row.
CHUNK = 1 << 20
#: Bytes of an archive fetched at a time.
FETCH = 1 << 20
#: No date but this: archives of the same rows are the same bytes.
DATE = "1970-01-01T00:00:00Z"

#: Payload bytes in an archive, about.
ARCHIVE = 256 << 20


def digest32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def numbered(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) as records (record, page_id, url, payload): each row has a number of its own; a null html is an empty payload.

    The numbers are those of rows in their partitions, so pages that aren't a scan of
    files are first written to the shared folder: every pass must number them alike.
    """
    p = common.steady(pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html")), "pages")
    return p.select(F.monotonically_increasing_id().alias("record"), "page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))


def chunked(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of records (record, page_id, url, payload): rows (record, page_id, url, chunk_no, last, data) of at most chunk bytes each, a record's in order; an empty payload has one empty row.

    Payloads are cut up where they are, so that nothing after this sees a whole one.
    """
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / chunk)).cast("int")
    rows = records.withColumn("n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk_no"))
    return rows.select("record", "page_id", "url", "chunk_no", (F.col("chunk_no") == F.col("n") - 1).alias("last"), F.expr(f"substring(payload, chunk_no * {chunk} + 1, {chunk})").alias("data"))


_HEAD = pa.schema([("record", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("bytes", pa.int64()), ("sha1", pa.binary()), ("check", pa.binary())])


def digested(chunks: DataFrame) -> DataFrame:
    """(record, page_id, url, bytes, sha1, check) of each record of a chunk table, by digests that run along its rows; check is another digest beside SHA-1."""

    def run(batches):
        sha, other, size = hashlib.sha1(), xxhash.xxh3_128(), 0
        for rb in batches:
            rows: list[tuple] = []
            for record, page_id, url, no, last, data in zip(*(rb.column(i).to_pylist() for i in range(6)), strict=True):
                if no == 0:
                    sha, other, size = hashlib.sha1(), xxhash.xxh3_128(), 0
                sha.update(data)
                other.update(data)
                size += len(data)
                if last:
                    rows.append((record, page_id, url, size, sha.digest(), other.digest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _HEAD, strict=True)], schema=_HEAD)

    return common.by_arrow(chunks.select("record", "page_id", "url", "chunk_no", "last", "data"), run, "record long, page_id long, url string, bytes long, sha1 binary, check binary")


def classified(heads: DataFrame, least_bytes: int = 0) -> DataFrame:
    """heads (record, page_id, url, bytes, sha1, check) with record_type and refers_to.

    Of records with equal payloads of at least least_bytes bytes the one with the
    smallest page_id is the response and the others are revisits of it; smaller payloads
    are all responses. Of rows that repeat that page_id with its payload the first is the
    response, and the others revisit it by the same id. A null page_id is never the
    smallest if there is another.

    Records are joined by digests alone, those of a payload with many copies in place.
    """
    heads = common.cut(heads)
    payload = ["sha1", "check", "bytes"]
    first = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "record"))
    groups = heads.where(F.col("bytes") >= least_bytes).groupBy(*payload).agg(first.alias("x"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    groups = groups.select(*payload, "copies", F.col("x.page_id").alias("first_id"), F.col("x.record").alias("first_record"))
    joined = common.join_unique(heads, groups, payload, "copies", heads.count())
    revisit = F.col("first_record").isNotNull() & (F.col("record") != F.col("first_record"))
    return joined.select(*heads.columns, F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def _line(value: str | None) -> str:
    """A header's value: line ends can't stand in it."""
    return (value or "").replace("\r", " ").replace("\n", " ")


def _head(page_id, url, kind, refers, length: int, sha1: bytes) -> bytes:
    block = b"" if kind == "revisit" else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    # a revisit has no payload of its own: its block is the response's head alone
    block = block or b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_line(url)}", f"X-Page-Id: {'' if page_id is None else page_id}", f"WARC-Payload-Digest: sha1:{digest32(sha1)}", f"X-Payload-Length: {length}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {'' if refers is None else refers}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {refers}')}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block) + (0 if kind == 'revisit' else length)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block


class _Record:
    """Writes one record as a gzip member, chunk by chunk; of a revisit the head alone."""

    def __init__(self, sink, head: bytes, bare: bool, size: int, sha1: bytes) -> None:
        self.sink, self.z, self.bare, self.size, self.sha1 = sink, zlib.compressobj(1, zlib.DEFLATED, 31), bare, size, sha1
        self.seen, self.digest = 0, hashlib.sha1()
        self._put(head)

    def _put(self, data: bytes) -> None:
        if x := self.z.compress(data):
            self.sink.write(x)

    def write(self, data: bytes) -> None:
        self.seen += len(data)
        self.digest.update(data)
        if not self.bare:
            self._put(data)

    def close(self) -> None:
        if self.seen != self.size or self.digest.digest() != self.sha1:
            raise RuntimeError("a payload isn't the one that its head was made for: the pages were numbered anew")
        self._put(b"\r\n\r\n")
        self.sink.write(self.z.flush())


def write(chunks: DataFrame, heads: DataFrame, folder: str) -> DataFrame:
    """Write a chunk table as archives in folder, with heads as classified has them; a row for each file: path, records.

    A record's head comes before its rows in the order of records and chunk numbers, so a
    task streams them into a gzip member as they come and holds one row at a time. The
    digest stands in the head, before the payload; the one that runs along the rows must
    agree with it in the end. A file gets its final name only once it is whole, by a name
    that depends on the task alone: a task that runs again writes the same file.
    """
    spark = heads.sparkSession
    size = heads.agg(F.sum("bytes")).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // ARCHIVE))
    none = lambda t: F.lit(None).cast(t)
    first = heads.select("record", F.lit(-1).alias("chunk_no"), "page_id", "url", "record_type", "refers_to", "sha1", "bytes", none("binary").alias("data"))
    rest = chunks.select("record", "chunk_no", none("long").alias("page_id"), none("string").alias("url"), none("string").alias("record_type"), none("long").alias("refers_to"), none("binary").alias("sha1"), none("long").alias("bytes"), "data")
    rows = first.unionByName(rest).repartition(n, "record").sortWithinPartitions("record", "chunk_no")

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        name, n = f"part-{task.partitionId():06d}.warc.gz", 0
        tmp = f"{path}/_{name}.{task.taskAttemptId()}"
        sink = member = None
        for rb in batches:
            for _, no, page_id, url, kind, refers, sha1, size, data in zip(*(rb.column(i).to_pylist() for i in range(9)), strict=True):
                if no < 0:
                    if member is not None:
                        member.close()
                    if sink is None:
                        sink = fs.open_output_stream(tmp)
                    member = _Record(sink, _head(page_id, url, kind, refers, size, sha1), kind == "revisit", size, sha1)
                    n += 1
                elif member is None:
                    raise RuntimeError("chunk rows without a head: the pages were numbered anew")
                else:
                    member.write(data)
        if sink is not None:
            member.close()
            sink.close()
            common.put_in_place(fs, tmp, f"{path}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], names=["path", "records"])

    return common.by_arrow(rows, run, "path string, records long")


class _Reader(io.RawIOBase):
    """The unfolded bytes of a file of gzip members, as they come."""

    def __init__(self, source) -> None:
        self.source, self.z, self.left = source, None, b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while True:
            if not self.left:
                self.left = self.source.read(FETCH)
                if not self.left:
                    return 0
            if self.z is None:
                self.z = zlib.decompressobj(31)
            out = self.z.decompress(self.left, len(into))
            self.left = self.z.unconsumed_tail
            if self.z.eof:
                self.left, self.z = self.z.unused_data, None
            if out:
                into[: len(out)] = out
                return len(out)


def parse(stream: io.BufferedReader, chunk: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of the records in an archive's bytes."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        head = _headers(stream)
        left = int(head["content-length"])
        http = b""
        while left and not http.endswith(b"\r\n\r\n"):
            more = stream.readline(min(left, 1 << 16))
            http, left = http + more, left - len(more)
        row = {"page_id": int(x) if (x := head.get("x-page-id")) else None, "url": head.get("warc-target-uri"), "record_type": head["warc-type"], "refers_to": int(x) if (x := head.get("x-refers-to-page")) else None, "stated_digest": head["warc-payload-digest"].partition(":")[2], "stated_bytes": int(head["x-payload-length"])}
        sha, k, total = hashlib.sha1(), 0, 0
        while True:
            data = stream.read(min(left, chunk))
            if len(data) < min(left, chunk):
                raise ValueError("the archive ends within a record")
            left -= len(data)
            total += len(data)
            sha.update(data)
            yield row | {"chunk_no": k, "data": data, "bytes_so_far": total, "digest_so_far": digest32(sha.digest()), "last": not left}
            k += 1
            if not left:
                break


def _headers(stream: io.BufferedReader) -> dict[str, str]:
    out = {}
    while (line := stream.readline()).strip():
        name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("stated_digest", pa.string()), ("stated_bytes", pa.int64()), ("chunk_no", pa.int64()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_())])


def read(files: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunk rows of the archives that files lists (path): a row for each chunk of each record.

    digest_so_far is the SHA-1 of the payload up to and with the row's chunk, in bare
    base32; the last row's is the payload's. Without with_data the bytes stay out.
    """

    def run(batches):
        for rb in batches:
            for uri in rb.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_stream(path, compression=None) as source:
                    yield from _batches(parse(io.BufferedReader(_Reader(source), 1 << 16)))

    def _batches(rows: Iterable[dict]):
        held, size = [], 0
        for r in rows:
            size += len(r["data"])
            held.append(r if with_data else r | {"data": None})
            if size >= 16 * CHUNK or len(held) >= 10_000:
                yield pa.RecordBatch.from_pylist(held, schema=_READ)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_READ)

    schema = "page_id long, url string, record_type string, refers_to long, stated_digest string, stated_bytes long, chunk_no long, data binary, bytes_so_far long, digest_so_far string, last boolean"
    return common.by_arrow(files.select("path"), run, schema)


def roundtrip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages as archives in the shared folder, read them back, and return a row for each record.

    payload_bytes and payload_digest are of the payload that was read; for a revisit,
    which carries none, they are those its head states.
    """
    folder = common.fresh_path(spark, "warc")
    chunks = chunked(numbered(pages))
    files = common.cut(write(chunks, common.cut(classified(digested(chunks), least_bytes)), folder))
    n = max(1, files.count())
    rows = read(files.repartition(n, "path"), with_data=False).where("last")
    whole = (F.col("record_type") == "revisit") | ((F.col("bytes_so_far") == F.col("stated_bytes")) & (F.col("digest_so_far") == F.col("stated_digest")))
    return rows.select(
        "page_id",
        F.when(F.col("record_type") == "revisit", F.col("stated_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(F.col("record_type") == "revisit", F.col("stated_digest")).otherwise(F.col("digest_so_far")).alias("payload_digest"),
        "record_type",
        "refers_to",
        whole.alias("intact"),
    )

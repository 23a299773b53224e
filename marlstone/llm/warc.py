"""WARC archives written and read as a chunked record table.

Pages are cut into (record, chunk number) rows of at most ``chunk`` bytes before they reach Python; each task streams its rows into
one .warc.gz file (one gzip member per record, digest carried from chunk to chunk and checked against the header), and the reader
streams a file back into chunk rows that carry the digest so far. No record is ever held whole by the writer or the reader.
Payloads that several records share (equal in length and SHA-256; the SHA-1 is printed only) are written once: the record with the
largest page_id is the response, the others revisit it.

Files are named after the task's attempt and only those in the manifest, a table written by the successful attempts, are read, so
lost executors and repeated attempts do no harm. They are opened through pyarrow.fs by the URI of the shared folder.

Defined results: null html is an empty payload; a null url writes no target; rows with a null page_id revisit the record with an id that
has their payload, and are responses if there is none; repeated rows are records of their own, with the same record id if they
repeat a page_id. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import join_hot, shared_path, stash

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"  # fixed, so that equal input gives equal files
_CHUNKS = "record_id string, page_id long, record_type string, refers_to long, chunk int, data binary, so_far long, digest string, last boolean"


def uri(spark: SparkSession, path: str) -> str:
    """Qualified as Hadoop does it, in the form that pyarrow reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _line(s: str) -> str:
    return s.replace("\r", "%0D").replace("\n", "%0A")


def head(row: dict, record_id: str) -> bytes:
    """WARC and HTTP header of a record; the payload follows for a response, nothing for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    revisit = row["response_id"] is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {_line(row['url'])}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{row['response_id']}>"]
    lines += [f"WARC-Payload-Digest: sha1:{base32(row['sha1'])}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else row['bytes'])}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _writes(folder: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"{path}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out = gz = digest = row = None
        records = 0

        def finish() -> None:
            if row is not None:
                if row["response_id"] is None and digest.hexdigest() != row["sha1"]:
                    raise ValueError(f"page {row['page_id']}: the payload written has another digest than the one read")
                out.write(gz.compress(b"\r\n\r\n") + gz.flush())

        for batch in it:
            for new in batch.to_pylist():
                if new["chunk"] == 0:
                    if out is None:
                        fs.create_dir(path, recursive=True)
                        out = fs.open_output_stream(name, compression=None)
                    finish()
                    row, digest, gz = new, hashlib.sha1(), zlib.compressobj(1, zlib.DEFLATED, 31)
                    unnamed = row["page_id"] is None or row["response_id"] is not None and row["page_id"] == row["response_id"]
                    record_id = f"urn:page:{row['page_id']}" if not unnamed else f"urn:page:none:{task.partitionId()}:{records}"
                    out.write(gz.compress(head(row, record_id)))
                    records += 1
                if row["response_id"] is None:
                    digest.update(new["data"])
                    out.write(gz.compress(new["data"]))
        if out is not None:
            finish()
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([records], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return run


class Stream:
    """Bytes of a file of gzip members, as they come: lines for headers, then counted bytes."""

    def __init__(self, raw, step: int = 1 << 16) -> None:
        self.raw, self.step, self.held, self.gz = raw, step, b"", zlib.decompressobj(31)

    def _more(self) -> bool:
        data = self.gz.unused_data if self.gz.eof else b""
        if self.gz.eof:
            self.gz = zlib.decompressobj(31)
        data = data or self.gz.unconsumed_tail or self.raw.read(self.step)
        if not data:
            return False
        self.held += self.gz.decompress(data, 4 * self.step)
        return True

    def line(self) -> bytes | None:
        while b"\r\n" not in self.held:
            if not self._more():
                return None
        line, _, self.held = self.held.partition(b"\r\n")
        return line

    def some(self, most: int) -> bytes:
        while not self.held:
            if not self._more():
                raise EOFError("the archive ends within a record")
        out, self.held = self.held[:most], self.held[most:]
        return out

    def fields(self) -> dict[str, str] | None:
        """First line under "", then the fields in lower case up to the empty line; blank lines before are skipped."""
        while (line := self.line()) == b"":
            pass
        if line is None:
            return None
        out = {"": line.decode()}
        while line := self.line():
            k, _, v = line.decode().partition(":")
            out[k.strip().lower()] = v.strip()
        return out


def chunks_of(raw, chunk: int, with_data: bool) -> Iterator[tuple]:
    """Chunk rows of one archive; every record has one row at least, the last is marked."""
    stream = Stream(raw)
    while (warc := stream.fields()) is not None:
        http = stream.fields()
        rid = warc["warc-record-id"].strip("<>")
        page = rid.split(":")[2]
        page_id = int(rid.split(":")[2]) if page != "none" else None
        size = int(http["content-length"])
        if warc["warc-type"] == "revisit":
            yield rid, page_id, "revisit", int(warc["warc-refers-to"].strip("<>").split(":")[2]), 0, None, size, warc["warc-payload-digest"].removeprefix("sha1:"), True
            continue
        digest, left, k = hashlib.sha1(), size, 0
        while True:
            parts, got = [], 0
            while got < min(chunk, left):
                parts.append(stream.some(min(chunk, left) - got))
                digest.update(parts[-1])
                got += len(parts[-1])
            left -= got
            so_far = base64.b32encode(digest.digest()).decode()
            if not left and "sha1:" + so_far != warc["warc-payload-digest"]:
                raise ValueError(f"{rid}: payload and digest differ")
            yield rid, page_id, "response", None, k, b"".join(parts) if with_data else None, size - left, so_far, not left
            k += 1
            if not left:
                break


def _reads(chunk: int, with_data: bool, folder: str):
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
    names = [x.split()[0] for x in _CHUNKS.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for files in it:
            for name in files.column("file").to_pylist():
                rows: list[tuple] = []
                with fs.open_input_stream(name, compression=None) as raw:
                    for row in chunks_of(raw, chunk, with_data):
                        rows.append(row)
                        if len(rows) == (64 if with_data else 4096):
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    return run


def write_warc(pages: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """Writes the archives into a new part of the shared folder; returns the manifest: file, records, bytes."""
    spark = pages.sparkSession
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), body.alias("body"), F.sha1(body).alias("sha1"), F.octet_length(body).cast("long").alias("bytes"), F.concat_ws(":", F.octet_length(body), F.sha2(body, 256)).alias("key"))
    groups = rows.groupBy("key").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    groups = stash(groups, "op8-groups")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = join_hot(rows, groups.where("n > 1"), "key", "n", total)
    known = known.withColumn("response_id", F.when(F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")))
    pieces = F.when(F.col("response_id").isNull(), F.greatest(F.lit(1), F.ceil(F.col("bytes") / chunk))).otherwise(1)
    cut = known.withColumn("chunk", F.explode(F.sequence(F.lit(0), (pieces - 1).cast("int"))))
    data = F.when(F.col("response_id").isNull(), F.substring("body", F.col("chunk") * chunk + 1, F.lit(chunk)))
    cut = cut.select("page_id", "url", "sha1", "bytes", "response_id", "chunk", data.alias("data"))
    folder = uri(spark, shared_path(spark, "warc"))
    return stash(cut.mapInArrow(_writes(folder), "file string, records long, bytes long"), "op8-manifest").withColumn("folder", F.lit(folder))


def read_warc(manifest: DataFrame, chunk: int = 1 << 16, with_data: bool = True) -> DataFrame:
    """Chunk rows of the archives: record_id, page_id, record_type, refers_to, chunk, data, so_far (bytes), digest (so far), last."""
    spark = manifest.sparkSession
    first = manifest.select("folder").first()
    if first is None:
        return spark.createDataFrame([], _CHUNKS)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file").repartition(tasks, "file").mapInArrow(_reads(chunk, with_data, first[0]), _CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record, from its last chunk."""
    return chunks.where("last").select("page_id", F.col("so_far").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")

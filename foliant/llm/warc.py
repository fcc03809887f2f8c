"""WARC: archives written as one gzip stream, normalised to a member per record with a sidecar index, and read back."""

from __future__ import annotations

import base64
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import cut, shared_dir, ship

LEAST, SALTS, CHUNK = 1000, 32, 1 << 20
#: Bytes of a written archive from which the task goes on in a new one.
ARCHIVE_BYTES = 1 << 30
DATE = "1970-01-01T00:00:00Z"


def _packed(payloads: pd.Series) -> pd.Series:
    pack = zstandard.ZstdCompressor(level=3).compress
    return payloads.map(lambda x: pack(x.encode("utf-8", "surrogatepass")))


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """page_id, url, payload (UTF-8, packed by Zstandard for the shuffle), payload_bytes, payload_digest (hex SHA-1), record_type, refers_to.

    Of equal payloads of ``least`` bytes or more the row with the largest page_id is the response and the
    others revisit it; smaller ones are all responses. Equal means of one SHA-256 digest; groups
    meet by (digest, salt) first and answer by it. Null payloads are empty; null ids are
    smaller than any other; rows that repeat the response's id are responses too.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1(F.col("payload").cast("binary")), "key": F.sha2("payload", 256), "salt": F.pmod(F.xxhash64("page_id"), F.lit(SALTS))})
    ship(pages.sparkSession)
    groups = (
        rows.where(F.col("payload_bytes") >= least).groupBy("key", "salt").agg(F.max("page_id").alias("keep"))
        .groupBy("key").agg(F.max("keep").alias("keep"), F.collect_set("salt").alias("salts")).select("key", "keep", F.explode("salts").alias("salt"))
    )
    revisit = ~F.col("page_id").eqNullSafe(F.col("keep")) & F.col("keep").isNotNull()
    return rows.withColumn("payload", F.pandas_udf(_packed, "binary")("payload")).join(groups, ["key", "salt"], "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("keep")).alias("refers_to"))


def _urn(page_id: int | None, place: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}' if page_id is not None else f'place:{place}')}>"


def _record(row: dict, place: str, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head and no payload."""
    payload = zstandard.ZstdDecompressor().decompress(row["payload"])
    again = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http if again else http + payload
    url = "".join(c if "!" <= c <= "~" else "".join(f"%{x:02X}" for x in c.encode("utf-8", "surrogatepass")) for c in row["url"] or "")
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_urn(row['page_id'], place)}", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(row['payload_digest'])).decode()}", f"WARC-Payload-Length: {row['payload_bytes']}", f"Content-Length: {len(block)}",
    ]
    if url:
        head.insert(4, f"WARC-Target-URI: {url}")
    if row["page_id"] is not None:
        head.append(f"WARC-Page-ID: {row['page_id']}")
    if again:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(row['refers_to'], '')}", f"WARC-Refers-To-Page-ID: {row['refers_to']}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(folder: str, date: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        task, made, out = TaskContext.get(), 0, None

        def finished() -> pa.RecordBatch:
            out.write(gz.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

        for b in batches:
            for row in b.to_pylist():
                if out is None:
                    path = f"{root}/whole-{task.partitionId():06d}-{task.taskAttemptId()}-{made:04d}.warc.gz"
                    out, gz, n, made = store.open_output_stream(path, compression=None), zlib.compressobj(6, zlib.DEFLATED, 31), 0, made + 1
                out.write(gz.compress(_record(row, f"{path}:{n}", date)))
                n += 1
                if out.tell() >= most:
                    yield finished()
                    out = None
        if out is not None:
            yield finished()

    return run


def write_whole(records: DataFrame, folder: str, date: str = DATE, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write planned records, each file one gzip stream; returns (path, records). Only files of tasks that succeeded are listed.

    A task writes one file, and a further one each time that a file has reached ``archive_bytes``, so an archive is
    larger than that by a record at most. No records make no file.
    """
    ship(records.sparkSession)
    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)
    return cut(records.mapInArrow(_write(folder, date, archive_bytes), "path string, records long"))


class _Inflated:
    """A gzip file of one or more members as one stream of bytes, held a chunk at a time."""

    def __init__(self, file):
        self.file, self.inflate, self.buffer, self.ended, self.begun = file, zlib.decompressobj(31), bytearray(), False, False

    def _more(self) -> bool:
        while not self.ended:
            raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail or self.file.read(CHUNK)
            if self.inflate.eof:
                raw = raw or self.file.read(CHUNK)
                self.inflate, self.begun = zlib.decompressobj(31), False
            if not raw:
                if self.begun:
                    raise ValueError("the archive ends before its gzip stream does")
                self.ended = True
                return False
            self.begun = True
            data = self.inflate.decompress(raw, CHUNK)
            if data:
                self.buffer += data
                return True
        return False

    def line_block(self, end: bytes) -> bytes | None:
        """Up to and with ``end``; None at the end of the stream."""
        seen = 0
        while (at := self.buffer.find(end, max(0, seen - len(end)))) < 0:
            seen = len(self.buffer)
            if not self._more():
                if self.buffer.strip():
                    raise ValueError("the archive ends within a record's header")
                return None
        out = bytes(self.buffer[: at + len(end)])
        del self.buffer[: at + len(end)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self._more():
                raise ValueError("the archive ends within a record")
            out = bytes(self.buffer[:n])
            del self.buffer[: len(out)]
            n -= len(out)
            yield out


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in raw.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)}


def _normalise(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        attempt = TaskContext.get().taskAttemptId()
        for b in batches:
            for path in b.column(0).to_pylist():
                stem = path.rsplit("/", 1)[-1].removesuffix(".warc.gz")
                target, rows, at = f"{root}/{stem}-{attempt}.warc.gz", [], 0
                with store.open_input_stream(path, compression=None) as file, store.open_output_stream(target, compression=None) as out, store.open_output_stream(f"{target}.cdxj", compression=None) as index:
                    stream = _Inflated(file)
                    while (head := stream.line_block(b"\r\n\r\n")) is not None:
                        named = _headers(head.lstrip(b"\r\n"))
                        gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                        out.write(gz.compress(head.lstrip(b"\r\n")))
                        for chunk in stream.take(int(named["content-length"]) + 4):
                            out.write(gz.compress(chunk))
                        out.write(gz.flush())
                        size = out.tell() - at
                        entry = {"id": named.get("warc-record-id", ""), "type": named.get("warc-type", ""), "uri": named.get("warc-target-uri"), "offset": at, "length": size}
                        index.write((json.dumps(entry) + "\n").encode())
                        rows.append((target, at, size, entry["id"], entry["type"]))
                        at += size
                        if len(rows) >= 10_000:
                            yield _index_rows(rows)
                            rows = []
                if rows:
                    yield _index_rows(rows)

    return run


def _index_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "offset", "length", "record_id", "record_type"])


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite archives (column path) that are one gzip stream as a member for each record; returns the index: path, offset, length, record_id, record_type.

    A stream is inflated once, a chunk at a time; beside each new archive a sidecar ``.cdxj`` has a line of
    JSON for each record. Archives of many members are taken as well, and one of no bytes has no records. A file that
    ends before its gzip stream, or before a record, stops the job with a ValueError. A file is read by one
    task, as a stream can't be entered half-way (write_whole bounds those that it makes). Null paths aren't allowed;
    a path that is listed twice is rewritten twice; other columns are ignored; no rows give no rows.
    """
    ship(archives.sparkSession)
    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)
    return cut(archives.select("path").mapInArrow(_normalise(folder), "path string, offset long, length long, record_id string, record_type string"))


_READ = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, path string, offset long"


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        opened, file = None, None
        number = lambda x: None if x is None else int(x)
        for b in batches:
            out, size = [], 0
            for path, offset, length in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if path != opened:
                    opened, file = path, store.open_input_file(path)
                file.seek(offset)
                head, _, block = zlib.decompress(file.read(length), 31).partition(b"\r\n\r\n")
                named = _headers(head)
                payload = block[: int(named["content-length"])].partition(b"\r\n\r\n")[2]
                digest = base64.b32decode(named["warc-payload-digest"].removeprefix("sha1:")).hex()
                out.append((number(named.get("warc-page-id")), named["warc-type"], number(named.get("warc-refers-to-page-id")), int(named["warc-payload-length"]), digest, payload, path, offset))
                size += len(payload)
                if size > 16 * CHUNK:
                    yield _pages(out)
                    out, size = [], 0
            if out:
                yield _pages(out)

    return run


def _pages(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _READ.split(", ")])


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The records that an index names, each inflated from its own member: page_id, record_type, refers_to, payload_bytes and payload_digest (of the full payload, as the headers have them), payload (none for revisits), path, offset.

    Rows that repeat are read as often as they come, in any order; a record without a page id has a null one; other columns are ignored; no rows give no rows."""
    ship(index.sparkSession)
    return index.select("path", "offset", "length").mapInArrow(_read(folder), _READ)


def archive_folder(spark, name: str) -> str:
    """A new folder for archives in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

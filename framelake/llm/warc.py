"""WARC archives: writing records from pages, and reading them back as a chunked record table.

Writing: a task streams its pages into one gzipped archive in the shared folder, a gzip member a record, payloads in chunks
of `chunk` bytes. A file belongs to an attempt; only the manifest rows of tasks that succeeded name it, so a lost
executor leaves at most an unread file. Equal payloads (by SHA-1 and length) of at least `least` bytes are stored once, by the
smallest page_id; the others are revisit records that refer to it.

Reading: an archive is decompressed piece by piece, and fails if it ends within a record or has not the number of records that the
manifest states. Each record becomes rows (record_id, chunk_no, data) with the byte
count and SHA-1 of the payload so far, so whoever reads the last chunk knows the digest and no record is ever held whole.
Revisit records have one empty chunk; their digest and length come from their headers.

Defined cases: null html is an empty payload; null urls are written as about:blank; rows without page_id are always
responses; rows that share the smallest page_id are all responses; an empty table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import column, keep, new_folder, table

CHUNK = 1 << 18
LEAST = 0
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, records long, bytes long"
CHUNKS = "record_id string, page_id long, url string, record_type string, refers_to long, stated_digest string, chunk_no int, data binary, last boolean, payload_bytes long, payload_digest string"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}"


def _open(uri: str, mode: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_output_stream(path, compression=None) if mode == "w" else store.open_input_stream(path, compression=None)


def plan(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, refers_to: null for responses."""
    sized = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    sized = sized.select("*", F.sha1(F.col("html").cast("binary")).alias("sha"), F.octet_length("html").alias("size"))
    firsts = sized.where(F.col("size") >= least).groupBy("sha", "size").agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id")).where("first_id < last_id")
    firsts = keep(firsts.select("sha", "size", "first_id"))
    joined = sized.join(firsts, ["sha", "size"], "left")
    return joined.select("page_id", "url", "html", F.when(F.col("first_id") < F.col("page_id"), F.col("first_id")).alias("refers_to"))


def _write(root: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, records, written = f"{root}/{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            ids, urls, refs, html = (column(batch, c) for c in ("page_id", "url", "refers_to", "html"))
            for k in range(batch.num_rows):
                if out is None:
                    out = _open(path, "w")
                payload = memoryview(html[k].as_buffer())
                page, refers = ids[k].as_py(), refs[k].as_py()
                digest = base32(hashlib.sha1(payload).digest())
                url = "".join(c if c.isprintable() and c != " " else "%20" for c in urls[k].as_py() or "about:blank")
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                body = len(payload) if refers is None else 0
                head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <{record_id(page, digest)}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + body}"]
                head += [f"X-Page-ID: {page}"] * (page is not None)
                if refers is not None:
                    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers, digest)}>", f"X-Refers-To-Page: {refers}"]
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                parts = [pack.compress("\r\n".join([*head, "", ""]).encode() + http)]
                for at in range(0, body, chunk):
                    parts.append(pack.compress(payload[at : at + chunk]))
                    if sum(map(len, parts)) >= chunk:
                        written += sum(out.write(p) for p in parts)
                        parts = []
                parts += [pack.compress(b"\r\n\r\n"), pack.flush()]
                written += sum(out.write(p) for p in parts)
                records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records]), pa.array([written])], ["path", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, root: str | None = None, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """Writes pages (page_id, url, html) and returns the manifest (path, records, bytes), one row an archive."""
    from pyarrow import fs

    root = root or new_folder(pages.sparkSession, "warc")
    store, path = fs.FileSystem.from_uri(root)
    store.create_dir(path, recursive=True)
    return keep(plan(pages, least).mapInArrow(_write(root, chunk), MANIFEST))


class Pieces:
    """Reads lines and bytes from a gzipped stream of many members, a piece at a time."""

    def __init__(self, stream, size: int):
        self.stream, self.size, self.held, self.raw, self.unpack, self.ended = stream, size, b"", b"", zlib.decompressobj(31), False
        #: Within a gzip member.
        self.torn = False

    def more(self) -> bool:
        while not self.ended:
            if not self.raw:
                self.raw = self.stream.read(self.size)
                if not self.raw:
                    self.ended = True
                    return False
            self.torn = True
            got = self.unpack.decompress(self.raw, self.size)
            self.raw = self.unpack.unconsumed_tail
            if self.unpack.eof:
                self.raw, self.unpack, self.torn = self.unpack.unused_data, zlib.decompressobj(31), False
            if got:
                self.held += got
                return True
        return False

    def line(self, needed: bool = True) -> bytes | None:
        """A line without its end; None at the end of the stream, which is an error where a line is needed."""
        while (at := self.held.find(b"\n")) < 0:
            if not self.more():
                if needed or self.held or self.torn:
                    raise ValueError("the archive ends within a record")
                return None
        line, self.held = self.held[:at], self.held[at + 1 :]
        return line.rstrip(b"\r")

    def upto(self, most: int) -> bytes:
        if not self.held and not self.more():
            raise ValueError("the archive ends within a record")
        while len(self.held) < most and self.more():
            pass
        part, self.held = self.held[:most], self.held[most:]
        return part


def records(stream, chunk: int) -> Iterator[tuple]:
    """Rows of CHUNKS."""
    source = Pieces(stream, chunk)
    while (line := source.line(needed=False)) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head: dict[str, str] = {}
        while line := source.line():
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        left, http = int(head["content-length"]), {}
        while line := source.line():
            left -= len(line) + 2
            name, _, value = line.decode().partition(":")
            http[name.strip().lower()] = value.strip()
        left -= 2
        kind = head["warc-type"]
        page, refers = head.get("x-page-id"), head.get("x-refers-to-page")
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        fixed = (head["warc-record-id"].strip("<>"), int(page) if page else None, head["warc-target-uri"], kind, int(refers) if refers else None, digest)
        if kind == "revisit":
            yield (*fixed, 0, b"", True, int(http["content-length"]), digest)
            continue
        running, done, k = hashlib.sha1(), 0, 0
        while True:
            data = source.upto(min(left, chunk)) if left else b""
            running.update(data)
            left -= len(data)
            done += len(data)
            yield (*fixed, k, data, not left, done, base32(running.digest()))
            k += 1
            if not left:
                break


def read_archives(manifest: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives that the manifest names. with_data: else `data` is null and only digests are made."""
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CHUNKS.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}[x.split()[1]] for x in CHUNKS.split(", ")]
        data_at = names.index("data")
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([None if k == data_at and not with_data else r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
        for batch in batches:
            for path, written in zip(column(batch, "path").to_pylist(), column(batch, "records").to_pylist(), strict=True):
                rows, size, complete = [], 0, 0
                with _open(path, "r") as stream:
                    for row in records(stream, chunk):
                        rows.append(row)
                        complete += row[data_at + 1]
                        size += len(row[data_at]) if with_data else 0
                        if size >= 16 * chunk or len(rows) >= 4096:
                            yield batch_of(rows)
                            rows, size = [], 0
                if complete != written:
                    raise ValueError(f"{path} holds {complete} records of {written}")
                if rows:
                    yield batch_of(rows)

    return manifest.select("path", "records").repartition(n).mapInArrow(run, CHUNKS)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    chunks = read_archives(write_archives(table(spark, sf_dir, "pages")))
    return chunks.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", (F.col("stated_digest") == F.col("payload_digest")).alias("digest_agrees"))


OP8_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha, octet_length(encode(coalesce(html, ''))) AS size FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha, size) AS first_id FROM p)
SELECT page_id, size::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(sha, (k // 4 * 5 + 1)::BIGINT, 5))::INT) >> (15 - 5 * (k % 4))::INT) & 31)::BIGINT + 1, 1)), '') AS payload_digest,
    CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first_id < page_id THEN first_id END AS refers_to, true AS digest_agrees
FROM f
"""

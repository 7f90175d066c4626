"""WARC archives: one gzip member per record, written by tasks, and a reader that splits files by byte ranges."""

from __future__ import annotations

import gzip
import uuid
import zlib
from collections.abc import Iterable, Iterator
from hashlib import sha256
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cut
from ..functions.lineage import shared_dir
from .common import hinted

MAGIC = b"\x1f\x8b\x08"
#: Payloads below this many bytes are always written out.
REVISIT_BYTES = 100
#: Bytes after which a task starts another file, and bytes of a file that one task reads.
FILE_BYTES, RANGE_BYTES = 256 << 20, 8 << 20
#: Tasks of a reading job; beyond that a task has several ranges.
MOST_TASKS = 50_000
#: Record ids: that of a row is percent-encoded; a row without one has none.
PAGE, NO_PAGE = "urn:page:", "urn:no-page"
_STEP = 1 << 16


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri("s3" + uri[3:] if uri.startswith("s3a:") else uri)


def _record(kind: str, record_id: str, date: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), *fields, ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 6, mtime=0)


def _page_record(page: str | None, url: str | None, payload: str, digest: str, size: int, refers_to: str | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    name = NO_PAGE if page is None else PAGE + quote(page, safe="")
    if refers_to is None:
        return _record("response", name, date, fields, http + payload.encode())
    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{PAGE}{quote(refers_to, safe='')}>")]
    return _record("revisit", name, date, fields, http)


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    date: str = "2000-01-01T00:00:00Z", file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write a record per row under `folder` and return the manifest: path, length, records.

    Of rows with equal payloads of at least REVISIT_BYTES, the one with the smallest id is a response and the others
    are revisits of it, which keep the HTTP head but no payload. Each task writes files of its own, named by task
    attempt, and reports them when they are closed; only reported files count, so what a lost or repeated task
    left behind is never read. The folder must be one that all executors share and pyarrow can open.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("bigint").alias("size"),
    )
    twice = (
        rows.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and first is not null").select("digest", "first")
    )
    refers = F.when(~F.col("page").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.col("first"))
    planned = rows.join(hinted(cut(twice)), "digest", "left").select(
        F.col("page").cast("string"), "url", "payload", "digest", "size", refers.cast("string").alias("refers_to")
    )
    _filesystem(folder)[0].create_dir(_filesystem(folder)[1], recursive=True)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        store, top = _filesystem(folder)
        task = TaskContext.get()
        done, out, length, count = [], None, 0, 0

        def close() -> None:
            out.close()
            done.append((f"{folder}/{name}", length, count))

        for part in parts:
            for row in zip(*part.columns):
                if out is None:
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(done)}.warc.gz"
                    out = store.open_output_stream(f"{top}/{name}", compression=None)
                    info = _record("warcinfo", f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}", date, [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(info)
                    length, count = len(info), 0
                data = _page_record(*(x.as_py() for x in row), date)
                out.write(data)
                length, count = length + len(data), count + 1
                if length >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        paths, lengths, counts = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(lengths, pa.int64()), pa.array(counts, pa.int64())], ["path", "length", "records"])

    return cut(planned.mapInArrow(run, "path string, length bigint, records bigint"))


class _Window:
    """The part of a file that is being looked at."""

    def __init__(self, file, size: int, at: int):
        self.file, self.size, self.base, self.data = file, size, at, b""
        file.seek(at)

    def more(self) -> bool:
        got = self.file.read(16 * _STEP)
        self.data += got
        return bool(got)

    def drop(self, before: int) -> None:
        if before - self.base > 64 * _STEP or before - self.base >= len(self.data):
            cut_at = min(before - self.base, len(self.data))
            self.data, self.base = self.data[cut_at:], self.base + cut_at

    def find(self, start: int, end: int) -> int:
        """The next place of the magic from `start` on, or -1 if there is none before `end`."""
        while True:
            at = self.data.find(MAGIC, max(0, start - self.base))
            if at >= 0:
                return self.base + at if self.base + at < end else -1
            start = max(start, self.base + len(self.data) - len(MAGIC) + 1)
            self.drop(start)
            if start >= end or not self.more():
                return -1

    def member(self, at: int, whole: bool = True) -> tuple[bytes, int] | None:
        """The record in the member that starts at `at`, and where the next begins; None if no WARC record starts here.

        Once the version line was seen, a member that can't be decoded, or has no end, is an error. With
        whole=False the version line is all that is looked at.
        """
        z, out, pos, known = zlib.decompressobj(31), bytearray(), at, False
        while not z.eof:
            while pos - self.base >= len(self.data):
                if not self.more():
                    if known:
                        raise ValueError(f"the record at {at} is cut off")
                    return None
            step = self.data[pos - self.base : pos - self.base + _STEP]
            try:
                out += z.decompress(step)
            except zlib.error as e:
                if known:
                    raise ValueError(f"the record at {at} is damaged") from e
                return None
            pos += len(step)
            if not known and len(out) >= 7:
                if not out.startswith(b"WARC/1."):
                    return None
                known = True
                if not whole:
                    return bytes(out), pos
        return (bytes(out), pos - len(z.unused_data)) if known else None


def records(file, size: int, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields and block of the records that start in [start, end); the last one may end beyond.

    The magic also turns up inside compressed data, so each find must decode to a WARC version line. (An
    archive stored uncompressed inside a record is the one thing this can't tell apart.)

    Records follow one another without a gap from the first byte to the last. Whoever reads a record makes sure that
    the next one begins where it ends, whoever owns that one, so a damaged record is an error wherever it is.
    """
    window, at = _Window(file, size, start), start
    at = window.find(at, end)
    while at >= 0 and (found := window.member(at)) is None:
        at = window.find(at + 1, end)
    headless = start == 0 and at != 0 and size > 0
    while at >= 0:
        raw, after = found
        head, _, rest = raw.partition(b"\r\n\r\n")
        pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
        fields = {k.strip().lower(): v.strip() for k, _, v in pairs}
        yield at, fields, rest[: int(fields.get("content-length", len(rest)))]
        if after >= size:
            break
        window.drop(after)
        found = window.member(after, whole=after < end)
        if found is None:
            raise ValueError(f"no record begins at {after}, where one ends")
        at = after if after < end else -1
    if headless:
        raise ValueError("no record begins at 0")


def read_archives(spark: SparkSession, files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A row per response or revisit record of the files (path, length): page, url, record_type, refers_to,
    payload_bytes, payload_digest, payload (null for revisits).

    A task reads ranges of `range_bytes`, whatever the files' sizes. It looks for gzip magic, checks candidates by
    decoding them, and owns the records that start inside its range. A payload that doesn't have its recorded
    digest, a damaged or cut-off record and bytes between records are errors (see `records`): nothing is skipped.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("bigint")))
    ranges = files.filter("length > 0").select("path", "length", starts.alias("start"))
    # a number of its own: the rows are tiny, and the adaptive planner would put them all into one task
    ranges = ranges.repartition(min(max(1, ranges.count()), MOST_TASKS), "path", "start")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                store, path = _filesystem(row["path"])
                rows, held = [], 0
                with store.open_input_file(path) as file:
                    for at, fields, block in records(file, row["length"], row["start"], row["start"] + range_bytes):
                        if fields.get("warc-type") in ("response", "revisit"):
                            rows.append(_row(row["path"], at, fields, block))
                            held += len(block)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("page", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    return ranges.mapInArrow(run, "page string, url string, record_type string, refers_to string, payload_bytes bigint, payload_digest string, payload binary")


def _row(path: str, at: int, fields: dict[str, str], block: bytes) -> dict:
    head, _, payload = block.partition(b"\r\n\r\n")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    http = dict(x.lower().split(": ", 1) for x in head.decode("latin-1").split("\r\n")[1:] if ": " in x)
    size = int(http.get("content-length", len(payload)))
    names = (fields.get(k, "").removeprefix("<").removesuffix(">") for k in ("warc-record-id", "warc-refers-to"))
    page, to = (unquote(n.removeprefix(PAGE)) if n.startswith(PAGE) else None for n in names)
    new = fields["warc-type"] == "response"
    if new and (len(payload) != size or sha256(payload).hexdigest() != digest):
        raise ValueError(f"{path} at {at}: the payload doesn't have its recorded length or digest")
    return {"page": page, "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "refers_to": to, "payload_bytes": size, "payload_digest": digest, "payload": payload if new else None}


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write `pages` as archives in the session's shared folder and read them back: id, payload_bytes,
    payload_digest, record_type, refers_to, url, payload.

    A null payload is empty. Equal rows, also in the id, with the smallest id are all responses; a row without an
    id revisits a group that has ids; a group without ids has responses only. A null url stays null. White space and
    control characters in urls come back percent-encoded. Other columns are not read; no rows in, no rows out.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(pages, folder, id_col, url_col, payload_col)
    kind = pages.schema[id_col].dataType
    return read_archives(spark, manifest).select(
        F.col("page").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "url", "payload"
    )

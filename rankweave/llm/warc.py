"""WARC archives: a writer, and a reader whose tasks each own a byte range.

Each record is a gzip member of its own. A reading task looks for gzip's magic
bytes in its range, validates a candidate by decoding its header and on until a
WARC version line shows, and owns the records that start inside the range; it
reads past the end to finish the last one. A match of the magic bytes inside
compressed data does not decode to a version line and is passed over.

A payload may itself hold an archive, stored so that its members stand in the
file as they are; a range that starts inside such a record takes them for
records. Each range therefore also tells where its first record starts and
where the one after its last does. Along a file these must meet; a range whose
first record is not where the ranges before it end is read again from there,
or has none, until all meet. The first range of a file starts with a record.

Archives are written and read by the executors in the session's shared folder,
each file under a temporary name first; a task that is run again keeps the file
that is there, which has the same records. Only the (path, bytes) of files, the
records and the ranges' ends go through Spark.

Defined cases: a null html is an empty payload, and an empty payload is one
like any other; a null url gives no target URI; of equal payloads the smallest
page_id is the response - also where several rows have that page_id - and rows
without page_id revisit it; if none of them has a page_id, all are responses; a
record of any length is read whole by one task; an empty table gives no
records; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankweave.llm.shared import scratch_path, table, written

MAGIC, VERSION, LINE = b"\x1f\x8b\x08", b"WARC/1.", b"\r\n"
#: Bytes of a reader's range, of a read, and of a step in which a candidate is decoded to validate it.
RANGE, CHUNK, STEP = 8 << 20, 1 << 20, 512
DATE = "2000-01-01T00:00:00Z"
ID = "urn:rankweave:page:"
#: Payloads of fewer bytes are never revisits.
LEAST_PAYLOAD = 0


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{ID}{page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(f"%{ord(c):02X}" if c in "\r\n\0 " else c for c in url)))
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<{ID}{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")]
    head += [("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("WARC-Payload-Length", str(len(payload)))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + LINE + block + LINE + LINE
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text) + packer.flush()


def parse(raw: bytes) -> dict:
    """Fields of a record's bytes."""
    head, _, rest = raw.partition(LINE + LINE)
    fields = {}
    for line in head.split(LINE)[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip().decode()
    block = rest[: int(fields[b"content-length"])]
    payload = block.partition(LINE + LINE)[2] if fields[b"warc-type"] == "response" else None
    return {"type": fields[b"warc-type"], "id": fields[b"warc-record-id"].strip("<>"), "uri": fields.get(b"warc-target-uri"), "refers_to": fields.get(b"warc-refers-to", "").strip("<>") or None, "digest": fields.get(b"warc-payload-digest", "").removeprefix("sha1:") or None, "length": int(fields.get(b"warc-payload-length", -1)), "payload": payload}


def _open(path: str):
    from pyarrow import fs

    scheme, mark, rest = path.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if mark and scheme in ("s3a", "s3n") else path)


class RangeReader:
    """The records of one file that start at start <= offset < end.

    begin: where the first of them is known to start, at or behind start;
    without it, it is sought. After records() has run, `first` is the start of
    the first record read and `exit` that of the one after the last, the file's
    size if there is none; both None if no record starts in the range.
    """

    def __init__(self, path: str, start: int, end: int, begin: int | None = None):
        self.path, self.start, self.end, self.begin = path, start, end, begin
        self.first: int | None = None
        self.exit: int | None = None

    def _more(self) -> bool:
        new = self.file.read_at(CHUNK, self.at + len(self.held))
        self.held += new
        return bool(new)

    def _starts_record(self, place: int) -> bool:
        """Whether a gzip header at place is followed by data that decodes to a WARC version line."""
        opener, told, fed = zlib.decompressobj(31), b"", place
        while len(told) < len(VERSION):
            if fed >= len(self.held) and not self._more():
                return False
            step = self.held[fed : fed + STEP]
            try:
                told += opener.decompress(step, 64)
            except zlib.error:
                return False
            if not VERSION.startswith(told[: len(VERSION)]) or (opener.eof and len(told) < len(VERSION)):
                return False
            fed += len(step)
        return True

    def _seek(self, stop: int | None) -> bool:
        """Moves to the next record's start, before stop if that is given."""
        place = 0
        while True:
            found = self.held.find(MAGIC, place)
            if found < 0:
                place = max(place, len(self.held) - len(MAGIC) + 1)
                if (stop is not None and self.at + place >= stop) or not self._more():
                    return False
                continue
            if stop is not None and self.at + found >= stop:
                return False
            if self._starts_record(found):
                self.held, self.at = self.held[found:], self.at + found
                return True
            place = found + 1

    def records(self) -> Iterator[tuple[int, bytes]]:
        """(offset, record) of every record."""
        system, name = _open(self.path)
        with system.open_input_file(name) as self.file:
            self.at = self.start if self.begin is None else self.begin
            self.held = self.file.read_at(max(0, min(CHUNK, self.end - self.at + STEP)), self.at)
            while self.at < self.end and self._seek(self.end if self.first is None else None):
                if self.first is not None and self.at >= self.end:
                    break
                if self.first is None:
                    self.first = self.at
                opener, parts, fed = zlib.decompressobj(31), [], 0
                while not opener.eof:
                    if fed >= len(self.held) and not self._more():
                        raise EOFError(f"{self.path}: the record at {self.at} is cut off")
                    parts.append(opener.decompress(self.held[fed:]))
                    fed = len(self.held)
                yield self.at, b"".join(parts)
                used = len(self.held) - len(opener.unused_data)
                self.held, self.at = self.held[used:], self.at + used
            if self.first is not None:
                self.exit = self.at if self.at >= self.end and self._seek(None) else None
                self.exit = self.at if self.exit is not None else system.get_file_info(name).size


def read_range(path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of every record that seems to start at start <= offset < end."""
    return RangeReader(path, start, end).records()


def write_archives(pages: DataFrame, folder: str, least_payload: int = LEAST_PAYLOAD) -> DataFrame:
    """Writes an archive per task into the folder; (path, bytes) of the files."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    named = written(rows.where(F.octet_length("html") >= least_payload).select("page_id", "digest"), "named")
    firsts = named.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    again = named.distinct().join(firsts, "digest").where("not page_id <=> first").where("first is not null")
    again = again.select(F.col("digest").alias("same"), F.col("page_id").alias("again"), F.col("first").cast("long").alias("refers_to"))
    # by page and digest, so that a payload of many pages is not one key; html meets only the pages that revisit
    revisits = (F.col("digest") == F.col("same")) & F.col("page_id").eqNullSafe(F.col("again"))
    rows = rows.join(written(again, "again"), revisits, "left").select("page_id", "url", F.col("html").cast("binary").alias("html"), "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        path = f"{folder}/part-{context.partitionId():06d}.warc.gz"
        system, name = _open(path)
        system.create_dir(name.rpartition("/")[0], recursive=True)
        draft, size = f"{name}.{context.taskAttemptId()}", 0
        with system.open_output_stream(draft) as out:
            for batch in batches:
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    size += out.write(record(page_id, url, html, refers_to))
        from pyarrow import fs

        there = system.get_file_info(name)
        if there.type == fs.FileType.File:  # of an attempt before this one
            size = there.size
            system.delete_file(draft)
        else:
            system.move(draft, name)
        yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size]})

    return written(rows.mapInArrow(write, "path string, bytes long"), "files")


RECORD = "path string, offset long, record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"
#: The range that a row is of; a row of its own has the file's size and the range's ends.
ENDS = "start long, range_bytes long, first long, exit long"


def read_archives(files: DataFrame, range_bytes: int = RANGE, with_payload: bool = True) -> DataFrame:
    """RECORD of every record in the archives (path, bytes).

    For a response, digest and length are those of the payload that was read,
    and must be those of its header; for a revisit they are the header's.
    """
    total = files.agg(F.sum(F.ceil(F.col("bytes") / range_bytes)).alias("n")).first().n or 0
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long")))
    ranges = files.where("bytes > 0").select("path", "bytes", starts.alias("start")).withColumn("begin", F.lit(None).cast("long"))
    schema = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in f"{RECORD}, {ENDS}".split(", ")])
    names = schema.names[: len(RECORD.split(", "))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start, begin in zip(*(c.to_pylist() for c in batch.columns)):
                rows, held = [], 0
                reader = RangeReader(path, start, min(size, start + range_bytes), begin)
                for offset, raw in reader.records():
                    own = parse(raw)
                    payload = own["payload"]
                    if payload is not None:
                        digest, length = base32_sha1(payload), len(payload)
                        if own["digest"] not in (None, digest) or own["length"] not in (-1, length):
                            raise ValueError(f"{path}: the payload of the record at {offset} is damaged")
                    else:
                        digest, length = own["digest"], own["length"]
                    row = (path, offset, own["id"], own["type"], own["uri"], digest, length, own["refers_to"], payload if with_payload else None)
                    rows.append(dict(zip(names, row)) | {"start": start})
                    held += len(raw)
                    if held > 4 * CHUNK:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                rows.append({"path": path, "start": start, "range_bytes": size, "first": reader.first, "exit": reader.exit})
                yield pa.RecordBatch.from_pylist(rows, schema)

    def run(some: DataFrame, n: int) -> DataFrame:
        return written(some.repartition(max(1, min(n, 20_000))).select("path", "bytes", "start", "begin").mapInArrow(read, f"{RECORD}, {ENDS}"), "records")

    found = run(ranges, int(total))
    while True:
        ahead = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        ends = found.where("range_bytes is not null").select("path", F.col("range_bytes").alias("bytes"), "start", "first", F.last("exit", ignorenulls=True).over(ahead).alias("begin"))
        inside = F.col("begin") < F.least(F.col("bytes"), F.col("start") + range_bytes)  # else no record starts in the range
        wanted = F.when(inside, F.greatest("begin", "start"))
        wrong = written(ends.where(F.col("begin").isNotNull() & ~F.col("first").eqNullSafe(wanted)).select("path", "bytes", "start", "begin"), "wrong")
        n = wrong.count()
        if not n:
            return found.where("range_bytes is null").select(names)
        found = written(found.join(wrong.select("path", "start"), ["path", "start"], "left_anti").select(found.columns).union(run(wrong, n)), "records")


def op2_warc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    page = lambda column: F.expr(f"try_cast(substring({column}, {len(ID) + 1}) AS bigint)")
    found = read_archives(files, with_payload=False)
    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, upper(sha1(html)) AS h FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 8), lambda k:
    list_aggregate(list_transform(range(0, 4), lambda j:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(h, 5 * k + 1, 5))::BIGINT >> (15 - 5 * j)) & 31) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM m
"""

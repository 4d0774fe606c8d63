"""WARC archives of captures, and their index by external merge of sorted runs.

Writing: each capture becomes a WARC/1.1 record, a gzip member of its own. Of equal payloads the one of the least id is a
response and the others are revisits that refer to it (identical payload digest; from `least` bytes on, smaller payloads are
always responses). Digests that repeat are looked up by a join (broadcast where they are counted to be few, else shuffled,
which Spark splits where one digest is hot); pages then move once, compressed and revisits without payload, to the task that
writes their file. Files hold about `file_bytes` of records, all kinds counted. Records go through Spark's own text writer, so
commits, retries and any file system that Spark knows work as for other tables: a member ends with the four bytes of its
size, of which the last is zero below 16 MiB, and this zero is the writer's line separator. A longer record is several
members in a row. A file begins with a warcinfo record, which has no key and so sorts first; its captures are sorted by URL
key and time.

Reading: files are read member by member; each response's payload digest is computed anew and must equal the record's. The
index rows of a file (no payloads) are sorted: a run. The runs are stored, and dealt out by ranges of (URL key, time, id)
taken from a sample, RANGE_ROWS rows to a range; each range merges its slices of all runs by a k-way loser tree, so the
ranges in order are one global capture history. A task holds one range. A URL with very many captures is split, as time and
id are part of the range.

Defined results: null html is an empty payload; a null url has an empty key; a null id is read back as null; repeated rows
with the least id of a payload are all responses; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit
from uuid import NAMESPACE_URL, UUID, uuid5

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from terraquill.llm.runtime import counted, lookup_join, new_folder, stored, tidy

EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc)
#: Bytes of records in a file, before compression, unless a caller wants other files; about those of a record without payload.
FILE_BYTES, HEAD_BYTES = 16 << 20, 640
#: Index rows that a task merges.
RANGE_ROWS = 200_000
#: Most bytes of a gzip member whose stated size ends with a zero byte.
MEMBER = (1 << 24) - 1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed, then path and query, all lower-case, without scheme, www or fragment."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return (url or "").lower()
    if not host:
        return (url or "").lower()
    host = host.removeprefix("www.")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return (key + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")).lower()


def digest(payload: bytes) -> str:
    """Base32 SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{UUID(int=0 if page_id is None else (1 << 64) + (page_id & (1 << 64) - 1))}>"


def page_of(text: str) -> int | None:
    n = UUID(text.strip("<>").removeprefix("urn:uuid:")).int
    if n < 1 << 64:
        return None
    n -= 1 << 64
    return n - (1 << 64) if n >= 1 << 63 else n


def _clean(value: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value or "")


def record(page_id: int | None, url: str | None, seconds: int, payload: bytes, payload_bytes: int, sha1: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    body = http if revisit else http + payload
    date = (EPOCH + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{sha1}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def information(name: str) -> bytes:
    """The record that begins a file."""
    body = b"software: terraquill\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid5(NAMESPACE_URL, name)}>", f"WARC-Date: {EPOCH:%Y-%m-%dT%H:%M:%SZ}"]
    return "\r\n".join([*head, "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def squeezed(data: bytes) -> bytes:
    """data as gzip members without the last byte, a zero that the writer adds."""
    return b"".join(gzip.compress(data[at : at + MEMBER], 6, mtime=0) for at in range(0, len(data), MEMBER))[:-1]


def members(data: bytes, step: int = 1 << 14) -> Iterator[tuple[int, int, bytes]]:
    """(offset, end, content) of the gzip members of a file."""
    at = 0
    while at < len(data):
        begin, out, one = at, [], zlib.decompressobj(31)
        while not one.eof:
            if at >= len(data):
                raise ValueError(f"a member that begins at byte {begin} and doesn't end")
            out.append(one.decompress(data[at : at + step]))
            at = min(at + step, len(data)) - len(one.unused_data)
        yield begin, at, b"".join(out)


def parse(data: bytes) -> Iterator[dict]:
    """The captures of a file: headers by lower-case name, payload, offset and length. Other records are passed over."""
    parts = members(data)
    for at, end, content in parts:
        split = content.index(b"\r\n\r\n")
        lines = content[:split].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict((k.lower(), v) for k, _, v in (x.partition(": ") for x in lines[1:]))
        size = split + 4 + int(head["content-length"])
        more = [content]
        while sum(map(len, more)) < size + 4:
            _, end, content = next(parts)
            more.append(content)
        content = b"".join(more)
        if content[size:] != b"\r\n\r\n":
            raise ValueError(f"a record that doesn't end at byte {end}")
        http, _, payload = content[split + 4 : size].partition(b"\r\n\r\n")
        if head["warc-type"] not in ("response", "revisit"):
            continue
        stated = next(int(x[16:]) for x in http.decode().split("\r\n") if x.lower().startswith("content-length: "))
        yield {"head": head, "payload": payload, "size": stated, "offset": at, "length": end - at}


def _payload(html: pa.Scalar) -> bytes:
    return (html.as_py() or "").encode()


def _facts(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, sha1) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [_payload(x) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in held], pa.int64()), pa.array([digest(x) for x in held], pa.string())], ["page_id", "payload_bytes", "sha1"])

    return pages.select("page_id", "html").mapInArrow(tidy(run), "page_id long, payload_bytes long, sha1 string")


def write(pages: DataFrame, path: str, least: int = 0, seconds: str = "seconds", file_bytes: int = FILE_BYTES) -> None:
    """Writes pages (page_id, url, html, seconds) as WARC files of about file_bytes below path."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), F.col(seconds).cast("long").alias("seconds"))
    each = F.when(F.col("payload_bytes") >= least, 1).otherwise(F.col("n"))
    sizes = [F.sum(F.col("payload_bytes") * each + F.col("n") * HEAD_BYTES).alias("total"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("again")]
    firsts, state = counted(_facts(pages).groupBy("sha1", "payload_bytes").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")), *sizes)
    total = state.total or 0
    files = max(1, -(-total // file_bytes), min(spark.sparkContext.defaultParallelism, total >> 20))
    own = lookup_join(_with_digest(pages), firsts.where("n > 1").drop("n"), ["sha1", "payload_bytes"], "left", rows=state.again or 0)
    own = own.withColumn("revisit", (F.col("payload_bytes") >= least) & F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull()))
    own = own.select("page_id", "url", "seconds", F.when(~F.col("revisit"), F.col("packed")).alias("packed"), "payload_bytes", "sha1", "first", "revisit")
    own = own.repartition(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            rows = batch.to_pylist()
            if rows and not begun:
                first = squeezed(information(f"{path}/{TaskContext.get().partitionId()}"))
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([first], pa.binary())], ["key", "seconds", "page_id", "value"])
                begun = True
            made = [squeezed(record(r["page_id"], r["url"], r["seconds"], _unpacked(r["packed"], r["payload_bytes"]), r["payload_bytes"], r["sha1"], r["first"], r["revisit"])) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([url_key(r["url"]) for r in rows], pa.string()), batch.column(2), batch.column(0), pa.array(made, pa.binary())], ["key", "seconds", "page_id", "value"])

    made = own.mapInArrow(tidy(run), "key string, seconds long, page_id long, value binary")
    made = made.sortWithinPartitions("key", "seconds", "page_id").select(F.col("value").cast("string").alias("value"))
    made.write.option("lineSep", "\0").text(path)


def _unpacked(packed: bytes | None, size: int) -> bytes:
    return pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True) if packed else b""


def _with_digest(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 3)
        for batch in batches:
            held = [_payload(x) for x in batch.column(2)]
            packed = pa.array([codec.compress(x, asbytes=True) if x else None for x in held], pa.binary())
            own = [batch.column(0), batch.column(1), packed, batch.column(3), pa.array([digest(x) for x in held], pa.string()), pa.array([len(x) for x in held], pa.int64())]
            yield pa.RecordBatch.from_arrays(own, ["page_id", "url", "packed", "seconds", "sha1", "payload_bytes"])

    return pages.mapInArrow(tidy(run), "page_id long, url string, packed binary, seconds long, sha1 string, payload_bytes long")


_INDEX = "key string, seconds long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long, run_pos long"


def _order(key: str | None, seconds: int | None, page_id: int | None) -> tuple:
    """Nulls come first, as in Spark's ranges."""
    return key is not None, key or "", seconds is not None, seconds or 0, page_id is not None, page_id or 0


def read(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of all records in WARC files below path, a sorted run for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _INDEX.split(", ")]
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for r in parse(content.as_buffer().to_pybytes()):
                    h = r["head"]
                    sha1 = h["warc-payload-digest"].removeprefix("sha1:")
                    revisit = h["warc-type"] == "revisit"
                    if not revisit and (digest(r["payload"]) != sha1 or len(r["payload"]) != r["size"]):
                        raise ValueError(f"payload and digest differ in {file} at {r['offset']}")
                    seconds = int((datetime.strptime(h["warc-date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc) - EPOCH).total_seconds())
                    refers = page_of(h["warc-refers-to"]) if revisit else None
                    rows.append((url_key(h.get("warc-target-uri")), seconds, page_of(h["warc-record-id"]), r["size"], sha1, h["warc-type"], refers, file, r["offset"], r["length"]))
                rows = [(*r, place) for place, r in enumerate(sorted(rows, key=lambda r: _order(*r[:3])))]
                if rows:
                    types = [pa.int64() if x.endswith(" long") else pa.string() for x in _INDEX.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(tidy(run), _INDEX)


class LoserTree:
    """K-way merge of sorted iterators: inner nodes hold the losers of their matches, so a new head plays log k matches."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.k = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = i
                return
            if self._beats(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.winner = i

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (head := self.heads[self.winner]) is not None:
            yield head
            self.heads[self.winner] = next(self.runs[self.winner], None)
            self._play(self.winner)


def merged(index: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The index with range_no and range_pos: in this order captures stand by URL key, time and id."""
    names = index.columns
    kinds = dict(index.dtypes)
    order = ["key", "seconds", "page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, runs, last = TaskContext.get().partitionId(), [], [], None
        at = 0
        for batch in batches:
            held.append(batch)
            for file, *key in zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ["file", *order])):
                if file != last:
                    runs.append([])
                    last = file
                runs[-1].append((_order(*key), at))
                at += 1
        places = [place for _, place in LoserTree(runs)]
        if places:
            out = pa.Table.from_batches(held).take(pa.array(places)).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array([number] * len(out), pa.int32()), pa.array(range(len(out)), pa.int64())], [*names, "range_no", "range_pos"])

    # In a range the slices of the runs stand one after the other, each in its run's own order.
    dealt = index.repartitionByRange(max(1, math.ceil(index.count() / range_rows)), *order).sortWithinPartitions("file", "run_pos")
    return dealt.mapInArrow(run, ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", range_no int, range_pos long")


def numbered(index: DataFrame) -> DataFrame:
    """The merged index with capture_no, the place of a capture among all: what lies before its range, and range_pos."""
    before = F.sum("n").over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1))
    # A row for each range, of RANGE_ROWS rows each: few, whatever the input.
    ranges = index.groupBy("range_no").agg(F.count(F.lit(1)).alias("n")).select("range_no", F.coalesce(before, F.lit(0)).alias("_before"))
    return index.join(F.broadcast(ranges), "range_no").withColumn("capture_no", F.col("_before") + F.col("range_pos")).drop("_before")


def archive(pages: DataFrame, least: int = 0, range_rows: int = RANGE_ROWS, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes pages as WARC files in the shared folder, reads them back, and returns a row per record in global order."""
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    seconds = F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(1 << 31)).alias("seconds")
    write(pages.select("page_id", "url", "html", seconds), path, least, file_bytes=file_bytes)
    index = numbered(stored(merged(stored(read(spark, path)), range_rows)))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("key").alias("url_key"), "seconds", "file", "offset", "length", "range_no", "range_pos", "capture_no")


#: For op5 with least = 0, on tables without repeated or null ids, and URLs with scheme and host, without user or port. The
#: digest's hex digits become bits, and five bits a character.
ORACLE_SQL = """
WITH urls AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#]+)', 1)), '^www\\.', '') AS host, regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q FROM pages),
keys AS (SELECT page_id, page_id & 2147483647 AS seconds, lower(array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END) AS url_key FROM urls),
captures AS (SELECT *, row_number() OVER (ORDER BY url_key, seconds, page_id) - 1 AS capture_no FROM keys),
payloads AS (SELECT page_id, encode(coalesce(html, '')) AS p FROM pages),
bits AS (SELECT page_id, octet_length(p) AS payload_bytes, p, array_to_string(list_transform(string_split(sha1(p), ''), lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', c)]), '') AS b FROM payloads),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY p) AS first FROM bits)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(b[5 * i + 1] AS INTEGER) + 8 * CAST(b[5 * i + 2] AS INTEGER) + 4 * CAST(b[5 * i + 3] AS INTEGER) + 2 * CAST(b[5 * i + 4] AS INTEGER) + CAST(b[5 * i + 5] AS INTEGER), 1)), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, url_key, seconds, capture_no FROM firsts JOIN captures USING (page_id)
"""

"""WARC records in ZIP archives: a writer, and a reader of central and ZIP64 directories that reads ranges only.

Each archive has two stored members: ``archive/data.warc.gz``, in which each record is a gzip member of its own, and
``indexes/index.cdxj``, with a line for each record that gives its range. The reader takes the end of the file, follows
it to the directory, finds where the stored members' bytes lie, and reads the index and then records by range; nothing is
extracted. The index is checked against its CRC in the directory, and records by their payloads' digests; the data
member's CRC isn't, as it's never read as a whole. A payload met before is written as a revisit record, without the
payload. An archive has ``ARCHIVE_BYTES`` or ``ARCHIVE_RECORDS`` at most (and one record at least), so that writer and
reader hold a bounded index. What reaches the driver is one row for each archive.

Defined cases: a null payload counts as empty; a payload is its bytes, valid UTF-8 or not; one larger than an archive's
bytes has an archive to itself and the rest before it; of rows with equal payloads those with the smallest id are
responses (several, if rows repeat) and others, null ids included, revisit it; if all their ids are null all are
responses; a null URL gives no target header, and bytes of one that aren't UTF-8 are replaced; an empty table gives no
archives; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.hot import join_unique, sieved
from linkweave.runtime import fresh_path, pick, settle, ship

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes and number of records after which a task begins another archive, and bytes read at once.
ARCHIVE_BYTES, ARCHIVE_RECORDS, READ_BYTES = 1 << 30, 200_000, 8 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, serial: str, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """A WARC/1.1 record; a revisit of ``refers_to``, with the HTTP head alone, if that's given."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}:{serial}>"),
        ("WARC-Date", DATE),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields.append(("Content-Length", str(len(block))))
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of a record; field names in lower case."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}, payload


class ArchiveWriter:
    """Writes records to a stream that need not seek; members have ZIP64 sizes."""

    def __init__(self, sink):
        self.zip = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index: list[bytes] = []
        self.bytes = 0

    def add(self, page_id, url: str | None, data: bytes) -> None:
        packed = gzip.compress(data, 5, mtime=0)
        self.index.append(json.dumps({"url": url, "page": page_id, "offset": self.bytes, "length": len(packed)}).encode() + b"\n")
        self.data.write(packed)
        self.bytes += len(packed)

    def close(self) -> None:
        self.data.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as out:
            for line in self.index:
                out.write(line)
        self.zip.close()


class Archive:
    """Range reads of stored members. ``read(offset, length)`` and ``size`` give the file."""

    def __init__(self, read, size: int):
        self.read = read
        tail_at = max(0, size - 65_557)  # the end record and the longest comment
        tail = read(tail_at, size - tail_at)
        at = tail.rfind(b"PK\5\6")
        # A comment may hold these bytes too: the end record is the one whose comment ends with the file.
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(b"PK\5\6", 0, at)
        if at < 0:
            raise ValueError("no end of a central directory")
        count, length, offset = struct.unpack_from("<HII", tail, at + 10)
        place = tail_at + at - 20
        locator = read(place, 20) if place >= 0 else b""
        if locator[:4] == b"PK\6\7":
            end = read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 end record where its locator points")
            count, length, offset = struct.unpack_from("<QQQ", end, 32)
        self.members: dict[str, tuple[int, int, int, int]] = {}
        entries, at = read(offset, length), 0
        for _ in range(count):
            sig, method, crc, packed, plain, n_name, n_extra, n_note, header = struct.unpack_from("<4s6xH4xIIIHHH8xI", entries, at)
            if sig != b"PK\1\2":
                raise ValueError("a broken central directory")
            at += 46
            name, extra = entries[at : at + n_name].decode(), entries[at + n_name : at + n_name + n_extra]
            at += n_name + n_extra + n_note
            while len(extra) >= 4:
                kind, n = struct.unpack_from("<HH", extra)
                if kind == 1:  # 64-bit values of those fields that are full, in this order
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                    plain = next(wide) if plain == 0xFFFFFFFF else plain
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    header = next(wide) if header == 0xFFFFFFFF else header
                extra = extra[4 + n :]
            self.members[name] = method, packed, header, crc

    def range_of(self, name: str) -> tuple[int, int]:
        """(offset, length) of a stored member's bytes in the file."""
        method, packed, header, _ = self.members[name]
        if method:
            raise ValueError(f"{name} isn't stored")
        local = self.read(header, 30)
        if local[:4] != b"PK\3\4":
            raise ValueError(f"no local header of {name}")
        n_name, n_extra = struct.unpack_from("<HH", local, 26)
        return header + 30 + n_name + n_extra, packed

    def index(self) -> Iterator[dict]:
        at, length = self.range_of(INDEX)
        held, crc = b"", 0
        for k in range(0, length, READ_BYTES):
            data = self.read(at + k, min(READ_BYTES, length - k))
            crc = zlib.crc32(data, crc)
            *lines, held = (held + data).split(b"\n")
            yield from map(json.loads, lines)
        if crc != self.members[INDEX][3]:
            raise ValueError(f"{INDEX} has another CRC than the directory says")

    def records(self, entries=None) -> Iterator[bytes]:
        """Records of index entries (all, by default), by range; ranges that follow each other are read at once."""
        base = self.range_of(DATA)[0]
        group: list[dict] = []
        for entry in self.index() if entries is None else entries:
            if group and (entry["offset"] != group[-1]["offset"] + group[-1]["length"] or entry["offset"] + entry["length"] - group[0]["offset"] > READ_BYTES):
                yield from self._group(base, group)
                group = []
            group.append(entry)
        if group:
            yield from self._group(base, group)

    def _group(self, base: int, group: list[dict]) -> Iterator[bytes]:
        start = group[0]["offset"]
        data = self.read(base + start, group[-1]["offset"] + group[-1]["length"] - start)
        for entry in group:
            at = entry["offset"] - start
            yield zlib.decompress(data[at : at + entry["length"]], 31)


def with_first(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html as bytes) with ``first``: the smallest id of rows with the same payload, where there are several.

    Only rows whose payload may be shared are moved, and those of very common payloads stay in place too.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html")).withColumn("sha1", F.sha1("html"))
    large = F.octet_length("html") >= least_bytes
    shared = rows.filter(large).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    shared = settle(shared, "shared-payloads")
    marked = sieved(rows, "sha1", shared)
    alone = marked.filter(~F.col("may")).select("page_id", "url", "html", F.lit(None).cast(dict(rows.dtypes)["page_id"]).alias("first"))
    return alone.unionByName(join_unique(marked.filter("may"), shared, "sha1", how="left").select("page_id", "url", "html", F.when(large, F.col("first")).alias("first")))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> list[str]:
    """Write archives below ``folder`` (a URI); their paths."""
    ship(pages.sparkSession)
    rows = with_first(pick(pages, page_id=id_col, url=url_col, html=html_col), least_bytes).withColumn("url", F.col("url").cast("binary"))

    def run(batches):
        context = TaskContext.get()
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        part, serial, files = context.partitionId(), 0, 0
        writer = sink = mine = None

        def done():
            writer.close()
            sink.close()
            name = f"{base}/part-{part:06d}-{files:04d}.zip"
            fs.move(mine, name)
            return pa.RecordBatch.from_pydict({"file": [name]})

        for batch in batches:
            for page, url, html, first in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if writer is None:
                    mine = f"{base}/.part-{part:06d}-{files:04d}.{context.taskAttemptId()}"
                    sink = fs.open_output_stream(mine)
                    writer = ArchiveWriter(sink)
                again = first if first is not None and page != first else None
                url = url.decode("utf-8", "replace") if url is not None else None
                writer.add(page, url, record(page, f"{part}-{serial}", url, html, again))
                serial += 1
                if writer.bytes >= ARCHIVE_BYTES or len(writer.index) >= ARCHIVE_RECORDS:
                    yield done()
                    writer, files = None, files + 1
        if writer is not None:
            yield done()

    return sorted(r.file for r in rows.mapInArrow(run, "file string").collect())


def read(spark, folder: str, files: list[str], id_type: str = "bigint") -> DataFrame:
    """Per record of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    The digest of a response is made from its payload again and must equal the header's.
    """
    ship(spark)
    table = spark.createDataFrame([(x,) for x in files], "file string")

    def number(urn: str | None) -> int | None:
        page = urn.split(":")[2].rstrip(">") if urn else ""
        return int(page) if page else None

    def run(batches):
        fs = pa.fs.FileSystem.from_uri(folder)[0]
        for batch in batches:
            for file in batch.column("file").to_pylist():
                with fs.open_input_file(file) as source:

                    def ranged(offset: int, length: int, source=source) -> bytes:
                        return source.read_at(length, offset)

                    rows: list[tuple] = []
                    held = 0
                    for data in Archive(ranged, source.size()).records():
                        fields, http, payload = parse(data)
                        said, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                        if kind == "response" and digest(payload) != said:
                            raise ValueError(f"{fields['warc-record-id']}: its payload has another digest")
                        rows.append((number(fields["warc-record-id"]), fields.get("warc-target-uri"), int(http["content-length"]), said, kind, number(fields.get("warc-refers-to")), payload if kind == "response" else None))
                        held += len(payload)
                        if held > READ_BYTES or len(rows) >= 10_000:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    return table.repartition(max(1, len(files))).mapInArrow(
        run, f"page_id {id_type}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {id_type}, payload binary"
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = fresh_path(spark, "warc")
    return read(spark, folder, write(pages, folder)).drop("payload", "url")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT x, min(page_id) AS first FROM p GROUP BY x)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + ((('0x' || substr(x, 1 + 5 * (k // 4), 5))::INTEGER >> (15 - 5 * (k % 4))::INTEGER) & 31)::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first OR first IS NULL THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (x)
"""

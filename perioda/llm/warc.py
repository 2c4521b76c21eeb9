"""Legacy archive converter: ARC files (versions 1 and 2) to WARC files, and the reader that takes them back.

Pages are written as ARC records, one gzip member each, into files of bounded size, where they are read. From the records'
digests alone, which are shuffled without payloads, it is decided which record of equal payloads stays a response. The converter
then streams each ARC file: it parses the header line by the fields that the file's version declares, takes the declared
length, and writes the WARC record with an identifier, a timestamp, a type and digests made from it. Files go to shared storage
under a temporary name first and are renamed when whole, so a task that is run again leaves one whole file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, new_folder, remove_folder, settle

# Fixed values of the formats: field names that an ARC file's second header line declares, by version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ROLL_BYTES = 64 << 20  # of records in a file
DATE = "20000101000000"  # of pages without one
LEVEL = 3
MANIFEST = "file string, n int, page_id long, payload_bytes long, payload_digest string"
RECORDS = "page_id long, url string, warc_date string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return file_system(folder)


class Archive:
    """A file of gzip members, renamed to its name when closed."""

    def __init__(self, folder: str, name: str) -> None:
        self.fs, base = _open(folder)
        self.fs.create_dir(base, recursive=True)
        self.final, self.name = f"{base}/{name}", name
        self.temp = f"{base}/.{name}.{uuid.uuid4().hex}"
        self.out, self.size, self.records = self.fs.open_output_stream(self.temp, compression=None), 0, 0

    def add(self, data: bytes) -> None:
        member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        self.out.write(member.compress(data) + member.flush())
        self.size += len(data)
        self.records += 1

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temp, self.final)


def read_members(folder: str, name: str) -> io.BufferedReader:
    fs, base = _open(folder)
    return io.BufferedReader(gzip.GzipFile(fileobj=fs.open_input_stream(f"{base}/{name}", compression=None)), 1 << 20)


def http_block(page_id: int | None, payload: bytes) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
    return head.encode() + (b"" if page_id is None else f"X-Page-Id: {page_id}\r\n".encode()) + b"\r\n" + payload


def arc_header(version: int, name: str) -> bytes:
    body = f"{version} 0 archive\n{ARC_FIELDS[version]}\n\n".encode()
    start = f"filedesc://{name} 0.0.0.0 {DATE} text/plain "
    return start.encode() + (b"" if version == 1 else f"200 - - 0 {name} ".encode()) + f"{len(body)}\n".encode() + body


def arc_record(version: int, name: str, offset: int, url: str | None, date: str, block: bytes) -> bytes:
    where = quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%~-._|")
    extra = "" if version == 1 else f"200 {base32_sha1(block)} - {offset} {name} "
    return f"\n{where} 0.0.0.0 {date} text/html {extra}{len(block)}\n".encode() + block


def arc_records(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, content) of each record of an ARC file; the version line and the declared field names rule the parsing."""
    first = stream.readline().split()
    declared = stream.read(int(first[-1])).decode().split("\n")
    version = int(declared[0].split()[0])
    names = declared[1].split() or ARC_FIELDS[version].split()
    while line := stream.readline():
        if not line.strip():
            continue
        values = line.decode("utf-8", "replace").rstrip("\n").split(" ")
        if len(values) != len(names):
            raise ValueError(f"ARC version {version} header has {len(values)} fields, {len(names)} are declared: {line[:200]!r}")
        fields = dict(zip(names, values))
        content = stream.read(size := int(fields["Archive-length"]))
        if len(content) != size:
            raise ValueError(f"ARC record ends after {len(content)} of {size} bytes")
        yield fields, content


def split_http(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    head, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
    return head + b"\r\n\r\n", payload, fields


def record_id(page_id: int | None, name: str, n: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}' if page_id is not None else f'{name}:{n}')}>"


def warc_record(fields: dict[str, str], block: bytes, identifier: str, refers_to: int | None, page_id: int | None, digest: str) -> bytes:
    d = fields["Archive-date"]
    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    head, payload, _ = split_http(block)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {identifier}", f"WARC-Date: {date}", f"WARC-Target-URI: {fields['URL']}",
             f"WARC-IP-Address: {fields['IP-address']}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        lines.append(f"WARC-Page-Id: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, '', 0)}", f"WARC-Refers-To-Page-Id: {refers_to}"]
    body = block if refers_to is None else head
    lines += [f"WARC-Block-Digest: sha1:{base32_sha1(body)}", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def warc_records(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:80]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").strip().partition(": ")
            fields[k] = v
        yield fields, stream.read(int(fields["Content-Length"]))


def write_arc(pages: DataFrame, folder: str, *, version: int = 1, key: str = "page_id", url: str = "url", html: str = "html", roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """ARC files of the pages in `folder`; returns the manifest (MANIFEST), settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, part, k = None, TaskContext.get().partitionId(), 0
        for b in batches:
            rows: list[tuple] = []
            for page_id, address, text in zip(*(c.to_pylist() for c in b.columns)):
                payload = (text or "").encode()
                if archive is None or archive.size > roll_bytes:
                    if archive:
                        archive.close()
                    archive = Archive(folder, f"pages-{part:06d}-{k:04d}.arc.gz")
                    archive.add(arc_header(version, archive.name))
                    k += 1
                rows.append((archive.name, archive.records, page_id, len(payload), base32_sha1(payload)))
                archive.add(arc_record(version, archive.name, archive.size, address, DATE, http_block(page_id, payload)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], names=["file", "n", "page_id", "payload_bytes", "payload_digest"])
        if archive:
            archive.close()

    return settle(pages.select(F.col(key).cast("long"), url, html).mapInArrow(run, MANIFEST), "arc-manifest")


def choose_responses(manifest: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """manifest with refers_to: of equal payloads of at least min_bytes, the largest page_id; null for it and for smaller payloads.

    Rows that tie on the largest page_id are all responses; rows of a null page_id refer to a numbered one if there is any.
    """
    own = manifest.where(F.col("payload_bytes") >= min_bytes)
    tops = own.groupBy("payload_digest").agg(F.max("page_id").alias("__top"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    tops = settle(tops, "warc-tops")  # written, so that AQE can split the join of a payload that very many pages share
    refers = F.when((F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("__top")), F.col("__top"))
    return manifest.join(tops, "payload_digest", "left").withColumn("refers_to", refers).drop("__top")


def convert(decided: DataFrame, arc: str, warc: str, files: int) -> DataFrame:
    """WARC files for the ARC files in `decided` (a group's rows are those of one file of bounded size); (file, records), settled."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["file"].iloc[0]
        refers = dict(zip(pdf["n"], pdf["refers_to"]))
        digests = dict(zip(pdf["n"], pdf["payload_digest"]))
        archive = Archive(warc, name.replace(".arc.gz", ".warc.gz"))
        archive.add(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: " + record_id(None, name, 0).encode() + b"\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
        with read_members(arc, name) as stream:
            for n, (fields, block) in enumerate(arc_records(stream), 1):
                _, payload, head = split_http(block)
                if (digest := base32_sha1(payload)) != digests[n]:
                    raise ValueError(f"{name}, record {n}: digest {digest}, expected {digests[n]}")
                page_id = int(head["X-Page-Id"]) if "X-Page-Id" in head else None
                to = None if pd.isna(refers[n]) else int(refers[n])
                archive.add(warc_record(fields, block, record_id(page_id, name, n), to, page_id, digest))
        archive.close()
        return pd.DataFrame({"file": [archive.name], "records": [archive.records]})

    own = decided.select("file", "n", "payload_digest", F.col("refers_to").cast("long")).repartition(files, "file")
    return settle(own.groupBy("file").applyInPandas(run, "file string, records int"), "warc-manifest")


def read_warc(files: DataFrame, folder: str, n_files: int, payloads: bool = False) -> DataFrame:
    """Records (RECORDS) of the named WARC files of a folder; payloads are checked against their digests; null unless asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        names = [x.split()[0] for x in RECORDS.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        for b in batches:
            for name in b.column(0).to_pylist():
                rows: list[tuple] = []
                with read_members(folder, name) as stream:
                    for f, block in warc_records(stream):
                        if f["WARC-Type"] not in ("response", "revisit"):
                            continue
                        _, payload, head = split_http(block)
                        digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                        if f["WARC-Type"] == "response" and (base32_sha1(payload) != digest or len(payload) != int(head["Content-Length"])):
                            raise ValueError(f"{name}: payload and digest differ in {f['WARC-Record-ID']}")
                        number = lambda k, f=f: int(f[k]) if k in f else None
                        rows.append((number("WARC-Page-Id"), f["WARC-Target-URI"], f["WARC-Date"], f["WARC-Record-ID"], f["WARC-Type"], int(head["Content-Length"]), digest, number("WARC-Refers-To-Page-Id"), payload if payloads and f["WARC-Type"] == "response" else None))
                        if len(rows) >= 1000:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    return files.select("file").repartition(n_files, "file").mapInArrow(run, RECORDS)


def archive_pages(spark: SparkSession, pages: DataFrame, *, folder: str | None = None, version: int = 1, min_bytes: int = 0, keep_arc: bool = False) -> DataFrame:
    """Pages through ARC and WARC files and back: the records read (RECORDS, without payloads).

    Null html is an empty payload, null url about:blank, null page_id stays null. Repeated rows are records of their own.
    Columns other than page_id, url and html are not read. An empty table writes no file and gives no record.
    """
    folder = folder or new_folder(spark, "archives")
    manifest = write_arc(pages, f"{folder}/arc", version=version)
    files = manifest.select("file").distinct().count()
    if not files:
        return spark.createDataFrame([], RECORDS)
    done = convert(choose_responses(manifest, min_bytes=min_bytes), f"{folder}/arc", f"{folder}/warc", files)
    if not keep_arc:
        remove_folder(spark, f"{folder}/arc")
    return read_warc(done, f"{folder}/warc", files)

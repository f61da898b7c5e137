"""WARC records inside ZIP packages: written as a cluster, read by byte ranges.

A package holds two stored (uncompressed) members: ``archive/data.warc.gz``, one gzip
member a record, and ``indexes/index.cdxj``, one line a record with its offset and
length. The reader takes the end of a package, follows the ZIP64 locator if there is
one, parses the central directory, finds where stored members begin, reads the index
and then ranges of whole records; nothing is extracted. A package without an index is
read from its archive member in one go, record by record.

Of records with equal payloads (SHA-1, MD5 and length agree) of at least
``min_bytes`` bytes, those of the largest page_id are responses and the others are
revisits that name it. Equal payloads are found from narrow rows; a payload that a
third of all pages share is counted before the shuffle, and the join that tells a
page its response is a plain equi-join, which adaptive execution splits.

Packages lie in the shared folder under names of their own for every task attempt;
the stored list of packages names those of the attempts that succeeded.

Defined cases: a null html is an empty payload; a null url has no header and reads
back as null; a null page_id has an empty record id and reads back as null, and
loses against every other id. Rows that repeat the largest page_id of a payload are all
responses. Line breaks in a url are percent-encoded. An empty table makes no package.
Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.scratch import scratch_path, write_scratch

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
MAX_PACKAGE_BYTES = 256 << 20
MAX_PACKAGE_RECORDS = 50_000
RANGE_BYTES = 2 << 20
PIECE_BYTES = 16 << 10
TASK_BYTES = 64 << 20
LOCATE_TASKS = 10_000
HADOOP_SCHEMES = {"s3a": "s3", "s3n": "s3"}
KEY = ("sha1", "md5", "n_bytes")

# Fixed values of the ZIP format.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, MAX_COMMENT, FULL32, FULL16 = 22, 65_535, 0xFFFFFFFF, 0xFFFF
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- writing


def typed_pages(
    pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(page_id, url, html, record_type, refers_to) of every page."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.col(url_col).alias("url"),
        payload.alias("html"),
        F.unhex(F.sha1(payload)).alias("sha1"),
        F.unhex(F.md5(payload)).alias("md5"),
        F.octet_length(payload).alias("n_bytes"),
    )
    groups = (
        rows.filter(F.col("n_bytes") >= min_bytes)
        .groupBy(*KEY)
        .agg(F.max("page_id").alias("response_id"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return rows.join(groups, list(KEY), "left").select(
        "page_id",
        "url",
        "html",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("response_id")).alias("refers_to"),
    )


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}",
        "Content-Type": "application/http; msgtype=response",
    }
    if url is not None:
        head["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": REVISIT_PROFILE}
    block = http if refers_to is not None else http + payload
    head["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def gzipped(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with its file system, as Spark resolves it, so that packages lie where tables of that name would."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path and its name there; the names that Hadoop has for object stores are known too."""
    scheme, sign, rest = path.partition("://")
    return arrow_fs.FileSystem.from_uri(f"{HADOOP_SCHEMES.get(scheme, scheme)}{sign}{rest}")


class _Package:
    """A package being written to a stream: records go straight through, index lines wait for the end."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.zip"
        files, path = file_system(self.path)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        self.stream = files.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.size, self.lines = 0, []

    def add(self, page_id, data: bytes) -> None:
        packed = gzipped(data)
        self.member.write(packed)
        self.lines.append(json.dumps({"id": page_id, "offset": self.size, "length": len(packed)}))
        self.size += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.lines))
        self.zip.close()
        self.stream.close()
        return self.path, len(self.lines), self.size


def write_packages(typed: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the records of ``typed`` pages into packages under ``folder``; the stored list (path, n_records, n_bytes)."""
    folder = folder or scratch_path(typed.sparkSession, "packages")
    folder = qualified(typed.sparkSession, folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        package = None
        for batch in batches:
            done = []
            for page_id, url, page, refers_to in zip(
                batch["page_id"], batch["url"], batch["html"], batch["refers_to"], strict=True
            ):
                package = package or _Package(folder)
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                package.add(page_id, record(page_id, url, page.encode("utf-8"), refers_to))
                if package.size >= MAX_PACKAGE_BYTES or len(package.lines) >= MAX_PACKAGE_RECORDS:
                    done.append(package.close())
                    package = None
            if done:
                yield pd.DataFrame(done, columns=["path", "n_records", "n_bytes"])
        if package:
            yield pd.DataFrame([package.close()], columns=["path", "n_records", "n_bytes"])

    rows = typed.select("page_id", "url", "html", "refers_to")
    return write_scratch(rows.mapInPandas(run, "path string, n_records bigint, n_bytes bigint"), "package-list")


# ---- reading


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int  # offset of the local header


def read_range(file, start: int, length: int) -> bytes:
    file.seek(start)
    data = file.read(length)
    if len(data) != length:
        raise ValueError(f"{length} bytes at {start}: the package ends after {len(data)}")
    return data


def central_directory(file, size: int) -> list[Member]:
    """The members of a package, from its end record and central directory."""
    tail_start = max(0, size - END_SIZE - MAX_COMMENT)
    tail = read_range(file, tail_start, size - tail_start)
    at = tail.rfind(END)
    while at >= 0 and at + END_SIZE + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("not a ZIP package: no end record")
    count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    locator_at = tail_start + at - 20
    if locator_at >= 0 and (locator := read_range(file, locator_at, 20))[:4] == LOCATOR64:
        end64 = read_range(file, int.from_bytes(locator[8:16], "little"), 56)
        if end64[:4] != END64:
            raise ValueError("the ZIP64 locator points to no end record")
        count, length, start = struct.unpack("<QQQ", end64[32:56])
    data, members, at = read_range(file, start, length), [], 0
    for _ in range(count):
        if data[at : at + 4] != CENTRAL:
            raise ValueError(f"broken central directory at {at}")
        method = int.from_bytes(data[at + 10 : at + 12], "little")
        packed, size_, n_name, n_extra, n_comment = struct.unpack("<IIHHH", data[at + 20 : at + 34])
        header = int.from_bytes(data[at + 42 : at + 46], "little")
        name = data[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
        extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
        size_, packed, header = _zip64(extra, size_, packed, header)
        members.append(Member(name, method, packed, header))
        at += 46 + n_name + n_extra + n_comment
    return members


def _zip64(extra: bytes, *values: int) -> list[int]:
    """Sizes and offset, each from the ZIP64 field where its 32 bits are full, in this order."""
    out, at = list(values), 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack("<HH", extra[at : at + 4])
        if kind == 1:
            field, used = extra[at + 4 : at + 4 + length], 0
            for i, value in enumerate(out):
                if value == FULL32:
                    out[i] = int.from_bytes(field[used : used + 8], "little")
                    used += 8
        at += 4 + length
    return out


def data_start(file, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is not stored")
    local = read_range(file, member.header, 30)
    if local[:4] != LOCAL:
        raise ValueError(f"{member.name}: no local header")
    n_name, n_extra = struct.unpack("<HH", local[26:30])
    return member.header + 30 + n_name + n_extra


def locate_records(packages: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, start, length, n_records): byte ranges of whole records in every package of ``packages`` (path).

    A range grows to ``range_bytes``, or to one record. Without an index, a package is one range with null n_records.
    """

    def ranges(path: str) -> Iterator[tuple[str, int, int, int | None]]:
        files, name = file_system(path)
        with files.open_input_file(name) as file:
            members = {m.name: m for m in central_directory(file, file.size())}
            for archive in (m for m in members.values() if m.name.endswith((".warc", ".warc.gz"))):
                base, index = data_start(file, archive), members.get(INDEX)
                if index is None or archive.name != ARCHIVE:
                    yield path, base, archive.size, None
                    continue
                start = end = n = 0
                for line in read_range(file, data_start(file, index), index.size).decode().splitlines():
                    entry = json.loads(line)
                    if n and (entry["offset"] != end or end + entry["length"] - start > range_bytes):
                        yield path, base + start, end - start, n
                        start, n = entry["offset"], 0
                    end, n = entry["offset"] + entry["length"], n + 1
                if n:
                    yield path, base + start, end - start, n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                frame = pd.DataFrame(ranges(path), columns=["path", "start", "length", "n_records"])
                yield frame.astype({"n_records": "Int64"})

    # a stated number of tasks, since rows of a path each are too small for the planner to keep apart
    listed = packages.select("path").repartition(max(1, min(packages.count(), LOCATE_TASKS)))
    return listed.mapInPandas(run, "path string, start bigint, length bigint, n_records bigint")


def records(data: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record in the chunks of a WARC, gzip members or plain.

    Gzip data is fed in small pieces, so what is left behind the end of a member is never copied at length.
    """
    text, parts, unpack, plain = bytearray(), [], None, None
    for chunk in data:
        if plain is None:
            plain = chunk[:2] != b"\x1f\x8b"
        if plain:
            text += chunk
            yield from _whole(text)
            continue
        for at in range(0, len(chunk), PIECE_BYTES):
            piece = chunk[at : at + PIECE_BYTES]
            while piece:
                unpack = unpack or zlib.decompressobj(31)
                parts.append(unpack.decompress(piece))
                piece = unpack.unused_data
                if unpack.eof:
                    text += b"".join(parts)
                    parts, unpack = [], None
                    yield from _whole(text)
    if text.strip() or parts:
        raise ValueError("the archive ends inside a record")


def _whole(text: bytearray) -> Iterator[tuple[dict[str, str], bytes]]:
    """The whole records at the front of ``text``, which are then taken off."""
    at = 0
    while (split := text.find(b"\r\n\r\n", at)) >= 0:
        head = text[at:split].decode("utf-8", "replace").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {head[0][:40]!r}")
        headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head[1:])}
        stop = split + 4 + int(headers["content-length"])
        if len(text) < stop + 4:
            break
        yield headers, bytes(text[split + 4 : stop])
        at = stop + 4
    del text[:at]


def _page_of(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def decoded(headers: dict[str, str], block: bytes) -> tuple:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload; a response's digest is verified."""
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.lower().split(": ", 1) for line in http.decode("utf-8", "replace").split("\r\n")[1:])
    digest, length = headers["warc-payload-digest"].removeprefix("sha1:"), int(fields["content-length"])
    kind = headers["warc-type"]
    if kind == "response" and (len(payload), base32_sha1(payload)) != (length, digest):
        raise ValueError(f"{headers['warc-record-id']}: the payload is not what its headers say")
    shown = payload if kind == "response" else None
    refers_to = _page_of(headers.get("warc-refers-to"))
    return _page_of(headers["warc-record-id"]), headers.get("warc-target-uri"), kind, refers_to, length, digest, shown


def read_records(located: DataFrame, with_payload: bool = True, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of the records in byte ranges.

    Ranges are dealt over all cores, and over more tasks from ``task_bytes`` of archive a task, whatever package they belong to. ``with_payload=False`` leaves the payload out.
    """
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    names = names if with_payload else names[:-1]

    def chunks(file, start: int, length: int) -> Iterator[bytes]:
        for at in range(start, start + length, RANGE_BYTES):
            yield read_range(file, at, min(RANGE_BYTES, start + length - at))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start, length, n in batch[["path", "start", "length", "n_records"]].itertuples(index=False):
                files, name = file_system(path)
                with files.open_input_file(name) as file:
                    rows, size, seen = [], 0, 0
                    for headers, block in records(chunks(file, start, length)):
                        rows.append(decoded(headers, block)[: len(names)])
                        size, seen = size + len(block), seen + 1
                        if size > RANGE_BYTES:
                            yield _frame(rows, names)
                            rows, size = [], 0
                    if not pd.isna(n) and seen != n:
                        raise ValueError(f"{path}: {seen} records where the index has {n}")
                    if rows:
                        yield _frame(rows, names)

    kinds = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"
    located = write_scratch(located, "ranges")
    total = located.agg(F.sum("length")).first()[0] or 0
    tasks = max(located.sparkSession.sparkContext.defaultParallelism, -(-total // task_bytes))
    dealt = located.repartition(tasks)  # dealt in turn, and a stated number is kept by the planner
    return dealt.mapInPandas(run, kinds + (", payload binary" if with_payload else ""))


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})


def packages_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A list of packages that came from elsewhere, as input of ``locate_records``."""
    return spark.createDataFrame([(p,) for p in paths], "path string")

import io
import struct
import zipfile

import pytest
from pyarrow import fs as arrow_fs
from pyspark.sql import functions as F

from corpuskiln.llm import zip_warc as Z
from corpuskiln.scratch import scratch_path

TYPE = "page_id bigint, url string, html string, sha1 string, n int, refers_to int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TYPE)


def brute(rows, least=0):
    best = {}
    for i, _, page in rows:
        if i is not None:
            best[page or ""] = max(best.get(page or "", i), i)
    out = []
    for i, url, page in rows:
        data = (page or "").encode()
        top = best.get(page or "") if len(data) >= least else i
        kind = "response" if top == i or top is None else "revisit"
        out.append((i, url, kind, top if kind == "revisit" else None, len(data), Z.base32_sha1(data)))
    return sorted(out, key=repr)


ROWS = [(i, f"http://a/{i}", f"<p>{i % 9}é" * (i % 5)) for i in range(60)] + [
    (100, None, None),
    (101, "u\r\nX: y", ""),
    (None, "n", "lone"),
    (None, "n", "<p>1é"),
    (59, "http://a/59", "<p>5é" * 4),
    (102, "long", "z" * 3_000_000),
]
CLEAN = [(i, u and u.replace("\r", "%0D").replace("\n", "%0A"), p) for i, u, p in ROWS]


def fields(rows):
    names = ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest")
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


def test_round_trip(spark):
    packages = Z.write_packages(Z.typed_pages(table(spark, ROWS).repartition(3)))
    located = Z.locate_records(packages, range_bytes=2_000)
    assert located.count() > packages.count()
    found = Z.read_records(located).collect()
    assert fields(found) == brute(CLEAN)
    payload = {r["page_id"]: bytes(r["payload"]) for r in found if r["record_type"] == "response" and r["page_id"]}
    assert payload[102] == b"z" * 3_000_000 and payload[101] == b""


def test_several_tasks_read(spark):
    packages = Z.write_packages(Z.typed_pages(table(spark, ROWS).repartition(3)))
    located = Z.locate_records(packages, range_bytes=500)
    found = Z.read_records(located, with_payload=False)
    tasks = found.groupBy(F.spark_partition_id()).count().count()
    assert tasks >= 4  # of 8 cores
    more = Z.read_records(located, with_payload=False, task_bytes=100)
    assert more.rdd.getNumPartitions() > 8 and fields(more.collect()) == brute(CLEAN)


def test_folders_lie_where_tables_would(spark):
    assert Z.qualified(spark, "/tmp/a") == "file:///tmp/a" == Z.qualified(spark, "file:/tmp/a")
    assert Z.file_system("file:///tmp/a")[1] == "/tmp/a"


def test_smaller_payloads_are_all_responses(spark):
    found = Z.read_records(Z.locate_records(Z.write_packages(Z.typed_pages(table(spark, ROWS), min_bytes=10))), False)
    assert fields(found.collect()) == brute(CLEAN, 10)


def test_empty_table(spark):
    packages = Z.write_packages(Z.typed_pages(table(spark, [])))
    assert packages.count() == 0
    assert Z.read_records(Z.locate_records(packages)).count() == 0


def own_package(data: bytes, name=Z.ARCHIVE, comment=b"", extra=()) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
        for other in extra:
            package.writestr(other, b"x" * 10)
        package.writestr(name, data)
        package.comment = comment
    return out.getvalue()


@pytest.mark.parametrize("packed", [True, False])
def test_foreign_package_without_an_index(spark, packed):
    record = [Z.record(i, f"u{i}", b"payload %d" % i, None) for i in range(5)]
    data = b"".join(Z.gzipped(r) if packed else r for r in record)
    content = own_package(data, "other/x.warc.gz" if packed else "other/x.warc", b"PK\x05\x06 a comment", ("a.txt", "b/c"))
    path = scratch_path(spark, "foreign") + ".zip"
    path = path if "://" in path else f"file://{path}"
    files, name = arrow_fs.FileSystem.from_uri(path)
    with files.open_output_stream(name) as out:
        out.write(content)
    found = Z.read_records(Z.locate_records(Z.packages_of(spark, [path]))).collect()
    assert sorted((r["page_id"], bytes(r["payload"])) for r in found) == [(i, b"payload %d" % i) for i in range(5)]


def test_zip64_directory():
    """A package whose 32-bit fields are all full, with the true values in ZIP64 records."""
    data, name = b"0123456789", b"archive/data.warc"
    local = struct.pack("<4sHHHHHIIIHH", Z.LOCAL, 45, 0, 0, 0, 0, 0, Z.FULL32, Z.FULL32, len(name), 20) + name
    local += struct.pack("<HHQQ", 1, 16, len(data), len(data))
    prefix = b"junk" * 5
    extra = struct.pack("<HHB", 9, 1, 7) + struct.pack("<HHQQQ", 1, 24, len(data), len(data), len(prefix))
    central = struct.pack("<4sHHHHHHIIIHHHHHII", Z.CENTRAL, 45, 45, 0, 0, 0, 0, 0, Z.FULL32, Z.FULL32, len(name), len(extra), 0, 0, 0, 0, Z.FULL32)
    central += name + extra
    at = len(prefix) + len(local) + len(data)
    end64 = struct.pack("<4sQHHIIQQQQ", Z.END64, 44, 45, 45, 0, 0, 1, 1, len(central), at)
    locator = struct.pack("<4sIQI", Z.LOCATOR64, 0, at + len(central), 1)
    end = struct.pack("<4sHHHHIIH", Z.END, 0, 0, Z.FULL16, Z.FULL16, Z.FULL32, Z.FULL32, 0)
    file = io.BytesIO(prefix + local + data + central + end64 + locator + end)
    (member,) = Z.central_directory(file, len(file.getvalue()))
    assert (member.name, member.size) == (name.decode(), len(data))
    assert Z.read_range(file, Z.data_start(file, member), member.size) == data


def test_broken_packages_and_records_are_errors():
    with pytest.raises(ValueError):
        Z.central_directory(io.BytesIO(b"x" * 50), 50)
    with pytest.raises(ValueError):
        list(Z.records(iter([Z.gzipped(Z.record(1, "u", b"abc", None))[:-9]])))
    headers, block = next(Z.records(iter([Z.record(1, "u", b"abc", None)])))
    with pytest.raises(ValueError):
        Z.decoded(headers, block.replace(b"abc", b"abd"))

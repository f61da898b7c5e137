"""Readers and writers on files."""

import pytest

from checks import derived
from corpuskiln.operators import clones
from corpuskiln.scratch import scratch_path
from corpuskiln.sources import readers, writers

REPORT = """<?xml version="1.0"?>
<report version="1">
 <check threshold="6">
  <set lineCount="8" fingerprint="f1">
   <block sourceFile="a.py" startLineNumber="1" endLineNumber="8"/>
   <block sourceFile="a.py" startLineNumber="20" endLineNumber="27"/>
  </set>
  <set lineCount="9" fingerprint="f1">
   <block sourceFile="a.py" startLineNumber="1" endLineNumber="9"/>
   <block sourceFile="b.py" startLineNumber="4" endLineNumber="12"/>
  </set>
  <set lineCount="6" fingerprint="f2"><block sourceFile="c.py" startLineNumber="1" endLineNumber="6"/></set>
  <summary duplicateFileCount="2" duplicateLineCount="30"/>
 </check>
</report>
"""

TRICKY = ['plain', 'quote " and, comma', "line\nbreak", "  spaces  ", "tab\t", "\\back\\", '""', "trail\n", "é中", '"\n"']


def test_xml_report(spark, tmp_path):
    path = tmp_path / "report.xml"
    path.write_text(REPORT)
    report = readers.scan_clone_report(spark, str(path))
    assert [(r.fingerprint, r.line_count, len(r.block)) for r in report.orderBy("ord").collect()] == [
        ("f1", 8, 2),
        ("f1", 9, 2),
        ("f2", 6, 1),
    ]
    reduced = clones.clone_report_reduce(report, "ord")
    assert [tuple(r) for r in reduced.collect()] == [("f1", 9)]
    out = str(tmp_path / "reduced")
    writers.sink_csv_tables(reduced, out, writers.REPORT_HEADERS)
    back = spark.read.option("header", True).csv(out)
    assert back.columns == ["fingerprint", "lineCount"] and back.count() == 1


def test_xml_summary(spark, tmp_path):
    path = tmp_path / "report.xml"
    path.write_text(REPORT)
    assert {tuple(r) for r in readers.scan_clone_summary(spark, str(path)).collect()} == {
        ("duplicateFileCount", "2"),
        ("duplicateLineCount", "30"),
    }
    empty = tmp_path / "empty.xml"
    empty.write_text("<check><set fingerprint='x' lineCount='1'/></check>")
    assert readers.scan_clone_summary(spark, str(empty)).count() == 0


@pytest.mark.parametrize("per_file", [2, 1000])
def test_csv_round_trip(spark, tmp_path, per_file):
    df = spark.createDataFrame(list(enumerate(TRICKY)), "id long, content string")
    path = str(tmp_path / "csv")
    writers.sink_csv(df.coalesce(1), path, samples_per_file=per_file)
    back = readers.scan_csv_shards(spark, path, df.schema)
    assert [r.content for r in back.orderBy("id").collect()] == TRICKY
    assert len(back.inputFiles()) == (5 if per_file == 2 else 1)


def test_csv_written_by_python(spark, tmp_path):
    import csv

    header = ["repo_name", "path", "copies", "size", "content", "license"]
    for shard in range(2):
        with open(tmp_path / f"{shard}.csv", "w", newline="", encoding="utf-8") as file:
            out = csv.writer(file, lineterminator="\n")
            out.writerow(header)
            out.writerows([[f"r{shard}", t, "1", "2", t, "mit"] for t in TRICKY])
    rows = readers.scan_csv_shards(spark, str(tmp_path / "*.csv")).collect()
    assert sorted(r.content for r in rows) == sorted(TRICKY * 2)
    assert all(r.content == r.path and r.license == "mit" for r in rows)


def test_jsonl_gz_round_trip(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(TRICKY + ["\r\n", " "])), "id long, content string").coalesce(1)
    path = str(tmp_path / "json")
    writers.sink_jsonl_gz(df, path, samples_per_file=5)
    back = readers.scan_jsonl(spark, [path], df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert len(back.inputFiles()) == 3 and all(f.endswith(".gz") for f in back.inputFiles())


def test_small_table_is_spread_and_large_is_not(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).coalesce(1).write.parquet(path)
    assert derived.spread(spark, path).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    limit = derived.ROW_GROUP_BYTES
    derived.ROW_GROUP_BYTES = 1
    try:
        assert derived.spread(spark, path).rdd.getNumPartitions() == 1
    finally:
        derived.ROW_GROUP_BYTES = limit


def test_large_report_is_read_in_pieces_in_order(spark):
    path = scratch_path(spark, "large-report")
    rows = [(f"f{i:05d}", i, 0, [(f"file{k}", k, k + 6) for k in range(12)]) for i in range(3000)]
    report = spark.createDataFrame(
        rows, "fingerprint string, line_count long, part int, block array<struct<source_file:string,start_line:long,end_line:long>>"
    )
    writers.sink_clone_report(report.coalesce(1), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        found = readers.scan_clone_report(spark, path)
        assert found.rdd.getNumPartitions() > 4
        got = found.orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.fingerprint, r.line_count) for r in got] == [(r[0], r[1]) for r in rows]
    assert all(len(r.block) == 12 for r in got)

"""Exact duplicates in a stream with an initial state and an end of its memory."""

import time

import pytest
from pyspark.sql import functions as F

from corpuskiln.functions.text import content_hash
from corpuskiln.operators.dedup import first_of_hash
from corpuskiln.scratch import scratch_path
from corpuskiln.streaming import known_hashes, streams

SCHEMA = "doc_id long, content string"


def arrive(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def folders(spark):
    return [scratch_path(spark, name) for name in ("arriving", "unseen", "state")]


def run(spark, folders, **options):
    path, out, state = folders
    rows = streams.read_stream(spark, path, spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)
    known_hashes.stream_exact_dedup_known(rows, out, state, **options).awaitTermination()
    return sorted(r.doc_id for r in spark.read.schema("doc_id long, hash string").parquet(out).collect())


def hashes(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "content string").select(content_hash(F.col("content")).alias("hash"))


def test_without_an_end_it_equals_the_batch(spark, folders):
    rows = [(i, f"text {i % 7}") for i in range(40)] + [(50, ""), (51, None), (52, " ")]
    for part in range(3):
        arrive(spark, folders[0], rows[part::3])
    found = run(spark, folders)
    df = spark.createDataFrame([(i, t or "") for i, t in rows], SCHEMA)
    assert len(found) == first_of_hash(df, "doc_id", "content").count() == 8


def test_known_hashes_never_pass_and_survive_a_restart(spark, folders):
    known = hashes(spark, ["old", "old", "older", None])
    arrive(spark, folders[0], [(1, "old"), (2, "new"), (3, "new")])
    first = run(spark, folders, known=known)
    assert len(first) == 1 and first[0] in (2, 3)
    arrive(spark, folders[0], [(4, "older"), (5, "new"), (6, "newer")])
    # a restarted query goes on from its checkpoint: hashes of the table and of earlier rows are both remembered
    assert run(spark, folders, known=known) == [*first, 6]


def test_a_hash_passes_again_after_its_end(spark, folders):
    arrive(spark, folders[0], [(1, "a"), (2, "a"), (3, "b")])
    first = run(spark, folders, known=hashes(spark, ["c"]), expiry_ms=1000)
    assert len(first) == 2 and first[1] == 3
    time.sleep(1.2)
    arrive(spark, folders[0], [(11, "a"), (12, "c"), (13, "d")])
    assert run(spark, folders, known=hashes(spark, ["c"]), expiry_ms=1000) == [*first, 11, 12, 13]


def test_a_long_end_keeps_the_hash(spark, folders):
    arrive(spark, folders[0], [(1, "a")])
    assert run(spark, folders, expiry_ms=3_600_000) == [1]
    arrive(spark, folders[0], [(2, "a"), (3, "b")])
    assert run(spark, folders, expiry_ms=3_600_000) == [1, 3]

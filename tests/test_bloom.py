"""The Bloom filter against the exact set."""

import re

import pytest
from pyspark.sql import functions as F

from corpuskiln.operators import clones
from corpuskiln.operators.bloom import bloom_filter, maybe_in
from corpuskiln.scratch import write_scratch


def keys(spark, start, n):
    return spark.range(start, start + n).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("window"))


@pytest.mark.parametrize("n, blocks, most", [(1_000, 1 << 14, 0.001), (40_000, 1 << 14, 0.02), (40_000, 64, 1.0)])
def test_no_key_is_lost_and_false_ones_are_few(spark, n, blocks, most):
    table = write_scratch(bloom_filter(keys(spark, 0, n), "window", blocks), "filter")
    assert table.count() <= blocks
    inside = maybe_in(keys(spark, 0, n), "window", table, blocks)
    assert inside.columns == ["window"] and inside.count() == n
    assert maybe_in(keys(spark, 10**6, 50_000), "window", table, blocks).count() <= most * 50_000


def test_no_keys_and_null_keys(spark):
    none = bloom_filter(keys(spark, 0, 0), "window")
    assert maybe_in(keys(spark, 0, 10), "window", none).count() == 0
    null = spark.createDataFrame([(None,)], "window binary")
    assert maybe_in(null, "window", bloom_filter(null, "window")).count() == 1


@pytest.fixture
def two_corpora(spark):
    rows = [("training", i, "\n".join(f"line {i} {k}" for k in range(12))) for i in range(300)]
    rows += [("generated", 0, rows[7][2]), ("generated", 1, "other\n" * 9)]
    return write_scratch(spark.createDataFrame(rows, "side string, file_id long, content string"), "corpora")


def test_only_hits_of_the_training_corpus_are_shuffled(spark, two_corpora):
    windows = clones.line_windows(two_corpora, "file_id", "content", 6, "side")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the exact join as for a large generated corpus
    try:
        found = clones._possible_windows(windows)
        rows = found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r["file_id"] for r in rows if not r["is_generated"]} == {7}
    assert len([r for r in rows if not r["is_generated"]]) == 7
    # the filter is met below the exchange of the exact join
    final = plan.split("Initial Plan")[0]
    assert re.search(r"SortMergeJoin \[window", final) and final.index("SortMergeJoin") < final.index("BroadcastHashJoin [_block")


@pytest.mark.parametrize("blocks", [1, 1 << 10])
def test_a_full_filter_gives_the_same_windows(spark, two_corpora, blocks):
    windows = clones.line_windows(two_corpora, "file_id", "content", 6, "side")
    rows = clones._possible_windows(windows, blocks).collect()
    assert len([r for r in rows if not r["is_generated"]]) == 7

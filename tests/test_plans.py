"""Physical plans: what reaches the scan, what is shuffled, which joins run."""

import re

import pytest
from pyspark.sql import functions as F

from checks import derived
from checks.queries import QUERIES
from corpuskiln.operators import clones, collection, dedup, filters, ngrams, ordering
from corpuskiln.scratch import scratch_path

SF_DIR = "/root/testdata/sf0.001"
# queries that run several jobs before they return
STORED = ("stream", "near_", "cluster", "duplicate_clusters", "clone", "scan_", "sink_", "memorization", "lsh", "jaccard", "annotate")


@pytest.fixture(scope="module")
def explain():
    def run(df, mode="simple"):
        from contextlib import redirect_stdout
        from io import StringIO

        out = StringIO()
        with redirect_stdout(out):
            df.explain(mode=mode)
        return out.getvalue()

    return run


@pytest.fixture(scope="module")
def docs(spark):
    path = scratch_path(spark, "docs")
    rows = derived.documents(spark, SF_DIR).select("doc_id", F.col("text").alias("content"), "lang", "source")
    rows.write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if not any(part in n for part in STORED)])
def test_no_cross_joins(spark, explain, name):
    plan = explain(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark, explain, stored_plans):
    tables = {
        "files": ("id string, repo_name string, path string, mode int", [("i", "r", "a.py", 1)]),
        "contents": ("id string, copies int, size int, content string, binary boolean, extra string", [("i", 1, 1, "x", False, "e")]),
        "licenses": ("repo_name string, license string, note string", [("r", "mit", "n")]),
    }
    stored = []
    for name, (schema, rows) in tables.items():
        path = scratch_path(spark, name)
        spark.createDataFrame(rows, schema).write.parquet(path)
        stored.append(spark.read.parquet(path))
    stored_plans.clear()
    plan = explain(collection.collect_sources(*stored), "formatted")
    assert any("StringEndsWith(path, .py)" in p or "StringEndsWith(path,.py)" in p for p in stored_plans)
    assert re.search(r"PushedFilters: \[[^\]]*(Not\(EqualTo\(binary,true\)\)|EqualTo\(binary,false\)|Not\(binary\))", plan)
    assert not any(re.search(r"ReadSchema: struct<[^>]*(mode|extra|note)", p) for p in [plan, *stored_plans])


def test_features_scan_reads_two_columns(docs, explain):
    plan = explain(filters.drop_reasons(docs), "formatted")
    # the texts, and the stored hashes
    read = set(re.findall(r"ReadSchema: struct<([^>]*)>", plan))
    assert read == {"doc_id:bigint,content:string", "_hash:string", "doc_id:bigint,_hash:string"}


def test_generated_windows_leave_training_windows_before_they_are_counted(spark, stored_plans):
    rows = [("training", i, "\n".join(f"line {i} {k}" for k in range(9))) for i in range(5)]
    rows.append(("generated", 0, rows[2][2]))
    both = spark.createDataFrame(rows, "side string, doc_id long, content string")
    found = clones.line_clones(both, side_col="side")
    assert {(r.side, r.file_id) for r in found.collect()} == {("training", 2), ("generated", 0)}
    reduced = next(p for p in stored_plans if "_wanted" in p.partition("== Physical Plan ==")[2])
    # the only aggregate is that of the filter's blocks
    assert set(re.findall(r"Aggregate\(keys=\[(\w+)", reduced.partition("== Physical Plan ==")[2])) <= {"_block", "_groupingexpression"}
    counted = next(p for p in stored_plans if "bool_or" in p)
    assert "SortAggregate" not in counted.partition("== Physical Plan ==")[2]


def test_heuristics_compute_features_once(docs, explain):
    plan = explain(filters.heuristic_filter(docs))
    assert plan.count("AS line_max") == 1 and re.search(r"Filter \(+isnull\(_reason", plan)
    assert not re.search(r"Filter .*split\(content", plan)


def test_split_moves_no_text(docs, explain):
    plan = explain(ordering.train_valid_split(docs, "doc_id"))
    main = [line for line in plan.splitlines() if not re.match(r"\s*:", line)]
    assert not any("Exchange" in line for line in main)
    assert not any("content" in line for line in plan.splitlines() if "Exchange" in line)


def test_first_of_hash_is_combined_before_the_shuffle(docs, explain):
    plan = explain(dedup.first_of_hash(docs, "doc_id", "content"))
    assert plan.index("functions=[min(doc_id") < plan.index("Exchange") < plan.index("partial_min")


def test_counts_are_combined_before_the_shuffle(docs, explain):
    plan = explain(ngrams.ngram_train(docs, "content"))
    assert plan.count("Exchange") == 1 and "partial_count" in plan and "PythonUDF" not in plan

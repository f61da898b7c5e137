"""Routing, exact duplicates and the heuristic filter."""

import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from corpuskiln.config import CleaningConfig, NearDupConfig
from corpuskiln.operators import clusters, collection, dedup, filters
from corpuskiln.operators.skew import join_hot_keys
from corpuskiln.plans.cleaning import clean_corpus
from corpuskiln.plans.collection import store_by_org

CODE = "import os\n\ndef f(a, b):\n    c = a\n    d = b\n    e = c\n    g = d\n    h = e + g\n    return h\n"


def test_owner_match_is_case_sensitive(spark):
    repos = ["google/x", "Google/x", "Azure/y", "azure/y", "fbsamples/z", "GoogleChrome/a/b", "other/q"]
    df = collection.org_route(spark.createDataFrame([(r,) for r in repos], "repo_name string"))
    assert {(r.repo_name, r.org) for r in df.collect()} == {
        ("google/x", "google"),
        ("Azure/y", "microsoft"),
        ("fbsamples/z", "facebook"),
        ("GoogleChrome/a/b", "google"),
    }
    assert [len(v) for v in collection.ORG_OWNERS.values()] == [32, 10, 5]


def test_owner_of_two_organisations_is_an_error(spark):
    with pytest.raises(ValueError):
        collection.owner_map(spark, {"a": ("x",), "b": ("x",)})


@pytest.mark.parametrize("hot_rows", [1, 2, 1000])
def test_collect_repeats_files_per_licence_with_hot_content(spark, hot_rows):
    files = spark.createDataFrame(
        [("c1", "r1", f"p{i}.py") for i in range(9)] + [("c2", "r2", "a.py"), ("c3", "r2", "b.txt"), ("c4", "r2", "d.py")],
        "id string, repo_name string, path string",
    )
    contents = spark.createDataFrame(
        [("c1", 9, 1, "x", False), ("c2", 1, 1, "y", False), ("c3", 1, 1, "z", False), ("c4", 1, 1, "b", True)],
        "id string, copies int, size int, content string, binary boolean",
    )
    licenses = spark.createDataFrame([("r1", "mit"), ("r2", "mit"), ("r2", "bsd")], "repo_name string, license string")
    rows = collection.collect_sources(files, contents, licenses, hot_rows=hot_rows).collect()
    assert len(rows) == 9 + 2
    assert {(r.path, r.license) for r in rows if r.repo_name == "r2"} == {("a.py", "mit"), ("a.py", "bsd")}


@pytest.mark.parametrize("hot_rows", [1, 7, 1000])
def test_join_hot_keys_equals_join(spark, hot_rows):
    rows = spark.range(500).withColumn("key", F.when(F.col("id") < 300, F.lit(0)).otherwise(F.col("id") % 50))
    per_key = rows.groupBy("key").agg(F.sum("id").alias("total"))
    got = join_hot_keys(rows, per_key, ["key"], "id", hot_rows)
    want = rows.join(per_key, "key")
    assert sorted(map(tuple, got.select("id", "key", "total").collect())) == sorted(
        map(tuple, want.select("id", "key", "total").collect())
    )


def test_first_copy_uses_up_the_hash(spark):
    # the first copy fails the line limit; its reflowed later copy is still a duplicate
    texts = [(1, "x" * 200), (2, "\n".join(["x" * 50] * 4)), (3, CODE)]
    df = spark.createDataFrame(texts, "doc_id long, content string")
    config = CleaningConfig(filter_proba=0.0)
    reasons = dict(filters.drop_reasons(df, config=config).collect())
    assert reasons == {1: "line_mean", 2: "duplicate", 3: None}
    assert [r.doc_id for r in filters.heuristic_filter(df, config=config).collect()] == [3]
    assert [r.doc_id for r in dedup.exact_dedup(df).orderBy("doc_id").collect()] == [1, 3]


def test_null_texts_are_copies(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x"), (4, "")], "doc_id bigint, content string")
    assert sorted(r["doc_id"] for r in dedup.exact_dedup(df).collect()) == [1, 3, 4]
    assert dedup.duplicate_fraction(df).first()["duplicate_fraction"] == 0.25


def test_default_rules_in_order(spark):
    texts = {
        1: "",
        2: "# auto-generated\n" + CODE,
        3: CODE + "#" + "x " * 600,
        4: ("x = '" + "y" * 150 + "'\n") * 5 + "for i in z: pass",
        5: CODE + "\n" + "-+-+-+" * 60 + "\n",
        6: "def f(): pass\n",
        7: CODE,
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, content string")
    reasons = dict(filters.drop_reasons(df, config=CleaningConfig(filter_proba=0.0)).collect())
    assert reasons == {1: "empty", 2: "autogenerated", 3: "line_max", 4: "line_mean", 5: "alpha_frac", 6: "few_assignments", 7: None}


def test_thinning_is_repeatable_and_independent(spark):
    df = spark.range(20000).withColumnRenamed("id", "doc_id").withColumn("flag", F.lit(True))
    once = filters.probabilistic_thin(df, "flag", "doc_id", "a")
    twice = filters.probabilistic_thin(once, "flag", "doc_id", "b")
    kept = {r.doc_id for r in once.collect()}
    assert kept == {r.doc_id for r in filters.probabilistic_thin(df.repartition(3), "flag", "doc_id", "a").collect()}
    assert abs(len(kept) / 20000 - 0.3) < 0.02
    assert abs(twice.count() / 20000 - 0.09) < 0.01


def test_report_counts_every_row(spark):
    df = spark.createDataFrame([(i, CODE if i % 2 else CODE + str(i)) for i in range(10)], "doc_id long, content string")
    reasons = filters.drop_reasons(df, config=CleaningConfig(filter_proba=0.0))
    report = {r.drop_reason: r.n_rows for r in filters.filter_report(reasons).collect()}
    assert report == {"kept": 6, "duplicate": 4}
    assert filters.filter_summary(reasons).first().asDict() == {
        "rows_loaded": 10,
        "duplicate_fraction": 0.4,
        "rows_filtered": 6,
    }


def test_counts_are_taken_in_the_pass_that_writes(spark, tmp_path, stored_plans):
    df = spark.createDataFrame([(i, CODE if i % 2 else CODE + str(i)) for i in range(10)], "doc_id long, content string")
    reasons = filters.drop_reasons(df, config=CleaningConfig(filter_proba=0.0))
    stored_plans.clear()
    counted = Observation("reasons")
    filters.observe_reasons(reasons, counted).write.parquet(str(tmp_path / "reasons"))
    assert filters.observed_report(counted) == {r.drop_reason: r.n_rows for r in filters.filter_report(reasons).collect()}
    assert filters.observed_summary(counted) == filters.filter_summary(reasons).first().asDict()
    assert len(stored_plans) == 1 and "CollectMetrics" in stored_plans[0]


def test_every_reason_is_counted(spark):
    rows = [(i, r) for i, r in enumerate([None, None, *filters.DROP_REASONS])]
    reasons = spark.createDataFrame(rows, "doc_id long, drop_reason string")
    counted = Observation()
    assert filters.observe_reasons(reasons, counted).count() == len(rows)
    assert filters.observed_report(counted) == {"kept": 2, **dict.fromkeys(filters.DROP_REASONS, 1)}
    none = Observation()
    filters.observe_reasons(reasons.limit(0), none).collect()
    assert filters.observed_report(none) == {}
    assert filters.observed_summary(none) == {"rows_loaded": 0, "duplicate_fraction": None, "rows_filtered": 0}


def test_reasons_are_counted_in_a_stream(spark, tmp_path):
    seen = {}

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event): ...

        def onQueryIdle(self, event): ...

        def onQueryProgress(self, event):
            row = event.progress.observedMetrics.get("reasons")
            for reason, n in (row.asDict() if row else {}).items():
                seen[reason] = seen.get(reason, 0) + n

        def onQueryTerminated(self, event):
            seen["done"] = 1

    listener = Listener()
    spark.streams.addListener(listener)
    try:
        spark.createDataFrame([(1, None), (2, "ratio"), (3, "ratio")], "doc_id long, drop_reason string").write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("doc_id long, drop_reason string").parquet(str(tmp_path / "in"))
        query = filters.observe_reasons(stream, "reasons").writeStream.format("noop").trigger(availableNow=True)
        query.option("checkpointLocation", str(tmp_path / "state")).start().awaitTermination()
        for _ in range(100):
            if "done" in seen:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert (seen["kept"], seen["ratio"], seen["empty"]) == (1, 2, 0)


def test_copies_are_counted_where_they_are_removed(spark):
    df = spark.createDataFrame([(i, "x") for i in range(6)], "doc_id long, content string")
    outcome = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 3), (4, 3, 4), (4, 4, 4)], "cluster_id long, id long, extreme_id long")
    counted = Observation()
    kept = clusters.observe_copies(df, outcome, counted)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {0, 1, 3, 4, 5}
    stats = clusters.near_dedup_stats(df, outcome).first().asDict()
    assert counted.get == {k: v for k, v in stats.items() if k != "n_clusters"}


def test_cleaning_plan_with_near_duplicates(spark):
    base = CODE + "\n".join(f"    word_{i} = {i}" for i in range(200))
    rows = [(1, base), (2, base + "\nlast = 1"), (3, base + " \n"), (4, CODE.replace("f(", "other("))]
    df = spark.createDataFrame(rows, "doc_id long, content string")
    result = clean_corpus(df, config=CleaningConfig(filter_proba=0.0), near=NearDupConfig())
    assert sorted(r.doc_id for r in result.rows.collect()) == [1, 4]
    assert result.stats.first().asDict() == {
        "original_rows": 3,
        "n_clusters": 1,
        "files_in_clusters": 2,
        "unique_files": 1,
        "rows_kept": 2,
    }
    assert clean_corpus(df, config=CleaningConfig(filter_proba=0.0)).rows.count() == 3


def test_store_by_org(spark, tmp_path):
    df = spark.createDataFrame([("google/a", 1048576), ("google/b", 1048576), ("facebook/c", 524288)], "repo_name string, size long")
    summary = store_by_org(collection.org_route(df), str(tmp_path / "out"))
    assert {tuple(r) for r in summary.collect()} == {("google", 2, 2.0), ("facebook", 1, 0.5)}
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"org=google", "org=facebook"}

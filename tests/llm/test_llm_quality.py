import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import ODD_TEXTS, documents, words
from pyspark.sql import functions as F

from corpuskiln.llm.quality import (
    COUNTS,
    RATIOS,
    IsolationForest,
    QualityConfig,
    drop_low_quality,
    judge,
    repeated_words,
    statistics,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    found = WORD.findall(text)
    windows = Counter(tuple(found[i : i + 3]) for i in range(len(found) - 2))
    covered = {i + k for i in range(len(found) - 2) if windows[tuple(found[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(found),
        sum(map(len, found)),
        len(re.findall(r"[#*$%&|<>]", text)),
        sum(x in lines[:i] for i, x in enumerate(lines)),
        len(covered),
    )


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab \n\t\x0b\x1c\x85 #<é"), st.characters(codec="utf-8")), max_size=120))
def test_counts_equal_brute_force(text):
    assert statistics(text)[:5] == brute(text)


def test_repeated_words_with_many_different_words():
    n = 3_000_000
    ids = np.arange(n)
    ids[-3:] = ids[:3]
    assert repeated_words(ids) == 6


def labelled(spark):
    rows = [(i, ". ".join(words(i * 31 + k, 12).capitalize() for k in range(12))) for i in range(500)]
    bad = [(1000 + i, " ".join(f"{w}###" if k % 2 else f"{w} |" for k, w in enumerate(words(9000 + i, 90).split()))) for i in range(60)]
    labels = [(i, 1, 0) for i, _ in rows[:250]] + [(i, 0, 0) for i, _ in bad[:30]]
    return rows, bad, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_unlabelled_rows_are_told_apart(spark):
    rows, bad, labels = labelled(spark)
    odd = [(5000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    found = judge(documents(spark, [*rows, *bad, *odd]), labels).collect()
    verdict = {r["doc_id"]: r for r in found}
    for i, text in [*rows, *bad, *odd]:
        counts = brute(text)
        assert tuple(verdict[i][c] for c in COUNTS) == counts
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert verdict[i]["base_failed"] == failed
        assert not (failed and verdict[i]["kept"])
    assert sum(verdict[i]["kept"] for i, _ in rows) >= 0.98 * len(rows)
    assert sum(verdict[i]["kept"] for i, _ in bad) <= 0.05 * len(bad)


def test_every_family_has_its_say(spark):
    """The labelled bad rows differ by symbols alone; capitals, long words and missing marks count all the same."""
    rows, bad, labels = labelled(spark)
    shout = [(2000 + i, ". ".join(words(7000 + i * 31 + k, 12).upper() for k in range(12))) for i in range(6)]
    long = [(3000 + i, ". ".join(words(8000 + i * 31 + k, 12).replace(" ", " lengthened").capitalize() for k in range(12))) for i in range(6)]
    marks = [(4000 + i, "!? ".join(words(6000 + i, 140).split())) for i in range(6)]
    kept = {r["doc_id"]: r["kept"] for r in judge(documents(spark, [*rows, *bad, *shout, *long, *marks]), labels).collect()}
    for odd in (shout, long, marks):
        assert not any(kept[i] for i, _ in odd)
    assert not any(kept[i] for i, _ in bad)
    assert sum(kept[i] for i, _ in rows) >= 0.98 * len(rows)


def test_stage_keeps_columns_and_empty_tables(spark):
    rows, bad, labels = labelled(spark)
    docs = documents(spark, [*rows, *bad, (None, "short")])
    kept = drop_low_quality(docs, labels)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert None not in ids and len(ids & {i for i, _ in rows}) >= 490
    assert judge(docs.limit(0), labels).count() == 0
    # without labels only the base rule rejects
    unlabelled = judge(docs, labels.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] for r in unlabelled)


def test_stage_removes_rows_not_ids(spark):
    rows, bad, labels = labelled(spark)
    clean = [(None, ". ".join(words(90_000 + i * 31 + k, 12).capitalize() for k in range(12))) for i in range(10)]
    docs = documents(spark, [*rows, *bad, *clean, (None, "short"), (None, None), (300, "short too")])
    kept = [(r["doc_id"], r["text"]) for r in drop_low_quality(docs, labels).collect()]
    assert sum(i is None for i, _ in kept) >= 9 and set(kept) <= {*rows, *bad, *clean}
    assert rows[300] in kept


def test_forest_paths_equal_a_walk():
    rnd = np.random.default_rng(2)
    rows = rnd.random((300, len(RATIOS)))
    config = QualityConfig(trees=20, sample=64)
    forest = IsolationForest(rows, config)
    scores = forest.score(rows)
    for k in (0, 17, 299):
        total = 0.0
        for tree in range(config.trees):
            node = 0
            while forest.feature[tree, node] >= 0:
                node = 2 * node + 1 + int(rows[k, forest.feature[tree, node]] > forest.value[tree, node])
            total += forest.path[tree, node]
        assert abs(scores[k] - 2 ** (-total / config.trees / forest.norm)) < 1e-12
    far = np.full((1, len(RATIOS)), 9.0)
    assert forest.score(far)[0] > np.quantile(scores, 0.9)


def test_stage_takes_columns_with_the_names_it_uses(spark):
    rows = [(i, words(i, 80)) for i in range(6)] + [(7, "short")]
    names = {c: F.lit(c) for c in ("__id", "__digest", "__row", "__own_id", "digest", "kept", "score", "scores")}
    docs = documents(spark, rows).withColumns(names)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    kept = drop_low_quality(docs, labels)
    assert kept.columns == docs.columns
    found = kept.collect()
    assert {r["doc_id"] for r in found} == set(range(6)) and all(r[c] == c for r in found for c in names)


def test_forest_with_a_box_sets_unseen_values_apart():
    """Rows that all agree in a column: only splits over the box can part another value from them."""
    rnd = np.random.default_rng(5)
    rows = np.column_stack([np.zeros(400), rnd.normal(size=(400, len(RATIOS) - 1))])
    odd = np.zeros((1, len(RATIOS)))
    odd[0, 0] = 3.0
    box = np.minimum(rows.min(0), odd[0]), np.maximum(rows.max(0), odd[0])
    config = QualityConfig()
    plain, boxed = IsolationForest(rows, config), IsolationForest(rows, config, box)
    assert boxed.score(odd)[0] > np.quantile(boxed.score(rows), 0.999)
    assert plain.score(odd)[0] < np.quantile(plain.score(rows), 0.5)


def test_labels_that_nothing_parts_reject_nothing(spark):
    rows, _, _ = labelled(spark)
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i, _ in rows], "doc_id bigint, quality int, toxic int")
    found = judge(documents(spark, rows), labels, QualityConfig(max_good_loss=0.0)).collect()
    gone = [r["doc_id"] for r in found if not r["kept"] and not r["base_failed"]]
    assert not [i for i in gone if i % 2]  # none of the good ones


def test_held_out_labels_are_found(spark):
    """Half of the labels set forest and threshold; the documents of the other half are judged as well."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = judge(docs, labels.filter("doc_id % 2 = 0")).filter("NOT base_failed").join(labels, "doc_id").filter("doc_id % 2 = 1")
    rates = {r["quality"]: r["kept"] for r in found.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rates[0] <= 0.05 and rates[1] >= 0.97

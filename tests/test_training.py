"""Metrics, n-gram models and streams."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuskiln.operators import metrics, ngrams
from corpuskiln.operators.collection import org_route, union_corpora
from corpuskiln.operators.dedup import first_of_hash
from corpuskiln.scratch import scratch_path
from corpuskiln.streaming import streams

ROWS = [
    (1, "a", "the cat sat on the mat"),
    (2, "a", "the cat"),
    (3, "b", "the dog sat"),
    (4, "b", "one"),
    (5, "c", ""),
    (6, "c", "cat sat on the dog on the mat"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(ROWS, "doc_id long, org string, content string")


def grams(rows, n):
    found = Counter()
    for _, _, text in rows:
        words = text.split()
        for i in range(len(words) - n + 1):
            found[(" ".join(words[i : i + n - 1]), words[i + n - 1])] += 1
    return found


def as_dict(df):
    return {(r.context, r.word): r[2] for r in df.collect()}


@pytest.mark.parametrize("n", [1, 2, 3])
def test_counts(corpus, n):
    assert as_dict(ngrams.ngram_train(corpus, "content", n)) == dict(grams(ROWS, n))


@pytest.mark.parametrize("n", [1, 2, 3])
def test_perplexity_of_a_model(spark, corpus, n):
    model = ngrams.ngram_train(corpus.filter("org <> 'c'"), "content", n)
    valid = corpus.filter("org = 'c'")
    got = ngrams.ngram_perplexity(model, valid, "content", n).first()
    counts = grams(ROWS[:4], n)
    contexts = Counter()
    for (context, _), c in counts.items():
        contexts[context] += c
    v = len({w for _, w in counts}) + 1
    logs = [math.log((counts[g] + 1) / (contexts[g[0]] + v)) for g in grams(ROWS[4:], n).elements()]
    assert got.n_tokens == len(logs)
    assert got.perplexity == pytest.approx(math.exp(-sum(logs) / len(logs)))


def test_federated_average(corpus):
    got = as_dict(ngrams.ngram_federated(corpus, "content", "org"))
    want = Counter()
    for org in "abc":
        rows = [r for r in ROWS if r[1] == org]
        counts = grams(rows, 2)
        for gram, c in counts.items():
            want[gram] += len(rows) * c / sum(counts.values()) / len(ROWS)
    assert got == pytest.approx(dict(want))
    assert sum(got.values()) == pytest.approx(1)


def test_incremental_equals_centralised(corpus):
    state = ngrams.ngram_incremental(corpus, "content", "org", ["b", "a", "c"])
    assert {(r.context, r.word): r.n for r in state.collect()} == dict(grams(ROWS, 2))
    assert state.filter("context = 'the' and word = 'cat'").first().first_step == 2


def test_loss_and_perplexity(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "seq_id long, loss double")
    assert metrics.perplexity(df).first().loss == 4.5
    # batches 0..2 of two sequences
    assert metrics.perplexity(df, batch_size=2, max_eval_steps=2).first().loss == 2.5
    assert metrics.perplexity(df.select("seq_id", F.lit(1e6).alias("loss"))).first().perplexity == math.inf


def test_weighted_means(spark):
    clients = spark.createDataFrame([(1, 10.0), (3, 2.0)], "num_examples int, perplexity double")
    assert metrics.weighted_metric(clients).first().perplexity == 4.0
    vectors = spark.createDataFrame([("k", [1.0, 0.0], 1), ("k", [5.0, 4.0], 3), ("m", [2.0, 2.0], 9)], "key string, v array<double>, n int")
    got = {r.key: r.v for r in metrics.weighted_vector_mean(vectors, "key", "v", "n").collect()}
    assert got == {"k": [4.0, 3.0], "m": [2.0, 2.0]}


def test_union_keeps_duplicates(corpus):
    assert union_corpora(corpus, corpus, corpus.select("content", "org", "doc_id")).count() == 18


@pytest.fixture(scope="module")
def arriving(spark):
    """The corpus as several files, with copies across files."""
    path = scratch_path(spark, "arriving")
    rows = [(i, f"{'abc'[i % 3]}/r", ROWS[i % 6][2] + (" \n" if i % 2 else "")) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, repo_name string, content string")
    df.repartition(6).write.parquet(path)
    return path, df


def test_streamed_routing_equals_batch(spark, arriving):
    path, df = arriving
    owners = {"x": ("a",), "y": ("b",)}
    out = scratch_path(spark, "routed")
    rows = streams.read_stream(spark, path, df.schema, files_per_trigger=2)
    streams.stream_org_route(rows, out, scratch_path(spark, "state"), owners).awaitTermination()
    got = spark.read.parquet(out)
    assert {(r.doc_id, r.org) for r in got.collect()} == {(r.doc_id, r.org) for r in org_route(df, owners).collect()}


def test_streamed_dedup_equals_batch(spark, arriving):
    path, df = arriving
    out = scratch_path(spark, "first")
    rows = streams.read_stream(spark, path, df.schema, files_per_trigger=1)
    streams.stream_exact_dedup(rows, out, scratch_path(spark, "state")).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == got.select("hash").distinct().count() == first_of_hash(df, "doc_id", "content").count()


def test_streamed_counts_equal_batch(spark, arriving):
    path, df = arriving
    out = scratch_path(spark, "model")
    rows = streams.read_stream(spark, path, df.schema, files_per_trigger=2)
    state = scratch_path(spark, "state")
    counts = as_dict(ngrams.ngram_train(df, "content"))
    for compact_every in (2, 2, 100):  # the second and third start find no new file
        streams.stream_ngram_train(rows, "content", out, state, compact_every=compact_every).awaitTermination()
        assert {(r.context, r.word): r.n for r in streams.latest_model(spark, out).collect()} == counts
    df.write.mode("append").parquet(path)
    streams.stream_ngram_train(rows, "content", out, state, compact_every=2).awaitTermination()
    twice = {(r.context, r.word): r.n for r in streams.latest_model(spark, out).collect()}
    assert twice == {key: 2 * n for key, n in counts.items()}


def test_incremental_counts_group_once(corpus):
    state = ngrams.ngram_incremental(corpus, "content", "org", ["a", "b", "a"])
    plan = state._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_ngrams_are_counted_in_slices_of_text(spark, corpus, monkeypatch):
    copies = spark.range(64).select("id", F.lit("a b c d e").alias("content")).coalesce(1)
    dealt = ngrams.sliced(copies, "content", 16)
    assert dealt.rdd.getNumPartitions() == 36 and sorted(dealt.collect()) == sorted(copies.collect())
    assert sum(map(bool, dealt.rdd.glom().map(len).collect())) > 10
    assert ngrams.sliced(copies, "content").rdd.getNumPartitions() == 1
    assert ngrams.sliced(copies.filter("id < 0"), "content", 16).isEmpty()
    whole = as_dict(ngrams.ngram_federated(corpus, "content", "org"))
    monkeypatch.setattr(ngrams.sliced, "__defaults__", (16,))
    assert as_dict(ngrams.ngram_train(corpus, "content")) == dict(grams(ROWS, 2))
    assert as_dict(ngrams.ngram_federated(corpus, "content", "org")) == pytest.approx(whole)


def test_routing_by_a_list_moves_no_text(corpus):
    rows = corpus.withColumn("repo_name", F.concat("org", F.lit("/x")))
    plan = org_route(rows, {"first": ("a", "b"), "second": ("c",)})._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert org_route(rows, {}).isEmpty()

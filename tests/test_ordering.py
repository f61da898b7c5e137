"""Positions, shuffles, splits and packing against plain Python."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from corpuskiln.config import PackingConfig
from corpuskiln.functions.text import PRE_TOKEN
from corpuskiln.operators import ordering, packing


@pytest.fixture(scope="module")
def ids(spark):
    return spark.range(0, 1000).select((F.col("id") * 3).alias("doc_id")).repartition(7)


def order_key(i, seed):
    return hashlib.md5(f"{i}:{seed}".encode()).hexdigest()


@pytest.mark.parametrize("prefix", [1, 4])
def test_seeded_shuffle(ids, prefix):
    got = {r.position: r.doc_id for r in ordering.seeded_shuffle(ids, "doc_id", 42, prefix=prefix).collect()}
    assert [got[i] for i in range(1000)] == sorted(range(0, 3000, 3), key=lambda i: order_key(i, 42))


@pytest.mark.parametrize("n", [1, 4, 5, 999])
@pytest.mark.parametrize("prefix", [1, 4])
def test_split_is_exact(ids, n, prefix):
    part = ids.filter(F.col("doc_id") < 3 * n)
    rows = ordering.train_valid_split(part, "doc_id", prefix=prefix).collect()
    test = {r.doc_id for r in rows if r.split == "test"}
    ranked = sorted(range(0, 3 * n, 3), key=lambda i: order_key(i, 1))
    assert len(rows) == n and test == set(ranked[: math.ceil(0.2 * n)])


def test_buffer_shuffle_moves_less_than_the_buffer(spark):
    df = spark.range(3000).select(F.col("id").alias("position"))
    rows = ordering.buffer_shuffle(df, "position", "position", 1, buffer=50, chunk=16).collect()
    assert sorted(r.shuffled_position for r in rows) == list(range(3000))
    moved = [abs(r.shuffled_position - r.position) for r in rows]
    assert 0 < max(moved) < 50


@pytest.mark.parametrize("chunk", [1, 10, 65536])
def test_running_values_by_group(spark, chunk):
    rows = [(i, "hot" if i % 3 else "cold", (i * 7) % 11) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, key string, value long").repartition(5)
    order, part = [F.col("id")], ordering.id_chunk(F.col("id"), chunk)
    totals = ordering.running_total(df, F.col("value"), order, part, "total", by=["key"]).collect()
    lows = ordering.running_minimum(df, F.col("value"), order, part, "low", by=["key"]).collect()
    for row in totals:
        assert row.total == sum(v for i, k, v in rows if k == row.key and i < row.id)
    for row in lows:
        assert row.low == min((v for i, k, v in rows if k == row.key and i < row.id), default=None)


def test_ids_spread_over_all_integers(spark, monkeypatch):
    monkeypatch.setattr(ordering, "CHUNK_IDS", 8)
    rows = [(hash_id, i) for i, hash_id in enumerate(sorted({(x * 2654435761 * 97531) % 2**60 - 2**59 for x in range(300)}))]
    df = spark.createDataFrame(rows, "id long, want long").repartition(4)
    got = ordering.number_rows(df, [F.col("id")], ordering.id_chunk(F.col("id"), 2), "got")
    assert got.filter("got <> want").count() == 0 and got.count() == len(rows)


def test_running_function_ids(spark):
    df = spark.createDataFrame([(f, p) for f in (5, 2, 300) for p in (2, 1)], "file long, place int")
    got = ordering.running_function_id(df, "file", "place", chunk=4).orderBy("function_id").collect()
    assert [tuple(r) for r in got] == [(2, 1, 1), (2, 2, 2), (5, 1, 3), (5, 2, 4), (300, 1, 5), (300, 2, 6)]


def pack(docs, length, separator):
    stream = [t for doc in docs for t in [*doc, separator]]
    return [stream[i : i + length] for i in range(0, len(stream) - length + 1, length)]


@pytest.mark.parametrize("length,limit,chunk", [(4, None, 2), (7, None, 65536), (1, None, 3), (5, 3, 1), (1000, None, 4)])
def test_pretokenized_pack(spark, length, limit, chunk):
    docs = [list(range(i * 100, i * 100 + (i * 5) % 13)) for i in range(12)]
    df = spark.createDataFrame(list(enumerate(docs)), "pos long, ids array<long>").repartition(3)
    got = packing.pretokenized_pack(df, "ids", "pos", F.lit(-1).cast("bigint"), length, limit, chunk=chunk)
    rows = got.orderBy("seq_id").collect()
    assert [r.tokens for r in rows] == pack([d[:limit] for d in docs], length, -1)
    assert [r.seq_id for r in rows] == list(range(len(rows)))


def test_pack_per_shard(spark):
    docs = [(i, "ab"[i % 2], [i] * 3) for i in range(9)]
    df = spark.createDataFrame(docs, "pos long, shard string, ids array<long>")
    got = packing.pretokenized_pack(df, "ids", "pos", F.lit(0).cast("bigint"), 5, shard_col="shard").collect()
    for shard in "ab":
        want = pack([ids for _, s, ids in docs if s == shard], 5, 0)
        assert [r.tokens for r in sorted(got, key=lambda r: r.seq_id) if r.shard == shard] == want


def test_pack_text_and_batches(spark):
    import regex

    texts = ["one two, three's", "", "a  b\n\nc é", "end"]
    python_pattern = regex.compile(PRE_TOKEN)
    df = spark.createDataFrame(list(enumerate(texts)), "pos long, content string")
    got = packing.pack_sequences(df, "content", "pos", PackingConfig(seq_length=3, separator="<s>"))
    want = pack([python_pattern.findall(t) for t in texts], 3, "<s>")
    assert [r.tokens for r in got.orderBy("seq_id").collect()] == want
    batches = packing.sequence_batches(got, 2).orderBy("batch_id").collect()
    assert [[s.tokens for s in b.sequences] for b in batches] == [want[i : i + 2] for i in range(0, len(want), 2)]


def test_batches_move_tokens_once(spark):
    texts = [" ".join(f"w{i}_{k}" for k in range(i % 7)) for i in range(40)] + [None]
    df = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "pos long, content string").repartition(5)
    config = PackingConfig(seq_length=4, separator="<s>")
    plain = packing.pack_sequences(df, "content", "pos", config)
    tokens = {r.seq_id: r.tokens for r in plain.collect()}
    n = len(tokens)

    def backwards(ids):
        assert sorted(r.seq_id for r in ids.collect()) == list(range(n))
        return ids.withColumn("shuffled_position", F.lit(n - 1) - F.col("seq_id"))

    def batched(sequences):
        got = packing.sequence_batches(sequences, 3)
        plan = got._jdf.queryExecution().executedPlan().toString()
        # the pieces of all sequences are dealt by batch, once
        assert plan.count("Exchange hashpartitioning(batch_id") + plan.count("Exchange hashpartitioning(seq_id") == 1
        return {r.batch_id: [(x.seq_id, x.tokens) for x in r.sequences] for r in got.collect()}

    def want(numbered):
        return {b: [(i, numbered[i]) for i in range(3 * b, min(3 * b + 3, n))] for b in range(-(-n // 3))}

    assert batched(packing.pack_sequences(df, "content", "pos", config, batch_size=3)) == want(tokens)
    turned = packing.pack_sequences(df, "content", "pos", config, batch_size=3, order=backwards)
    assert batched(turned) == want({n - 1 - i: t for i, t in tokens.items()})
    with pytest.raises(ValueError):
        packing.pack_sequences(df, "content", "pos", config, shard_col="content", order=backwards)


def buffered(n, buffer, seed):
    """What a reader with a bounded buffer hands out, one row after the other."""
    held, handed = [], []
    for place in range(n):
        if place < buffer:
            held.append(place)
            continue
        drawn = int(hashlib.md5(f"{place - buffer}:slot:{seed}".encode()).hexdigest()[:8], 16)
        slot = int(drawn / 2**32 * buffer)
        handed.append(held[slot])
        held[slot] = place
    return handed + sorted(held, key=lambda place: order_key(place, seed))


@pytest.mark.parametrize("n, buffer, slot_rows, parts", [(3000, 50, 2, 7), (3000, 50, 1024, 1), (997, 1, 4, 3), (20, 50, 4, 3), (50, 50, 1, 2), (0, 5, 4, 1)])
def test_reservoir_equals_a_sequential_buffer(spark, n, buffer, slot_rows, parts):
    df = spark.range(n).select(F.col("id").alias("position"), (F.col("id") * 3).alias("_next_id")).repartition(parts)
    rows = ordering.reservoir_shuffle(df, "position", 9, buffer=buffer, slot_rows=slot_rows).collect()
    assert all(r._next_id == 3 * r.position for r in rows)
    assert [r.position for r in sorted(rows, key=lambda r: r.shuffled_position)] == buffered(n, buffer, 9)
    assert sorted(r.shuffled_position for r in rows) == list(range(n))


def test_reservoir_sorts_rows_within_their_slot_only(spark, stored_plans):
    ordering.reservoir_shuffle(spark.range(5000).withColumnRenamed("id", "position"), "position", 9, buffer=10)
    (plan,) = stored_plans
    assert "rangepartitioning" not in plan and "SinglePartition" not in plan

"""Buffer-wise packing and restarting sums against a walk through the rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpuskiln.config import PackingConfig
from corpuskiln.operators.packing import pack_sequences_buffered, pretokenized_pack_buffered
from corpuskiln.operators.restarts import in_groups, restarts
from corpuskiln.scratch import write_scratch


def walk(sizes, bound):
    """Group of each row: a group ends with the row that fills it."""
    groups, group, held = [], 0, 0
    for size in sizes:
        groups.append(group)
        held += size
        if held >= bound:
            group, held = group + 1, 0
    return groups


def sequences(docs, measure, bound, separator, length, limit=None):
    """Sequences of a stream that fills a buffer, cuts it and drops its tail, as a loop over the documents."""
    out, buffer, held = [], [], 0

    def cut():
        out.extend(buffer[i : i + length] for i in range(0, len(buffer) - length + 1, length))

    for doc in docs:
        buffer += [*doc[:limit], separator]
        held += measure(doc)
        if held >= bound:
            cut()
            buffer, held = [], 0
    cut()
    return out


SHARDS = {
    "ordinary": lambda rnd: [rnd.randrange(1, 9) for _ in range(300)],
    "with empty rows": lambda rnd: [rnd.choice([0, 0, 0, 1, 7]) for _ in range(200)] + [0] * 5,
    "larger than the bound": lambda rnd: [rnd.choice([1, 2, 55, 130]) for _ in range(60)],
    "exactly the bound": lambda rnd: [5] * 41,
    "nothing but empty rows": lambda rnd: [0] * 7,
    "one row": lambda rnd: [3],
    "one large row": lambda rnd: [1000, 0, 0],
    "ones": lambda rnd: [1] * 150,
}


@pytest.fixture(scope="module")
def shards():
    rnd = random.Random(3)
    return {name: make(rnd) for name, make in SHARDS.items()}


@pytest.mark.parametrize("bound", [1, 10])
def test_restarts_equal_a_walk(spark, shards, bound):
    rows = []
    for shard, sizes in shards.items():
        at = 0
        for i, size in enumerate(sizes):
            rows.append((shard, i, at, size))
            at += size
    spans = write_scratch(spark.createDataFrame(rows, "shard string, i int, at long, size long").repartition(4), "spans")
    groups = restarts(spans, bound, ["shard"])
    found = in_groups(spans, groups, bound, ["shard"], "start").collect()
    assert len(found) == len(rows)
    for shard, sizes in shards.items():
        own = sorted((r["i"], r["start"]) for r in found if r["shard"] == shard)
        order = {start: k for k, start in enumerate(sorted({start for _, start in own}))}
        wanted = walk(sizes, bound)
        assert [order[start] for _, start in own] == wanted, shard


def test_no_rows(spark):
    spans = write_scratch(spark.createDataFrame([], "i int, at long, size long"), "spans")
    groups = restarts(spans, 5)
    assert groups.count() == 0 and in_groups(spans, groups, 5).count() == 0


@pytest.mark.parametrize("limit, chunk", [(None, 65_536), (6, 3)])
def test_token_buffers_equal_a_loop(spark, shards, limit, chunk):
    rnd, rows, wanted = random.Random(4), [], set()
    config = PackingConfig(seq_length=4, buffer_sequences=3, max_doc_tokens=limit)
    for shard, sizes in shards.items():
        docs = [[rnd.randrange(1, 99) for _ in range(size)] for size in sizes]
        rows += [(shard, 10 * i, doc or None) for i, doc in enumerate(docs)]
        found = sequences(docs, len, 12, 0, 4, limit)
        wanted |= {(shard, k, tuple(s)) for k, s in enumerate(found)}
    df = spark.createDataFrame(rows, "shard string, at long, ids array<int>").repartition(5)
    got = pretokenized_pack_buffered(df, "ids", "at", F.lit(0), config, "shard", chunk).collect()
    assert {(r["shard"], r["seq_id"], tuple(r["tokens"])) for r in got} == wanted and len(got) == len(wanted)


def test_character_buffers_equal_a_loop(spark):
    rnd = random.Random(5)
    docs = [" ".join(["word"] * rnd.choice([0, 1, 3, 40])) for _ in range(120)]
    config = PackingConfig(seq_length=8, buffer_sequences=2, chars_per_token=3.6, separator="<end>")
    df = spark.createDataFrame([(i, doc or None) for i, doc in enumerate(docs)], "at long, content string")
    got = pack_sequences_buffered(df.repartition(3), "content", "at", config).orderBy("seq_id").collect()
    tokens = {d: [" word" if i else "word" for i in range(d.count("word"))] for d in docs}
    lengths = {tuple(t): len(d) for d, t in tokens.items()}
    wanted = sequences([tokens[d] for d in docs], lambda t: lengths[tuple(t)], math.ceil(8 * 3.6 * 2), "<end>", 8)
    assert [r["seq_id"] for r in got] == list(range(len(wanted)))
    assert [r["tokens"] for r in got] == wanted


def test_no_task_walks_through_a_shard(spark, stored_plans):
    rows = [(i, [1, 2, 3]) for i in range(400)]
    df = spark.createDataFrame(rows, "at long, ids array<int>")
    pretokenized_pack_buffered(df, "ids", "at", F.lit(0), PackingConfig(seq_length=4, buffer_sequences=3)).count()
    jumps = [p for p in stored_plans if "source" in p.partition("== Physical Plan ==")[2]]
    # 100 groups: a table of pointers for each doubling up to 128
    assert 7 <= len(jumps) <= 16
    windows = [line for p in stored_plans for line in p.partition("== Physical Plan ==")[2].splitlines() if "Window [" in line]
    assert windows and all("_chunk" in w or "_cell" in w or "_all" in w for w in windows)

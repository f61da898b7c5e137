"""Components with split vertices against a union-find, and how many turns and rows a task they take."""

import random

import pytest
from pyspark.sql import functions as F

from corpuskiln.operators.components import star_components
from corpuskiln.operators.clusters import connected_components


def union_find(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a is None or b is None:
            continue
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {(find(x), x) for x in list(parent)}


RNG = random.Random(5)
SHAPES = {
    "path": [(i, i + 1) for i in range(70)],
    "shuffled path": list(zip(*(lambda ids: (ids[:-1], ids[1:]))(RNG.sample(range(1000), 70)))),
    "stars": [(0, i) for i in range(1, 50)] + [(300, i) for i in range(101, 160)] + [(40, 120)],
    "random": [tuple(RNG.sample(range(90), 2)) for _ in range(60)],
    "complete": [(i, j) for i in range(12) for j in range(12)],
    "repeats, loops and nulls": [(3, 3), (5, 4), (4, 5), (5, 5), (None, 4), (9, None), (None, None)],
}


# all shapes as one graph, each with ids of its own, and an empty one
TOGETHER = [tuple(x if x is None else x + 2000 * i for x in pair) for i, pairs in enumerate(SHAPES.values()) for pair in pairs]


@pytest.mark.parametrize("hot_rows", [1_000_000, 3])
@pytest.mark.parametrize("pairs", [TOGETHER, []], ids=["shapes", "none"])
def test_equals_union_find(spark, pairs, hot_rows):
    found = star_components(spark.createDataFrame(pairs, "id_a long, id_b long"), hot_rows).collect()
    assert len(found) == len(set(found))
    assert {(r.cluster_id, r.id) for r in found} == union_find(pairs)


def test_long_chain_and_wide_star_take_few_turns(spark, stored_plans):
    chain = spark.range(5_000).select(F.col("id").alias("id_a"), (F.col("id") + 1).alias("id_b"))
    star = spark.range(1, 50_001).select(F.lit(2_000_000).cast("bigint").alias("id_a"), (F.col("id") + 3_000_000).alias("id_b"))
    found = star_components(chain.unionByName(star), hot_rows=5_000)
    sizes = {tuple(r) for r in found.groupBy("cluster_id").count().collect()}
    assert sizes == {(0, 5_001), (2_000_000, 50_001)}
    # links, then four tables a turn
    assert (len(stored_plans) - 1) // 4 <= 15


def test_a_hot_vertex_is_spread(spark):
    from corpuskiln.operators.skew import join_hot_keys

    edges = spark.range(40_000).select(F.lit(0).cast("bigint").alias("centre"), (F.col("id") + 1).alias("id"))
    nearest = edges.groupBy("centre").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = join_hot_keys(edges, nearest.select("centre", F.col("n").alias("first")), ["centre"], "id", 500, nearest)
        rows = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(rows) == 40_000 and len(rows) > 4 and max(rows) <= 2 * sorted(rows)[len(rows) // 2]


def test_same_clusters_as_contraction(spark):
    rng = random.Random(11)
    pairs = [tuple(sorted(rng.sample(range(400), 2))) for _ in range(250)]
    df = spark.createDataFrame(pairs, "id_a long, id_b long")
    assert set(star_components(df).select("cluster_id", "id").collect()) == set(
        connected_components(df).select("cluster_id", "id").collect()
    )

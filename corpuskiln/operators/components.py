"""Connected components of a graph in which a vertex may have any number of edges.

Two steps take turns until neither changes an edge. In the large step every vertex hands its larger
neighbours to the smallest vertex around it; in the small step it hands its smaller
neighbours to the smallest of them and stays with that one itself. Both keep the components, and
paths shrink to about half in a turn, so the turns grow with the logarithm of the longest path.
At the end every vertex points at the smallest of its component.

The smallest neighbour is aggregated before the shuffle. It goes back to the edges of its vertex
by a join, for which a vertex of more than ``hot_rows`` edges is cut into copies by a hash of the
other end (``operators/skew.py``), each with the same smallest neighbour. So neither a star over
all vertices nor many components under one vertex put their edges into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskiln.operators.skew import HOT_ROWS, join_hot_keys
from corpuskiln.scratch import write_scratch


def _stored(edges: DataFrame, moved: Column, name: str) -> DataFrame:
    """The distinct (id, near) rows of ``edges``, stored, and whether any of them is new."""
    return write_scratch(edges.groupBy("id", "near").agg(F.max(moved).alias("moved")), name)


def _large_step(edges: DataFrame, hot_rows: int) -> DataFrame:
    ends = edges.select(F.col("near").alias("centre"), F.col("id").alias("other")).unionByName(
        edges.select(F.col("id").alias("centre"), F.col("near").alias("other"))
    )
    # only a vertex with larger neighbours hands any on
    nearest = ends.groupBy("centre").agg(
        F.least("centre", F.min("other")).alias("first"), F.count_if(F.col("other") > F.col("centre")).alias("n")
    )
    nearest = write_scratch(nearest.filter("n > 0"), "nearest")
    larger = edges.select("id", F.col("near").alias("centre"))
    joined = join_hot_keys(larger, nearest.select("centre", "first"), ["centre"], "id", hot_rows, nearest.select("centre", "n"))
    handed = joined.select("id", F.col("first").alias("near"), (F.col("first") != F.col("centre")).alias("_moved"))
    return _stored(handed, F.col("_moved"), "large-star")


def _small_step(edges: DataFrame, hot_rows: int) -> DataFrame:
    nearest = write_scratch(edges.groupBy("id").agg(F.min("near").alias("first"), F.count("*").alias("n")), "nearest")
    own = nearest.select("id", F.col("first").alias("near"), F.lit(False).alias("_moved"))
    # a vertex with one smaller neighbour has nothing to hand on
    several = nearest.filter("n > 1")
    joined = join_hot_keys(edges, several.select("id", "first"), ["id"], "near", hot_rows, several.select("id", "n"))
    handed = joined.filter(F.col("near") != F.col("first")).select(
        F.col("near").alias("id"), F.col("first").alias("near"), F.lit(True).alias("_moved")
    )
    return _stored(own.unionByName(handed), F.col("_moved"), "small-star")


def star_components(pairs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(cluster_id, id) of every vertex of ``pairs`` (id_a, id_b); the cluster id is its smallest member.

    Pairs may repeat and come in any order. A pair of equal ids makes a cluster of one, unless others hold the id too; pairs
    with a null are skipped.
    """
    ends = pairs.filter("id_a IS NOT NULL AND id_b IS NOT NULL")
    links = ends.select(F.greatest("id_a", "id_b").alias("id"), F.least("id_a", "id_b").alias("near"))
    links = write_scratch(links.distinct(), "links")
    edges, changing = links.filter(F.col("id") != F.col("near")), True
    while changing:
        large = _large_step(edges, hot_rows)
        edges = _small_step(large, hot_rows)
        changing = any(not step.filter("moved").isEmpty() for step in (edges, large))
    members = edges.select(F.col("near").alias("cluster_id"), "id")
    centres = edges.select(F.col("near").alias("cluster_id"), F.col("near").alias("id")).distinct()
    alone = links.filter(F.col("id") == F.col("near")).select("id")
    linked = edges.select("id").unionByName(edges.select(F.col("near").alias("id"))).distinct()
    single = alone.join(linked, "id", "left_anti").select(F.col("id").alias("cluster_id"), "id")
    return members.unionByName(centres).unionByName(single)

"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000


def join_hot_keys(
    rows: DataFrame,
    per_key: DataFrame,
    keys: list[str],
    id_col: str,
    hot_rows: int = HOT_ROWS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Inner join of ``rows`` with ``per_key``, which has few rows per key.

    A key with more than ``hot_rows`` rows is spread over count/hot_rows parts by
    a hash of ``id_col``, and its rows in ``per_key`` are repeated once per part.
    There are at most rows/hot_rows hot keys, which bounds the list that is
    broadcast. ``counts`` (keys, n) saves the count when the caller has it.
    """
    if counts is None:
        counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / F.lit(hot_rows)).cast("int")
    hot = F.broadcast(counts.filter(F.col("n") > hot_rows).select(*keys, parts.alias("_n_parts")))
    n_parts = F.coalesce("_n_parts", F.lit(1))
    spread = rows.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(id_col), n_parts).cast("int"))
    repeated = per_key.join(hot, keys, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), n_parts - 1))
    )
    return spread.drop("_n_parts").join(repeated.drop("_n_parts"), [*keys, "_part"]).drop("_part")

"""Exact duplicates by content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskiln.functions.text import content_hash
from corpuskiln.operators.skew import join_hot_keys
from corpuskiln.scratch import write_scratch


def _hash(text_col: str) -> Column:
    """The content hash; null texts, which have none, share a value that no text has, so that they are copies in joins too."""
    return F.coalesce(content_hash(F.col(text_col)), F.lit("null")).alias("_hash")


def first_of_hash(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id of the first row of each content hash; the minimum is combined before the shuffle."""
    hashed = df.select(id_col, _hash(text_col))
    return hashed.groupBy("_hash").agg(F.min(id_col).alias(id_col)).select(id_col)


def later_copies(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids whose content hash an earlier row has.

    The hashes are stored, so the text is read once. A minimum per hash is combined
    before the shuffle, and only hashes of several rows meet their rows again.
    """
    hashed = write_scratch(df.select(id_col, _hash(text_col)), "hashes")
    shared = hashed.groupBy("_hash").agg(F.min(id_col).alias("_first"), F.count("*").alias("n")).filter("n > 1")
    again = join_hot_keys(hashed, shared.drop("n"), ["_hash"], id_col, counts=shared.select("_hash", "n"))
    return again.filter(F.col(id_col) > F.col("_first")).select(id_col)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "content") -> DataFrame:
    """Keep the first row, by id, of each content hash. Ids must be unique.

    The join's small side holds the ids that go, so the planner may send it whole if it measures it small.
    """
    return df.join(later_copies(df, id_col, text_col), id_col, "left_anti")


def duplicate_fraction(df: DataFrame, text_col: str = "content") -> DataFrame:
    """One row: 1 - distinct hashes / rows."""
    per_hash = df.select(_hash(text_col)).groupBy("_hash").agg(F.count("*").alias("_n"))
    unique_share = F.try_divide(F.count("*").cast("double"), F.sum("_n").cast("double"))
    return per_hash.agg((1 - unique_share).alias("duplicate_fraction"))

"""Collection of source files and their routing to organisations."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.operators.skew import HOT_ROWS, join_hot_keys
from corpuskiln.scratch import write_scratch

# Repository owners of each organisation. An owner is matched
# with its exact case.
ORG_OWNERS: dict[str, tuple[str, ...]] = {
    "google": (
        "google", "GoogleCloudPlatform", "google-research", "google-deepmind", "googleapis", "GoogleChromeLabs",
        "GoogleChrome", "googlefonts", "googlemaps", "googlecodelabs", "google-developer-training",
        "googlesamples", "googleworkspace", "googlearchive", "google-research-datasets", "googlecreativelab",
        "GoogleContainerTools", "googleprojectzero", "googleanalytics", "googleads", "googlecolab",
        "googleinterns", "google-admin", "GoogleCodeExporter", "google-ar", "google-coral", "googleforgames",
        "google-marketing-solutions", "GoogleTrends", "GoogleCloudPlatformTraining", "googlevr",
        "GoogleWebComponents",
    ),
    "microsoft": (
        "microsoft", "MicrosoftDocs", "MicrosoftLearning", "Azure", "MicrosoftEdge", "microsoftgraph",
        "microsoftarchive", "Microsoft-OpenSource-Labs", "OfficeDev", "msintuneappsdk",
    ),
    "facebook": ("facebook", "facebookresearch", "facebookincubator", "facebookexperimental", "fbsamples"),
}


def collect_sources(
    files: DataFrame, contents: DataFrame, licenses: DataFrame, suffix: str = ".py", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Text files with ``suffix``, with their content and licence.

    Both filters and the pruned columns reach the scans. A repository with
    several licence rows repeats its files once per row. Content is shared by
    its copies, so one content id may name a third of all files; both joins
    spread such keys. Licences join first: they are narrow, are stored for the count of hot
    contents, and the content then moves once.
    """
    named = files.filter(F.col("path").endswith(suffix)).select("id", "repo_name", "path")
    textual = contents.filter(~F.col("binary")).select("id", "copies", "size", "content")
    licensed = write_scratch(
        join_hot_keys(named, licenses.select("repo_name", "license"), ["repo_name"], "path", hot_rows), "licensed"
    )
    return join_hot_keys(licensed, textual, ["id"], "path", hot_rows).select(
        "repo_name", "path", "copies", "size", "content", "license"
    )


def owner_map(spark: SparkSession, owners: dict[str, tuple[str, ...]] = ORG_OWNERS) -> DataFrame:
    """(owner, org) rows; an owner listed twice would repeat rows, so that is an error.

    An Arrow table is a relation of known size, so a join with it moves no text; a list of rows has none.
    """
    rows = [(owner, org) for org, names in owners.items() for owner in names]
    if len({owner for owner, _ in rows}) != len(rows):
        raise ValueError("an owner may belong to one organisation only")
    names, orgs = zip(*rows) if rows else ((), ())
    return spark.createDataFrame(
        pa.table({"owner": pa.array(names, pa.string()), "org": pa.array(orgs, pa.string())})
    )


def org_route(
    df: DataFrame, owners: dict[str, tuple[str, ...]] | DataFrame = ORG_OWNERS, repo_col: str = "repo_name"
) -> DataFrame:
    """Add ``org``, the organisation that owns the repository; other rows are dropped.

    ``owners`` is a list in the program or a table (owner, org) with each owner
    once. The planner knows the size of either and broadcasts it only if it is small.
    """
    table = owners if isinstance(owners, DataFrame) else owner_map(df.sparkSession, owners)
    owner = F.split_part(F.col(repo_col), F.lit("/"), F.lit(1))
    return df.withColumn("_owner", owner).join(table.withColumnRenamed("owner", "_owner"), "_owner").drop("_owner")


def org_summary(routed: DataFrame, size_col: str = "size") -> DataFrame:
    """Rows and megabytes per organisation."""
    return routed.groupBy("org").agg(
        F.count("*").alias("n_rows"), (F.sum(size_col) / F.lit(1024.0 * 1024.0)).alias("size_mb")
    )


def union_corpora(*corpora: DataFrame) -> DataFrame:
    """All rows of all corpora, duplicates kept."""
    return reduce(lambda left, right: left.unionByName(right), corpora)

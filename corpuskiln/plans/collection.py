"""Corpus collection: join, routing by organisation, output and summary."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corpuskiln.operators.collection import ORG_OWNERS, org_route, org_summary
from corpuskiln.operators.features import cast_size
from corpuskiln.sources.writers import sink_org_csv


def route_rows(raw: DataFrame, owners: dict[str, tuple[str, ...]] = ORG_OWNERS) -> DataFrame:
    return cast_size(org_route(raw, owners))


def store_by_org(routed: DataFrame, path: str) -> DataFrame:
    """Write the rows of each organisation and return their summary."""
    sink_org_csv(routed, path)
    return org_summary(routed)

"""Corpus cleaning: filter, and near-duplicate removal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskiln.config import CleaningConfig, NearDupConfig
from corpuskiln.operators.clusters import near_dedup_stats, near_duplicates, without_copies
from corpuskiln.operators.filters import drop_reasons, heuristic_filter
from corpuskiln.scratch import write_scratch


@dataclass
class CleanCorpus:
    """What cleaning leaves, and how it got there. ``outcome`` and ``stats`` only with near-dedup."""

    rows: DataFrame
    outcome: DataFrame | None = None
    stats: DataFrame | None = None


def clean_corpus(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "content",
    config: CleaningConfig = CleaningConfig(),
    near: NearDupConfig | None = None,
    mode: str = "components",
    token_count: Column | None = None,
) -> CleanCorpus:
    """Heuristic filter and, with ``near``, removal of near duplicates.

    ``token_count`` is a column of ``df`` with the counts of the caller's tokenizer.
    Near-dedup reads the filtered rows several times, so they are stored first.
    """
    filtered = heuristic_filter(df, id_col, text_col, config, token_count)
    if near is None:
        return CleanCorpus(filtered)
    filtered = write_scratch(filtered, "filtered")
    outcome = near_duplicates(filtered, id_col, text_col, near, mode)
    return CleanCorpus(without_copies(filtered, outcome, id_col), outcome, near_dedup_stats(filtered, outcome))


def cleaning_outcome(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "content",
    config: CleaningConfig = CleaningConfig(),
    token_count: Column | None = None,
) -> DataFrame:
    """Which rows stay and why the others go: (id, kept, drop_reason)."""
    return drop_reasons(df, id_col, text_col, config, token_count).select(
        id_col,
        F.col("drop_reason").isNull().alias("kept"),
        F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason"),
    )

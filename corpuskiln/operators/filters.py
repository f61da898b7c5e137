"""Heuristic filter over the file features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from corpuskiln.config import CleaningConfig
from corpuskiln.functions.hashing import uniform_draw
from corpuskiln.operators.dedup import later_copies
from corpuskiln.operators.features import file_features

# what ``drop_reasons`` can say, in the order of its rules
DROP_REASONS = (
    "empty",
    "autogenerated",
    "line_max",
    "line_mean",
    "alpha_frac",
    "ratio",
    "config_or_test",
    "has_no_keywords",
    "few_assignments",
    "duplicate",
)
KEPT = "kept"


def thinned(flag: Column, key: Column, salt: str, proba: float, seed: int) -> Column:
    """True when a flagged row loses its draw; each ``salt`` is an independent draw."""
    return flag & (uniform_draw(key, salt, seed) <= F.lit(float(proba)))


def probabilistic_thin(
    df: DataFrame, flag_col: str, id_col: str, salt: str, proba: float = 0.7, seed: int = 1
) -> DataFrame:
    """Drop flagged rows with probability ``proba``, repeatably per id."""
    return df.filter(~thinned(F.col(flag_col), F.col(id_col), salt, proba, seed))


def heuristic_reason(id_col: str, config: CleaningConfig) -> Column:
    """The first rule a row of features fails, NULL when it passes all.

    An empty text has NULL statistics, which no comparison would catch, so it
    is the first reason.
    """
    key = F.col(id_col)
    return (
        F.when(F.col("line_mean").isNull(), "empty")
        .when(F.col("autogenerated"), "autogenerated")
        .when(F.col("line_max") > config.line_max, "line_max")
        .when(F.col("line_mean") > config.line_mean, "line_mean")
        .when(F.col("alpha_frac") < config.alpha_frac, "alpha_frac")
        .when(F.col("ratio") < config.min_token_ratio, "ratio")
        .when(
            thinned(F.col("config_or_test"), key, "config_or_test", config.filter_proba, config.seed),
            "config_or_test",
        )
        .when(
            thinned(F.col("has_no_keywords"), key, "has_no_keywords", config.filter_proba, config.seed),
            "has_no_keywords",
        )
        .when(F.col("has_few_assignments"), "few_assignments")
    )


def drop_reasons(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "content",
    config: CleaningConfig = CleaningConfig(),
    token_count: Column | None = None,
) -> DataFrame:
    """(id, drop_reason) of every row; NULL marks the rows that stay.

    A later copy is a duplicate even when the first copy fails a rule, because
    the first copy uses up the hash. The text takes no part in the join.
    """
    counted = [] if token_count is None else [token_count.alias("_token_count")]
    given = None if token_count is None else F.col("_token_count")
    judged = file_features(df.select(id_col, text_col, *counted), text_col, config, given).select(
        id_col, heuristic_reason(id_col, config).alias("_reason")
    )
    later = later_copies(df, id_col, text_col).withColumn("_later", F.lit(True))
    reason = F.when(F.col("_later"), F.lit("duplicate")).otherwise(F.col("_reason"))
    return judged.join(later, id_col, "left").select(id_col, reason.alias("drop_reason"))


def heuristic_filter(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "content",
    config: CleaningConfig = CleaningConfig(),
    token_count: Column | None = None,
) -> DataFrame:
    """Rows that pass, with their feature columns.

    The rules look at one row each, so they run before the join and keep failing
    rows out of the shuffle. The row number holds the filter above the features:
    pushed below them, it would compute each feature again.
    """
    judged = file_features(df, text_col, config, token_count).withColumns(
        {"_reason": heuristic_reason(id_col, config), "_row": F.monotonically_increasing_id()}
    )
    passing = judged.filter(F.col("_reason").isNull() & (F.col("_row") >= 0)).drop("_reason", "_row")
    return passing.join(later_copies(df, id_col, text_col), id_col, "left_anti")


def filter_report(reasons: DataFrame) -> DataFrame:
    """Rows per drop reason; 'kept' counts the rows that stay."""
    return reasons.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason")).agg(
        F.count("*").alias("n_rows")
    )


def observe_reasons(reasons: DataFrame, observation: Observation | str) -> DataFrame:
    """``reasons``, counting its rows by reason in whatever pass reads them; a stream takes a name instead of an observation."""
    reason = F.coalesce("drop_reason", F.lit(KEPT))
    return reasons.observe(observation, *[F.count_if(reason == r).alias(r) for r in (KEPT, *DROP_REASONS)])


def observed_report(observation: Observation) -> dict[str, int]:
    """Rows per drop reason as ``filter_report`` counts them, once the observed rows have been written."""
    return {reason: n for reason, n in observation.get.items() if n}


def observed_summary(observation: Observation) -> dict[str, float | int | None]:
    """The row of ``filter_summary`` from the same counts."""
    counts = observation.get
    rows = sum(counts.values())
    return {
        "rows_loaded": rows,
        "duplicate_fraction": counts["duplicate"] / rows if rows else None,
        "rows_filtered": counts[KEPT],
    }


def filter_summary(reasons: DataFrame) -> DataFrame:
    """One row: rows loaded, share of duplicates, rows kept."""
    rows = F.count("*")
    duplicates = F.count_if(F.col("drop_reason").eqNullSafe("duplicate"))
    return reasons.agg(
        rows.alias("rows_loaded"),
        F.try_divide(duplicates.cast("double"), rows.cast("double")).alias("duplicate_fraction"),
        F.count_if(F.col("drop_reason").isNull()).alias("rows_filtered"),
    )

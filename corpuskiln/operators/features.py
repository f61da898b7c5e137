"""Feature columns of a file, computed in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskiln.config import CleaningConfig
from corpuskiln.functions import text as T

FEATURES = (
    "hash",
    "line_mean",
    "line_max",
    "alpha_frac",
    "ratio",
    "autogenerated",
    "config_or_test",
    "has_no_keywords",
    "has_few_assignments",
)


def cast_size(df: DataFrame, size_col: str = "size") -> DataFrame:
    """File size as a number; what does not parse becomes NULL."""
    return df.withColumn(size_col, F.col(size_col).try_cast("bigint"))


def file_features(
    df: DataFrame,
    text_col: str = "content",
    config: CleaningConfig = CleaningConfig(),
    token_count: Column | None = None,
) -> DataFrame:
    """Add all feature columns.

    The split text and its lower-case form are columns of their own first:
    several features use them, and a projection computes each once.
    """
    text = F.col(text_col)
    prepared = df.withColumns({"_pieces": T.split_breaks(text), "_lower": F.lower(text)})
    headed = prepared.withColumn("_head", T.head_of(F.col("_pieces"), config.scan_width))
    pieces, lowered, head = F.col("_pieces"), F.col("_lower"), F.col("_head")
    return headed.withColumns(
        {
            "hash": T.content_hash(text),
            "line_mean": T.mean_length(pieces),
            "line_max": T.max_length(pieces),
            "alpha_frac": T.alpha_frac(text),
            "ratio": T.char_token_ratio(text, token_count),
            "autogenerated": T.generated_head(head),
            "config_or_test": T.config_or_test(head, lowered, config.keyword_coeff),
            "has_no_keywords": ~T.contains_any(lowered, T.CODE_KEYWORDS),
            "has_few_assignments": T.has_few_assignments(text, config.min_assignments),
        }
    ).drop("_pieces", "_lower", "_head")

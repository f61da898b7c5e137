"""Memorization: what generated text repeats of a training corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.config import CLONE_THRESHOLD_LINES, GenerationConfig
from corpuskiln.operators.clones import GENERATED, clone_report_totals, clone_sets, cross_file_sets, line_clones
from corpuskiln.operators.ordering import running_function_id
from corpuskiln.functions.text import pre_token_count
from corpuskiln.operators.prompts import (
    TokenCount,
    extract_functions,
    number_generations,
    prompt_token_limit,
    strip_prompt,
    truncate_at_stop,
)

from corpuskiln.scratch import write_scratch


@dataclass
class MemorizationReport:
    clones: DataFrame
    reduced: DataFrame
    totals: DataFrame


def build_prompts(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "content",
    config: GenerationConfig = GenerationConfig(),
    count_tokens: TokenCount = pre_token_count,
) -> DataFrame:
    """(function_id, function_name, signature_with_docstring) of a Python corpus.

    Numbering reads the functions twice, so they are stored first.
    """
    short = write_scratch(
        prompt_token_limit(extract_functions(df, id_col, text_col), limit=config.prompt_tokens, count_tokens=count_tokens),
        "functions",
    )
    return running_function_id(short, id_col, "position").select(
        "function_id", "function_name", "signature_with_docstring"
    )


def postprocess_generations(
    generations: DataFrame,
    function_col: str,
    position_col: str,
    prompt_col: str,
    text_col: str,
    config: GenerationConfig = GenerationConfig(),
) -> DataFrame:
    """(function_id, generation_id, generated_content): prompt removed, text cut at the first stop string."""
    body = strip_prompt(F.col(text_col), F.col(prompt_col))
    numbered = number_generations(
        generations.select(function_col, position_col, truncate_at_stop(body, config.stop_strings).alias("generated_content")),
        function_col,
        position_col,
    )
    return numbered.select(F.col(function_col).alias("function_id"), "generation_id", "generated_content")


def two_sides(training: DataFrame, generated: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Both corpora in one table, with a ``side`` column; see ``GENERATED`` of the clones."""
    return training.select(F.lit("training").alias("side"), id_col, text_col).unionByName(
        generated.select(F.lit(GENERATED).alias("side"), id_col, text_col)
    )


def memorization_report(
    training: DataFrame,
    generated: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "content",
    threshold: int = CLONE_THRESHOLD_LINES,
) -> MemorizationReport:
    both = two_sides(training, generated, id_col, text_col)
    clones = line_clones(both, id_col, text_col, threshold, side_col="side")
    reduced = cross_file_sets(clone_sets(clones))
    return MemorizationReport(clones, reduced, clone_report_totals(reduced))

"""Functions of Python sources, prompts made of them, and generated text."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuskiln.config import GenerationConfig
from corpuskiln.functions import text as T
from corpuskiln.functions.batches import slices
from corpuskiln.operators.ordering import CHUNK_IDS, id_chunk, number_rows, running_total
from corpuskiln.scratch import write_scratch

# tokens of a text column, for tokenizers other than the built-in pieces
TokenCount = Callable[[Column], Column]

FUNCTION_TYPE = "array<struct<position:int,function_name:string,signature_with_docstring:string>>"
FUNCTIONS = pa.list_(
    pa.struct([("position", pa.int32()), ("function_name", pa.string()), ("signature_with_docstring", pa.string())])
)


def functions_of(source: Column) -> Column:
    """All functions of a Python source; the text is NULL without a docstring.

    Functions come in breadth-first order, nested ones and methods included,
    async ones not. The text runs from the ``def`` line to the end of the
    docstring. A source that does not parse has no functions.
    """

    def describe(source):
        if source is None:
            return []
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse(source)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return []
        rows = re.split("\r\n|\r|\n", source)
        found = []
        for node in ast.walk(tree):
            if not isinstance(node, ast.FunctionDef):
                continue
            docstring = ast.get_docstring(node, clean=False)
            text = None
            if docstring is not None and docstring.strip():
                text = "\n".join(rows[node.lineno - 1 : node.body[0].value.end_lineno])
            found.append(
                {
                    "position": len(found) + 1,
                    "function_name": node.name,
                    "signature_with_docstring": text,
                }
            )
        return found

    @F.arrow_udf(FUNCTION_TYPE)
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for sources in batches:
            for rows in slices(sources):
                yield pa.array([describe(source) for source in rows.to_pylist()], FUNCTIONS)

    # keeps later filters and counts from parsing every file again
    return parse.asNondeterministic()(source)


def parsed_functions(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(file id, functions) of every file; the text column goes no further."""
    return df.select(id_col, functions_of(F.col(text_col)).alias("functions"))


def extract_functions(df: DataFrame, id_col: str = "doc_id", text_col: str = "content") -> DataFrame:
    """One row per function with a docstring."""
    return (
        parsed_functions(df, id_col, text_col)
        .select(id_col, F.inline("functions"))
        .filter(F.col("signature_with_docstring").isNotNull())
    )


def prompt_token_limit(
    df: DataFrame,
    text_col: str = "signature_with_docstring",
    limit: int = GenerationConfig.prompt_tokens,
    count_tokens: TokenCount = T.pre_token_count,
) -> DataFrame:
    """Rows whose text has at most ``limit`` tokens, as ``count_tokens`` counts the text column's."""
    return df.filter(count_tokens(F.col(text_col)) <= limit)


def function_counts(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "content",
    limit: int = GenerationConfig.prompt_tokens,
    chunk: int = CHUNK_IDS,
    count_tokens: TokenCount = T.pre_token_count,
) -> DataFrame:
    """Functions and extracted functions per file, with totals up to and including the file.

    ``count_tokens`` is used inside an array function, so it has to be made of built-in expressions.
    """
    extracted = F.filter(
        "functions", lambda f: count_tokens(f["signature_with_docstring"]) <= limit
    )
    # the totals read the counts several times; stored, each file is parsed once
    counted = write_scratch(
        parsed_functions(df, id_col, text_col).select(
            id_col, F.size("functions").alias("n_functions"), F.size(extracted).alias("n_docstrings")
        ),
        "function-counts",
    )
    order, part = [F.col(id_col)], id_chunk(F.col(id_col), chunk)
    totals = running_total(counted, F.col("n_functions"), order, part, "_functions")
    totals = running_total(totals, F.col("n_docstrings"), order, part, "_docstrings")
    return totals.select(
        id_col,
        "n_functions",
        "n_docstrings",
        (F.col("_functions") + F.col("n_functions")).alias("total_functions"),
        (F.col("_docstrings") + F.col("n_docstrings")).alias("total_docstrings"),
    )


def prompt_expand(
    prompts: DataFrame,
    separator: str,
    id_col: str = "function_id",
    text_col: str = "signature_with_docstring",
    config: GenerationConfig = GenerationConfig(),
) -> DataFrame:
    """One row per requested generation: (function_id, copy_id, sample_id, prompt).

    A prompt is repeated ``n_samples // batch_size`` times and each copy asks
    for ``batch_size`` generations. ``num_tasks`` keeps that many first prompts,
    in id order, whatever the ids are.
    """
    if config.num_tasks is not None:
        numbered = number_rows(prompts, [F.col(id_col)], id_chunk(F.col(id_col)), "_number", start=1)
        prompts = numbered.filter(F.col("_number") <= config.num_tasks).drop("_number")
    copies = config.n_samples // config.batch_size
    requests = F.flatten(
        F.array(
            *[
                F.array(
                    *[
                        F.struct(F.lit(copy).alias("copy_id"), F.lit(sample).alias("sample_id"))
                        for sample in range(1, config.batch_size + 1)
                    ]
                )
                for copy in range(1, copies + 1)
            ]
        )
    )
    prompt = F.concat(F.lit(separator), T.strip_spaces(F.col(text_col)))
    if copies == 0:
        return prompts.select(id_col, F.lit(0).alias("copy_id"), F.lit(0).alias("sample_id"), prompt.alias("prompt")).limit(0)
    return prompts.select(id_col, F.inline(requests), prompt.alias("prompt"))


def strip_prompt(generation: Column, prompt: Column) -> Column:
    """Drop as many leading characters as the prompt has."""
    return F.substring(generation, F.length(prompt) + 1, F.length(generation))


def truncate_at_stop(text: Column, stops: Sequence[str] = GenerationConfig.stop_strings) -> Column:
    """The text before the earliest stop string."""
    found = [F.nullif(F.instr(text, stop), F.lit(0)) for stop in stops]
    first = F.least(*found) if len(found) > 1 else found[0]
    return F.when(first.isNull(), text).otherwise(F.substring(text, F.lit(1), first - 1))


def number_generations(df: DataFrame, function_col: str, position_col: str, out: str = "generation_id") -> DataFrame:
    """Generation ids from 1 within each function, in ``position_col`` order.

    A function has as many rows as generations were asked for, so one window a function is small.
    """
    return df.withColumn(out, F.row_number().over(Window.partitionBy(function_col).orderBy(position_col)).cast("bigint"))

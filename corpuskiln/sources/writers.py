"""Writers: CSV per organisation, compressed JSON lines, clusters, reports and their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln import config

# Column headers of the published tables.
PROMPT_HEADERS = {
    "function_id": "function id",
    "function_name": "function name",
    "signature_with_docstring": "signature with docstring",
}
GENERATION_HEADERS = {
    "function_id": "function id",
    "generation_id": "generation id",
    "generated_content": "generated content",
}
REPORT_HEADERS = {"fingerprint": "fingerprint", "line_count": "lineCount"}


def _csv(df: DataFrame, samples_per_file: int):
    return (
        df.write.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("lineSep", "\n")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("maxRecordsPerFile", samples_per_file)
    )


def sink_csv(df: DataFrame, path: str, samples_per_file: int = config.SAMPLES_PER_FILE) -> None:
    _csv(df, samples_per_file).csv(path)


def sink_org_csv(routed: DataFrame, path: str, samples_per_file: int = config.SAMPLES_PER_FILE) -> None:
    """One folder of CSV files per organisation, without a shuffle.

    A quoted field may hold line breaks, so a CSV file cannot be split on
    reading; ``samples_per_file`` bounds what one reader gets.
    """
    _csv(routed, samples_per_file).partitionBy("org").csv(path)


def sink_jsonl_gz(df: DataFrame, path: str, samples_per_file: int = config.SAMPLES_PER_FILE) -> None:
    """JSON lines, gzip, at most ``samples_per_file`` rows per file."""
    df.write.option("compression", "gzip").option("maxRecordsPerFile", samples_per_file).json(path)


def sink_duplicate_clusters(nested: DataFrame, path: str) -> None:
    nested.write.json(path)


def sink_csv_tables(df: DataFrame, path: str, headers: dict[str, str], samples_per_file: int = config.SAMPLES_PER_FILE) -> None:
    """A table with its published column headers."""
    renamed = df.select(*[F.col(name).alias(header) for name, header in headers.items()])
    _csv(renamed, samples_per_file).csv(path)


def sink_clone_report(report: DataFrame, path: str) -> None:
    """The nested report as XML ``set`` elements with ``block`` children."""
    block = F.transform(
        "block",
        lambda b: F.struct(
            b["source_file"].alias("_sourceFile"),
            b["start_line"].alias("_startLineNumber"),
            b["end_line"].alias("_endLineNumber"),
        ),
    )
    sets = report.select(
        F.col("fingerprint").alias("_fingerprint"), F.col("line_count").alias("_lineCount"), block.alias("block")
    )
    sets.write.format("xml").option("rootTag", "check").option("rowTag", "set").save(path)


def sink_clone_summary(summary: DataFrame, path: str) -> None:
    """One row as the attributes of a ``summary`` element."""
    attributes = summary.select(*[F.col(name).alias(f"_{name}") for name in summary.columns])
    attributes.write.format("xml").option("rootTag", "check").option("rowTag", "summary").save(path)

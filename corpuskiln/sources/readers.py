"""Readers: Parquet tables, CSV shards, JSON lines and XML clone reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from corpuskiln.sources.writers import GENERATION_HEADERS, PROMPT_HEADERS

RAW_CODE = "repo_name string, path string, copies string, size string, content string, license string"


# a ``set`` element without blocks, or one up to its end tag
EMPTY_SET = r"""<set\b(?:[^>"']|"[^"]*"|'[^']*')*/>"""
SET_ELEMENT = rf"(?s){EMPTY_SET}|<set\b.*"

CLONE_REPORT = Ty.StructType(
    [
        Ty.StructField("_fingerprint", Ty.StringType()),
        Ty.StructField("_lineCount", Ty.LongType()),
        Ty.StructField(
            "block",
            Ty.ArrayType(
                Ty.StructType(
                    [
                        Ty.StructField("_sourceFile", Ty.StringType()),
                        Ty.StructField("_startLineNumber", Ty.LongType()),
                        Ty.StructField("_endLineNumber", Ty.LongType()),
                    ]
                )
            ),
        ),
    ]
)


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table."""
    return spark.read.parquet(path)


def scan_csv_shards(spark: SparkSession, path: str, schema: str | Ty.StructType = RAW_CODE) -> DataFrame:
    """All CSV files of a folder; quoted fields may hold line breaks and quotes."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("lineSep", "\n")
        .csv(path)
    )


def scan_jsonl(spark: SparkSession, paths: str | list[str], schema: str | Ty.StructType) -> DataFrame:
    """JSON lines, plain or compressed, of one or more files or folders."""
    return spark.read.schema(schema).json(paths)


def scan_clone_report(spark: SparkSession, path: str) -> DataFrame:
    """(ord, fingerprint, line_count, block): one row per ``set`` element.

    A large file is read in pieces that begin and end at ``set`` elements. ``ord`` follows the document: file, offset of the piece read, place in it.
    """
    # the text reader splits a file at the end tags; each piece holds one set and those without blocks before it
    pieces = spark.read.option("lineSep", "</set>").text(path)
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )
    elements = pieces.select(place.alias("piece"), F.posexplode(F.regexp_extract_all("value", F.lit(SET_ELEMENT), F.lit(0))))
    closed = F.when(F.col("col").rlike(f"^{EMPTY_SET}$"), F.col("col")).otherwise(F.concat("col", F.lit("</set>")))
    parsed = elements.select(F.struct("piece", "pos").alias("ord"), F.from_xml(closed, CLONE_REPORT).alias("_set"))
    sets = parsed.select("ord", "_set.*")
    block = F.transform(
        F.coalesce("block", F.array()),
        lambda b: F.struct(
            b["_sourceFile"].alias("source_file"),
            b["_startLineNumber"].alias("start_line"),
            b["_endLineNumber"].alias("end_line"),
        ),
    )
    return sets.select(
        "ord",
        F.col("_fingerprint").alias("fingerprint"),
        F.col("_lineCount").alias("line_count"),
        block.alias("block"),
    )


def scan_clone_summary(spark: SparkSession, path: str) -> DataFrame:
    """(key, value): the attributes of the first ``summary`` element; no rows without one."""
    summary = spark.read.format("xml").option("rowTag", "summary").option("inferSchema", False).load(path)
    names = [name for name in summary.columns if name.startswith("_") and name != "_VALUE"]
    if not names:
        return spark.createDataFrame([], "key string, value string")
    pairs = F.array(
        *[F.struct(F.lit(name[1:]).alias("key"), F.col(name).cast("string").alias("value")) for name in names]
    )
    first = summary.limit(1).select(F.inline(pairs))
    return first.filter(F.col("value").isNotNull())


def scan_csv_table(spark: SparkSession, path: str, headers: dict[str, str], types: dict[str, str]) -> DataFrame:
    """A published table (see ``sink_csv_tables``) with the names of its columns in place of its headers."""
    schema = ", ".join(f"`{header}` {types.get(name, 'string')}" for name, header in headers.items())
    rows = scan_csv_shards(spark, path, schema)
    return rows.select(*[F.col(f"`{header}`").alias(name) for name, header in headers.items()])


def scan_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(function_id, function_name, signature_with_docstring) of a stored prompt table."""
    return scan_csv_table(spark, path, PROMPT_HEADERS, {"function_id": "bigint"})


def scan_generations(spark: SparkSession, path: str) -> DataFrame:
    """(function_id, generation_id, generated_content) of a stored table of generations."""
    return scan_csv_table(spark, path, GENERATION_HEADERS, {"function_id": "bigint", "generation_id": "bigint"})

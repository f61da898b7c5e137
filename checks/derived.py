"""Input tables of the operators, derived from the given ones.

``checks.oracle`` holds the same derivations as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.config import CleaningConfig
from corpuskiln.sources.readers import scan_parquet

OWNERS = {
    "org_a": ("src0", "src1", "src2", "src3", "src4"),
    "org_b": ("src5", "src6", "src7", "src8", "src9"),
    "org_c": ("src10", "src11", "src12", "src13", "src14"),
}
ORGS = tuple(OWNERS)
STOPS = ("\nThe", "\nAnd", "\nOf")

# The given texts are prose: looser limits than those for source code.
PROSE = CleaningConfig(line_max=3000, line_mean=600, alpha_frac=0.75, min_token_ratio=2.5, min_assignments=-1)


# The piece of a Parquet file one task reads.
ROW_GROUP_BYTES = 128 * 1024 * 1024


def spread(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; a small one with few files is spread over all cores.

    A file with one row group is one task, whatever its text costs to process.
    Rows move only if the whole table is smaller than a row group per core, so
    a large table is never shuffled here.
    """
    df = scan_parquet(spark, path)
    files, cores = df.inputFiles(), spark.sparkContext.defaultParallelism
    if len(files) >= cores:
        return df
    listing = spark.read.format("binaryFile").load(files)
    size = listing.agg(F.sum("length")).first()[0] or 0
    return df.repartition(cores) if size < cores * ROW_GROUP_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark, f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def raw_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.when(F.col("lang") == "fr", ".md").otherwise(".py")
    return documents(spark, sf_dir).select(
        "doc_id",
        F.concat_ws("/", "source", "lang").alias("repo_name"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string"), suffix).alias("path"),
        F.lit("1").alias("copies"),
        F.col("n_chars").cast("string").alias("size"),
        F.col("text").alias("content"),
    )


def code_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files, contents (shared by equal files) and licenses (two for English repositories)."""
    raw = raw_code(spark, sf_dir).withColumn("id", F.md5("content"))
    contents = raw.groupBy("id").agg(
        F.count("*").alias("copies"),
        F.max(F.col("size").cast("bigint")).alias("size"),
        F.max("content").alias("content"),
        (F.max(F.col("size").cast("bigint")) < 100).alias("binary"),
    )
    repos = raw.select("repo_name").distinct()
    licenses = repos.withColumn("license", F.lit("mit")).unionByName(
        repos.filter(F.col("repo_name").endswith("/en")).withColumn("license", F.lit("apache-2.0"))
    )
    return raw.select("id", "repo_name", "path"), contents, licenses


def python_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python file per document, with its text as the docstring of a method."""
    doc = F.col("doc_id").cast("string")
    content = F.concat(
        F.lit("class C"),
        doc,
        F.lit(":\n    def method_"),
        doc,
        F.lit('(self, x):\n        r"""'),
        F.col("text"),
        F.lit('\n"""\n        return x\n\ndef plain(y):\n    return y\n'),
    )
    return documents(spark, sf_dir).select("doc_id", content.alias("content"))


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as prompts; the generation repeats the prompt before the next assistant turn."""
    turns = table(spark, sf_dir, "conversations")
    users = turns.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    answers = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return users.join(answers, ["conv_id", "turn"]).select(
        "conv_id", "turn", "prompt", F.concat("prompt", "answer").alias("generation")
    )


def client_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        documents(spark, sf_dir)
        .groupBy(F.col("source").alias("client"))
        .agg(F.count("*").alias("num_examples"), F.avg("n_chars").alias("perplexity"))
    )

"""Streaming forms: routing, exact duplicates and incremental counts over arriving files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty
from pyspark.sql.streaming import StreamingQuery

from corpuskiln.functions.text import content_hash
from corpuskiln.operators.collection import ORG_OWNERS, org_route
from corpuskiln.operators.ngrams import ngram_update

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
COMPACT_EVERY = 20
MODEL = "context string, word string, n bigint, first_step int, last_step int"


def read_stream(
    spark: SparkSession, path: str, schema: Ty.StructType, file_glob: str = "*.parquet", files_per_trigger: int = 1000
) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", file_glob)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def stream_org_route(
    rows: DataFrame, out: str, checkpoint: str, owners: dict[str, tuple[str, ...]] = ORG_OWNERS
) -> StreamingQuery:
    """Append each arriving row to the folder of its organisation."""
    return (
        org_route(rows, owners)
        .writeStream.format("parquet")
        .partitionBy("org")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def first_of_stream(rows: DataFrame, text_col: str, keep: Sequence[str]) -> DataFrame:
    """The first row seen of each content hash.

    Only the hash and the kept columns enter the state shuffle, and copies within
    one Arrow batch leave before it, so a hash shared by a third of all rows sends
    one row per batch. The state keeps one entry per distinct hash for good, in RocksDB
    (see ``use_disk_state``).
    """
    hashed = rows.select(*keep, content_hash(F.col(text_col)).alias("hash"))

    def first_in_batch(batches):
        for batch in batches:
            yield batch.drop_duplicates("hash")

    return hashed.mapInPandas(first_in_batch, hashed.schema).dropDuplicates(["hash"])


def use_disk_state(spark: SparkSession) -> None:
    """Keep stream state in RocksDB; the default provider holds all of it in executor memory.

    A batch stores its changes of the state, unless the session says otherwise, not the files of the whole state.
    """
    if not spark.conf.get(STATE_PROVIDER, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(STATE_PROVIDER, ROCKSDB)
    if spark.conf.get(CHANGELOG, None) is None:
        spark.conf.set(CHANGELOG, "true")


def stream_exact_dedup(
    rows: DataFrame, out: str, checkpoint: str, text_col: str = "content", keep: Sequence[str] = ("doc_id",)
) -> StreamingQuery:
    use_disk_state(rows.sparkSession)
    return (
        first_of_stream(rows, text_col, keep)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_ngram_train(
    rows: DataFrame, text_col: str, out: str, checkpoint: str, n: int = 2, compact_every: int = COMPACT_EVERY
) -> StreamingQuery:
    """Write the counts of each batch under ``out``, and now and then the counts of all batches so far.

    A batch writes folders of its own number, so a batch that is run again after a
    failure replaces them by the same rows. Work per batch grows with the batch; the
    whole model is rewritten once in ``compact_every`` batches.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        counts = ngram_update(None, batch, text_col, batch_id + 1, n)
        counts.write.mode("overwrite").parquet(f"{out}/kind=counts/batch={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            whole = latest_model(batch.sparkSession, out, upto=batch_id)
            whole.write.mode("overwrite").parquet(f"{out}/kind=compacted/batch={batch_id}")

    return (
        rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest_model(spark: SparkSession, out: str, upto: int | None = None) -> DataFrame:
    """The model that ``stream_ngram_train`` has left under ``out``, whichever query or driver wrote it.

    The last compacted counts, if any, and those of the batches after them.
    """
    parts = spark.read.schema(f"{MODEL}, kind string, batch bigint").parquet(out)
    if upto is not None:
        earlier = (F.col("kind") == "counts") | (F.col("batch") < upto)
        parts = parts.filter((F.col("batch") <= upto) & earlier)
    last = F.coalesce(parts.filter("kind = 'compacted'").agg(F.max("batch")).scalar(), F.lit(-1))
    wanted = F.when(F.col("kind") == "compacted", F.col("batch") == last).otherwise(F.col("batch") > last)
    return (
        parts.filter(wanted)
        .groupBy("context", "word")
        .agg(F.sum("n").alias("n"), F.min("first_step").alias("first_step"), F.max("last_step").alias("last_step"))
    )

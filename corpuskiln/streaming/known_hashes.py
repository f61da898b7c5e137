"""Exact duplicates in a stream whose memory ends: hashes in state with a time to live, and a start from a batch table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from corpuskiln.functions.text import content_hash
from corpuskiln.streaming.streams import use_disk_state

# hashes share a state group, so Python is called once a group and batch, not once a hash
GROUPS = 4096
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


class FirstOfHash(StatefulProcessor):
    """Lets the first row of a hash pass, and remembers the hash for ``expiry_ms`` from then on (for good if None).

    A copy does not prolong the memory. The time is that of the batch. Each hash of a group is an entry of its own in
    the store, looked up by its key; a group is never read whole.
    """

    def __init__(self, columns: Sequence[str], expiry_ms: int | None):
        self.columns, self.expiry_ms = list(columns), expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "hash string", "known boolean", self.expiry_ms)

    def _is_new(self, digest: str) -> bool:
        if self.seen.containsKey((digest,)):
            return False
        self.seen.updateValue((digest,), (True,))
        return True

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for digest in initialState["hash"]:
            self.seen.updateValue((digest,), (True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            single = batch.drop_duplicates("hash")
            yield single.loc[[self._is_new(digest) for digest in single["hash"]], self.columns]


def unseen_rows(
    rows: DataFrame,
    text_col: str,
    keep: Sequence[str],
    known: DataFrame | None = None,
    expiry_ms: int | None = None,
    groups: int = GROUPS,
) -> DataFrame:
    """(keep..., hash) of the first row of every content hash that is not known.

    ``known`` has a column ``hash``, repeats allowed; it becomes the state of the first batch and is not read again by a
    query that is restarted from its checkpoint. Its hashes end like all others, counted from that batch.
    State: one entry a hash, in RocksDB, which Spark drops after its time; with an expiry no more than the
    hashes that arrive in that time, and those of ``known``. Null texts share the hash of an empty one.
    The hashes are dealt evenly over ``groups``, which bounds the tasks at work; it is fixed for a checkpoint.
    Texts never enter the state shuffle. Copies of one Arrow batch are dropped before it, so a hash of a third of all
    rows sends one row a batch of its scan.
    """
    hashed = rows.select(*keep, F.coalesce(content_hash(F.col(text_col)), content_hash(F.lit(""))).alias("hash"))

    def first_in_batch(batches):
        for batch in batches:
            yield batch.drop_duplicates("hash")

    def grouped(df):
        return df.withColumn("_group", F.pmod(F.xxhash64("hash"), F.lit(groups)).cast("int")).groupBy("_group")

    start = None if known is None else grouped(known.select("hash").filter("hash IS NOT NULL").distinct())
    return grouped(hashed.mapInPandas(first_in_batch, hashed.schema)).transformWithStateInPandas(
        FirstOfHash(hashed.columns, expiry_ms),
        hashed.schema,
        "Append",
        "None" if expiry_ms is None else "ProcessingTime",
        start,
    )


def stream_exact_dedup_known(
    rows: DataFrame,
    out: str,
    checkpoint: str,
    known: DataFrame | None = None,
    expiry_ms: int | None = None,
    text_col: str = "content",
    keep: Sequence[str] = ("doc_id",),
) -> StreamingQuery:
    """Append the rows of ``unseen_rows`` to ``out``; all that has arrived is handled, then the query ends.

    State that ends would ask for one more batch for ever, so this query runs batches for rows only; ended
    hashes leave the state with the next of them.
    """
    spark = rows.sparkSession
    use_disk_state(spark)
    writer = (
        unseen_rows(rows, text_col, keep, known, expiry_ms)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    before = spark.conf.get(EMPTY_BATCHES)
    spark.conf.set(EMPTY_BATCHES, "false")
    try:  # a query keeps the settings of its start
        return writer.start()
    finally:
        spark.conf.set(EMPTY_BATCHES, before)

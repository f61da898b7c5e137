"""Exact duplicates by a tree-merge of sorted digest runs, with DataFrame functions only.

Every document becomes a narrow row: id and digests of its whole text. The rows
are dealt over nodes; each node merges the sorted runs that all scan tasks send it
(the sort aggregate below) into one run, with one entry a digest. Rounds follow a binomial tree:
in round r the nodes whose bit r is set, and no lower one, send their run to the node without
that bit, which merges it with its own and keeps one identifier a digest. So half of the
nodes leave in each round, and node 0 holds the result. A digest that fills a third of the
corpus travels as one entry a node, never as its rows, and the run of a node is dealt
over all tasks by digest.

Verified: an entry is keyed on SHA-256, MD5 and the length in bytes together, at
every level, so two texts merge only if all three agree. No text moves.

Defined cases: a null text equals the empty text. A null id loses against every
other id. Of rows that repeat both id and text one stays. Other columns of the
input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.scratch import write_scratch

LEAVES = 64
# nodes that merge into one of them in a round; 2 gives binomial rounds
FAN_IN = 2
KEY = ("sha256", "md5", "n_bytes")


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored rows (doc_id, row_id, digests): the only pass over the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.monotonically_increasing_id().alias("row_id"),
        F.unhex(F.sha2(text, 256)).alias("sha256"),
        F.unhex(F.md5(text)).alias("md5"),
        F.octet_length(text).alias("n_bytes"),
    )
    return write_scratch(rows, "digests")


def merge_runs(rows: DataFrame, largest: bool = True, leaves: int = LEAVES, fan_in: int = FAN_IN) -> DataFrame:
    """One row a text: its digests, ``keep`` (doc_id, row_id) and ``group_size``.

    ``leaves`` and ``fan_in`` shape the tree only; the rows are the same for all.
    """
    best = F.max if largest else F.min
    runs = rows.select(
        *KEY,
        F.pmod(F.xxhash64("row_id"), F.lit(leaves)).alias("node"),
        F.struct("doc_id", "row_id").alias("keep"),
        F.lit(1).cast("bigint").alias("n"),
    )
    reach = 1
    while True:
        receiver = F.col("node") - F.pmod("node", F.lit(reach))
        runs = runs.groupBy(receiver.alias("node"), *KEY).agg(best("keep").alias("keep"), F.sum("n").alias("n"))
        if reach >= leaves:
            return runs.drop("node").withColumnRenamed("n", "group_size")
        reach *= fan_in


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True
) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    ``largest`` says which id of equal texts stays. An empty table gives an empty result.
    """
    rows = digest_rows(docs, id_col, text_col)
    return _decide(rows, largest).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _decide(rows: DataFrame, largest: bool) -> DataFrame:
    # stored, so that the join reads two tables and adaptive execution can split a hot digest in it
    merged = write_scratch(merge_runs(rows, largest), "merged-runs")
    return rows.join(merged, list(KEY)).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("keep.row_id")).alias("kept"),
        F.lower(F.hex("sha256")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has no copy with a larger id, all columns kept.

    Removed (id, digest) pairs travel, never texts: the anti-join's small side is
    the list of what goes. Rows that repeat a kept id and text are thinned to one.
    """
    decided = write_scratch(_decide(digest_rows(docs, id_col, text_col), True), "decided")
    keys = ["__id", "__sha256"]
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
        F.col(id_col).alias("__id"),
        F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("__sha256"),
    )
    verdict = decided.groupBy(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha256")).agg(
        F.max("kept").alias("__kept"), F.count("*").alias("__rows")
    )
    null_safe = lambda a, b: a["__id"].eqNullSafe(b["__id"]) & (a["__sha256"] == b["__sha256"])
    gone = verdict.filter("NOT __kept OR __rows > 1")
    kept = keyed.join(gone, null_safe(keyed, gone), "left_anti")
    repeats = verdict.filter("__kept AND __rows > 1").select(*keys)
    if repeats.limit(1).count():
        thinned = keyed.join(repeats, null_safe(keyed, repeats), "left_semi").dropDuplicates(keys)
        kept = kept.unionByName(thinned)
    return kept.select("__row.*")

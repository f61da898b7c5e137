"""Global positions, seeded shuffles and exact splits without a one-task sort.

A position is the row's place inside its chunk plus the rows of all earlier
chunks. Chunks are ranges of the sort key. Many chunks are added up the same way, by
ranges of chunks, so no window sees more than ``CHUNK_IDS`` rows, however the
keys are spread over the 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty
from pyspark.sql.window import Window

from corpuskiln import config
from corpuskiln.functions.hashing import hex_int, order_hash, uniform_draw
from corpuskiln.scratch import write_scratch

CHUNK_IDS = 65_536
# ranges of ranges: 2^16 keys, 2^32 keys, 2^48 keys
CHUNK_LEVELS = 2
HASH_PREFIX = 4
# rows of one buffer slot in a range of positions, on average
SLOT_ROWS = 1_024


def id_chunk(key: Column, size: int = CHUNK_IDS) -> Column:
    """Range of ``size`` consecutive integer keys."""
    return F.floor(key / F.lit(size)).cast("bigint")


def _before(aggregate, value: str, order: Sequence, by: Sequence[str]) -> Column:
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return aggregate(value).over(window)


def _chunk_starts(chunks: DataFrame, aggregate, merge, by: list[str], levels: int) -> DataFrame:
    """(by, _chunk, _start): what all earlier chunks add up to."""
    if levels == 0:
        return chunks.select(*by, "_chunk", _before(aggregate, "_all", ["_chunk"], by).alias("_start"))
    ranged = chunks.withColumn("_range", id_chunk(F.col("_chunk")))
    ranges = ranged.groupBy(*by, F.col("_range").alias("_chunk")).agg(aggregate("_all").alias("_all"))
    upper = _chunk_starts(ranges, aggregate, merge, by, levels - 1).select(
        *by, F.col("_chunk").alias("_range"), F.col("_start").alias("_upper")
    )
    inside = ranged.withColumn("_lower", _before(aggregate, "_all", ["_chunk"], [*by, "_range"]))
    return inside.join(upper, [*by, "_range"]).select(
        *by, "_chunk", merge(F.col("_upper"), F.col("_lower")).alias("_start")
    )


def _running(df, value, aggregate, merge, order, chunk, out, by) -> DataFrame:
    by = list(by)
    keyed = df.withColumns({"_chunk": chunk, "_value": value})
    # stored, since every level reads it; each level would scan the input again
    chunks = write_scratch(keyed.groupBy(*by, "_chunk").agg(aggregate("_value").alias("_all")), "chunks")
    numbered = chunks.schema["_chunk"].dataType == Ty.LongType()
    levels = CHUNK_LEVELS if numbered and chunks.count() > CHUNK_IDS else 0
    starts = _chunk_starts(chunks, aggregate, merge, by, levels)
    placed = keyed.withColumn("_inside", _before(aggregate, "_value", order, [*by, "_chunk"]))
    return (
        placed.join(starts, [*by, "_chunk"])
        .withColumn(out, merge(F.col("_start"), F.col("_inside")))
        .drop("_chunk", "_value", "_start", "_inside")
    )


def running_total(
    df: DataFrame, value: Column, order: Sequence[Column], chunk: Column, out: str, by: Sequence[str] = ()
) -> DataFrame:
    """Add the sum of ``value`` over all rows before this one, per ``by`` group.

    ``chunk`` must not decrease along ``order``, and a chunk must hold a bounded
    number of rows.
    """

    def merge(start: Column, inside: Column) -> Column:
        return (F.coalesce(start, F.lit(0)) + F.coalesce(inside, F.lit(0))).cast("bigint")

    return _running(df, value, F.sum, merge, order, chunk, out, by)


def running_minimum(
    df: DataFrame, value: Column, order: Sequence[Column], chunk: Column, out: str, by: Sequence[str] = ()
) -> DataFrame:
    """Add the least ``value`` among all rows before this one; NULL if there is none."""
    return _running(df, value, F.min, F.least, order, chunk, out, by)


def number_rows(
    df: DataFrame, order: Sequence[Column], chunk: Column, out: str, by: Sequence[str] = (), start: int = 0
) -> DataFrame:
    """Consecutive numbers from ``start`` along ``order``, per ``by`` group."""
    numbered = running_total(df, F.lit(1), order, chunk, out, by)
    return numbered.withColumn(out, F.col(out) + start) if start else numbered


def running_function_id(
    functions: DataFrame, file_col: str, position_col: str, out: str = "function_id", chunk: int = CHUNK_IDS
) -> DataFrame:
    """Ids from 1 in file order, then in the order of functions inside a file."""
    file_id = F.col(file_col)
    return number_rows(functions, [file_id, F.col(position_col)], id_chunk(file_id, chunk), out, start=1)


def seeded_shuffle(df: DataFrame, id_col: str, seed: int, out: str = "position", prefix: int = HASH_PREFIX) -> DataFrame:
    """Position of each row in a full shuffle; the hash prefix forms the chunks."""
    hashed = df.withColumn("_order", order_hash(F.col(id_col), seed))
    key = F.col("_order")
    return number_rows(hashed, [key], hex_int(key, prefix), out).drop("_order")


def buffer_shuffle(
    df: DataFrame,
    position_col: str,
    id_col: str,
    seed: int,
    buffer: int = config.SHUFFLE_BUFFER,
    out: str = "shuffled_position",
    chunk: int = CHUNK_IDS,
) -> DataFrame:
    """Local shuffle: a row moves by less than ``buffer`` places."""
    place = F.col(position_col).cast("double") + uniform_draw(F.col(id_col), "buffer", seed) * F.lit(float(buffer))
    keyed = df.withColumn("_place", place)
    order = [F.col("_place"), F.col(position_col)]
    return number_rows(keyed, order, id_chunk(F.col("_place"), chunk), out).drop("_place")


def reservoir_shuffle(
    df: DataFrame,
    position_col: str,
    seed: int,
    buffer: int = config.SHUFFLE_BUFFER,
    out: str = "shuffled_position",
    slot_rows: int = SLOT_ROWS,
) -> DataFrame:
    """Place of each row after a buffer of ``buffer`` rows, as a reader with such a buffer hands them out.

    The first rows fill the slots; each later row takes a drawn slot, and the row that held it
    goes out. At the end the rows still held go out in a seeded order. So a row leaves when the next one draws its
    slot, and its place is found among the rows of that slot alone. Slots are cut into
    ranges of positions; what a range still holds goes out by the first draw of its slot in a later range. The draw depends on
    the position and the seed only, so the places do not depend on partitions, and no row is sorted
    but with those of its slot and range.

    Positions are gapless from 0. The seeded order at the end holds at most ``buffer`` rows.
    """
    place = F.col(position_col).cast("bigint")
    drawn = F.floor(uniform_draw(place - buffer, "slot", seed) * F.lit(float(buffer))).cast("bigint")
    placed = df.withColumns(
        {"_place": place, "_slot": F.when(place < buffer, place).otherwise(drawn), "_range": id_chunk(place, buffer * slot_rows)}
    )
    firsts = placed.groupBy("_slot", "_range").agg(F.min("_place").alias("_first"))
    later = Window.partitionBy("_slot").orderBy("_range")
    carried = firsts.select("_slot", "_range", F.lead("_first").over(later).alias("_carried"))
    inside = Window.partitionBy("_slot", "_range").orderBy("_place")
    followed = (
        placed.withColumn("_next", F.lead("_place").over(inside))
        .join(carried, ["_slot", "_range"])
        .withColumn("_next", F.coalesce("_next", "_carried"))
        .drop("_slot", "_range", "_carried")
    )
    followed = write_scratch(followed, "slots")
    # the last row is always among those still held, so they know the number of rows
    held = Window.orderBy(order_hash(F.col("_place"), seed), "_place")
    all_held = Window.partitionBy()
    last = followed.filter(F.col("_next").isNull()).withColumn(
        out, F.max("_place").over(all_held) + 1 - F.count("*").over(all_held) + F.row_number().over(held) - 1
    )
    out_early = followed.filter(F.col("_next").isNotNull()).withColumn(out, F.col("_next") - buffer)
    return out_early.unionByName(last).drop("_place", "_next")


def split_boundary(df: DataFrame, id_col: str, fraction: float, seed: int, prefix: int = HASH_PREFIX) -> DataFrame:
    """One row with the largest order hash that still belongs to the test part.

    Counts per hash prefix locate the prefix where the cut falls; only the rows
    of that prefix are ranked.
    """
    hashed = df.select(order_hash(F.col(id_col), seed).alias("_order"))
    total = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = hashed.groupBy(F.substring("_order", 1, prefix).alias("_prefix")).agg(F.count("*").alias("_rows"))
    cut = (
        counts.withColumns({"_upto": F.sum("_rows").over(upto), "_all": F.sum("_rows").over(total)})
        .withColumn("_wanted", F.ceil(F.lit(fraction) * F.col("_all")))
        .filter((F.col("_upto") >= F.col("_wanted")) & (F.col("_upto") - F.col("_rows") < F.col("_wanted")))
        .select("_prefix", (F.col("_wanted") - F.col("_upto") + F.col("_rows")).alias("_rank"))
    )
    # ``cut`` is a single row, so the broadcast has a fixed size
    inside = hashed.withColumn("_prefix", F.substring("_order", 1, prefix)).join(F.broadcast(cut), "_prefix")
    ranked = inside.withColumn("_place", F.row_number().over(Window.partitionBy("_prefix").orderBy("_order")))
    return ranked.filter(F.col("_place") == F.col("_rank")).select("_order")


def train_valid_split(
    df: DataFrame,
    id_col: str,
    fraction: float = config.SPLIT_TEST_FRACTION,
    seed: int = config.SPLIT_SEED,
    prefix: int = HASH_PREFIX,
) -> DataFrame:
    """Add ``split``: exactly ceil(fraction * rows) rows are 'test', the rest 'train'.

    The cut is a scalar subquery, so the rows themselves are not shuffled.
    """
    boundary = split_boundary(df, id_col, fraction, seed, prefix).scalar()
    in_test = order_hash(F.col(id_col), seed) <= boundary
    return df.withColumn("split", F.when(in_test, F.lit("test")).otherwise(F.lit("train")))

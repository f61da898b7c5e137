"""A blocked Bloom filter as a small table, so that a large scan drops rows before anything is shuffled.

Each key sets a few bits of one 64-bit block. Blocks are merged by ``bit_or``, in the tasks first and
then by block, so the table has at most ``blocks`` rows whatever the number of keys. That
bound is what allows it to be sent to every task. A key that was added is never lost; of
others a few pass, more the fuller the blocks are, and an exact join behind the filter removes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 2 ** 20 rows of 16 bytes; with 8 million keys about one other key in 30 passes, with a million one in 2,000
BLOCKS = 1 << 20
BITS = 4
SIX_BITS = 63


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column) -> Column:
    """The bits of a key inside its block, from a hash of its own."""
    chosen, mask = F.xxhash64(key, F.lit("bits")), F.lit(0).cast("bigint")
    for k in range(BITS):
        bit = F.shiftrightunsigned(chosen, 6 * k).bitwiseAND(F.lit(SIX_BITS)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return mask


def bloom_filter(keys: DataFrame, key: str, blocks: int = BLOCKS) -> DataFrame:
    """(_block, _bits) of all keys, at most ``blocks`` rows."""
    return keys.groupBy(_block(F.col(key), blocks).alias("_block")).agg(F.bit_or(_mask(F.col(key))).alias("_bits"))


def maybe_in(rows: DataFrame, key: str, keys: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Rows whose key may be in the filter ``keys``: all that are, and a few others. No row is shuffled."""
    marked = rows.withColumns({"_block": _block(F.col(key), blocks), "_wanted": _mask(F.col(key))})
    found = marked.join(F.broadcast(keys), "_block")  # bounded by its number of blocks
    return found.filter(F.col("_bits").bitwiseAND(F.col("_wanted")) == F.col("_wanted")).drop("_block", "_wanted", "_bits")


def seen_in(rows: DataFrame, key: str, keys: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """As ``maybe_in``, as a semi-join, which the planner moves below columns made of other columns: they are made for rows that pass only."""
    block, mask = _block(F.col(key), blocks), _mask(F.col(key))
    hit = (block == F.col("_block")) & (F.col("_bits").bitwiseAND(mask) == mask)
    return rows.join(F.broadcast(keys), hit, "left_semi")

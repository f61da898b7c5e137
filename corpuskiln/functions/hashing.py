"""Hashes and repeatable random draws built on md5 and 64-bit integers.

md5 and integer arithmetic mean the same on every engine, so each value
here can be recomputed outside Spark.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_RANGE = 1 << 32


def hex_int(hexed: Column, digits: int) -> Column:
    """The first ``digits`` hex digits as a BIGINT."""
    return F.conv(F.substring(hexed, 1, digits), 16, 10).cast("bigint")


def order_hash(key: Column, seed: int) -> Column:
    """md5 of the id and the seed: a seeded random order over unique ids."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def uniform_draw(key: Column, salt: str, seed: int) -> Column:
    """Repeatable uniform number in [0, 1) per id; one ``salt`` per use."""
    hexed = F.md5(F.concat_ws(":", key.cast("string"), F.lit(salt), F.lit(str(seed))))
    return hex_int(hexed, 8).cast("double") / F.lit(float(DRAW_RANGE))

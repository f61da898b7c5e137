"""MinHash signatures and the pairs of files that share a band of one."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskiln.config import NearDupConfig
from corpuskiln.functions import text as T
from corpuskiln.functions.batches import slices
from corpuskiln.operators.skew import join_hot_keys
from corpuskiln.scratch import write_scratch

MERSENNE_31 = 2_147_483_647
# hash functions whose values a worker holds at once, words it hashes or compares at once
LANES = 64
BLOCK = 1024
# files of a group, or groups of a bucket, that meet those of another block in one row
PAIR_BLOCK = 1024


def permutation_coefficients(num_perm: int) -> tuple[list[int], list[int]]:
    """Multipliers and offsets of the hash family (a*h + b) mod (2^31 - 1)."""

    def seven_digits(label: str) -> int:
        return int(hashlib.md5(label.encode()).hexdigest()[:7], 16)

    return (
        [1 + seven_digits(f"a{i}") for i in range(num_perm)],
        [seven_digits(f"b{i}") for i in range(num_perm)],
    )


@lru_cache(maxsize=None)
def band_layout(threshold: float, num_perm: int) -> tuple[int, int]:
    """(bands, rows per band) with the least false positives plus false negatives.

    A pair of similarity s shares a band with probability 1 - (1 - s^r)^b; both
    error areas around the threshold weigh the same.
    """
    below = (np.arange(1000) + 0.5) / 1000 * threshold
    above = threshold + (np.arange(1000) + 0.5) / 1000 * (1 - threshold)
    best = None
    for bands in range(1, num_perm + 1):
        for rows in range(1, num_perm // bands + 1):
            false_hits = np.mean(1 - (1 - below**rows) ** bands) * threshold
            misses = np.mean((1 - above**rows) ** bands) * (1 - threshold)
            error = 0.5 * false_hits + 0.5 * misses
            if best is None or error < best[0]:
                best = (error, bands, rows)
    return best[1], best[2]


def _permuted(hashed: np.ndarray, multipliers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(a*h + b) mod (2^31 - 1) of 28-bit hashes, one row a hash and one column a function.

    2^31 is 1 modulo this prime, so the upper bits are added to the lower ones; the sum is below twice the prime,
    and subtracting it once wraps to a large number where it was not due.
    """
    out = np.empty((len(hashed), len(multipliers)), dtype=np.uint32)
    for at in range(0, len(hashed), BLOCK):
        value = hashed[at : at + BLOCK, None] * multipliers + offsets
        folded = ((value & MERSENNE_31) + (value >> 31)).astype(np.uint32)
        np.minimum(folded, folded - np.uint32(MERSENNE_31), out=out[at : at + BLOCK])
    return out


def signature_of(text: Column, num_perm: int, min_tokens: int) -> Column:
    """Signature of the words of a text, as ``num_perm`` BIGINT slots; NULL below ``min_tokens`` words.

    Runs on slices of Arrow batches: words are cut by two vectorized calls, each distinct
    word of a slice is hashed once, and a slot is the minimum over the distinct words of a row.
    """
    # bytes of other alphabets are 128 or more, and break words
    word_bytes = [code if code < 128 and not re.fullmatch(T.WORD_BREAK, chr(code)) else ord(" ") for code in range(256)]
    word_bytes = np.array(word_bytes, dtype=np.uint8)
    multipliers, offsets = (np.array(x, dtype=np.int64) for x in permutation_coefficients(num_perm))

    def split_words(rows):
        rows = rows.cast(pa.string())
        ends = np.frombuffer(rows.buffers()[1], dtype=np.int32)[rows.offset : rows.offset + len(rows) + 1]
        data = rows.buffers()[2]
        data = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, dtype=np.uint8)
        plain = pa.StringArray.from_buffers(len(rows), pa.py_buffer(ends - ends[0]), pa.py_buffer(word_bytes[data]))
        return pc.ascii_split_whitespace(plain)

    def sign_rows(rows):
        pieces = split_words(rows)
        words = pc.list_flatten(pieces)
        owners = pc.list_parent_indices(pieces)
        filled = pc.greater(pc.binary_length(words), 0)
        owners = pc.filter(owners, filled).to_numpy(zero_copy_only=False)
        coded = pc.filter(words, filled).dictionary_encode()
        # the first seven hex digits
        heads = b"".join([hashlib.md5(word).digest()[:4] for word in coded.dictionary.cast(pa.binary()).to_pylist()])
        hashed = np.frombuffer(heads, dtype=">u4").astype(np.int64) >> 4
        counts = np.bincount(owners, minlength=len(rows))
        signed = counts >= min_tokens
        codes = coded.indices.to_numpy(zero_copy_only=False)
        width = max(len(hashed), 1)
        # 32-bit keys sort several times faster
        key = np.int32 if len(rows) * width <= MERSENNE_31 else np.int64
        kept = signed[owners]
        keys = owners[kept].astype(key) * key(width) + codes[kept].astype(key)
        keys.sort()
        distinct = keys[np.flatnonzero(np.diff(keys, prepend=key(-1)))]
        where, owner = distinct % width, distinct // width
        bounds = np.flatnonzero(np.diff(owner, prepend=key(-1), append=key(-1))).tolist()
        slots = np.zeros((int(signed.sum()), num_perm), dtype=np.int64)
        for lane in range(0, num_perm, LANES):
            lanes = slice(lane, lane + LANES)
            permuted = _permuted(hashed, multipliers[lanes], offsets[lanes])
            for row, (start, end) in enumerate(pairwise(bounds)):
                least = permuted.take(where[start : min(end, start + BLOCK)], axis=0).min(axis=0)
                for at in range(start + BLOCK, end, BLOCK):
                    least = np.minimum(least, permuted.take(where[at : min(end, at + BLOCK)], axis=0).min(axis=0))
                slots[row, lanes] = least
        bounds = np.concatenate(([0], np.cumsum(signed * num_perm))).astype(np.int32)
        return pa.ListArray.from_arrays(bounds, slots.ravel(), mask=pa.array(~signed))

    @F.arrow_udf("array<bigint>")
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for rows in slices(texts):
                yield sign_rows(rows)

    # a filter on the signature must not be pushed below it: it would sign every text twice
    return sign.asNondeterministic()(text)


def minhash_signature(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "content", config: NearDupConfig = NearDupConfig()
) -> DataFrame:
    """(id, signature) of every file with enough words, repeats counted."""
    signature = signature_of(F.col(text_col), config.num_perm, config.min_tokens)
    return df.select(id_col, signature.alias("signature")).filter(F.col("signature").isNotNull())


def band_buckets(signatures: DataFrame, id_col: str, config: NearDupConfig = NearDupConfig()) -> DataFrame:
    """(bucket, id) rows: one 16-byte bucket per band of each signature."""
    bands, rows = band_layout(config.jaccard_threshold, config.num_perm)
    # all bands read the slots as text, so that is a column of its own
    texts = signatures.select(id_col, F.col("signature").cast("array<string>").alias("_slots"))
    keys = [
        F.unhex(F.md5(F.concat_ws(",", F.lit(str(band)), F.slice("_slots", band * rows + 1, rows))))
        for band in range(bands)
    ]
    return texts.select(F.explode(F.array(*keys)).alias("bucket"), id_col)


def shared_buckets(buckets: DataFrame, id_col: str, config: NearDupConfig = NearDupConfig()) -> DataFrame:
    """(bucket, id, root, n) of buckets with two files or more; ``root`` is the smallest id.

    ``buckets`` is read twice, so pass a stored table.
    """
    per_bucket = write_scratch(
        buckets.groupBy("bucket")
        .agg(F.min(id_col).alias("root"), F.count("*").alias("n"))
        .filter(F.col("n") > 1),
        "repeated-buckets",
    )
    counts = per_bucket.select("bucket", "n")
    return join_hot_keys(buckets, per_bucket, ["bucket"], id_col, config.hot_rows, counts)


def star_pairs(shared: DataFrame, id_col: str, config: NearDupConfig = NearDupConfig()) -> DataFrame:
    """Pairs (id_a < id_b) that connect the files of each bucket, for ``connected_components``.

    Files link to the smallest id of their part of the bucket, and these link to
    the smallest id of the bucket: n - 1 pairs instead of n^2, with the same
    connected components. A part has about ``chunk`` files, which bounds the
    links of a vertex.
    """
    parts = F.ceil(F.col("n") / F.lit(config.chunk)).cast("int")
    chunked = shared.withColumn("_part", F.pmod(F.xxhash64(id_col), parts))
    centres = chunked.groupBy("bucket", "_part").agg(F.min(id_col).alias("_centre"), F.min("root").alias("root"))
    members = chunked.join(centres.drop("root"), ["bucket", "_part"]).select(
        F.col("_centre").alias("id_a"), F.col(id_col).alias("id_b")
    )
    roots = centres.select(F.col("root").alias("id_a"), F.col("_centre").alias("id_b"))
    return members.unionByName(roots).filter(F.col("id_a") < F.col("id_b")).distinct()


def stored_buckets(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "content", config: NearDupConfig = NearDupConfig()
) -> DataFrame:
    """The shared buckets of a corpus, written once for the steps that follow."""
    signatures = minhash_signature(df, id_col, text_col, config)
    buckets = write_scratch(band_buckets(signatures, id_col, config), "buckets")
    return write_scratch(shared_buckets(buckets, id_col, config), "shared-buckets")


def star_links(shared: DataFrame, id_col: str) -> DataFrame:
    """Pairs (id_a < id_b): the smallest file of a bucket and each other file in it."""
    pairs = shared.filter(F.col(id_col) > F.col("root"))
    return pairs.select(F.col("root").alias("id_a"), F.col(id_col).alias("id_b")).distinct()


def _linked_groups(groups: DataFrame, block: int) -> DataFrame:
    """(first, second): groups that share a bucket, each pair found at its first common bucket only.

    The groups of a bucket are dealt into parts of about ``block``, and each two parts of a bucket meet under a key of their own.
    """
    placed = groups.select("group", "buckets", F.posexplode("buckets").alias("_at", "bucket"))
    parts = placed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    parts = parts.select("bucket", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("_parts"))
    dealt = placed.join(parts, "bucket").select(
        "bucket",
        "group",
        F.slice("buckets", F.lit(1), F.col("_at")).alias("_earlier"),
        "_parts",
        F.pmod(F.xxhash64("group"), F.col("_parts")).cast("int").alias("_part"),
    )
    dealt = write_scratch(dealt, "bucket-parts")
    low = dealt.select(
        "bucket",
        F.col("group").alias("first"),
        F.col("_earlier").alias("_before_first"),
        F.col("_part").alias("_low"),
        F.explode(F.sequence(F.col("_part"), F.col("_parts") - 1)).alias("_high"),
    )
    high = dealt.select(
        "bucket",
        F.col("group").alias("second"),
        F.col("_earlier").alias("_before_second"),
        F.explode(F.sequence(F.lit(0), F.col("_part"))).alias("_low"),
        F.col("_part").alias("_high"),
    )
    once = (F.col("_low") < F.col("_high")) | (F.col("first") < F.col("second"))
    new = ~F.arrays_overlap("_before_first", "_before_second")
    return low.join(high, ["bucket", "_low", "_high"]).filter(once & new).select("first", "second")


def bucket_links(
    shared: DataFrame, id_col: str, config: NearDupConfig = NearDupConfig(), block: int = PAIR_BLOCK
) -> DataFrame:
    """Pairs (id_a < id_b) of all files that share a bucket, each pair once.

    The rows grow with the square of a bucket, so pairs are made last and are not shuffled: files with the same buckets
    form a group, groups that share a bucket are found once, and what is dealt over the tasks are pairs of blocks of at
    most about ``block`` files, which a task unfolds row by row.
    """
    files = shared.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    keyed = files.agg(F.array_sort(F.collect_set("bucket")).alias("buckets"))
    digest = F.unhex(F.md5(F.array_join(F.transform("buckets", lambda bucket: F.hex(bucket)), ",")))
    keyed = write_scratch(keyed.withColumn("_set", digest), "file-buckets")
    groups = write_scratch(
        keyed.groupBy("_set").agg(F.min("id").alias("group"), F.count("*").alias("n"), F.first("buckets").alias("buckets")),
        "bucket-groups",
    )
    named = join_hot_keys(
        keyed.select("_set", "id"),
        groups.select("_set", "group", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("_parts")),
        ["_set"],
        "id",
        config.hot_rows,
        groups.select("_set", "n"),
    )
    blocks = named.groupBy("group", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int").alias("_block"))
    blocks = write_scratch(blocks.agg(F.collect_list("id").alias("_ids")), "group-blocks")
    copies = groups.filter("n > 1").select(F.col("group").alias("first"), F.col("group").alias("second"))
    met = _linked_groups(groups, block).unionByName(copies)
    left = blocks.select(F.col("group").alias("first"), F.col("_block").alias("_a"), F.col("_ids").alias("_left"))
    right = blocks.select(F.col("group").alias("second"), F.col("_block").alias("_b"), F.col("_ids").alias("_right"))
    inside = F.col("first") == F.col("second")
    cells = met.join(left, "first").join(right, "second").filter(~inside | (F.col("_a") <= F.col("_b")))
    cells = cells.repartition("first", "_a", "second", "_b")
    same = (inside & (F.col("_a") == F.col("_b"))).alias("_same")
    pairs = cells.select(same, F.explode("_left").alias("_x"), "_right").select("_same", "_x", F.explode("_right").alias("_y"))
    pairs = pairs.filter(~F.col("_same") | (F.col("_x") < F.col("_y")))
    return pairs.select(F.least("_x", "_y").alias("id_a"), F.greatest("_x", "_y").alias("id_b"))


def lsh_candidates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "content",
    config: NearDupConfig = NearDupConfig(),
    mode: str = "pairs",
) -> DataFrame:
    """Candidate pairs of a corpus: all pairs of files that share a bucket.

    ``stars`` gives n - 1 of them for the n files of a bucket, from its smallest file to each other one.
    """
    shared = stored_buckets(df, id_col, text_col, config)
    if mode == "pairs":
        return bucket_links(shared, id_col, config)
    if mode == "stars":
        return star_links(shared, id_col)
    raise ValueError(f"unknown mode {mode!r}")

"""All pairs of token sets with a Jaccard similarity of at least a threshold, exact, without comparing all pairs.

Copies become one set first. Similar sets differ in few tokens: dealt by hash into more segments than
that, they have a segment with the same tokens, so only sets with an equal segment of like size meet, and what
meets is compared in full. A segment is several tokens, so other sets seldom meet, and no order of the tokens is needed.
No signature is drawn, so no pair is found or lost by chance.

Below ``SEGMENT_THRESHOLD`` segments would be too short. There tokens stand in one global order, rare ones first. Two sets that
are similar enough share a token among the first few of both, so only those prefixes are indexed and
joined. A common token at known positions bounds the overlap that is still possible, and the
sizes bound the similarity; sets only meet those of their class of sizes and the next, and 256 parity bits of
either bound their difference; pairs that fail any of these never leave the join.

A token that many prefixes hold is spread over parts of about ``hot_rows`` sets. Similar sets are the result, so a group
of n *different* sets that are all similar has all its pairs in it; use clusters for those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskiln.functions import text as T
from corpuskiln.functions.batches import SLICE_ROWS
from corpuskiln.operators.bloom import bloom_filter, seen_in
from corpuskiln.operators.skew import join_hot_keys
from corpuskiln.scratch import write_scratch

HOT_SETS = 50_000
# sets of a list that meet those of another block in one row
BLOCK_SETS = 1024
# tokens of the sets that are compared in one step
CELL_TOKENS = 1 << 20
# from here on a segment holds more than two tokens on average
SEGMENT_THRESHOLD = 0.7
HALF = np.uint64(0xFFFFFFFF)
# segments that are dealt and not kept, as a share of those kept
SPARE = 0.25
# 64-bit words of parities that an entry of the index carries
PARITY_WORDS = 4
BITS = [f"bits{word}" for word in range(PARITY_WORDS)]
# rounding of threshold times size must not raise a bound
SLACK = 1e-9


@dataclass
class SetPairs:
    """``pairs`` (id_a, id_b, jaccard) of representatives, ``members`` (id, representative) of all rows."""

    pairs: DataFrame
    members: DataFrame


def _at_least(value: Column) -> Column:
    return F.ceil(value - F.lit(SLACK)).cast("int")


def token_frequencies(sets: DataFrame) -> DataFrame:
    """(token, n): in how many sets each token occurs."""
    return sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def ordered_sets(sets: DataFrame, hot_rows: int = HOT_SETS) -> DataFrame:
    """(id, tokens): the tokens of each set with the rarest of the corpus first, equally rare ones by name."""
    counts = write_scratch(token_frequencies(sets), "token-counts")
    exploded = sets.select("id", F.explode("tokens").alias("token"))
    ranked = join_hot_keys(exploded, counts, ["token"], "id", hot_rows, counts)
    gathered = ranked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("_ranked"))
    return gathered.select("id", F.col("_ranked.token").alias("tokens"))


def _parities() -> list[Column]:
    """256 bits: each says whether an odd number of the set's tokens hash to it. Sets that differ in k tokens differ in at most k bits."""
    return [
        F.expr(
            f"aggregate(filter(_hashes, h -> (h & {PARITY_WORDS - 1}) = {word}), 0L,"
            " (bits, h) -> bits ^ shiftleft(1L, cast((h >> 8) & 63 as int)))"
        ).alias(f"bits{word}")
        for word in range(PARITY_WORDS)
    ]


def prefixes(ordered: DataFrame, threshold: float) -> DataFrame:
    """(token, id, size, pos, bits): the index. A set of s tokens has s - ceil(threshold s) + 1 entries."""
    size = F.size("tokens")
    hashed = ordered.withColumn("_hashes", F.transform("tokens", lambda token: F.xxhash64(token)))
    shown = F.slice("tokens", F.lit(1), size - _at_least(size * F.lit(threshold)) + 1)
    sized = hashed.select("id", "tokens", size.alias("size"), *_parities())
    return sized.select("id", "size", *BITS, F.posexplode(shown).alias("pos", "token"))


def _class_width(threshold: float) -> float:
    # a little wider than the ratio of sizes allows, so rounding puts no pair two classes apart
    return max(-math.log(threshold), 1e-3) * (1 + 1e-9)


def size_class(size: Column, threshold: float) -> Column:
    """Similar sets are of the same class, or the larger one is of the next."""
    return F.floor(F.ln(size.cast("double")) / F.lit(_class_width(threshold))).cast("int")


def candidates(index: DataFrame, threshold: float, hot_rows: int = HOT_SETS) -> DataFrame:
    """(small, large): pairs that pass the length, the position and the parity filter at a common token, each pair once."""
    counts = write_scratch(index.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"), "prefix-counts")
    # a token in one prefix only meets nothing
    shared = join_hot_keys(index, counts.select("token"), ["token"], "id", hot_rows, counts)
    shared = write_scratch(shared.withColumn("class", size_class(F.col("size"), threshold)), "prefix-index")
    other = shared.select(
        "token",
        F.explode(F.array("class", F.col("class") - 1)).alias("class"),
        F.col("id").alias("large"),
        F.col("size").alias("size_large"),
        F.col("pos").alias("pos_large"),
        *[F.col(bits).alias(f"{bits}_large") for bits in BITS],
    )
    per_class = shared.groupBy("token", "class").agg(F.count("*").alias("n"))
    met = join_hot_keys(shared.withColumnRenamed("id", "small"), other, ["token", "class"], "small", hot_rows, per_class)
    in_order = (F.col("size") < F.col("size_large")) | ((F.col("size") == F.col("size_large")) & (F.col("small") < F.col("large")))
    needed = _at_least((F.col("size") + F.col("size_large")) * F.lit(threshold / (1 + threshold)))
    left = 1 + F.least(F.col("size") - F.col("pos") - 1, F.col("size_large") - F.col("pos_large") - 1)
    apart = sum((F.bit_count(F.col(bits).bitwiseXOR(F.col(f"{bits}_large"))) for bits in BITS), F.lit(0))
    possible = in_order & (F.col("size") >= _at_least(F.col("size_large") * F.lit(threshold))) & (left >= needed)
    possible = possible & (apart <= F.col("size") + F.col("size_large") - 2 * needed)
    return met.filter(possible).select("small", "large").distinct()


def _keyed_sets(df: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """(id, tokens, _set): sorted tokens and the digest that equal sets share."""
    tokens = F.array_sort(F.coalesce(F.col(tokens_col), F.array().cast("array<string>")))
    return df.select(F.col(id_col).alias("id"), tokens.alias("tokens")).withColumn("_set", F.sha2(F.to_json("tokens"), 256))


def _named(keyed: DataFrame, hot_rows: int) -> DataFrame:
    per_set = keyed.groupBy("_set").agg(F.min("id").alias("representative"), F.count("*").alias("n"))
    counts = per_set.select("_set", "n")
    return join_hot_keys(keyed, per_set.drop("n"), ["_set"], "id", hot_rows, counts).select("id", "representative")


def set_members(df: DataFrame, id_col: str, tokens_col: str, hot_rows: int = HOT_SETS) -> DataFrame:
    """(id, representative) of all rows: equal sets share the smallest id. No set is compared, and each is made once."""
    return _named(write_scratch(_keyed_sets(df, id_col, tokens_col).select(F.unhex("_set").alias("_set"), "id"), "set-keys"), hot_rows)


def segment_sums(hashes: Column, kept: Column) -> Column:
    """The hashes of a set, dealt into segments by their lower half: the sum of the upper halves of each, in 32 bits.

    There are ``SPARE`` more segments than ``kept``; so many of those with the fewest tokens, which most sets share, are NULL.
    """

    def sums(some: pa.Array, counts: pa.Array) -> pa.Array:
        kept = counts.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        spare = (kept * SPARE).astype(np.int64)
        dealt = kept + spare
        starts = np.concatenate(([0], np.cumsum(dealt)))
        owners = pc.list_parent_indices(some).to_numpy(zero_copy_only=False)
        values = pc.list_flatten(some).to_numpy(zero_copy_only=False).view(np.uint64)
        values, owners = values[dealt[owners] > 0], owners[dealt[owners] > 0]
        place = starts[owners] + ((values & HALF) % dealt[owners].astype(np.uint64)).astype(np.int64)
        # exact: sums stay below 2^53
        total = np.bincount(place, weights=(values >> np.uint64(32)).astype(np.float64), minlength=starts[-1])
        folded = total.astype(np.uint64).astype(np.uint32).view(np.int32)
        # the order is that of (tokens, place) in every set, so the rarest common segment of two sets is kept in both
        sizes = np.bincount(place, minlength=starts[-1])
        sets = np.repeat(np.arange(len(dealt)), dealt)
        ranked = np.lexsort((sizes, sets))
        dropped = np.zeros(starts[-1], dtype=bool)
        dropped[ranked] = np.arange(starts[-1]) - starts[:-1][sets] < spare[sets]
        return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(folded, mask=dropped))

    @F.arrow_udf("array<int>")
    def summed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for some, counts in batches:
            for at in range(0, len(some), SLICE_ROWS):
                yield sums(some.slice(at, SLICE_ROWS), counts.slice(at, SLICE_ROWS))

    return summed.asNondeterministic()(hashes, kept)


def segment_count(size_class: Column, threshold: float) -> Column:
    """One more than the tokens in which the smaller set of a pair, of this class, and the larger one may differ."""
    largest = F.floor(F.exp((size_class + 1) * F.lit(_class_width(threshold))) * F.lit(1 + SLACK))
    return (F.floor(largest * F.lit((1 - threshold) / threshold) + F.lit(1e-6)) + 1).cast("int")


def segmented(keyed: DataFrame, threshold: float) -> DataFrame:
    """(_set, id, size, class, larger, sums): two rows a set, one for partners of its class or the next, one as the larger set of the class before.

    Similar sets differ in at most ``(1 - threshold) / threshold`` times the tokens of the smaller. Where one segment more is kept
    than the largest set of a class allows, two of them have a segment with the same tokens.
    """
    size = F.size("tokens")
    own = size_class(size, threshold)
    hashes = F.transform("tokens", lambda token: F.xxhash64(token)).alias("_hashes")
    classes = F.when(size > 0, F.array(own, own - 1)).otherwise(F.array(F.lit(None).cast("int")))
    rows = keyed.select("id", F.unhex("_set").alias("_set"), size.alias("size"), hashes, F.posexplode(classes).alias("_at", "class"))
    sums = segment_sums(F.col("_hashes"), segment_count(F.col("class"), threshold)).alias("sums")
    return rows.select("_set", "id", "size", "class", (F.col("_at") == 1).alias("larger"), sums)


def segment_candidates(sets: DataFrame, threshold: float, block: int = BLOCK_SETS) -> DataFrame:
    """(small, large, group, size_x, size_y): pairs of ``segmented`` sets that have enough segments in common, each pair once.

    A segment that is not common takes a token that is not, and of the common ones at most the spare are dropped. Sets that meet are gathered to one list a segment. Close copies
    share most segments, so equal lists are one with a count; a list of more than ``block`` sets is dealt in pairs of blocks.
    ``group`` names the largest list, or pair of blocks, that holds the pair.
    """
    placed = sets.filter("size > 0").select("id", "size", "class", "larger", F.posexplode("sums").alias("_at", "_sum"))
    placed = placed.filter(F.col("_sum").isNotNull())
    low, at = F.col("_sum").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)), (F.col("_at") % 65536).cast("bigint")
    # places beyond 65,536 share keys, which only adds candidates
    key = F.shiftleft(F.col("class").cast("bigint"), 48).bitwiseOR(F.shiftleft(at, 32)).bitwiseOR(low)
    entries = placed.select(key.alias("_key"), F.struct("larger", "id", "size").alias("_member")).repartition("_key")
    lists = entries.groupBy("_key").agg(F.array_sort(F.collect_list("_member")).alias("_sets"))
    lists = lists.filter((F.size("_sets") > 1) & ~F.get("_sets", F.lit(0))["larger"])
    lists = write_scratch(lists.groupBy("_sets").agg(F.count("*").alias("_alike")), "segment-lists")
    last = ((F.size("_sets") - 1) / F.lit(block)).cast("int")
    blocks = lists.select("_sets", "_alike", last.alias("_last"), F.explode(F.sequence(F.lit(0), last)).alias("_a"))
    blocks = blocks.select("_sets", "_alike", "_a", F.explode(F.sequence(F.col("_a"), F.col("_last"))).alias("_b"))
    blocks = blocks.select(
        "_alike",
        F.slice("_sets", F.col("_a") * block + 1, F.lit(block)).alias("_left"),
        F.slice("_sets", F.col("_b") * block + 1, F.lit(block)).alias("_right"),
    ).filter(~F.get("_left", F.lit(0))["larger"])
    # large lists first, so that pairs which meet in several are compared where the most of them are
    held = F.least(F.size("_left") + F.size("_right"), F.lit(1 << 20)).cast("bigint")
    group = F.shiftleft(held, 40).bitwiseOR(F.xxhash64("_left", "_right").bitwiseAND(F.lit((1 << 40) - 1)))
    # lists that begin with the same sets hold mostly the same pairs, which the task then adds up before they are shuffled
    blocks = blocks.withColumn("_group", group)
    blocks = blocks.repartition(F.get("_left", F.lit(0))["id"], F.get("_right", F.lit(0))["id"])
    met = blocks.select("_alike", "_group", F.explode("_left").alias("_x"), "_right").filter(~F.col("_x.larger"))
    met = met.select("_alike", "_group", "_x", F.explode("_right").alias("_y")).filter(F.col("_x") < F.col("_y"))
    smaller, larger = F.least("_x.size", "_y.size"), F.greatest("_x.size", "_y.size")
    like = (smaller >= _at_least(larger * F.lit(threshold))) & (F.col("_x.id") != F.col("_y.id"))
    sets_of_pair = [F.col(f"{side}.{name}").alias(f"{name}{side}") for side in ("_x", "_y") for name in ("id", "size")]
    pairs = met.filter(like).groupBy(*sets_of_pair).agg(F.sum("_alike").alias("_common"), F.max("_group").alias("group"))
    smaller, both = F.least("size_x", "size_y"), F.col("size_x") + F.col("size_y")
    apart = segment_count(size_class(smaller, threshold), threshold) - F.col("_common")
    allowed = F.floor(both * F.lit((1 - threshold) / (1 + threshold)) + F.lit(1e-6))
    return pairs.filter(apart <= allowed).select(
        F.col("id_x").alias("small"), F.col("id_y").alias("large"), "group", "size_x", "size_y"
    )


def _common_tokens(sets: pa.Table, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows x and y of ``sets``, ordered by x: tokens in both, tokens in either."""
    codes = pc.list_flatten(sets["tokens"]).combine_chunks().dictionary_encode()
    seen = np.zeros(len(codes.dictionary), dtype=bool)
    codes = codes.indices.to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(sets["tokens"]).to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    common = np.zeros(len(x), dtype=np.int64)
    for first, last in pairwise(np.flatnonzero(np.diff(x, prepend=-1, append=-1)).tolist()):
        own, others = codes[starts[x[first]] : ends[x[first]]], y[first:last]
        low, high = others.min(), others.max()
        seen[own] = True
        hits = seen[codes[starts[low] : ends[high]]]
        common[first:last] = np.add.reduceat(hits, starts[low : high + 1] - starts[low], dtype=np.int64)[others - low]
        seen[own] = False
    return common, sizes[x] + sizes[y] - common


def compared_in_groups(found: DataFrame, needed: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(id_a, id_b, jaccard) of candidates that are similar. Sets travel once a group they meet in, not once a pair.

    ``needed`` (group, id, size) are the sets of each group; groups share cells of about ``CELL_TOKENS`` tokens.
    """
    cells = max(1, math.ceil((needed.agg(F.sum("size")).first()[0] or 0) / CELL_TOKENS))
    cell = F.pmod(F.xxhash64("group"), F.lit(cells))
    # sizes tell sets of a repeated id apart
    sized = texts.withColumn("size", F.size("tokens"))
    sets = needed.join(sized, ["id", "size"]).select(cell.alias("cell"), "group", "id", "size", "tokens")
    kind = found.schema["small"].dataType.simpleString()

    def compared(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        sets = sets.take(np.argsort(sets["group"].to_numpy(), kind="stable"))
        rows = sets.select(["group", "id", "size"]).to_pandas()
        met = pairs.drop_columns(["cell"]).to_pandas()
        for at, side in (("x", "small"), ("y", "large")):
            met = met.merge(rows.assign(**{at: np.arange(len(rows))}).rename(columns={"id": side, "size": f"size_{at}"}))
        met = met.sort_values("x")
        common, either = _common_tokens(sets, met["x"].to_numpy(), met["y"].to_numpy())
        jaccard = common / either
        similar = jaccard >= threshold
        return pa.table({"small": met["small"][similar], "large": met["large"][similar], "jaccard": jaccard[similar]})

    dealt = found.withColumn("cell", cell).groupBy("cell").cogroup(sets.groupBy("cell"))
    similar = dealt.applyInArrow(compared, f"small {kind}, large {kind}, jaccard double")
    return similar.select(F.least("small", "large").alias("id_a"), F.greatest("small", "large").alias("id_b"), "jaccard")


def _compared(found: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(id_a, id_b, jaccard) of the candidates that are similar, by their tokens."""
    left = sets.select(F.col("id").alias("small"), F.col("tokens").alias("_left"))
    right = sets.select(F.col("id").alias("large"), F.col("tokens").alias("_right"))
    compared = found.join(left, "small").join(right, "large").withColumn("jaccard", T.jaccard(F.col("_left"), F.col("_right")))
    return compared.filter(F.col("jaccard") >= threshold).select(
        F.least("small", "large").alias("id_a"), F.greatest("small", "large").alias("id_b"), "jaccard"
    )


def similar_sets(
    df: DataFrame, id_col: str, tokens_col: str, threshold: float = 0.85, hot_rows: int = HOT_SETS
) -> SetPairs:
    """Pairs of different token sets (arrays without duplicates) whose Jaccard similarity reaches ``threshold`` > 0.

    Equal sets, empty ones too, share the smallest id as representative; an empty or null set is in no pair. Below
    ``SEGMENT_THRESHOLD`` a segment holds too few tokens to tell sets apart, and sets meet by prefixes.
    """
    if threshold < SEGMENT_THRESHOLD:
        members = set_members(df, id_col, tokens_col, hot_rows)
        rows = _keyed_sets(df, id_col, tokens_col)
        # the token list travels once a different set and task, not once a copy
        different = rows.groupBy("_set").agg(F.min("id").alias("id"), F.first("tokens").alias("tokens"))
        different = write_scratch(different, "different-sets")
        ordered = write_scratch(ordered_sets(different.select("id", "tokens"), hot_rows), "ordered-sets")
        found = write_scratch(candidates(prefixes(ordered, threshold), threshold, hot_rows), "candidates")
        return SetPairs(_compared(found, ordered, threshold), members)
    keyed = write_scratch(segmented(_keyed_sets(df, id_col, tokens_col), threshold), "set-keys")
    members = _named(keyed.filter("NOT larger").select("_set", "id"), hot_rows)
    per_set = keyed.groupBy("_set", "class", "larger")
    different = per_set.agg(F.min("id").alias("id"), F.first("size").alias("size"), F.first("sums").alias("sums"))
    found = write_scratch(segment_candidates(different, threshold, min(hot_rows, BLOCK_SETS)), "candidates")
    left = found.select("group", F.col("small").alias("id"), F.col("size_x").alias("size"))
    right = found.select("group", F.col("large").alias("id"), F.col("size_y").alias("size"))
    needed = write_scratch(left.unionByName(right).distinct(), "needed-sets")
    # only texts of candidates are cut into tokens once more
    wanted = write_scratch(bloom_filter(needed.select("id").distinct(), "id"), "wanted-sets")
    rows = _keyed_sets(seen_in(df, id_col, wanted), id_col, tokens_col)
    texts = rows.groupBy("_set").agg(F.min("id").alias("id"), F.first("tokens").alias("tokens"))
    return SetPairs(compared_in_groups(found, needed, texts.select("id", "tokens"), threshold), members)

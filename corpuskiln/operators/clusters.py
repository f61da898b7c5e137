"""Clusters of near duplicates, their extremes, and removal of the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuskiln.config import NearDupConfig
from corpuskiln.functions import text as T
from corpuskiln.operators.bloom import bloom_filter, seen_in
from corpuskiln.operators.components import star_components
from corpuskiln.operators.minhash import star_pairs, stored_buckets
from corpuskiln.operators.ordering import id_chunk, running_minimum
from corpuskiln.operators.skew import join_hot_keys
from corpuskiln.scratch import write_scratch


# parts in which the members of one cluster are ranked
RANK_PARTS = 4096


def connected_components(pairs: DataFrame, config: NearDupConfig = NearDupConfig()) -> DataFrame:
    """(cluster_id, id) of every vertex of ``pairs``; the cluster id is its smallest member.

    Local contraction: each vertex merges into the first vertex around it, by
    id and by a hash in turn, and the edges between merged vertices go on to the
    next level. Ids fold stars at once, hashes halve long chains on average, so
    the levels grow with the logarithm of the graph.
    """
    edges = write_scratch(pairs.select("id_a", "id_b"), "edges")
    merges: list[DataFrame] = []
    while not edges.isEmpty():
        level = len(merges)
        ends = edges.select(F.col("id_a").alias("id"), F.col("id_b").alias("_near")).unionByName(
            edges.select(F.col("id_b").alias("id"), F.col("id_a").alias("_near"))
        )
        if level % 2 == 0:
            parent = F.least("id", F.min("_near"))
        else:
            nearest = F.min(F.struct(F.xxhash64("_near", F.lit(level)).alias("rank"), F.col("_near").alias("id")))
            own = F.struct(F.xxhash64("id", F.lit(level)).alias("rank"), F.col("id"))
            parent = F.least(own, nearest)["id"]
        merged = write_scratch(ends.groupBy("id").agg(parent.alias("parent")), "merged")
        merges.append(merged)
        left = merged.select(F.col("id").alias("id_a"), F.col("parent").alias("_a"))
        right = merged.select(F.col("id").alias("id_b"), F.col("parent").alias("_b"))
        crossing = (
            edges.join(left, "id_a")
            .join(right, "id_b")
            .filter(F.col("_a") != F.col("_b"))
            .select(F.least("_a", "_b").alias("id_a"), F.greatest("_a", "_b").alias("id_b"))
            .distinct()
        )
        edges = write_scratch(crossing, "edges")
    if not merges:
        return edges.select(F.col("id_a").alias("cluster_id"), F.col("id_b").alias("id"))
    labels = merges[-1].select("id", F.col("parent").alias("_root"))
    for merged in reversed(merges[:-1]):
        upper = labels.select(F.col("id").alias("parent"), "_root")
        labels = merged.join(upper, "parent", "left").select("id", F.coalesce("_root", "parent").alias("_root"))
    labels = write_scratch(labels, "labels")
    smallest = labels.groupBy("_root").agg(F.min("id").alias("cluster_id"), F.count("*").alias("n"))
    named = join_hot_keys(
        labels, smallest.drop("n"), ["_root"], "id", config.hot_rows, smallest.select("_root", "n")
    )
    return named.select("cluster_id", "id")


def different_buckets(mates: DataFrame) -> DataFrame:
    """The rows (bucket, id, root) of one bucket of those that hold the same files, stored; 128 bits of their ids must agree."""
    mates = mates.distinct()
    marks = [F.bit_xor(F.xxhash64("id", F.lit(side))).alias(side) for side in ("_left", "_right")]
    files = mates.groupBy("bucket").agg(F.min("root").alias("root"), F.count("*").alias("n"), *marks)
    kept = files.groupBy("root", "n", "_left", "_right").agg(F.min("bucket").alias("bucket"))
    return write_scratch(mates.join(kept.select("bucket"), "bucket", "left_semi"), "different-buckets")


def _known_bases(chosen: DataFrame) -> DataFrame:
    """(base, _time): the first file that chose a base, stored."""
    return write_scratch(chosen.groupBy("base").agg(F.min("id").alias("_time")), "known-bases")


def greedy_clusters(shared: DataFrame, id_col: str, config: NearDupConfig = NearDupConfig()) -> DataFrame:
    """(cluster_id, id) rows of the greedy rule, files arriving in id order.

    A file joins the first earlier bucket mate that is a base already; without
    one, its first earlier mate becomes a base. A base is a member of its own
    cluster and may also be a member of another.

    A choice depends on earlier choices only, so repeating the rule for all files
    at once until nothing changes gives the sequential result. Inside a
    bucket, "the first base known before this file" is a running minimum, so no
    pairs of mates are formed. Buckets of the same files are one bucket, and after the first round only files are
    judged again that have a mate which became a base, ceased to be one, or did so at another file.
    """
    mates = different_buckets(shared.select("bucket", F.col(id_col).alias("id"), "root"))
    later = mates.filter(F.col("id") > F.col("root"))
    first_mate = write_scratch(later.groupBy("id").agg(F.min("root").alias("first_mate")), "first-mate")
    chosen, asked, known = None, later, _known_bases(first_mate.select("id", F.col("first_mate").alias("base")))
    while True:
        told = mates if chosen is None else mates.join(asked.select("bucket").distinct(), "bucket", "left_semi")
        facts = told.join(known, F.col("id") == F.col("base")).select(
            "bucket", "_time", F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("id"), "base"
        )
        asks = asked.select("bucket", F.col("id").alias("_time"), F.lit(0).alias("_kind"), "id", F.lit(None).cast("bigint").alias("base"))
        timeline = running_minimum(
            asks.unionByName(facts),
            F.col("base"),
            [F.col("_time"), F.col("_kind")],
            id_chunk(F.col("_time"), config.chunk),
            "_base",
            by=["bucket"],
        )
        answers = timeline.filter(F.col("_kind") == 0).groupBy("id").agg(F.min("_base").alias("_base"))
        again = first_mate.join(answers, "id").select("id", F.coalesce("_base", "first_mate").alias("base"))
        if chosen is not None:
            again = write_scratch(again, "judged-again")
            again = again.unionByName(chosen.join(again, "id", "left_anti"))
        chosen = write_scratch(again, "greedy")
        before, known = known.withColumnRenamed("_time", "_before"), _known_bases(chosen)
        moved = before.join(known, "base", "full").filter(~F.col("_time").eqNullSafe(F.col("_before"))).select("base")
        moved = write_scratch(moved, "moved-bases")
        if moved.isEmpty():
            break
        touched = mates.join(moved, F.col("id") == F.col("base")).select("bucket").distinct()
        files = later.join(touched, "bucket", "left_semi").select("id").distinct()
        asked = write_scratch(later.join(files, "id", "left_semi"), "asked")
    bases = chosen.select(F.col("base").alias("cluster_id"), F.col("base").alias("id")).distinct()
    return bases.unionByName(chosen.select(F.col("base").alias("cluster_id"), "id"))


def duplicate_clusters(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "content",
    config: NearDupConfig = NearDupConfig(),
    mode: str = "components",
) -> DataFrame:
    """(cluster_id, id): connected components, or the clusters of the greedy rule.

    ``components`` contracts the graph, ``stars`` finds the same clusters by alternating stars, with every vertex of
    many links split.
    """
    shared = stored_buckets(df, id_col, text_col, config)
    if mode == "stars":
        return star_components(star_pairs(shared, id_col, config), config.hot_rows)
    if mode == "components":
        return connected_components(star_pairs(shared, id_col, config), config)
    if mode == "greedy":
        return greedy_clusters(shared, id_col, config)
    raise ValueError(f"unknown mode {mode!r}")


def _first_undecided(undecided: DataFrame, pivots: int) -> DataFrame:
    """The first few ids of each cluster, ranked within parts of a cluster first."""
    places = undecided.select("cluster_id", "id", F.pmod(F.xxhash64("id"), F.lit(RANK_PARTS)).alias("_part"))
    per_part = Window.partitionBy("cluster_id", "_part").orderBy("id")
    few = places.withColumn("_place", F.row_number().over(per_part)).filter(F.col("_place") <= pivots)
    per_cluster = Window.partitionBy("cluster_id").orderBy("id")
    first = few.withColumn("_place", F.row_number().over(per_cluster)).filter(F.col("_place") <= pivots)
    return first.select("cluster_id", "id")


def _similar(a: Column, b: Column, threshold: float) -> Column:
    """Jaccard similarity of two token arrays is at least ``threshold``; sizes that rule it out are compared first."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return (small >= large * F.lit(threshold) - 1e-6) & (T.jaccard(a, b) >= threshold)


def _new_extremes(undecided: DataFrame, config: NearDupConfig, pivots: int) -> DataFrame:
    """Per cluster, those of its first undecided sets that no earlier one covers."""
    first = undecided.join(_first_undecided(undecided, pivots), ["cluster_id", "id"])
    ordered = first.groupBy("cluster_id").agg(
        F.array_sort(F.collect_list(F.struct("id", "tokens"))).alias("_sets")
    )
    nothing = F.slice("_sets", 1, 0)

    def keep(extremes, candidate):
        covered = F.exists(
            extremes, lambda other: _similar(other["tokens"], candidate["tokens"], config.jaccard_threshold)
        )
        return F.when(covered, extremes).otherwise(F.array_append(extremes, candidate))

    return ordered.select("cluster_id", F.aggregate("_sets", nothing, keep).alias("_extremes"))


def cluster_extremes(
    df: DataFrame,
    members: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "content",
    config: NearDupConfig = NearDupConfig(),
) -> DataFrame:
    """(cluster_id, id, extreme_id): the first earlier extreme that is similar enough, or the row itself.

    Members are taken in id order, with exact Jaccard similarity. Equal token
    sets share one outcome, so each distinct set of a cluster is judged once. A
    round settles the first undecided sets of every cluster and all sets
    they cover; a member meets extremes only, never all other members. Each round
    takes twice as many sets as the one before, up to ``max_pivots``, so the rounds
    grow with the logarithm of the extremes of a cluster, and beyond that bound with their number over
    it. The tokens travel as 64-bit hashes, and only undecided sets enter a round.
    """
    words = T.token_set(F.col(text_col))
    # texts of other files are not shuffled
    wanted = write_scratch(bloom_filter(members, "id"), "wanted-texts")
    texts = seen_in(df.select(F.col(id_col).alias("id"), text_col), "id", wanted)
    sets = write_scratch(
        members.join(texts, "id")
        .select("cluster_id", "id", words.alias("_words"))
        .select(
            "cluster_id",
            "id",
            F.transform("_words", lambda word: F.xxhash64(word)).alias("tokens"),
            F.unhex(F.md5(F.concat_ws(" ", F.array_sort("_words")))).alias("_set"),
        ),
        "cluster-sets",
    )
    distinct_sets = write_scratch(
        sets.groupBy("cluster_id", "_set").agg(F.min("id").alias("id"), F.count("*").alias("n")), "distinct-sets"
    )
    undecided = sets.drop("_set").join(distinct_sets.select("cluster_id", "id"), ["cluster_id", "id"], "left_semi")
    rounds: list[DataFrame] = []
    while True:
        pivots = min(config.pivots << len(rounds), max(config.pivots, config.max_pivots))
        extremes = _new_extremes(undecided, config, pivots)
        judged = join_hot_keys(undecided, extremes, ["cluster_id"], "id", config.hot_rows)
        matches = F.filter(
            "_extremes",
            lambda extreme: (extreme["id"] == F.col("id"))
            | _similar(extreme["tokens"], F.col("tokens"), config.jaccard_threshold),
        )
        judged = write_scratch(
            judged.withColumn("extreme_id", F.get(matches, F.lit(0))["id"]).drop("_extremes"), "judged"
        )
        rounds.append(judged.filter(F.col("extreme_id").isNotNull()).select("cluster_id", "id", "extreme_id"))
        undecided = judged.filter(F.col("extreme_id").isNull()).drop("extreme_id")
        if undecided.isEmpty():
            break
    settled = rounds[0]
    for later in rounds[1:]:
        settled = settled.unionByName(later)
    per_set = distinct_sets.join(settled, ["cluster_id", "id"]).select("cluster_id", "_set", "extreme_id")
    return join_hot_keys(
        sets.select("cluster_id", "_set", "id"),
        per_set,
        ["cluster_id", "_set"],
        "id",
        config.hot_rows,
        distinct_sets.select("cluster_id", "_set", "n"),
    ).select("cluster_id", "id", "extreme_id")


def removed_ids(outcome: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Cluster members that are an extreme of no cluster."""
    extreme_somewhere = F.max(F.col("id") == F.col("extreme_id")).alias("_extreme")
    per_file = outcome.groupBy("id").agg(extreme_somewhere).filter(~F.col("_extreme"))
    return per_file.select(F.col("id").alias(id_col))


def without_copies(df: DataFrame, outcome: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return df.join(removed_ids(outcome, id_col), id_col, "left_anti")


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "content",
    config: NearDupConfig = NearDupConfig(),
    mode: str = "components",
) -> DataFrame:
    """The outcome (cluster_id, id, extreme_id) of a corpus, stored."""
    members = write_scratch(duplicate_clusters(df, id_col, text_col, config, mode), "members")
    return write_scratch(cluster_extremes(df, members, id_col, text_col, config), "outcome")


def near_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "content",
    config: NearDupConfig = NearDupConfig(),
    mode: str = "components",
) -> DataFrame:
    """Rows of ``df`` without the copies of near-duplicate clusters."""
    return without_copies(df, near_duplicates(df, id_col, text_col, config, mode), id_col)


def annotate_clusters(
    outcome: DataFrame, files: DataFrame | None = None, id_col: str = "doc_id", about: Sequence[str] = ("repo_name", "path")
) -> DataFrame:
    """(cluster_id, id, is_extreme, copies): ``copies`` of extremes counts them and what they cover.

    A file that is an extreme of any cluster counts as one everywhere. ``files`` adds the columns ``about`` of each file.
    """
    copies = outcome.groupBy("cluster_id", F.col("extreme_id").alias("id")).agg(F.count("*").alias("_copies"))
    per_file = copies.groupBy("id").agg(F.max("_copies").alias("copies"))
    named = outcome.select("cluster_id", "id").join(per_file, "id", "left")
    if files is not None:
        named = named.join(files.select(F.col(id_col).alias("id"), *about), "id", "left")
    described = [] if files is None else list(about)
    return named.select("cluster_id", "id", *described, F.col("copies").isNotNull().alias("is_extreme"), "copies")


def nested_clusters(annotated: DataFrame, chunk: int = NearDupConfig().chunk) -> DataFrame:
    """Clusters as rows (cluster_id, part, members): one row, or several of about ``chunk`` members for a larger cluster."""
    member = F.struct(*[F.col(name) for name in annotated.columns if name != "cluster_id"])
    sizes = annotated.groupBy("cluster_id").agg(F.count("*").alias("n"))
    parts = sizes.select("cluster_id", F.ceil(F.col("n") / chunk).cast("int").alias("_parts"))
    spread = join_hot_keys(annotated, parts, ["cluster_id"], "id", counts=sizes)
    part = F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int").alias("part")
    return spread.groupBy("cluster_id", part).agg(F.array_sort(F.collect_list(member)).alias("members"))


def observe_copies(df: DataFrame, outcome: DataFrame, observation: Observation | str, id_col: str = "doc_id") -> DataFrame:
    """Rows without copies, as ``without_copies``, counting all rows, files in clusters and extremes in the pass that writes them.

    The outcome is reduced to one row a file and joined once; nothing is scanned again for the counts.
    """
    is_extreme = F.max(F.col("id") == F.col("extreme_id")).alias("_extreme")
    per_file = outcome.groupBy(F.col("id").alias(id_col)).agg(is_extreme)
    marked = df.join(per_file, id_col, "left").observe(
        observation,
        F.count("*").alias("original_rows"),
        F.count("_extreme").alias("files_in_clusters"),
        F.count_if("_extreme").alias("unique_files"),
        F.count_if(F.coalesce("_extreme", F.lit(True))).alias("rows_kept"),
    )
    return marked.filter(F.coalesce("_extreme", F.lit(True))).drop("_extreme")


def near_dedup_stats(df: DataFrame, outcome: DataFrame) -> DataFrame:
    """One row of five counts: rows, clusters, files in clusters, extremes, rows kept."""
    per_file = outcome.groupBy("id").agg(F.max(F.col("id") == F.col("extreme_id")).alias("_extreme"))
    files = per_file.agg(F.count("*").alias("files"), F.count_if("_extreme").alias("extremes"))
    clusters = outcome.select("cluster_id").distinct().agg(F.count("*").alias("n")).scalar()
    in_clusters = files.select("files").scalar()
    extremes = files.select("extremes").scalar()
    counted = df.agg(F.count("*").alias("original_rows"))
    return counted.withColumns(
        {
            "n_clusters": clusters,
            "files_in_clusters": in_clusters,
            "unique_files": extremes,
            "rows_kept": F.col("original_rows") - in_clusters + extremes,
        }
    )

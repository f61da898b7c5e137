"""Merkle manifest of a table: a tree of digests per source, a tree over the sources, and a proof for every row.

Every row is a leaf. Leaves of a source stand in the order of their ids; a level
groups ``FAN_IN`` consecutive nodes, and one aggregation makes their parents. The
subroots of all sources are the leaves of the top tree.

Proofs come by pointer jumping. Each node knows an ancestor and the siblings on
the way to it, at first its parent and the siblings of its own run. A round joins the nodes with
themselves on the ancestor: the distance doubles, the two segments are
concatenated. After the binary logarithm of the height every leaf has its whole
path. A round only keeps the nodes that later rounds can still point to.

Sizes: text is read once and never moves; ids and digests do. A run has at most
``FAN_IN`` nodes. Positions come from a range sort whose last key is a row number, so that
no source, id or repeated row fills a task, and from counts a source and range. A
join at distance D finds at most ``FAN_IN`` ** D leaves under one ancestor; where few
ancestors are left (``BROADCAST_NODES``, with segments as long as the tree is high), they are sent to all tasks instead,
so leaves under one subroot do not meet in one task. The driver sees the number of sources, the largest one and the root.

Defined cases: each null field counts as ``-``, also in the id; rows without id come first in their source and are never
tampered with. Rows of one id are ordered by their digests; equal rows are leaves of their own with
proofs of their own. A null source is a source, the first one. An empty table gives an empty
result. Columns that are not named as parameters are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuskiln.scratch import write_scratch

FAN_IN = 3
TOP = -1
BROADCAST_NODES = 4_096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

SEGMENT = "array<struct<left: binary, right: binary>>"
ANCESTOR = ("up_tree", "up_level", "up_idx")
INDEX_BITS = 33  # of monotonically_increasing_id, below the partition


def digest(data: Column) -> Column:
    return F.unhex(F.sha2(data, 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf_digest(values: list[Column]) -> Column:
    """Digest of all values, each as its byte count, a colon and its text, or ``-`` for null."""
    texts = [x.cast("string") for x in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return digest(F.concat(*parts))


def tampers(doc_id: Column) -> Column:
    """Whether the rehearsal tampers with a row: its id's checksum is even."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def leaf_rows(docs: DataFrame) -> DataFrame:
    """(src, doc_id, leaf, shown, row_id): ``shown`` is the leaf of the row as the verifier gets it."""
    rows = docs.select(*[F.col(f"`{c}`") for c in FIELDS])
    columns = [F.col(c) for c in FIELDS]
    cut = F.replace("text", F.lit("\n"), F.lit(""))
    leaf = leaf_digest(columns)
    shown = F.when(tampers(F.col("doc_id")) & F.contains("text", F.lit("\n")), leaf_digest([*columns[:-1], cut]))
    return rows.select(
        F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0")).alias("src"),  # null first, joins by value
        F.col("doc_id").cast("bigint").alias("doc_id"),
        leaf.alias("leaf"),
        shown.alias("shown"),
        F.monotonically_increasing_id().alias("row_id"),
    )


@dataclass
class Numbered:
    """Sorted rows with the range and place (``rng``, ``place``) of each, and per group and range (by, rng) its
    first place ``start``, ``before`` (rows of the group in earlier ranges) and ``n`` (rows of the group)."""

    rows: DataFrame
    spans: DataFrame

    def positions(self, keys: list[str], spans: DataFrame) -> DataFrame:
        """Rows with ``idx``, their position in their group; a range and group holds at most a range of rows."""
        placed = self.rows.join(spans, [*keys, "rng"])
        return placed.withColumn("idx", F.col("place") - F.col("start") + F.col("before")).drop("place", "start", "before")


def number_in_groups(rows: DataFrame, by: list[str], order: list[str], name: str) -> Numbered:
    keys = [F.col(c).asc_nulls_first() for c in (*by, *order)]
    at = F.monotonically_increasing_id()
    stored = write_scratch(
        rows.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("*", F.shiftright(at, INDEX_BITS).alias("rng"), at.bitwiseAND(F.lit((1 << INDEX_BITS) - 1)).alias("place")),
        name,
    )
    counted = stored.groupBy(*by, "rng").agg(F.min("place").alias("start"), F.count("*").alias("_rows"))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    spans = counted.select(
        *by,
        "rng",
        "start",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("before"),
        F.sum("_rows").over(group).alias("n"),
    )
    return Numbered(stored, write_scratch(spans, f"{name}-spans"))


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    found = 0
    while n > 1:
        n, found = -(-n // FAN_IN), found + 1
    return found


def grow(nodes: DataFrame, levels: int, name: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """The runs of each level and the nodes that are alone in their tree, by level.

    ``nodes`` has (tree, idx, n, digest) with ``n``, the nodes of the tree at this level. A run is
    (tree, idx, n, digest, kids): the parent, the size of its level, and its children in order.
    """
    runs, tops = [], []
    for level in range(levels + 1):
        tops.append(nodes.filter("n = 1").select("tree", "digest"))
        if level == levels:
            break
        kids = F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("kids")
        parents = nodes.filter("n > 1").groupBy("tree", F.floor(F.col("idx") / FAN_IN).alias("_run"), "n").agg(kids)
        joined = F.aggregate("kids", F.lit(""), lambda text, kid: F.concat(text, hexed(kid["digest"])))
        runs.append(
            write_scratch(
                parents.select(
                    "tree",
                    F.col("_run").alias("idx"),
                    F.ceil(F.col("n") / FAN_IN).alias("n"),
                    digest(joined).alias("digest"),
                    "kids",
                ),
                f"{name}-runs",
            )
        )
        nodes = runs[-1].drop("kids")
    return runs, tops


def links(runs: DataFrame, level: int) -> DataFrame:
    """(tree, level, idx, ancestor, segment) of the children of ``runs``, which are nodes of ``level``.

    The parent of the last run of a source is its subroot, a leaf of the top tree.
    """
    kid = F.col("kid.idx")

    def beside(keep) -> Column:
        return F.aggregate(F.filter("kids", keep), F.lit(b""), lambda all_, x: F.concat(all_, x["digest"]))

    one = F.struct(beside(lambda x: x["idx"] < kid).alias("left"), beside(lambda x: x["idx"] > kid).alias("right"))
    subroot = (F.col("n") == 1) & (F.col("tree") != TOP)
    return runs.select("*", F.explode("kids").alias("kid")).select(
        "tree",
        F.lit(level).cast("bigint").alias("level"),
        kid.alias("idx"),
        F.when(subroot, F.lit(TOP)).otherwise(F.col("tree")).cast("bigint").alias("up_tree"),
        F.when(subroot, F.lit(0)).otherwise(F.lit(level + 1)).cast("bigint").alias("up_level"),
        F.when(subroot, F.col("tree")).otherwise(F.col("idx")).cast("bigint").alias("up_idx"),
        F.array(one).cast(SEGMENT).alias("segment"),
    )


def jump(nodes: DataFrame, inner: DataFrame) -> DataFrame:
    """``nodes`` with the ancestors of their ancestors and longer segments; without ancestor once at the root."""
    kept = [c for c in nodes.columns if c not in (*ANCESTOR, "segment")]
    further = inner.select(
        *[F.col(c).alias(a) for c, a in zip(("tree", "level", "idx"), ANCESTOR, strict=True)],
        *[F.col(a).alias(f"_{a}") for a in ANCESTOR],
        F.col("segment").alias("_segment"),
    )
    none = F.array().cast(SEGMENT)
    return nodes.join(further, [*ANCESTOR], "left").select(
        *kept, *[F.col(f"_{a}").alias(a) for a in ANCESTOR], F.concat("segment", F.coalesce("_segment", none)).alias("segment")
    )


def _reaches(inner: DataFrame, distance: int) -> DataFrame:
    """Nodes that can be the ancestor of a leaf at this distance: those of the top tree, and those as high."""
    return inner.filter((F.col("tree") == TOP) | (F.col("level") >= distance))


def paths(leaves: DataFrame, inner: DataFrame, total_height: int) -> DataFrame:
    """``leaves`` (with ancestor and segment) once all segments reach the root."""
    distance = 1
    while True:
        # few nodes stand for few ancestors, each of very many leaves: a size that is counted, not guessed
        few = inner.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
        leaves = write_scratch(jump(leaves, F.broadcast(inner) if few else inner), "paths")
        distance *= 2
        if distance > total_height:
            return leaves
        near = _reaches(inner, distance)
        inner = write_scratch(jump(near, F.broadcast(near) if few else near), "ancestors")


def manifest(docs: DataFrame) -> DataFrame:
    """One row a document with (all digests binary) leaf, subroot, root, and ``segment``: its siblings left and right
    of it, level by level up to the root. ``shown`` is the leaf as the verifier gets it, null where it is the same."""
    # stored before they are sorted: finding the ranges would read and hash the texts a second time
    hashed = write_scratch(leaf_rows(docs), "leaf-digests")
    numbered = number_in_groups(hashed, ["src"], ["doc_id", "leaf", "row_id"], "leaves")
    sources = number_in_groups(numbered.spans.select("src", "n").distinct(), [], ["src"], "sources")
    sources = write_scratch(
        sources.positions([], sources.spans.withColumnRenamed("n", "n_sources")).select(
            "src", F.col("idx").alias("tree"), "n_sources"
        ),
        "source-numbers",
    )
    spans = write_scratch(numbered.spans.join(sources, "src"), "leaf-spans")
    leaves = write_scratch(
        numbered.positions(["src"], spans.drop("n_sources")).drop("src", "row_id"), "numbered-leaves"
    )
    most, n_sources = spans.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.max("n_sources"), F.lit(0))).first()
    runs, tops = grow(leaves.select("tree", "idx", "n", F.col("leaf").alias("digest")), height(most), "tree")
    subroots = tops[0]
    for top in tops[1:]:
        subroots = subroots.unionByName(top)
    subroots = write_scratch(subroots, "subroots")
    top_leaves = subroots.select(
        F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("idx"), F.lit(n_sources).cast("bigint").alias("n"), "digest"
    )
    top_runs, roots = grow(top_leaves, height(n_sources), "top")
    inner = [links(r, level) for level, r in enumerate(runs) if level] + [links(r, level) for level, r in enumerate(top_runs)]
    own = links(runs[0], 0) if runs else None
    alone = leaves.filter("n = 1").select(
        "tree",
        "idx",
        F.lit(TOP).cast("bigint").alias("up_tree"),
        F.lit(0).cast("bigint").alias("up_level"),
        F.col("tree").alias("up_idx"),
        F.array().cast(SEGMENT).alias("segment"),
    )
    first = alone if own is None else own.drop("level").unionByName(alone)
    found = leaves.drop("n").join(first, ["tree", "idx"])
    total = height(most) + height(n_sources)
    if inner:
        every = inner[0]
        for more in inner[1:]:
            every = every.unionByName(more)
        found = paths(found, write_scratch(every, "links"), total)
    # by source and range, so that the leaves of one source stay spread
    of_range = spans.select("tree", "rng").join(subroots.withColumnRenamed("digest", "subroot"), "tree")
    root = bytes(roots[-1].first()["digest"]) if n_sources else b""
    return found.join(of_range, ["tree", "rng"]).withColumn("root", F.lit(root))


def fold(leaf: Column, segment: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(
        segment, leaf, lambda below, run: digest(F.concat(hexed(run["left"]), hexed(below), hexed(run["right"])))
    )


def verify(found: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: every row checked against the root by its proof."""
    siblings = F.array_join(F.transform("segment", lambda run: F.concat(hexed(run["left"]), hexed(run["right"]))), "")
    folded = found.withColumn("_folded", fold(F.coalesce("shown", "leaf"), F.col("segment")))
    return folded.select(
        "doc_id",
        hexed(F.col("leaf")).alias("leaf"),
        hexed(F.col("subroot")).alias("subroot"),
        hexed(F.col("root")).alias("root"),
        F.sha2(siblings, 256).alias("proof_sha256"),
        hexed(F.col("_folded")).alias("folded_root"),
        (F.col("_folded") == F.col("root")).alias("verified"),
    )

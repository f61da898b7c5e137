"""Similar documents by word n-grams: a MinHash LSH forest, then exact Jaccard.

1. A document's shingles are its runs of five words (one run of all words if there are
   fewer). Documents with the same set of shingles form one class, so copies
   cost one class, however many there are. A class has one label of ``depth`` bytes a tree.
2. The labels of all trees are sorted over the whole cluster by (tree, label). The
   sorted labels are the tries: neighbours with a common prefix of d bytes meet in a node of depth d.
   Each neighbouring pair goes out with the length of its common prefix; pairs
   at the borders of partitions are found from the first and last row of each.
3. At a depth, classes joined by such pairs form a candidate group, which holds every pair of
   classes that share a node. The groups are cut into blocks of bounded size; each pair of blocks
   is one unit of work that counts common shingles of all its pairs exactly. It
   returns a row a class (links, copies linked) and one edge a class to the smallest linked
   one, never the pairs.
4. The depth is the longest prefix at which a pair at the threshold itself is found with the
   target recall, so what becomes of a pair does not depend on the other rows of the corpus.

The result has one row a document: its class (documents connected by links), named by
the largest doc_id in it, and its number of links. A hot group is spread by its sorted place, its copies
are one class, and its pairs are counted in blocks over many tasks.

Defined cases: a text without words has no shingles, no links and a class of its own.
A null text is empty. Null ids lose against others in naming a class; among equal or null ids the
larger digest of the text stays. Rows that repeat an id are documents of their own. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuskiln.llm.quality import text_digest
from corpuskiln.operators.clusters import connected_components
from corpuskiln.scratch import write_scratch


@dataclass(frozen=True)
class ForestConfig:
    words: int = 5
    similarity: tuple[int, int] = (4, 5)  # a fraction, so that the comparison is exact
    trees: int = 64
    depth: int = 8
    target_recall: float = 0.99999
    block_classes: int = 512
    block_shingles: int = 1 << 19
    seed: int = 11

    def found(self, similarity: float, depth: int) -> float:
        """The chance that two classes share a node of a depth in some tree."""
        return 1 - (1 - similarity**depth) ** self.trees

    def least_depth(self) -> int:
        threshold = self.similarity[0] / self.similarity[1]
        reached = (d for d in range(self.depth, 1, -1) if self.found(threshold, d) >= self.target_recall)
        return next(reached, 1)


def shingles(text: str, n_words: int) -> np.ndarray:
    """The sorted set of 64-bit hashes of a text's shingles."""
    words = text.split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n, width = max(0, len(h) - n_words + 1), n_words
    if not n and len(h):
        n, width = 1, len(h)
    key = np.full(n, width, np.uint64)
    for k in range(width):
        key = (key ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return np.unique(key)


def labels(own: np.ndarray, factors: np.ndarray) -> bytes:
    """One byte a MinHash, tree after tree."""
    folded = (own ^ (own >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(folded), 4096):
        np.minimum(least, np.multiply.outer(folded[at : at + 4096], factors).min(0), out=least)
    return ((least * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, config: ForestConfig, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored rows (doc_id, digest, set_id, n, labels); digest is that of the text, set_id a 128-bit one of the set, null without shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(config.seed)
        factors = rng.integers(0, 1 << 32, config.trees * config.depth, dtype=np.uint32) | np.uint32(1)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                own = shingles(text or "", config.words)
                rows.append((_set_id(own), len(own), labels(own, factors)) if len(own) else (None, 0, None))
            yield pd.concat(
                [batch[["doc_id", "digest"]], pd.DataFrame(rows, columns=["set_id", "n", "labels"], index=batch.index)], axis=1
            )

    rows = _texts(docs, id_col, text_col)
    stored = rows.mapInPandas(run, "doc_id bigint, digest binary, set_id binary, n bigint, labels binary")
    return write_scratch(stored, "signatures")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_digest(text).alias("digest"), text.alias("text"))


def _set_id(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def neighbours(classes: DataFrame, config: ForestConfig) -> DataFrame:
    """Stored pairs (id_a, id_b, shared) of classes next to each other in a sorted trie, with their common prefix."""
    depth, least = config.depth, config.least_depth()
    label = F.transform(
        F.sequence(F.lit(0), F.lit(config.trees - 1)),
        lambda t: F.struct(t.cast("int").alias("tree"), F.substr(F.col("labels"), t * depth + 1, F.lit(depth)).alias("label")),
    )
    rows = classes.select("set_id", F.inline(label))
    order = ["tree", "label", "set_id"]
    kinds = "id_a binary, id_b binary, shared int, tree int, label binary"
    names = [k.split()[0] for k in kinds.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs inside the partition; its first and last row come with a null id_b."""
        last, started = None, False
        for batch in batches:
            if not len(batch):
                continue
            if not started:
                yield _border(batch.iloc[0], names)
                started = True
            if last is not None:
                batch = pd.concat([last, batch], ignore_index=True)
            last = batch.iloc[[-1]]
            tree, ids = batch["tree"].to_numpy(), batch["set_id"].to_numpy()
            data = np.frombuffer(b"".join(batch["label"]), np.uint8).reshape(-1, depth)
            same = np.logical_and.accumulate(data[1:] == data[:-1], axis=1).sum(1)
            same[tree[1:] != tree[:-1]] = 0
            at = np.flatnonzero(same >= least)
            if len(at):
                out = pd.DataFrame({"id_a": ids[at], "id_b": ids[at + 1], "shared": same[at].astype(np.int32)})
                yield out.assign(tree=None, label=None)[names]
        if last is not None:
            yield _border(last.iloc[0], names)

    found = write_scratch(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(run, kinds), "neighbours"
    )
    # two rows a partition: neighbours among them span the borders
    borders = found.filter("id_b IS NULL").select(F.col("id_a").alias("set_id"), "tree", "label").distinct()
    before = Window.orderBy(*order)
    lagged = borders.select(*order, *[F.lag(c).over(before).alias(f"_{c}") for c in order]).filter("tree = _tree")
    prefix = F.lit(0)
    for d in range(1, depth + 1):
        same = F.substr("label", F.lit(1), F.lit(d)) == F.substr("_label", F.lit(1), F.lit(d))
        prefix = F.when(same, d).otherwise(prefix)
    spanning = lagged.select(F.col("_set_id").alias("id_a"), F.col("set_id").alias("id_b"), prefix.alias("shared"))
    pairs = found.filter("id_b IS NOT NULL").select("id_a", "id_b", "shared")
    return pairs.unionByName(spanning.filter(F.col("shared") >= least)).filter("id_a != id_b")


def _border(row: pd.Series, names: list[str]) -> pd.DataFrame:
    return pd.DataFrame([(row["set_id"], None, 0, row["tree"], row["label"])], columns=names)


def candidate_sets(
    docs: DataFrame, classes: DataFrame, groups: DataFrame, config: ForestConfig, id_col: str, text_col: str
) -> DataFrame:
    """Stored rows (set_id, group, n, copies, shingles) of the classes in candidate groups, from one document each."""
    wanted = classes.join(groups, "set_id").select("set_id", "group", "copies", "keep")
    texts = _texts(docs, id_col, text_col)
    same = texts["doc_id"].eqNullSafe(wanted["keep.doc_id"]) & (texts["digest"] == wanted["keep.digest"])
    rows = texts.join(wanted, same).select("set_id", "group", "copies", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(x or "", config.words) for x in batch["text"]]
            yield batch[["set_id", "group", "copies"]].assign(n=[len(s) for s in sets], shingles=[s.tobytes() for s in sets])

    kinds = "set_id binary, group binary, copies bigint, n bigint, shingles binary"
    return write_scratch(rows.mapInPandas(run, kinds).dropDuplicates(["set_id"]), "candidate-sets")


def blocks(sets: DataFrame, config: ForestConfig) -> DataFrame:
    """``sets`` dealt to pairs of blocks (group, block_a, block_b); a group of one block is one unit of work."""
    size = sets.groupBy("group").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    parts = F.greatest(F.ceil(F.col("m") / config.block_classes), F.ceil(F.col("total") / config.block_shingles))
    rows = sets.join(size.select("group", parts.cast("int").alias("parts")), "group")
    own = F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    return (
        rows.withColumn("block", own)
        .withColumn("other", other)
        .select(
            "group",
            F.least("block", "other").alias("block_a"),
            F.greatest("block", "other").alias("block_b"),
            "block",
            *("set_id", "copies", "n", "shingles"),
        )
    )


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of common shingles of all pairs of sets, from the postings of each shingle."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    key = np.concatenate(sets)
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(start, len(key)))
    counts = np.zeros(m * m, np.int64)
    for s in np.unique(size[(size > 1) & (size <= 24)]):
        held = owner[start[size == s][:, None] + np.arange(s)]
        a, b = np.triu_indices(s, 1)
        for at in range(0, len(held), max(1, 2_000_000 // len(a))):
            part = held[at : at + max(1, 2_000_000 // len(a))]
            counts += np.bincount((part[:, a] * m + part[:, b]).ravel(), minlength=m * m)
    counts = counts.reshape(m, m)
    wide = np.flatnonzero(size > 24)
    for at in range(0, len(wide), 2048):
        columns = wide[at : at + 2048]
        matrix = np.zeros((m, len(columns)), np.float32)
        column = np.repeat(np.arange(len(columns)), size[columns])
        first = np.repeat(start[columns] - np.concatenate(([0], size[columns].cumsum()[:-1])), size[columns])
        matrix[owner[first + np.arange(len(first))], column] = 1
        counts += np.triu((matrix @ matrix.T).astype(np.int64), 1)
    return counts + counts.T


def verify(unit: pd.DataFrame, config: ForestConfig) -> pd.DataFrame:
    """Rows a class of one pair of blocks: links, copies linked, an edge to the first class of its component."""
    unit = unit.sort_values("set_id", ignore_index=True)
    sets = [np.frombuffer(s, np.uint64) for s in unit["shingles"]]
    n, m = unit["n"].to_numpy(np.int64), len(unit)
    common = common_counts(sets)
    either = n[:, None] + n[None, :] - common
    links = common * config.similarity[1] >= config.similarity[0] * either
    np.fill_diagonal(links, False)
    block = unit["block"].to_numpy()
    if unit["block_a"].iat[0] != unit["block_b"].iat[0]:
        links &= block[:, None] != block[None, :]
    root = np.full(m, -1)
    for i in range(m):
        if root[i] < 0:
            root[i], edge = i, np.array([i])
            while len(edge):
                edge = np.flatnonzero(links[edge].any(0) & (root < 0))
                root[edge] = i
    ids = unit["set_id"].to_numpy()
    return pd.DataFrame(
        {
            "set_id": ids,
            "root": ids[root],
            "links": links.sum(1),
            "copies": links @ unit["copies"].to_numpy(np.int64),
        }
    )


def verified(sets: DataFrame, config: ForestConfig) -> DataFrame:
    """Stored rows of ``verify`` over all pairs of blocks."""
    key = ["group", "block_a", "block_b"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            new = (batch[key] != batch[key].shift()).any(axis=1).to_numpy()
            cuts = np.flatnonzero(new)
            if held and tuple(held[0][key].iloc[0]) == tuple(batch[key].iloc[0]):
                cuts = cuts[1:]
            out = []
            for a, b in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                if a in cuts and held:
                    out.append(verify(pd.concat(held, ignore_index=True), config))
                    held = []
                if b > a:
                    held.append(batch.iloc[a:b])
            if out:
                yield pd.concat(out, ignore_index=True)
        if held:
            yield verify(pd.concat(held, ignore_index=True), config)

    dealt = blocks(sets, config).repartition(*key).sortWithinPartitions(*key)
    kinds = "set_id binary, root binary, links bigint, copies bigint"
    return write_scratch(dealt.mapInPandas(run, kinds), "verified")


def similar_documents(
    docs: DataFrame, config: ForestConfig = ForestConfig(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, class_id, class_size, n_links (documents similar to it), n_text_links (different sets similar to its own)."""
    rows = _classified(docs, config, id_col, text_col)
    return rows.select("doc_id", "class_id", "class_size", "n_links", "n_text_links")


def _classified(docs: DataFrame, config: ForestConfig, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``similar_documents`` with the digest of the text and ``keep`` (doc_id, digest), the row of its class that stays."""
    rows = signatures(docs, config, id_col, text_col)
    classes = write_scratch(
        rows.filter("n > 0")
        .groupBy("set_id")
        .agg(F.max(F.struct("doc_id", "digest")).alias("keep"), F.count("*").alias("copies"), F.first("labels").alias("labels")),
        "classes",
    )
    pairs = write_scratch(neighbours(classes, config), "pairs")
    grouped = connected_components(pairs.select("id_a", "id_b").distinct())
    groups = write_scratch(grouped.select(F.col("id").alias("set_id"), F.col("cluster_id").alias("group")), "groups")
    sets = candidate_sets(docs, classes.drop("labels"), groups, config, id_col, text_col)
    found = verified(sets, config)
    edges = found.filter("root != set_id").select(F.col("root").alias("id_a"), F.col("set_id").alias("id_b")).distinct()
    members = connected_components(edges).select(F.col("id").alias("set_id"), F.col("cluster_id").alias("root"))
    degrees = found.groupBy("set_id").agg(F.sum("links").alias("links"), F.sum("copies").alias("linked"))
    of_set = (
        classes.drop("labels")
        .join(members, "set_id", "left")
        .join(degrees, "set_id", "left")
        .withColumn("root", F.coalesce("root", "set_id"))
    )
    of_set = write_scratch(of_set, "sets")
    named = of_set.groupBy("root").agg(F.max("keep").alias("keep"), F.sum("copies").alias("class_size"))
    known = of_set.join(named, "root").select(
        "set_id",
        named["keep"],
        "class_size",
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("links", F.lit(0)).alias("n_text_links"),
    )
    without = F.col("set_id").isNull()
    return (
        rows.select("doc_id", "digest", "set_id")
        .join(known, "set_id", "left")
        .select(
            "doc_id",
            "digest",
            F.when(without, F.struct("doc_id", "digest")).otherwise(F.col("keep")).alias("keep"),
            F.when(without, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("class_id"),
            F.when(without, 1).otherwise(F.col("class_size")).cast("bigint").alias("class_size"),
            F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
            F.coalesce("n_text_links", F.lit(0)).cast("bigint").alias("n_text_links"),
        )
    )


def drop_similar(docs: DataFrame, config: ForestConfig = ForestConfig()) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) less those similar to one that stays, all columns; one of each class stays.

    The row with the largest (doc_id, digest of the text) stays. The pairs that go are joined, not those that stay.
    Rows that repeat a kept id and its text stay together.
    """
    found = _classified(docs, config, "doc_id", "text")
    kept = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("digest") == F.col("keep.digest"))
    gone = found.filter(~kept).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    gone = write_scratch(gone, "similar")
    same = docs["doc_id"].eqNullSafe(gone["__id"]) & (text_digest(docs["text"]) == gone["__digest"])
    return docs.join(gone, same, "left_anti")

"""Quality rules with an isolation forest over the statistics that the rules use.

Every text gives the counts of the fixed rules and, from the same pass, ratios that
do not depend on its length, taken as logarithms, so that a tenth and a half differ as clearly as one and five.
Trees of random splits are grown over small samples of rows that are labelled good; a split
is drawn over the part of the box of *all* rows that its node covers, so a value that no good row has is
soon alone. A text that few splits set apart has short paths and is an anomaly.
The score is the mean path length over the trees, one forest over all ratios. Rows with a quality label say where
anomaly begins: at the score that parts good from bad best among those that reject at most
``max_good_loss`` of the good rows. Where no score parts them, the forest rejects nothing.

Sizes: the forest is fitted on at most ``fit_rows`` labelled rows, those of the smallest hash
of their id and counts (a documented bound, the same rows whatever the partitions); calibration
counts all labelled rows in ``SCORE_BINS`` bins before anything reaches the driver.
The statistics, the box, scores and verdicts cover all rows and whole texts.

Defined cases: a null text has no words. A text without words has ratios of 0 and
fails the base rule. Rows with equal doc_id are judged each by its own text; labels
that repeat or contradict each count. Without labels of both kinds nothing
but the base rule rejects, and scores are 0. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskiln.scratch import write_scratch

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("symbols_per_word", "dup_line_share", "repeat_share", "word_length", "upper_share", "marks_per_word")
# added before the logarithm: differences far below these do not count
OFFSETS = (0.01, 0.01, 0.01, 0.5, 0.005, 0.01)
SCORE_BINS = 2_000


@dataclass(frozen=True)
class QualityConfig:
    trees: int = 200
    sample: int = 256
    fit_rows: int = 20_000
    max_good_loss: float = 0.005
    seed: int = 7


def repeated_words(ids: np.ndarray) -> int:
    """Words inside three-word windows that occur at least twice, first occurrence included."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    size = np.int64(ids.max()) + 1
    if size < 2_000_000:
        keys = (ids[:n] * size + ids[1 : n + 1]) * size + ids[2:]
    else:  # numbers of pairs first, so that keys stay within 64 bits
        _, pair = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)
        keys = pair[:n] * size + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    repeated = np.zeros(n, bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    at = np.flatnonzero(repeated)
    covered = np.zeros(len(ids), bool)
    for k in range(WINDOW):
        covered[at + k] = True
    return int(covered.sum())


def statistics(text: str) -> tuple:
    """The counts and ratios of one whole text."""
    data = text.encode("utf-8")
    words = data.split()  # bytes split at exactly the six characters of the rule
    n_words = len(words)
    spaces = sum(map(text.count, " \t\n\r\x0b\x0c"))
    word_chars = len(text) - spaces
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    n_dup_lines = len(lines) - len(set(lines))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n_words)
    n_repeat = repeated_words(ids)
    upper = sum(map(str.isupper, text)) if n_words else 0
    marks = sum(map(text.count, "!?.,;:"))
    per_word, per_char = max(1, n_words), max(1, word_chars)
    ratios = (
        n_symbols / per_word,
        n_dup_lines / max(1, len(lines)),
        n_repeat / per_word,
        word_chars / per_word,
        upper / per_char,
        marks / per_word,
    )
    return (n_words, word_chars, n_symbols, n_dup_lines, n_repeat, *ratios)


def text_digest(text: Column) -> Column:
    """SHA-256 of the whole text; a null text is empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest of the text, counts, ratios, base_failed) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([statistics(x or "") for x in batch["text"]], columns=[*COUNTS, *RATIOS], index=batch.index)
            yield pd.concat([batch[["doc_id", "digest"]], found], axis=1)

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), text_digest(text).alias("digest"))
    kinds = [f"{c} bigint" for c in COUNTS] + [f"{c} double" for c in RATIOS]
    stats = rows.mapInPandas(run, ", ".join(["doc_id bigint", "digest binary", *kinds]))
    return stats.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )


# ---- the forest


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    m = np.maximum(n, 2.0)
    deep = 2 * (np.log(np.maximum(m - 1, 1.0)) + 0.5772156649) - 2 * (m - 1) / m
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, deep))


class IsolationForest:
    """Trees as arrays, one row a tree: the feature of a split (-1 in a leaf), its value, and the path length of a leaf.

    Node i has children 2i + 1 and 2i + 2; depth is bounded by log2 of the sample. Splits are drawn over the range
    of the rows of a node, or, with a ``box`` (least and largest values), over the part of the box that the node covers.
    """

    def __init__(self, rows: np.ndarray, config: QualityConfig, box: tuple[np.ndarray, np.ndarray] | None = None):
        rng = np.random.default_rng(config.seed)
        sample = min(config.sample, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(2, sample)))))
        size = 2 ** (self.depth + 1) - 1
        self.feature = np.full((config.trees, size), -1, np.int16)
        self.value = np.zeros((config.trees, size))
        self.path = np.zeros((config.trees, size))
        self.norm = max(1e-9, float(mean_path(sample)))
        for tree in range(config.trees):
            self._grow(tree, rows[rng.choice(len(rows), sample, replace=False)], rng, box)

    def _grow(self, tree: int, rows: np.ndarray, rng: np.random.Generator, box: tuple[np.ndarray, np.ndarray] | None) -> None:
        stack = [(0, 0, rows, box)]
        while stack:
            node, depth, part, inside = stack.pop()
            if len(part) > 1 and depth < self.depth:
                low, high = inside or (part.min(0), part.max(0))
                wide = np.flatnonzero(high > low)
            else:
                wide = ()
            if not len(wide):
                self.path[tree, node] = depth + float(mean_path(len(part)))
                continue
            f = rng.choice(wide)
            cut = rng.uniform(low[f], high[f])
            self.feature[tree, node], self.value[tree, node] = f, cut
            left, below, above = part[:, f] <= cut, None, None
            if inside:
                below, above = (low, high.copy()), (low.copy(), high)
                below[1][f] = above[0][f] = cut
            stack += [(2 * node + 1, depth + 1, part[left], below), (2 * node + 2, depth + 1, part[~left], above)]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / mean path of the sample): near 1 for anomalies, below 0.5 for the ordinary."""
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, value, path in zip(self.feature, self.value, self.path, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                right = rows[every, np.maximum(f, 0)] > value[node]
                node = np.where(f < 0, node, 2 * node + 1 + right)
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def scaled(ratios: np.ndarray) -> np.ndarray:
    return np.log(ratios + np.array(OFFSETS))


def fit_forest(stats: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> IsolationForest | None:
    """The forest over at most ``fit_rows`` rows that pass the base rule and are labelled good; None without any.

    Its box is that of all rows which pass the base rule.
    """
    passed = stats.filter("NOT base_failed")
    good = passed.join(labels.filter("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    ends = [F.min(c).alias(f"low_{c}") for c in RATIOS] + [F.max(c).alias(f"high_{c}") for c in RATIOS]
    box = passed.agg(*ends).first()
    n = good.count()
    if not n:
        return None
    # a hash below this limit marks about twice the rows needed, so few rows are sorted
    draw = F.pmod(F.xxhash64("doc_id", "n_words", "word_chars", F.lit(config.seed)), F.lit(1 << 40))
    limit = min(1 << 40, (1 << 40) * 2 * config.fit_rows // n + 1)
    rows = (
        good.select(draw.alias("draw"), "doc_id", *RATIOS)
        .filter(F.col("draw") < limit)
        .orderBy("draw", "doc_id", *RATIOS)
        .limit(config.fit_rows)
        .select(*RATIOS)
        .toPandas()
    )
    if not len(rows):
        return None
    low, high = (scaled(np.array([box[f"{end}_{c}"] for c in RATIOS], float)) for end in ("low", "high"))
    return IsolationForest(scaled(rows.to_numpy(float)), config, (low, high))


def scored(stats: DataFrame, forest: IsolationForest | None) -> DataFrame:
    """``stats`` with the score; the size of the forest is fixed by its parameters."""
    if forest is None:
        return stats.withColumn("score", F.lit(0.0))
    shared = stats.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(columns: pd.DataFrame) -> pd.Series:
        return pd.Series(shared.value.score(scaled(columns[[*RATIOS]].to_numpy(float))))

    return stats.withColumn("score", score(F.struct(*RATIOS)))


def calibrate(rows: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> float:
    """The score from which rows are rejected; ``labels`` has (doc_id, quality 0/1).

    Labelled rows are counted by bin of the score, good and bad apart.
    The threshold lies in the middle of the scores that part the labelled rows equally well; it is above
    every score where none parts them.
    """
    marked = labels.filter(F.col("quality").isin(0, 1)).select("doc_id", "quality")
    binned = (
        rows.filter("NOT base_failed")
        .join(marked, "doc_id")
        .groupBy(F.floor(F.col("score") * SCORE_BINS).cast("int").alias("bin"))
        .agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
        .toPandas()
    )
    good, bad = np.zeros(SCORE_BINS + 2), np.zeros(SCORE_BINS + 2)
    good[binned["bin"]], bad[binned["bin"]] = binned["good"], binned["bad"]
    if not good.sum() or not bad.sum():
        return 2.0
    # rows rejected if the threshold is the lower border of each bin
    lost, caught = good[::-1].cumsum()[::-1], bad[::-1].cumsum()[::-1]
    allowed = lost <= config.max_good_loss * good.sum()
    gain = np.where(allowed, caught / bad.sum() - lost / good.sum(), -1.0)
    if gain.max() <= 0:
        return 2.0
    at = np.flatnonzero(gain == gain.max())
    return (at[0] + at[-1]) / 2 / SCORE_BINS


def judge(
    docs: DataFrame,
    labels: DataFrame,
    config: QualityConfig = QualityConfig(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, the digest, the counts, base_failed, kept, score, ratios of every row of ``docs``.

    Rows are rejected from the calibrated score on.
    The statistics are stored once; the forest, the calibration and the verdicts read them.
    """
    stats = write_scratch(text_statistics(docs, id_col, text_col), "quality")
    rows = write_scratch(scored(stats, fit_forest(stats, labels, config)), "scores")
    threshold = calibrate(rows, labels, config)
    kept = ~F.col("base_failed") & (F.col("score") < F.lit(float(threshold)))
    return rows.select("doc_id", "digest", *COUNTS, "base_failed", kept.alias("kept"), "score", *RATIOS)


def drop_low_quality(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that are kept, all columns. Ids and digests of rejected rows travel, not texts.

    Rows of one id, or without an id, are judged and removed each by its own text.
    """
    gone = judge(docs, labels, config).filter("NOT kept").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    # the row as one column, so that no name of its own can clash
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    keyed = docs.select(row, F.col("doc_id").alias("__own_id"), text_digest(F.col("text")).alias("__own_digest"))
    same = F.col("__own_id").eqNullSafe(F.col("__id")) & (F.col("__own_digest") == F.col("__digest"))
    return keyed.join(gone.distinct(), same, "left_anti").select("__row.*")

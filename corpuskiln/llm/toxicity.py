"""Toxicity of whole texts: gradient-boosted trees over a few dense features, with isotonic calibration.

The features are densities of two lexicons (a stated one, and one learned from labelled texts), how near their
words stand to words of the second person, shares of capitals, rates of exclamation and runs of marks, and rates of disguised
words (digits and signs for letters, stars, stretched or spaced letters). Language, source and id are
no features.

Fitting uses a bounded sample of labelled rows: at most ``fit_rows`` of either class, those of the
smallest hash of their id, and none whose id's checksum is 2 modulo ``CHECK_PARTS``; these are held out. Rows weigh as many rows
as they stand for. The sample is cut into folds by the same checksum. The lexicon behind the features of a row is
learned from the other folds, so that the trees do not trust words that were picked by their own label.
Calibration orders the scores that trees of the other folds give, and makes them monotone by pooling neighbours.
Words are counted by Spark; lists of words, features of the sample and trees have sizes set by parameters.

Every text is scored whole, in one pass without a shuffle. The cache of tokens of a Python worker is bounded.

Defined cases: a null text is empty, an empty text has features of 0 and a score like any other. Rows without an id are scored and count as not
held out. Rows of one id are each scored by their own text; of a labelled id one text is fitted, the one of the smallest
digest, toxic if any of its labels says so. Labels other than 0 and 1, and labels without text, are not used.
Without labelled rows of both classes the score is h / (h + 1) for h words of the stated lexicon. An
empty table gives an empty result. Columns not named as parameters are not read.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskiln.scratch import write_scratch

CHECK_PARTS = 4
HELD_OUT = 2
PREDICT_FROM = 0.3

# Common insults, the stated lexicon.
INSULTS = (
    "arsehole asshole bastard bitch clown coward cretin creep crap cunt degenerate dickhead disgusting dumb dumbass fool freak "
    "filthy garbage hate hideous idiot idiotic imbecile jerk kill liar loser lunatic maggot moron moronic parasite pathetic pig "
    "prick psycho rat retard retarded scum scumbag shit shut sick slut stupid subhuman suck sucks swine trash trashy ugly useless "
    "vermin vile whore worthless abschaum arschloch bastardo basura blödmann connard débile dummkopf estúpido hurensohn "
    "idiota imbécil imbécile mierda miststück ordure pendejo puta pute salaud salope schwein trottel vollidiot"
).split()
# Words of the second person in English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur ya you're youre du dich dir dein deine deiner deinen deinem ihr euch euer eure "
    "tu te toi ton ta tes vous votre vos tú ti tuyo tuya tus usted ustedes vosotros vuestro os".split()
)
# Signs that stand for letters.
DISGUISES = str.maketrans("013457@$!|+", "oieasiasilt")

NEAR_WORDS = 5
MIN_SPACED = 4
CACHE_TOKENS = 200_000
WORD = re.compile(r"[^\W_]+")
# a sign or digit before a letter: inside a token it may stand for a letter, or part letters
SIGNS = re.compile(r"[0-9@$*#!|+._\-~^'’]+(?=[^\W\d_])")
MARK_RUN = re.compile(r"[!?]{2,}|[#$%&*@]{3,}")
TOKEN_END = re.compile(r"\s|$")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
CLOSING = re.compile(r"[\s.,;:!?…\"')\]}»”]+$")
SEPARATORS = re.compile(r"[._\-~^'’]+")
STRETCHED = re.compile(r"(.)\1{2,}")
INSIDE = re.compile(r"[^\W\d_][\d@$*#!|+]+[^\W\d_]")

LETTER, UPPER, ALNUM, SPACE = 1, 2, 4, 8


@cache
def character_classes() -> np.ndarray:
    """The classes of every code point, once a worker."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for code in range(len(table)):
        c = chr(code)
        table[code] = LETTER * c.isalpha() + UPPER * c.isupper() + ALNUM * c.isalnum() + SPACE * c.isspace()
    return table


FEATURES = (
    "log_words",
    "stated_density",
    "stated_words",
    "stated_kinds",
    "learned_density",
    "learned_words",
    "learned_weight",
    "second_person",
    "near_second_person",
    "nearness",
    "capital_letters",
    "capital_words",
    "exclamations",
    "mark_runs",
    "disguised",
    "disguised_lexicon",
)


@dataclass(frozen=True)
class ToxicityConfig:
    fit_rows: int = 8_000  # of either class
    lexicon_words: int = 200
    min_toxic_texts: int = 5
    min_log_odds: float = 2.0
    trees: int = 60
    depth: int = 3
    bins: int = 64
    rate: float = 0.2
    min_curvature: float = 1.0  # of a child; a row adds its weight times p (1 - p)
    penalty: float = 1.0


# ---- features


class TextFeatures:
    """Features of texts by a learned lexicon (word: log odds); remembers which word a disguised token stands for."""

    def __init__(self, learned: dict[str, float]):
        self.learned = learned
        self.stated = frozenset(INSULTS)
        self.known = self.stated | set(learned)
        self.wanted = self.known | SECOND_PERSON
        self.by_length: dict[int, list[str]] = {}
        for word in sorted(self.known):
            self.by_length.setdefault(len(word), []).append(word)
        self.unmasked: dict[str, str] = {}

    def unmask(self, token: str) -> str:
        """The word of a lexicon that a disguised token stands for, or an empty string."""
        folded = SEPARATORS.sub("", CLOSING.sub("", token).lower())
        plain = EDGES.sub("", folded.translate(DISGUISES))
        for word in (plain, STRETCHED.sub(r"\1\1", plain), STRETCHED.sub(r"\1", plain)):
            if word in self.known:
                return word
        masked = folded.strip("\"'([{")
        if "*" in masked or "#" in masked:
            letters = sum(c not in "*#" for c in masked)
            if 2 * letters >= len(masked) and len(masked) > 3:
                for word in self.by_length.get(len(masked), ()):
                    if all(c in "*#" or c == w for c, w in zip(masked, word, strict=True)):
                        return word
        return ""

    def disguised(self, text: str, kinds: np.ndarray, codes: np.ndarray) -> tuple[int, dict[int, str]]:
        """How many tokens have signs inside, and the words of the lexicons in disguise by the place where they start."""
        places = {m.start() for m in SIGNS.finditer(text)}
        letter = (kinds & LETTER) > 0
        if len(codes) > 2:
            same = letter[2:] & (codes[2:] == codes[1:-1]) & (codes[1:-1] == codes[:-2])
            places.update(np.flatnonzero(same).tolist())
        found: dict[int, str] = {}
        n, end = 0, -1
        space = (kinds & SPACE) > 0
        for at in sorted(places):
            if at < end:
                continue  # the same token
            start = at
            while start and not space[start - 1]:
                start -= 1
            end = TOKEN_END.search(text, at).start()
            token = text[start:end]
            word = self.unmasked.get(token)
            if word is None:
                plain = EDGES.sub("", token)
                hidden = "" if plain.lower() in self.known else self.unmask(token)
                word = hidden or ("-" if INSIDE.search(plain) else "")
                if len(self.unmasked) > CACHE_TOKENS:
                    self.unmasked.clear()
                self.unmasked[token] = word
            n += word != ""
            if word not in ("", "-"):
                found[start] = word
        if len(codes) >= 2 * MIN_SPACED - 1:  # letters with one sign or space between them
            alone = letter.copy()
            alone[1:] &= ~letter[:-1]
            alone[:-1] &= ~letter[1:]
            single = np.flatnonzero(alone)
            for run in np.split(single, np.flatnonzero(np.diff(single) != 2) + 1):
                if len(run) >= MIN_SPACED:
                    word = "".join(text[i] for i in run).lower()
                    if word in self.known and run[0] not in found:
                        found[int(run[0])] = word
                        n += 1
        return n, found

    def of(self, text: str) -> list[float]:
        words = WORD.findall(text.lower())
        n = len(words)
        if not n:
            return [0.0] * len(FEATURES)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = character_classes()[codes]
        letters, capitals = int(np.count_nonzero(kinds & LETTER)), int(np.count_nonzero(kinds & UPPER))
        shouted = self.shouted(kinds) if capitals > 1 else 0
        wanted = self.wanted
        seen = [(at, w) for at, w in enumerate(words) if w in wanted]
        disguised, hidden = self.disguised(text, kinds, codes)
        hits = [(at, w) for at, w in seen if w in self.known]
        if hidden:
            alnum = (kinds & ALNUM) > 0
            starts = np.flatnonzero(alnum & ~np.append(False, alnum[:-1]))
            hits += [(int(np.searchsorted(starts, at)), w) for at, w in hidden.items()]
        stated = [w for _, w in hits if w in self.stated]
        learned = [self.learned[w] for _, w in hits if w in self.learned]
        second = [at for at, w in seen if w in SECOND_PERSON]
        near, closest = 0, n
        if hits and second:
            persons = np.array(second)
            for at, _ in hits:
                right = int(np.searchsorted(persons, at))
                gap = min(abs(at - second[i]) for i in (right - 1, right) if 0 <= i < len(second))
                near += gap <= NEAR_WORDS
                closest = min(closest, gap)
        has_marks = any(mark in text for mark in "!?#$%&*@")
        return [
            math.log1p(n),
            len(stated) / n,
            math.log1p(len(stated)),
            float(len(set(stated))),
            len(learned) / n,
            math.log1p(len(learned)),
            max(learned, default=0.0),
            len(second) / n,
            near / max(1, len(hits)),
            1.0 / (1 + closest) if hits and second else 0.0,
            capitals / max(1, letters),
            shouted / n,
            (text.count("!") + text.count("?")) / n,
            len(MARK_RUN.findall(text)) / n if has_marks else 0.0,
            disguised / n,
            math.log1p(len(hidden)),
        ]

    @staticmethod
    def shouted(kinds: np.ndarray) -> int:
        """Stretches of two letters or more that are all capitals."""
        letter = np.concatenate(([False], (kinds & LETTER) > 0, [False]))
        edges = np.flatnonzero(letter[1:] != letter[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.append(0, np.cumsum((kinds & UPPER) > 0))
        return int(np.count_nonzero((ends - starts > 1) & (sums[ends] - sums[starts] == ends - starts)))


# ---- gradient-boosted trees


class BoostedTrees:
    """Full trees of one depth, split on quantiles of the features, grown on the gradient of the logistic loss.

    Node i has children 2i + 1 and 2i + 2. A node that cannot be split sends all rows to the left.
    """

    def __init__(self, rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, config: ToxicityConfig):
        self.depth = config.depth
        inner, leaves = 2**config.depth - 1, 2**config.depth
        self.feature = np.zeros((config.trees, inner), np.int16)
        self.cut = np.full((config.trees, inner), np.inf)
        self.leaf = np.zeros((config.trees, leaves))
        mean = float(np.clip(np.average(labels, weights=weights), 1e-6, 1 - 1e-6))
        self.start = math.log(mean / (1 - mean))
        cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, config.bins + 1)[1:-1])) for f in range(rows.shape[1])]
        # zero parts texts without a word from those with one, however few have one
        cuts = [np.unique(np.append(c, 0.0)) for c in cuts]
        binned = np.stack([np.searchsorted(c, rows[:, f], side="left") for f, c in enumerate(cuts)], 1)
        margin = np.full(len(rows), self.start)
        for tree in range(config.trees):
            p = 1 / (1 + np.exp(-margin))
            node = self._grow(tree, binned, cuts, weights * (p - labels), weights * p * (1 - p), config)
            margin += self.leaf[tree, node]

    def _grow(self, tree, binned, cuts, gradient, curvature, config) -> np.ndarray:
        node = np.zeros(len(binned), np.int64)
        for level in range(self.depth):
            width = 2**level
            best = np.zeros(width)
            choice = [(0, np.inf)] * width
            for f, c in enumerate(cuts):
                size = len(c) + 1
                at = node * size + binned[:, f]
                g = np.bincount(at, gradient, width * size).reshape(width, size)
                h = np.bincount(at, curvature, width * size).reshape(width, size)
                left_g, left_h = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
                all_g, all_h = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                right_g, right_h = all_g - left_g, all_h - left_h

                def worth(a, b):
                    return a * a / (b + config.penalty)

                gain = worth(left_g, left_h) + worth(right_g, right_h) - worth(all_g, all_h)
                enough = (left_h >= config.min_curvature) & (right_h >= config.min_curvature)
                gain = np.where(enough, gain, -1.0)
                top = gain.argmax(1)
                for k in range(width):
                    if gain[k, top[k]] > best[k] + 1e-9:
                        best[k], choice[k] = gain[k, top[k]], (f, float(c[top[k]]))
            first = width - 1
            for k, (f, cut) in enumerate(choice):
                self.feature[tree, first + k], self.cut[tree, first + k] = f, cut
            right = np.zeros(len(binned), bool)
            for k, (f, cut) in enumerate(choice):
                own = node == k
                right[own] = binned[own, f] > (np.searchsorted(cuts[f], cut) if np.isfinite(cut) else np.inf)
            node = 2 * node + right
        g = np.bincount(node, gradient, 2**self.depth)
        h = np.bincount(node, curvature, 2**self.depth)
        self.leaf[tree] = -config.rate * g / (h + config.penalty)
        return node

    def margin(self, rows: np.ndarray) -> np.ndarray:
        every, total = np.arange(len(rows)), np.full(len(rows), self.start)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (rows[every, feature[node]] > cut[node])
            total += leaf[node - len(cut)]
        return total


def isotonic(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (margin, share of label 1) of the monotone step function nearest to the labels, by pooling neighbours."""
    points, place = np.unique(margins, return_inverse=True)
    mass = np.bincount(place, weights)
    share = np.bincount(place, weights * labels) / mass
    blocks: list[list[float]] = []  # share, mass, mass times margin
    for x, y, w in zip(points, share, mass, strict=True):
        blocks.append([y, w, w * x])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            y2, w2, x2 = blocks.pop()
            y1, w1, x1 = blocks[-1]
            blocks[-1] = [(y1 * w1 + y2 * w2) / (w1 + w2), w1 + w2, x1 + x2]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] for b in blocks])


# ---- fitting


@dataclass
class ToxicityModel:
    learned: dict[str, float]
    trees: BoostedTrees | None
    margins: np.ndarray
    shares: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.trees is None:
            hits = np.expm1(features[:, FEATURES.index("stated_words")])
            return hits / (hits + 1)
        return np.clip(np.interp(self.trees.margin(features), self.margins, self.shares), 0.0, 1.0)


def check_part(doc_id: Column) -> Column:
    """Checksum of the id's text, modulo ``CHECK_PARTS``; rows of part ``HELD_OUT`` never serve for fitting."""
    return F.crc32(doc_id.cast("string").cast("binary")) % CHECK_PARTS


def fit_sample(docs: DataFrame, labels: DataFrame, config: ToxicityConfig, id_col: str, text_col: str) -> DataFrame:
    """Stored rows (doc_id, text, toxic, fold, weight), at most ``fit_rows`` of either class."""
    marked = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (check_part(F.col("doc_id")) != HELD_OUT))
    marked = marked.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = [
        marked.filter(F.col("toxic") == k)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(config.fit_rows)
        .withColumn("weight", F.lit(max(1.0, totals.get(k, 0) / config.fit_rows)))
        for k in (0, 1)
    ]
    chosen = write_scratch(parts[0].unionByName(parts[1]).withColumn("fold", check_part(F.col("doc_id"))), "fit-ids")
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    # at most 2 * fit_rows ids
    found = texts.filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id", "toxic", "weight", "fold").agg(F.min_by("text", F.sha2("text", 256)).alias("text"))
    return write_scratch(one, "fit-sample")


def learn_lexicons(sample: DataFrame, config: ToxicityConfig) -> dict[int | None, dict[str, float]]:
    """For each fold the words that the other folds show to be toxic, and for None those of all folds.

    A word counts once a text. Of the words that pass in any of these, the best ``lexicon_words`` of each leave Spark.
    """
    folds = [k for k in range(CHECK_PARTS) if k != HELD_OUT]
    texts = {(r["fold"], r["toxic"]): r["n"] for r in sample.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}[\p{L}\p{N}]+)"), F.lit(1)))
    counted = (
        sample.select("fold", "toxic", F.explode(words).alias("word"))
        .groupBy("word")
        .agg(
            *[
                F.count_if((F.col("fold") == f) & (F.col("toxic") == y)).alias(f"n{y}_{f}")
                for f in folds
                for y in (0, 1)
            ]
        )
        .filter(sum((F.col(f"n1_{f}") for f in folds), F.lit(0)) >= config.min_toxic_texts)
    )
    counted = write_scratch(counted, "word-counts")
    lexicons: dict[int | None, dict[str, float]] = {}
    for left_out in (None, *folds):
        used = [f for f in folds if f != left_out]
        toxic = sum((F.col(f"n1_{f}") for f in used), F.lit(0))
        clean = sum((F.col(f"n0_{f}") for f in used), F.lit(0))
        all_toxic, all_clean = (sum(texts.get((f, y), 0) for f in used) for y in (1, 0))
        odds = F.log((toxic + 0.5) / F.lit(all_toxic + 1.0)) - F.log((clean + 0.5) / F.lit(all_clean + 1.0))
        best = (
            counted.select("word", odds.alias("odds"), toxic.alias("toxic"))
            .filter((F.col("toxic") >= config.min_toxic_texts) & (F.col("odds") >= config.min_log_odds))
            .orderBy((F.col("odds") * F.sqrt("toxic")).desc(), "word")
            .limit(config.lexicon_words)
        )
        lexicons[left_out] = {r["word"]: float(r["odds"]) for r in best.collect()}
    return lexicons


def fit(
    docs: DataFrame,
    labels: DataFrame,
    config: ToxicityConfig = ToxicityConfig(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> ToxicityModel:
    sample = fit_sample(docs, labels, config, id_col, text_col)
    lexicons = learn_lexicons(sample, config)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = {f: TextFeatures(words) for f, words in lexicons.items() if f is not None}
        for batch in batches:
            found = [readers[f].of(t) for f, t in zip(batch["fold"], batch["text"], strict=True)]
            table = pd.DataFrame(found, columns=[*FEATURES], index=batch.index)
            yield pd.concat([batch[["doc_id", "toxic", "fold", "weight"]], table], axis=1)

    kinds = ", ".join(f"{c} double" for c in FEATURES)
    read = sample.select("doc_id", "toxic", F.col("fold").cast("int").alias("fold"), "weight", "text")
    table = read.mapInPandas(run, f"doc_id bigint, toxic int, fold int, weight double, {kinds}").toPandas()
    table = table.sort_values("doc_id")
    x, y = table[[*FEATURES]].to_numpy(float), table["toxic"].to_numpy(float)
    w, fold = table["weight"].to_numpy(float), table["fold"].to_numpy()
    if len(set(y)) < 2:
        return ToxicityModel({}, None, np.zeros(0), np.zeros(0))
    margins = np.empty(len(x))
    for f in set(fold):
        own = fold == f
        rest = ~own if len(set(y[~own])) > 1 else np.ones(len(x), bool)
        margins[own] = BoostedTrees(x[rest], y[rest], w[rest], config).margin(x[own])
    return ToxicityModel(lexicons[None], BoostedTrees(x, y, w, config), *isotonic(margins, y, w))


def score_texts(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, and the features of every row; the model has a size fixed by its parameters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        reader = TextFeatures(own.learned)
        for batch in batches:
            table = np.array([reader.of(t or "") for t in batch["text"]], float).reshape(-1, len(FEATURES))
            scores = own.scores(table)
            out = pd.DataFrame(table, columns=[*FEATURES], index=batch.index)
            head = batch[["doc_id", "held_out"]].assign(score=scores, predicted=(scores >= PREDICT_FROM).astype("int32"))
            yield pd.concat([head, out], axis=1)

    held_out = F.coalesce(check_part(F.col(f"`{id_col}`")) == HELD_OUT, F.lit(False))
    rows = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), held_out.alias("held_out"), F.col(f"`{text_col}`").alias("text")
    )
    kinds = ", ".join(f"{c} double" for c in FEATURES)
    return rows.mapInPandas(run, f"doc_id bigint, held_out boolean, score double, predicted int, {kinds}")


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    config: ToxicityConfig = ToxicityConfig(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from ``PREDICT_FROM``) of every row of ``docs``."""
    scored = score_texts(docs, fit(docs, labels, config, id_col, text_col), id_col, text_col)
    return scored.select("doc_id", "held_out", "score", "predicted")

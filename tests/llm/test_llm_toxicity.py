import random
import zlib

import numpy as np
import pytest
from llm_cases import ODD_TEXTS, documents, words

from corpuskiln.llm.toxicity import (
    FEATURES,
    INSULTS,
    BoostedTrees,
    TextFeatures,
    ToxicityConfig,
    fit,
    isotonic,
    toxicity,
)

CONFIG = ToxicityConfig(trees=30)
LABELS = "doc_id bigint, quality int, toxic int, text string, weight string"


def part(i):
    return zlib.crc32(str(i).encode()) % 4


def corpus(n, insults, seed=0):
    rnd, docs, labels = random.Random(seed), [], []
    for i in range(n):
        parts, toxic = words(seed * 10_000 + i, rnd.randrange(20, 200)).split(" "), int(i % 5 == 0)
        for _ in range(rnd.randrange(2, 6) * toxic):
            parts.insert(rnd.randrange(len(parts)), rnd.choice(insults))
        docs.append((i, " ".join(parts)))
        labels.append((i, 1, toxic, "x", "w"))
    return docs, labels


def outcome(spark, docs, labels, config=CONFIG):
    result = toxicity(documents(spark, docs).repartition(3), spark.createDataFrame(labels, LABELS), config)
    assert result.columns == ["doc_id", "held_out", "score", "predicted"]
    return result.collect()


def held_out_rates(rows, labels):
    toxic = {r[0]: r[2] for r in labels}
    held = [r for r in rows if r["held_out"]]
    hit = [r["predicted"] for r in held if toxic[r["doc_id"]]]
    false = [r["predicted"] for r in held if not toxic[r["doc_id"]]]
    return np.mean(hit), np.mean(false)


def test_held_out_accuracy_by_the_stated_lexicon(spark):
    docs, labels = corpus(600, ["idiot", "moron", "scum", "pathetic"])
    rows = outcome(spark, docs, labels)
    assert len(rows) == 600 and all(r["held_out"] == (part(r["doc_id"]) == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    hit, false = held_out_rates(rows, labels)
    assert hit >= 0.97 and false <= 0.03


def test_held_out_accuracy_by_learned_words(spark):
    invented = ["blorgface", "snivelgit", "krumwit", "dunderklot"]
    assert not set(invented) & set(INSULTS)
    docs, labels = corpus(800, invented, 1)
    hit, false = held_out_rates(outcome(spark, docs, labels), labels)
    assert hit >= 0.95 and false <= 0.03


def test_held_out_labels_language_and_source_change_nothing(spark):
    docs, labels = corpus(300, ["idiot", "scum"], 2)
    turned = [(i, q, 1 - t if part(i) == 2 else t, x, w) for i, q, t, x, w in labels]
    scores = {r["doc_id"]: r["score"] for r in outcome(spark, docs, labels)}
    assert scores == {r["doc_id"]: r["score"] for r in outcome(spark, docs, turned)}
    other = documents(spark, docs).selectExpr("doc_id", "text", "'xx' lang", "concat('s', doc_id) source", "0 n_chars")
    again = toxicity(other, spark.createDataFrame(labels, LABELS), CONFIG).collect()
    assert scores == {r["doc_id"]: r["score"] for r in again}


def test_odd_texts_null_ids_repeats_and_bad_labels(spark):
    docs, labels = corpus(200, ["idiot", "scum"], 3)
    odd = [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "you idiot"), (None, None), (0, "another text"), (0, "another text")]
    labels += [(1000 + i, None, i % 2, "x", "w") for i in range(len(ODD_TEXTS))]
    labels += [(None, 1, 1, "x", "w"), (3, 1, None, "x", "w"), (4, 1, 7, "x", "w"), (5, 1, 0, "x", "w"), (99_999, 1, 1, "x", "w")]
    rows = outcome(spark, docs + odd, labels)
    assert len(rows) == len(docs) + len(odd) and all(0 <= r["score"] <= 1 for r in rows)
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    same = {r["score"] for r in rows if r["doc_id"] == 0}
    assert len(same) == 2


@pytest.mark.parametrize("labels", [[], [(1, 1, 1, "x", "w")], [(1, 1, 0, "x", "w")]])
def test_without_labels_of_both_classes(spark, labels):
    rows = {r["doc_id"]: (r["score"], r["predicted"]) for r in outcome(spark, [(1, "you idiot"), (2, "fine"), (3, "scum trash")], labels)}
    assert rows == {1: (0.5, 1), 2: (0.0, 0), 3: (pytest.approx(2 / 3), 1)}


def test_empty_table(spark):
    assert outcome(spark, [], [(1, 1, 1, "x", "w"), (2, 1, 0, "x", "w")]) == []


def test_the_sample_is_bounded_and_weighted(spark):
    docs, labels = corpus(300, ["idiot"], 4)
    small = ToxicityConfig(fit_rows=30, trees=10)
    model = fit(documents(spark, docs), spark.createDataFrame(labels, LABELS), small)
    n_clean = sum(1 for i, _, t, _, _ in labels if not t and part(i) != 2)
    n_toxic = sum(1 for i, _, t, _, _ in labels if t and part(i) != 2)
    mean = 30 * max(1, n_toxic / 30) / (30 * max(1, n_toxic / 30) + 30 * n_clean / 30)
    assert model.trees.start == pytest.approx(np.log(mean / (1 - mean)))


@pytest.mark.parametrize(
    "text", ["1d!0t", "i.d.i.o.t", "id*ot", "idiiiiot", "(1D10T)", "you i d i o t .", "i-d-i-o-t!", "an 1diot?"]
)
def test_disguises_are_seen_through(text):
    row = dict(zip(FEATURES, TextFeatures({}).of(text), strict=True))
    assert row["stated_words"] > 0 and row["disguised_lexicon"] > 0


def test_plain_words_are_no_disguise():
    row = dict(zip(FEATURES, TextFeatures({}).of("Don't go to the well-known l'eau at 3rd street, A B C D!"), strict=True))
    assert row["stated_words"] == row["disguised_lexicon"] == row["disguised"] == 0


def test_features_by_hand():
    row = dict(zip(FEATURES, TextFeatures({"zorg": 3.0}).of("YOU are such an idiot!! a b zorg zorg c d."), strict=True))
    assert row["stated_density"] == pytest.approx(1 / 11) and row["learned_density"] == pytest.approx(2 / 11)
    assert row["learned_weight"] == 3.0 and row["second_person"] == pytest.approx(1 / 11)
    assert row["nearness"] == pytest.approx(1 / 5) and row["near_second_person"] == pytest.approx(1 / 3)
    assert row["capital_words"] == pytest.approx(1 / 11) and row["exclamations"] == pytest.approx(2 / 11)


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(2000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.3)).astype(float)
    trees = BoostedTrees(x, y, np.ones(len(x)), ToxicityConfig())
    assert ((trees.margin(x) > 0) == y).mean() > 0.97


def test_isotonic_is_monotone_and_keeps_the_mean():
    rng = np.random.default_rng(1)
    margins = np.round(rng.normal(size=500), 2)
    labels, weights = (rng.uniform(size=500) < 1 / (1 + np.exp(-margins))).astype(float), rng.uniform(0.5, 2, 500)
    points, shares = isotonic(margins, labels, weights)
    assert (np.diff(points) > 0).all() and (np.diff(shares) > 0).all()
    whole = np.interp(margins, points, shares)
    assert abs(np.average(whole, weights=weights) - np.average(labels, weights=weights)) < 0.02

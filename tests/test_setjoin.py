"""The set join against a comparison of all pairs."""

import random
from itertools import combinations

import pytest

from corpuskiln.operators.setjoin import _keyed_sets, candidates, ordered_sets, prefixes, segment_candidates, segmented, set_members, similar_sets
from corpuskiln.scratch import write_scratch


def corpus(seed, n=160):
    """Sets with common tokens, changed copies, equal sets and small ones."""
    rnd, rows = random.Random(seed), []
    for _ in range(n):
        kind = rnd.random()
        if rows and kind < 0.45:
            tokens = set(rnd.choice(rows))
            for _ in range(rnd.randrange(0, 4)):
                if tokens and rnd.random() < 0.5:
                    tokens.discard(rnd.choice(sorted(tokens)))
                else:
                    tokens.add(f"w{rnd.randrange(200)}")
        elif kind < 0.55:
            tokens = {f"w{k}" for k in range(rnd.randrange(4))}
        else:
            tokens = {f"w{int(200 * rnd.random() ** 3)}" for _ in range(rnd.randrange(1, 40))} | {"the", "of"}
        rows.append(tokens)
    return rows


def brute(rows, threshold):
    first = {}
    for i, tokens in enumerate(rows):
        first.setdefault(frozenset(tokens), i)
    pairs = {}
    for (a, i), (b, j) in combinations(first.items(), 2):
        jaccard = len(a & b) / len(a | b) if a | b else 0.0
        if jaccard >= threshold:
            pairs[min(i, j), max(i, j)] = jaccard
    return pairs, {i: first[frozenset(tokens)] for i, tokens in enumerate(rows)}


def table(spark, rows):
    shuffled = [(i, random.Random(i).sample(sorted(t), len(t)) if t else None) for i, t in enumerate(rows)]
    return spark.createDataFrame(shuffled, "doc_id long, words array<string>").repartition(4)


@pytest.mark.parametrize("threshold, hot_rows", [(0.85, 50_000), (0.85, 3), (0.5, 7), (1.0, 50_000)])
def test_equals_all_pairs(spark, threshold, hot_rows):
    rows = corpus(1)
    found = similar_sets(table(spark, rows), "doc_id", "words", threshold, hot_rows)
    pairs, members = brute(rows, threshold)
    got = found.pairs.collect()
    assert {(r["id_a"], r["id_b"]): r["jaccard"] for r in got} == pairs and len(got) == len(pairs)
    assert pairs or threshold == 1.0
    assert {r["id"]: r["representative"] for r in found.members.collect()} == members


@pytest.mark.parametrize("size", [1, 6, 7, 20, 40])
def test_pairs_at_the_threshold_itself(spark, size):
    """17 of 20 common tokens are 0.85 exactly; sizes where threshold times size is whole or not."""
    base = [f"t{k}" for k in range(size)]
    rows = [set(base)] + [set(base[: size - k]) for k in range(1, size)][:8] + [set(base) | {f"n{k}" for k in range(m)} for m in (1, 3, 7)]
    found = similar_sets(table(spark, rows), "doc_id", "words", 0.85)
    assert {(r["id_a"], r["id_b"]): r["jaccard"] for r in found.pairs.collect()} == brute(rows, 0.85)[0]


def test_few_pairs_are_compared(spark):
    """Sets that share their common tokens only never meet: their prefixes hold rare ones."""
    common = [f"the{k}" for k in range(20)]
    rows = [set(common) | {f"own{i}_{k}" for k in range(20)} for i in range(200)]
    sets = table(spark, rows).withColumnsRenamed({"doc_id": "id", "words": "tokens"})
    index = prefixes(write_scratch(ordered_sets(sets), "ordered"), 0.85)
    assert index.count() == 200 * 7
    assert candidates(index, 0.85).count() == 0


def test_sets_that_share_a_rare_token_only_are_not_compared(spark):
    """They pass the prefix, the length and the position filter; their parities tell them apart."""
    rows = [{"rare"} | {f"own{i}_{k}" for k in range(30)} for i in range(60)]
    common = [(i, ["rare", *sorted(t - {"rare"})]) for i, t in enumerate(rows)]
    index = prefixes(spark.createDataFrame(common, "id long, tokens array<string>"), 0.85)
    assert candidates(index, 0.85).count() == 0


def test_members_alone_compare_no_sets(spark, stored_plans):
    rows = corpus(2)
    members = set_members(table(spark, rows), "doc_id", "words")
    assert len(stored_plans) == 1
    assert {r["id"]: r["representative"] for r in members.collect()} == brute(rows, 0.85)[1]


def test_empty_sets_and_no_rows(spark):
    found = similar_sets(table(spark, [set(), set(), {"a"}]), "doc_id", "words")
    assert found.pairs.count() == 0
    assert {(r["id"], r["representative"]) for r in found.members.collect()} == {(0, 0), (1, 0), (2, 2)}
    none = similar_sets(table(spark, []), "doc_id", "words")
    assert none.pairs.count() == none.members.count() == 0


def sets_of(spark, rows):
    return write_scratch(segmented(_keyed_sets(table(spark, rows), "doc_id", "words"), 0.85), "set-keys")


def test_sets_with_a_common_rare_token_and_common_words_seldom_meet(spark):
    """Their prefixes share tokens; a segment is several tokens, and more than one has to be the same."""
    rnd = random.Random(5)
    rows = [{f"the{k}" for k in range(30)} | {f"w{rnd.randrange(400)}" for _ in range(60)} | {f"pair{i // 2}"} for i in range(200)]
    assert brute(rows, 0.85)[0] == {}
    assert segment_candidates(sets_of(spark, rows), 0.85).count() <= 3


@pytest.mark.parametrize("block", [3, 1024])
def test_copies_that_meet_in_many_segments_are_one_candidate_of_few_groups(spark, block):
    base = {f"t{k}" for k in range(200)}
    rows = [base | {f"own{i}"} for i in range(20)]
    found = segment_candidates(sets_of(spark, rows), 0.85, block).collect()
    assert sorted(tuple(sorted((r.small, r.large))) for r in found) == list(combinations(range(20), 2))
    groups = {r.group for r in found}
    assert len(groups) <= 2 * (len(rows) // block + 1) ** 2


def test_an_id_with_two_texts_is_compared_by_each(spark):
    a, b = {f"a{k}" for k in range(40)}, {f"b{k}" for k in range(60)}
    rows = [(5, a), (5, b), (5, a), (9, a | {"x"}), (9, b | {"x"}), (None, a | {"y"}), (2, b | {"z"})]
    df = spark.createDataFrame([(i, sorted(t)) for i, t in rows], "doc_id long, words array<string>")
    got = sorted((r.id_a, r.id_b, round(r.jaccard, 3)) for r in similar_sets(df, "doc_id", "words").pairs.collect())
    assert got == [(2, 5, 0.984), (2, 9, 0.968), (5, 9, 0.976), (5, 9, 0.984)]

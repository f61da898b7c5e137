import numpy as np
from llm_cases import ODD_TEXTS, changed, documents, words

from corpuskiln.llm.ngram_join import ForestConfig, common_counts, drop_similar, labels, shingles, similar_documents


def brute(rows):
    """doc index -> (class members, links) by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links = {i: set() for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                links[i].add(j)
                links[j].add(i)
    group = {}
    for i in links:
        if i not in group:
            todo, seen = [i], {i}
            while todo:
                for j in links[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            for j in seen:
                group[j] = seen
    return {rows[i][0]: (max(rows[j][0] for j in group[i]), len(group[i]), len(links[i])) for i in links}


def rows_with_copies():
    rows = [(i, words(i, 120)) for i in range(80)]
    rows += [(1000 + k, changed(rows[k % 20][1], k, 1 + k % 4)) for k in range(160)]
    rows += [(2000 + k, rows[5][1]) for k in range(50)]
    rows += [(3000 + k, rows[3][1] + "\n") for k in range(5)]
    shared = words(777, 40)
    rows += [(4000 + k, f"{words(4000 + k, 60)} {shared}") for k in range(60)]
    return rows


def as_result(found):
    return {r["doc_id"]: (r["class_id"], r["class_size"], r["n_links"]) for r in found}


def test_equals_all_pairs(spark):
    rows = rows_with_copies()
    want, found = brute(rows), as_result(similar_documents(documents(spark, rows)).collect())
    same = sum(found[i] == want[i] for i in want)
    assert found.keys() == want.keys() and same >= 0.99 * len(want)
    # every link reported is one: no class or count exceeds the true one
    assert all(found[i][1] <= want[i][1] and found[i][2] <= want[i][2] for i in want)


def test_small_blocks_give_the_same(spark):
    docs = documents(spark, rows_with_copies())
    whole = as_result(similar_documents(docs).collect())
    blocked = ForestConfig(block_classes=3, block_shingles=700)
    assert as_result(similar_documents(docs, blocked).collect()) == whole


def test_dense_group_of_different_texts(spark):
    base = words(1, 150)
    rows = [(k, changed(base, k, 2)) for k in range(250)]
    found = as_result(similar_documents(documents(spark, rows)).collect())
    assert found == brute(rows)


def test_a_dense_group_does_not_change_other_links(spark):
    """Lone pairs at the threshold itself are found whatever else the corpus holds."""
    config = ForestConfig(trees=8, target_recall=0.99)
    rows = []
    for k in range(40):
        pair = words(500 + k, 184).split()
        rows.append((k, " ".join(pair)))
        for at in (20, 60, 100, 140):  # 160 of 200 shingles stay common
            pair[at] = f"other{k}at{at}"
        rows.append((1000 + k, " ".join(pair)))
    base = words(1, 600)
    dense = [(5000 + k, changed(base, k, 1)) for k in range(120)]
    alone = as_result(similar_documents(documents(spark, rows), config).collect())
    among = as_result(similar_documents(documents(spark, [*rows, *dense]), config).collect())
    assert all(alone[i] == among[i] == (1000 + i % 1000, 2, 1) for i, _ in rows)


def test_labels_of_pairs_at_the_threshold_meet():
    config = ForestConfig()
    least = config.least_depth()
    assert config.found(0.8, least) >= 0.99999
    rnd = np.random.default_rng(5)
    factors = np.random.default_rng(config.seed).integers(0, 1 << 32, config.trees * config.depth, dtype=np.uint32) | np.uint32(1)
    for _ in range(2_000):
        n = rnd.integers(1, 40)  # 8 parts of 10 are common
        both = rnd.integers(0, 1 << 63, 10 * n).astype(np.uint64) << np.uint64(1)
        a, b = (np.frombuffer(labels(np.unique(x), factors), np.uint8).reshape(-1, config.depth) for x in (both[n:], both[:-n]))
        assert (a[:, :least] == b[:, :least]).all(1).any()


def test_odd_texts_repeats_nulls_and_empty(spark):
    rows = [*enumerate(ODD_TEXTS), (4, "other text with this id"), (None, "a b c d e f"), (90, "a b c d e f"), (90, "a b c d e f")]
    found = similar_documents(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    of = {}
    for r in found:
        of.setdefault(r["doc_id"], []).append((r["class_id"], r["class_size"], r["n_links"]))
    assert of[0] == [(0, 1, 0)] and of[1] == [(1, 1, 0)]
    assert of[None] == [(90, 3, 2)] and of[90] == [(90, 3, 2)] * 2
    assert similar_documents(documents(spark, [])).count() == 0
    assert drop_similar(documents(spark, [])).count() == 0


def test_stage_leaves_one_of_each_class(spark):
    rows = rows_with_copies()
    docs = documents(spark, rows)
    kept = drop_similar(docs)
    assert kept.columns == docs.columns
    classes = {c for c, _, _ in as_result(similar_documents(docs).collect()).values()}
    assert {r["doc_id"] for r in kept.collect()} == classes


def test_stage_removes_rows_not_ids(spark):
    near = words(1, 150)
    rows = [(None, changed(near, 2, 1)), (7, near), (None, words(3, 150)), (7, words(4, 150))]
    nulls = words(5, 150)
    rows += [(None, changed(nulls, k, 1)) for k in range(4)]
    rows += [(8, words(6, 150)), (8, words(7, 150)), (9, words(6, 150))]
    kept = [(r["doc_id"], r["text"]) for r in drop_similar(documents(spark, rows)).collect()]
    assert len(kept) == len(set(kept)) == 6 and set(kept) <= set(rows)
    assert {rows[1], rows[2], rows[3], rows[-2], rows[-1]} < set(kept)
    assert sum(r in rows[4:8] for r in kept) == 1


def test_common_counts_equal_sets():
    rnd = np.random.default_rng(0)
    sets = [np.unique(rnd.integers(0, 400, rnd.integers(1, 120)).astype(np.uint64)) for _ in range(70)]
    found = common_counts(sets)
    for i in range(70):
        for j in range(70):
            if i != j:
                assert found[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_shingles_do_not_depend_on_the_process():
    assert shingles("a b c d e", 5).tolist() == shingles(" a  b c d e ", 5).tolist()
    assert len(shingles("a b", 5)) == 1 and len(shingles("", 5)) == 0

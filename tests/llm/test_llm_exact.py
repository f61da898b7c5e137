import hashlib

from llm_cases import ODD_TEXTS, documents

from corpuskiln.llm.exact_dedup import digest_rows, drop_exact_duplicates, exact_duplicates, merge_runs


def brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(text or "", []).append(i)
    return {
        (i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest())
        for i, t in rows
    }


ROWS = [(i, ODD_TEXTS[i % len(ODD_TEXTS)]) for i in range(40)] + [(100 + i, "copy") for i in range(300)]


def test_equals_brute_force_with_hot_group(spark):
    found = exact_duplicates(documents(spark, ROWS).repartition(7)).collect()
    assert len(found) == len(ROWS)
    assert {tuple(r) for r in found} == brute(ROWS)


def test_tree_shape_does_not_change_the_result(spark):
    rows = digest_rows(documents(spark, ROWS))
    whole = {(bytes(r["sha256"]), r["keep"]["doc_id"], r["group_size"]) for r in merge_runs(rows).collect()}
    for leaves, fan_in in ((1, 2), (5, 2), (16, 3)):
        other = merge_runs(rows, leaves=leaves, fan_in=fan_in).collect()
        assert {(bytes(r["sha256"]), r["keep"]["doc_id"], r["group_size"]) for r in other} == whole


def test_stage_keeps_largest_id_and_one_of_repeats(spark):
    docs = documents(spark, [*ROWS, (7, "again"), (7, "again"), (None, "again"), (None, "lone"), (None, "lone")])
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    texts = [r["text"] or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({t or "" for _, t in ROWS}) + 2
    assert {r["doc_id"] for r in kept.filter("text = 'copy'").collect()} == {399}
    assert [r["doc_id"] for r in kept.filter("text = 'again'").collect()] == [7]


def test_repeated_rows_and_empty_table(spark):
    found = exact_duplicates(documents(spark, [(3, "a"), (3, "a"), (1, "a")])).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in found) == [(1, 3, 3), (3, 3, 3), (3, 3, 3)]
    assert sum(r["kept"] for r in found) == 1
    assert exact_duplicates(documents(spark, [])).count() == 0
    assert drop_exact_duplicates(documents(spark, [])).count() == 0


def test_no_python_on_the_path(spark):
    plan = exact_duplicates(documents(spark, ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan

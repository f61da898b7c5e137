import random

from llm_cases import ODD_TEXTS, documents

from corpuskiln.llm.line_dedup import drop_repeated_lines


def brute(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines = (text or "").split("\n")
        covered = set()
        for at in range(len(lines) - 2):
            window = tuple(lines[at : at + 3])
            if window in seen:
                covered |= {at, at + 1, at + 2}
            seen.add(window)
        out[i] = (len(lines), len(covered), "\n".join(x for k, x in enumerate(lines) if k not in covered))
    return out


def test_equals_brute_force(spark):
    rnd = random.Random(1)
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)]
    rows += [(100 + i, "\n".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 12)))) for i in range(60)]
    rows += [(200 + i, "\n".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(0, 40)))) for i in range(60)]
    rows += [(300, "l\n" * 3000), (301, "\n".join(f"line {k}" for k in range(3000)))]
    found = drop_repeated_lines(documents(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in found} == brute(rows)


def test_shared_passage_stays_once(spark):
    passage = "\n".join(f"sentence number {k} of the licence" for k in range(4))
    rows = [(i, f"head {i}\n{passage}\ntail {i}") for i in range(200)]
    found = {r["doc_id"]: r["text"] for r in drop_repeated_lines(documents(spark, rows)).collect()}
    assert found[0] == rows[0][1]
    assert all(found[i] == f"head {i}\ntail {i}" for i in range(1, 200))


def test_null_and_repeated_ids_and_empty_table(spark):
    same = "a\nb\nc"
    found = drop_repeated_lines(documents(spark, [(1, same), (1, same), (None, same), (2, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in found) == [(0, same), (1, ""), (1, ""), (2, "")]
    assert drop_repeated_lines(documents(spark, [])).count() == 0


def test_rows_without_an_id_keep_their_own_lines(spark):
    """Rows that share an id, or have none, lose only what stands in another row."""
    texts = ["x\ny\nz", "q\nx\ny\nz", "1\n2\n3\n4", "5\n6\n7\n8"]
    for doc_id in (None, 7):
        found = [r["text"] for r in drop_repeated_lines(documents(spark, [(doc_id, t) for t in texts])).collect()]
        assert sorted(found) in (sorted(["x\ny\nz", "q", *texts[2:]]), sorted(["", *texts[1:]]))


def test_no_python_on_the_path(spark):
    plan = drop_repeated_lines(documents(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan

import hashlib
import zlib

from llm_cases import DOC_TYPE, ODD_TEXTS
from pyspark.sql import functions as F

from corpuskiln.llm import merkle
from corpuskiln.llm.merkle import FIELDS, height, manifest, verify

COLUMNS = "doc_id leaf subroot root proof_sha256 folded_root verified".split()


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels_of(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        levels.append(nodes)
    return levels


def path(levels, i):
    for level in levels[:-1]:
        start = i // 3 * 3
        yield level[start:i], level[i + 1 : start + 3]
        i //= 3


def brute(rows):
    """The whole manifest by recursion over lists."""
    leaf = lambda r: H(*[enc(r[c]) for c in FIELDS])
    sources = {}
    for row in rows:
        sources.setdefault(row["source"], []).append(row)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        sources[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = [levels_of([leaf(r) for r in sources[s]]) for s in order]
    top = levels_of([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(order):
        for i, row in enumerate(sources[s]):
            proof = [*path(trees[k], i), *path(top, k)]
            text = row["text"]
            if text is not None and row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = H(*[enc(row[c]) for c in FIELDS[:-1]], enc(text))
            for left, right in proof:
                folded = H(*left, folded, *right)
            siblings = H(*[x for left, right in proof for x in left + right])
            root = top[-1][0]
            out.append((row["doc_id"], trees[k][0][i], trees[k][-1][0], root, siblings, folded, folded == root))
    return sorted(out, key=str)


def table(spark, rows):
    """Rows (doc_id, text, source), with columns whose names the operator uses inside."""
    full = [(i, t, None if i == 3 else "en", s, None if t is None else len(t), b"x", -1, 0, 0) for i, t, s in rows]
    return spark.createDataFrame(full, DOC_TYPE).withColumns({"tree": F.lit(5), "idx": F.lit("a"), "leaf": F.lit(1), "root": F.lit(2)})


def found(docs):
    result = verify(manifest(docs))
    assert result.columns == COLUMNS
    return sorted([tuple(r) for r in result.collect()], key=str)


def check(spark, rows):
    docs = table(spark, rows).repartition(5)
    got = found(docs)
    assert got == brute([r.asDict() for r in docs.collect()])
    return got


def test_sources_of_all_sizes_with_odd_texts(spark):
    sizes = {"b": 1, "a": 2, "é": 3, "Z": 4, "": 9, "hot": 250, None: 28}
    rows, i = [], 0
    for source, n in sizes.items():
        for k in range(n):
            rows.append((i, [*ODD_TEXTS, "a\nb"][k % (len(ODD_TEXTS) + 1)], source))
            i += 1
    got = check(spark, rows)
    assert {r[-1] for r in got} == {True, False}


def test_null_ids_ties_and_repeated_rows(spark):
    rows = [(None, "a\nb", "s"), (None, "a\nb", "s"), (None, "c", "s"), (3, "x\ny", "s"), (3, "x\ny", "s"), (3, "z", "s"), (5, None, None)]
    got = check(spark, rows)
    assert all(r[-1] for r in got if r[0] is None)


def test_one_document_one_source_and_many_sources(spark):
    lone = check(spark, [(7, "one", "s")])
    assert lone[0][1] == lone[0][2] == lone[0][3] and lone[0][4] == H()
    check(spark, [(i, f"t{i}", "s") for i in range(28)])
    check(spark, [(i, f"t{i}", f"s{i}") for i in range(28)])


def test_empty_table(spark):
    assert found(table(spark, [])) == []


def test_joins_without_broadcast_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_NODES", 0)
    check(spark, [(i, f"t\n{i}", "hot" if i % 3 else f"s{i}") for i in range(120)])


def test_height():
    assert [height(n) for n in (0, 1, 2, 3, 4, 9, 10, 27, 28)] == [0, 0, 1, 1, 2, 2, 3, 3, 4]


def test_positions_do_not_need_one_task_per_source(spark, stored_plans):
    docs = table(spark, [(i, "x", "hot") for i in range(200)])
    manifest(docs)
    windows = [line for plan in stored_plans for line in plan.splitlines() if "Window" in line]
    # windows run over counts a range only, never over rows
    assert windows and not any("row_number" in line for line in windows)

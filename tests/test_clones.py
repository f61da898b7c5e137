"""Line clones against a direct count of all line blocks."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpuskiln.operators import clones
from corpuskiln.plans.memorization import memorization_report
from corpuskiln.scratch import scratch_path
from corpuskiln.sources import readers, writers


def files(seed, n_files=14, shared=3):
    rng = random.Random(seed)
    blocks = [[f"line {rng.randrange(9)}" for _ in range(rng.randrange(3, 9))] for _ in range(shared)]
    made = []
    for i in range(n_files):
        lines = []
        for _ in range(rng.randrange(1, 4)):
            lines += rng.choice(blocks) if rng.random() < 0.7 else [f"own {rng.randrange(5)}"] * rng.randrange(1, 4)
            lines += [""] * rng.randrange(2)
        made.append((i, "\n".join("  " * rng.randrange(2) + line for line in lines)))
    return made


def filled(text):
    return [(no, line.strip()) for no, line in enumerate(text.split("\n"), start=1) if line.strip()]


def places_of(rows, length):
    """Block text -> places (file, index) of every block of ``length`` filled lines."""
    places = defaultdict(set)
    for i, text in rows:
        lines = [line for _, line in filled(text)]
        for at in range(len(lines) - length + 1):
            places[tuple(lines[at : at + length])].add((i, at))
    return places


def closure(rows, place, k):
    """The largest block around a window that occurs wherever the window does."""
    lines = {i: [line for _, line in filled(text)] for i, text in rows}
    file, at = place
    same = [(f, p) for f, texts in lines.items() for p in range(len(texts) - k + 1) if texts[p : p + k] == lines[file][at : at + k]]

    def agree(offset):
        found = {lines[f][p + offset] if 0 <= p + offset < len(lines[f]) else None for f, p in same}
        return len(found) == 1 and None not in found

    back = on = 0
    while agree(-back - 1):
        back += 1
    while agree(k + on):
        on += 1
    text = tuple(lines[file][at - back : at + k + on])
    return {(text, f, p - back) for f, p in same}


@pytest.mark.parametrize("hot_rows", [2, 1000])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clones_are_the_largest_blocks_around_repeated_windows(spark, seed, hot_rows):
    k, rows = 3, files(seed)
    df = spark.createDataFrame(rows, "doc_id long, content string").repartition(4)
    got = clones.line_clones(df, threshold=k, hot_rows=hot_rows).collect()
    index = {i: {no: at for at, (no, _) in enumerate(filled(text))} for i, text in rows}
    texts = {i: [line for _, line in filled(text)] for i, text in rows}

    blocks, names = set(), defaultdict(set)
    for r in got:
        start, end = index[r.file_id][r.start_line], index[r.file_id][r.end_line]
        assert end - start + 1 == r.line_count >= k
        text = tuple(texts[r.file_id][start : end + 1])
        blocks.add((text, r.file_id, start))
        names[r.fingerprint].add(text)
    assert len(blocks) == len(got)
    assert all(len(found) == 1 for found in names.values())
    assert len({text for text, _, _ in blocks}) == len(names) > 2

    repeated = [place for places in places_of(rows, k).values() if len(places) > 1 for place in places]
    assert blocks == {block for place in repeated for block in closure(rows, place, k)}


def test_a_block_with_a_popular_middle_stays_whole(spark):
    middle = [f"m{i}" for i in range(4)]
    long = [f"a{i}" for i in range(3)] + middle + [f"z{i}" for i in range(3)]
    rows = [(1, "\n".join(long)), (2, "\n".join(["x", *long])), (3, "\n".join(["y", *middle, "q"]))]
    df = spark.createDataFrame(rows, "doc_id long, content string")
    sets = clones.clone_sets(clones.line_clones(df, threshold=3))
    assert sorted((r.line_count, r.n_files) for r in sets.collect()) == [(4, 3), (10, 2)]


def test_same_lines_in_two_corpora(spark):
    shared = "\n".join(f"a = {i}" for i in range(7))
    training = spark.createDataFrame([(1, "x\n" + shared), (2, "q\n" * 20)], "doc_id long, content string")
    generated = spark.createDataFrame([(1, shared.replace("\n", "\n\n  ") + "\ny"), (2, "z\n" * 20)], "doc_id long, content string")
    report = memorization_report(training, generated)
    assert sorted((r.side, r.file_id, r.start_line, r.end_line) for r in report.clones.collect()) == [
        ("generated", 1, 1, 13),
        ("training", 1, 2, 8),
    ]
    assert report.totals.first().asDict() == {"unique_fingerprints": 1, "sum_of_lines": 7}
    assert memorization_report(training, generated, threshold=8).totals.first().asDict() == {
        "unique_fingerprints": 0,
        "sum_of_lines": 0,
    }


def test_reduce_skips_sets_of_one_file_without_claiming_them(spark):
    schema = "ord int, fingerprint string, line_count long, block array<struct<source_file:string,start_line:long,end_line:long>>"
    rows = [
        (1, "f", 10, [("a", 1, 10), ("a", 20, 29)]),
        (2, "f", 7, [("a", 1, 7), ("b", 1, 7)]),
        (3, "f", 9, [("a", 1, 9), ("c", 1, 9)]),
        (4, "g", 6, [("a", 1, 6), ("a", 9, 14)]),
    ]
    reduced = clones.clone_report_reduce(spark.createDataFrame(rows, schema), "ord")
    assert [tuple(r) for r in reduced.collect()] == [("f", 7)]
    assert clones.clone_report_totals(reduced).first().asDict() == {"unique_fingerprints": 1, "sum_of_lines": 7}


def test_report_parts_keep_every_place(spark):
    text = "\n".join(f"row {i}" for i in range(6))
    rows = [(i, text) for i in range(30)] + [(99, "\n".join(["one " + str(i) for i in range(6)] * 2))]
    found = clones.line_clones(spark.createDataFrame(rows, "doc_id long, content string")).cache()
    report = clones.clone_report(found, blocks_per_set=4).collect()
    hot = [r for r in report if r.block[0].source_file != "99"]
    assert len(hot) > 3
    assert {b.source_file for r in hot for b in r.block} == {str(i) for i in range(30)}
    numbered = clones.clone_report(found, blocks_per_set=4).withColumn("ord", F.monotonically_increasing_id())
    assert clones.clone_report_reduce(numbered, "ord").count() == 1
    assert clones.cross_file_sets(clones.clone_sets(found)).count() == 1


def test_stored_report_of_many_parts_lists_a_place_once(spark):
    text = "\n".join(f"row {i}" for i in range(6))
    rows = [(i, text) for i in range(30)] + [(99, "\n".join(["one " + str(i) for i in range(6)] * 2))]
    found = clones.line_clones(spark.createDataFrame(rows, "doc_id long, content string")).cache()
    path = scratch_path(spark, "report")
    writers.sink_clone_report(clones.clone_report(found, blocks_per_set=4), path)
    got = clones.report_places(readers.scan_clone_report(spark, path)).collect()
    wanted = found.select("fingerprint", "line_count", F.col("file_id").cast("string"), "start_line", "end_line").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, wanted))


def test_fingerprint_does_not_change_with_other_files(spark):
    """The md5 of the clone's own lines, whatever else repeats parts of it."""
    block = [f"shared {k}" for k in range(20)]
    rows = [(1, "\n".join(["one", *block, "end of one"])), (2, "\n".join(["two", *block, "", "end of two"]))]
    more = [*rows, (3, "\n".join(["x", *block[5:13], "y"])), (4, "\n".join(["z", *block[5:13], "w"]))]
    want = hashlib.md5("\n".join(block).encode()).hexdigest()
    for files_ in (rows, more):
        found = clones.line_clones(spark.createDataFrame(files_, "doc_id long, content string")).collect()
        of_block = {r.file_id: r.fingerprint for r in found if r.line_count == 20}
        assert of_block == {1: want, 2: want}
    parts = [r for r in found if r.line_count == 8]
    assert {r.fingerprint for r in parts} == {hashlib.md5("\n".join(block[5:13]).encode()).hexdigest()}


def test_long_common_stretch_of_many_units_takes_few_rounds(spark, stored_plans):
    """A block whose parts also occur alone, so that it consists of many units."""
    block = [f"shared {k}" for k in range(120)]
    rows = [(1, "\n".join(block)), (2, "\n".join(["head", *block, "tail"]))]
    rows += [(10 + k, "\n".join([f"own {k}", *block[6 * k : 6 * k + 8], f"end {k}"])) for k in range(18)]
    found = clones.line_clones(spark.createDataFrame(rows, "doc_id long, content string")).collect()
    assert {(r.file_id, r.start_line) for r in found if r.line_count == 120} == {(1, 1), (2, 2)}
    assert sum("h0" in p for p in stored_plans) < 40


def test_growth_over_many_units_takes_few_rounds(spark, stored_plans):
    """A block of 600 lines whose every line also occurs alone elsewhere, so that no two windows form one run."""
    rng = random.Random(8)
    block = [f"line {rng.randrange(10**9)}" for _ in range(600)]
    rows = [(0, "\n".join(["first", *block, "end"])), (1, "\n".join(["other", *block, "last"]))]
    rows += [(2 + i, "\n".join([f"own {i}", *block[i : i + 2], f"own {i} too"])) for i in range(0, 598, 2)]
    df = spark.createDataFrame(rows, "doc_id long, content string")
    found = clones.line_clones(df, threshold=2).collect()
    longest = [r for r in found if r["line_count"] == 600]
    assert {(r["file_id"], r["start_line"]) for r in longest} == {(0, 2), (1, 2)}
    assert len({r["fingerprint"] for r in longest}) == 1
    assert len(found) == 2 + 299 * 3
    # names of 1, 8, 64 and 512 units, written once
    ranks = [p for p in stored_plans if "on_3" in p.partition("== Physical Plan ==")[2] and "lead" in p]
    assert len(ranks) == 1 and len(stored_plans) <= 10

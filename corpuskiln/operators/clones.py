"""Blocks of equal lines across files, and the report made of them.

A clone is a block of ``threshold`` lines or more that occurs at two places or
more and cannot be extended: its places differ in the line before it and in the
line after it. Each repeated window of ``threshold`` lines is grown to the
largest block with the same places, and equal blocks form one clone set. The
sets list places, never pairs of places, so a licence header found in a third
of all files costs one row per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuskiln import config
from corpuskiln.functions import text as T
from corpuskiln.operators.bloom import BLOCKS, bloom_filter, maybe_in
from corpuskiln.operators.skew import HOT_ROWS, join_hot_keys
from corpuskiln.scratch import write_scratch

BLOCKS_PER_SET = 1000
# stretches of units are named by this many parts each
RADIX = 8
GENERATED = "generated"


def line_windows(
    df: DataFrame, file_col: str, text_col: str, threshold: int, side_col: str | None = None
) -> DataFrame:
    """One row per window of ``threshold`` lines: its key, its neighbours and its line numbers.

    Lines are stripped and blank ones left out; line numbers are those of the
    file. A file's windows come from its own row, so nothing is shuffled yet.
    """
    side = F.lit("") if side_col is None else F.col(side_col)
    # each array is a column of its own before a lambda reads it: inside a
    # lambda an expression would be computed again for every line
    split = df.select(side.alias("side"), F.col(file_col).alias("file_id"), T.split_breaks(F.col(text_col)).alias("_pieces"))
    numbered = F.transform(
        "_pieces", lambda piece, i: F.struct((i + 1).alias("no"), T.strip_spaces(piece).alias("line"))
    )
    filled = split.select("side", "file_id", F.filter(numbered, lambda x: x["line"] != "").alias("_filled"))
    columns = filled.select(
        "side",
        "file_id",
        F.transform("_filled", lambda x: x["line"]).alias("_lines"),
        F.transform("_filled", lambda x: x["no"]).alias("_no"),
    )
    # an empty start list for a file with too few lines
    starts = F.slice(F.sequence(F.lit(1), F.size("_lines") + 1), F.lit(1), F.greatest(F.size("_lines") - (threshold - 1), F.lit(0)))
    keyed = columns.select(
        "side",
        "file_id",
        "_no",
        F.transform(starts, lambda i: F.unhex(F.md5(F.array_join(F.slice("_lines", i, threshold), "\n")))).alias("_keys"),
    )
    windows = F.transform(
        "_keys",
        lambda key, i: F.struct(
            (i + 1).alias("place"),
            key.alias("window"),
            F.xxhash64(F.get("_keys", i - 1)).alias("before"),
            F.get("_keys", i - 1).isNotNull().alias("has_before"),
            F.xxhash64(F.get("_keys", i + 1)).alias("after"),
            F.get("_keys", i + 1).isNotNull().alias("has_after"),
            F.get("_no", i).alias("start_line"),
            F.get("_no", i + (threshold - 1)).alias("end_line"),
        ),
    )
    is_generated = F.coalesce(F.col("side") == GENERATED, F.lit(False)).alias("is_generated")
    return keyed.select("side", is_generated, "file_id", F.inline(windows))


def _possible_windows(windows: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Windows of the smaller corpus, and those windows of the larger one that it holds too.

    A clone has a place in both corpora. A Bloom filter of the generated windows, of a fixed size, meets the
    training windows in their scan, so what is shuffled for the exact join are the hits and a few
    false ones, not the windows of the training corpus.
    """
    generated = windows.filter(F.col("is_generated"))
    wanted = write_scratch(generated.select("window").distinct(), "generated-windows")
    hits = maybe_in(windows.filter(~F.col("is_generated")), "window", bloom_filter(wanted, "window", blocks), blocks)
    # each wanted window is one row; the planner would move a semi-join in front of the filter
    return hits.join(wanted, "window").select(*generated.columns).unionByName(generated)


def _repeated_windows(windows: DataFrame, by_side: bool) -> DataFrame:
    """Windows found twice (or in both corpora), and whether their neighbours never differ."""
    # one comparison of extremes per window tells "always the same neighbour"
    same_after = F.bool_and("has_after") & (F.min("after") == F.max("after"))
    same_before = F.bool_and("has_before") & (F.min("before") == F.max("before"))
    per_window = windows.groupBy("window").agg(
        F.count("*").alias("n"),
        F.bool_or("is_generated").alias("_some"),
        F.bool_and("is_generated").alias("_all"),
        same_after.alias("one_after"),
        same_before.alias("one_before"),
    )
    repeated = F.col("_some") & ~F.col("_all") if by_side else F.col("n") > 1
    return per_window.filter(repeated).drop("_some", "_all")


def _window_runs(places: DataFrame) -> DataFrame:
    """Neighbouring windows that only ever occur together, as one row per place.

    ``unit`` names such a run; ``island`` numbers the stretches of a file without
    a gap between repeated windows.
    """
    in_file = Window.partitionBy("side", "file_id").orderBy("place")
    follows = F.coalesce(F.lag("place").over(in_file) == F.col("place") - 1, F.lit(False))
    together = follows & F.coalesce(F.lag("one_after").over(in_file), F.lit(False)) & F.col("one_before")
    marked = places.withColumns({"_gap": (~follows).cast("int"), "_starts": (~together).cast("int")})
    numbered = marked.withColumns(
        {"island": F.sum("_gap").over(in_file), "run": F.sum("_starts").over(in_file)}
    )
    return numbered.groupBy("side", "file_id", "island", "run").agg(
        F.min("place").alias("first_place"),
        F.max("place").alias("last_place"),
        F.min("start_line").alias("start_line"),
        F.max("end_line").alias("end_line"),
        F.lower(F.hex(F.max(F.when(F.col("_starts") == 1, F.col("window"))))).alias("unit"),
    )


PLACE = ("side", "file_id", "island")


def _ranks(runs: DataFrame, longest: int) -> tuple[DataFrame, int]:
    """Runs with the names of the stretches behind and before them, and the number of levels.

    As in a suffix array built by prefix doubling, a stretch of ``RADIX`` ^ j units is named by the names of its
    ``RADIX`` parts; equal names mean equal stretches. ``on_j`` names the next units, ``back_j`` the ones before; NULL
    where the island ends first. All levels share one sort of the islands and are written once, so the width of the table
    is the logarithm of the longest island.
    """
    in_island = Window.partitionBy(*PLACE).orderBy("run")
    levels = 1
    while RADIX**levels <= longest:
        levels += 1
    rows = runs.select(*PLACE, "run", "unit", F.xxhash64("unit").alias("own"))
    rows = rows.withColumns({"on_0": F.lead("own", 1).over(in_island), "back_0": F.lag("own", 1).over(in_island)}).drop("own")
    for level in range(levels - 1):
        names = {}
        for column, shift in ((f"on_{level}", F.lead), (f"back_{level}", F.lag)):
            parts = [F.col(column), *[shift(column, k * RADIX**level).over(in_island) for k in range(1, RADIX)]]
            whole = parts[-1].isNotNull()
            names[column.replace(str(level), str(level + 1))] = F.when(whole, F.xxhash64(*parts))
        rows = rows.withColumns(names)
    return write_scratch(rows, "ranks"), levels


def _same(name: str) -> Column:
    return F.bool_and(F.col(name).isNotNull()) & (F.min(name) == F.max(name))


def _reach(ranks: DataFrame, levels: int) -> DataFrame:
    """(unit, n, _back, _on): the places of each unit, and how many units before and behind it all of them agree on.

    The longest common prefix of all places of a unit, digit by digit of ``RADIX``: from the longest stretch down, a unit goes
    on by as many whole stretches as its places agree on behind those it has. A round looks up
    ``RADIX`` - 1 names a place. Only units that agree on the nearest one take part.
    """
    first = write_scratch(
        ranks.groupBy("unit").agg(F.count("*").alias("n"), _same("back_0").alias("_some_back"), _same("on_0").alias("_some_on")), "units"
    )
    sides = F.array(
        F.when(F.col("_some_back"), F.struct(F.lit(-1).alias("side_of"), F.lit(0).alias("reach"))),
        F.when(F.col("_some_on"), F.struct(F.lit(1).alias("side_of"), F.lit(0).alias("reach"))),
    )
    active = first.select("unit", F.explode(F.array_compact(sides)).alias("_side")).select("unit", "_side.*")
    for level in reversed(range(levels)):
        step = RADIX**level
        asked = ranks.select(*PLACE, "run", "unit").join(active, "unit").withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(RADIX - 2))))
        asked = asked.withColumn("run", F.col("run") + F.col("side_of") * (F.col("reach") + F.col("_k") * step))
        named = ranks.select(*PLACE, "run", F.col(f"on_{level}").alias("_on"), F.col(f"back_{level}").alias("_back"))
        seen = asked.join(named, [*PLACE, "run"], "left").withColumn("name", F.when(F.col("side_of") > 0, F.col("_on")).otherwise(F.col("_back")))
        agreed = seen.groupBy("unit", "side_of", "reach", "_k").agg(_same("name").alias("_same"))
        steps = F.coalesce(F.min(F.when(~F.coalesce("_same", F.lit(False)), F.col("_k"))), F.lit(RADIX - 1))
        # read once, by the next round, so nothing is stored between the few rounds
        active = agreed.groupBy("unit", "side_of", "reach").agg(steps.alias("_steps")).select(
            "unit", "side_of", (F.col("reach") + F.col("_steps") * step).alias("reach")
        )
    reached = active.groupBy("unit").agg(
        F.max(F.when(F.col("side_of") < 0, F.col("reach"))).alias("_back"), F.max(F.when(F.col("side_of") > 0, F.col("reach"))).alias("_on")
    )
    return first.select("unit", "n").join(reached, "unit", "left").fillna(0, ["_back", "_on"])


def _fingerprints(df: DataFrame, clones: DataFrame, file_col: str, text_col: str, side_col: str | None) -> DataFrame:
    """(clone, fingerprint): md5 of the lines of each clone, read at its first place.

    All places have the same lines, so the fingerprint depends on the clone alone,
    whatever else the corpus holds.
    """
    place = F.struct("side", "file_id", "start_line", "end_line")
    first = clones.groupBy("clone").agg(F.min(place).alias("_at")).select("clone", "_at.*")
    side = F.lit("") if side_col is None else F.col(side_col)
    texts = df.select(side.alias("side"), F.col(file_col).alias("file_id"), F.col(text_col).alias("_text"))
    spans = first.groupBy("side", "file_id").agg(F.collect_list(F.struct("clone", "start_line", "end_line")).alias("_spans"))
    pieces = texts.join(spans, ["side", "file_id"]).select("_spans", T.split_breaks(F.col("_text")).alias("_pieces"))
    stripped = pieces.select(F.inline("_spans"), F.transform("_pieces", T.strip_spaces).alias("_lines"))
    own = F.slice("_lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1)
    filled = F.filter(own, lambda line: line != "")
    return stripped.select("clone", F.md5(F.array_join(filled, "\n")).alias("fingerprint"))


def line_clones(
    df: DataFrame,
    file_col: str = "doc_id",
    text_col: str = "content",
    threshold: int = config.CLONE_THRESHOLD_LINES,
    side_col: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(side, file_id, start_line, end_line, line_count, fingerprint), one row per place of a clone.

    With ``side_col`` a clone must occur in two corpora, the one whose side is
    ``GENERATED`` and another; without it, at two places of any files. The fingerprint is the md5 of its lines.
    """
    windows = line_windows(df, file_col, text_col, threshold, side_col)
    if side_col is not None:
        windows = write_scratch(_possible_windows(windows), "windows")
    per_window = write_scratch(_repeated_windows(windows, side_col is not None), "repeated-windows")
    places = join_hot_keys(
        windows.drop("before", "has_before", "after", "has_after", "is_generated"),
        per_window.drop("n"),
        ["window"],
        "file_id",
        hot_rows,
        per_window.select("window", "n"),
    )
    longest = Observation("runs")
    runs = _window_runs(places).observe(longest, F.max("run").alias("longest"))
    runs = write_scratch(runs, "window-runs")
    units = write_scratch(_reach(*_ranks(runs, longest.get["longest"] or 0)), "units-reach")
    counts = units.select("unit", "n")
    spread = runs.select(*PLACE, "run", "unit")
    grown = write_scratch(
        join_hot_keys(spread, units.drop("n"), ["unit"], "file_id", hot_rows, counts).select(
            *PLACE, "unit", (F.col("run") - F.col("_back")).alias("_from"), (F.col("run") + F.col("_on")).alias("_to")
        ),
        "grown",
    )
    # units of one block have the same places, so the first of them names the block
    block = F.struct(*PLACE, "_from", "_to")
    first = grown.groupBy("unit").agg(F.min(block).alias("clone"))
    grown = join_hot_keys(grown, first, ["unit"], "file_id", hot_rows, counts).drop("unit")
    firsts = runs.select("side", "file_id", "island", F.col("run").alias("_from"), "start_line", "first_place")
    lasts = runs.select("side", "file_id", "island", F.col("run").alias("_to"), "end_line", "last_place")
    line_count = F.col("last_place") - F.col("first_place") + threshold
    placed = write_scratch(
        grown.distinct()
        .join(firsts, ["side", "file_id", "island", "_from"])
        .join(lasts, ["side", "file_id", "island", "_to"])
        .select("side", "file_id", "start_line", "end_line", line_count.cast("bigint").alias("line_count"), "clone"),
        "placed-clones",
    )
    named = write_scratch(_fingerprints(df, placed, file_col, text_col, side_col), "fingerprints")
    return join_hot_keys(placed, named, ["clone"], "file_id", hot_rows).drop("clone")


def clone_sets(clones: DataFrame) -> DataFrame:
    """(fingerprint, line_count, n_blocks, n_files): the places of each clone, counted."""
    per_file = clones.groupBy("fingerprint", "line_count", "side", "file_id").agg(F.count("*").alias("_blocks"))
    return per_file.groupBy("fingerprint", "line_count").agg(
        F.sum("_blocks").alias("n_blocks"), F.count("*").alias("n_files")
    )


def clone_report(clones: DataFrame, blocks_per_set: int = BLOCKS_PER_SET) -> DataFrame:
    """The nested report: (fingerprint, line_count, part, block ARRAY<STRUCT>).

    A clone with many places is written as several parts, so no row grows with
    the number of copies. Every part also lists the first place of the clone, so
    a part of a clone that spans files shows two files. ``clones`` is read
    more than once, so pass a stored table.
    """
    source = F.concat_ws("/", F.nullif("side", F.lit("")), F.col("file_id").cast("string"))
    blocks = clones.withColumn("_block", F.struct(source.alias("source_file"), "start_line", "end_line"))
    per_set = blocks.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("_block").alias("_first"))
    parts = per_set.select("fingerprint", "_first", F.ceil(F.col("n") / blocks_per_set).cast("int").alias("_parts"))
    spread = join_hot_keys(blocks, parts, ["fingerprint"], "file_id", counts=per_set.select("fingerprint", "n"))
    part = F.pmod(F.xxhash64("side", "file_id"), F.col("_parts")).cast("int").alias("part")
    return spread.groupBy("fingerprint", "line_count", "_first", part).agg(F.collect_list("_block").alias("_blocks")).select(
        "fingerprint",
        "line_count",
        "part",
        F.array_sort(F.array_distinct(F.concat("_blocks", F.array("_first")))).alias("block"),
    )


def report_places(report: DataFrame) -> DataFrame:
    """(fingerprint, line_count, source_file, start_line, end_line): every place of a report once.

    All parts of a clone list its first place, so a place may stand in several sets.
    """
    return report.select("fingerprint", "line_count", F.inline("block")).distinct()


def clone_report_reduce(report: DataFrame, order_col: str) -> DataFrame:
    """(fingerprint, line_count): the first set of each fingerprint with blocks of two files.

    A set inside one file is skipped and does not use up its fingerprint.
    """
    several_files = F.size(F.array_distinct(F.col("block.source_file"))) > 1
    return (
        report.filter(several_files)
        .groupBy("fingerprint")
        .agg(F.min_by("line_count", order_col).alias("line_count"))
    )


def cross_file_sets(sets: DataFrame) -> DataFrame:
    """The reduction for counted sets, which list each fingerprint once."""
    return sets.filter(F.col("n_files") > 1).select("fingerprint", "line_count")


def clone_report_totals(reduced: DataFrame) -> DataFrame:
    """One row: number of fingerprints and sum of their lines."""
    return reduced.agg(
        F.count("*").alias("unique_fingerprints"),
        F.coalesce(F.sum("line_count"), F.lit(0)).alias("sum_of_lines"),
    )

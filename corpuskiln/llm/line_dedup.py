"""Repeated passages by overlapping windows of three lines, with DataFrame functions only.

Lines are the parts of a text between ``\\n``. Every three consecutive lines are a
window, known by its MD5 digest. The first place of a window over all documents
(smallest doc_id, then smallest MD5 of the text, then smallest line number) stays; every later place covers its
three lines. Covered lines that touch or overlap merge into intervals, and what
lies between the intervals is the cleaned text.

No line content is lost: each covered line equals a line at an earlier place, and
going from place to earlier place ends at a line that is not covered.

Hot windows (a licence in a third of all documents) are counted before the
shuffle, and the join that finds their later places is a plain equi-join, which
adaptive execution splits.

Defined cases: a null text is empty. A text of fewer than three lines is
unchanged. A null doc_id comes first in the order. Rows with equal or null doc_id are documents
of their own, known by the MD5 of their text; those that repeat both count as one document. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskiln.scratch import write_scratch

WINDOW = 3
DOC = ("doc_id", "text_md5")


def _lines(text_col: str) -> Column:
    return F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)


def _row_key(id_col: str, text_col: str) -> list[Column]:
    return [F.col(id_col).alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("text_md5")]


def line_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_md5, pos, window): one row a window, stored."""
    lines = F.col("lines")
    places = F.transform(
        F.sequence(F.lit(0), F.size(lines) - WINDOW),
        lambda i: F.struct(
            i.alias("pos"), F.unhex(F.md5(F.array_join(F.slice(lines, i + 1, WINDOW), "\n"))).alias("window")
        ),
    )
    rows = (
        docs.select(*_row_key(id_col, text_col), _lines(text_col).alias("lines"))
        .filter(F.size("lines") >= WINDOW)
        .select(*DOC, F.inline(places))
    )
    return write_scratch(rows, "windows")


def later_places(windows: DataFrame) -> DataFrame:
    """(doc_id, text_md5, pos) of every window whose content stands at an earlier place too."""
    place = F.struct(*DOC, "pos")
    first = (
        windows.groupBy("window")
        .agg(F.min(place).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("window", "first")
    )
    return windows.join(first, "window").filter(place > F.col("first")).select(*DOC, "pos")


def kept_spans(later: DataFrame) -> DataFrame:
    """Per document: ``spans`` of uncovered lines before the last covered one, and the line where the rest starts."""
    from pyspark.sql import Window

    in_doc = Window.partitionBy(*DOC).orderBy("pos")
    start = F.coalesce(F.lag("pos").over(in_doc) + WINDOW, F.lit(0))
    gaps = later.distinct().select(*DOC, "pos", start.alias("start"))
    span = F.when(F.col("pos") > F.col("start"), F.struct("start", (F.col("pos") - F.col("start")).alias("length")))
    return gaps.groupBy(*DOC).agg(
        F.array_sort(F.collect_list(span)).alias("spans"), (F.max("pos") + WINDOW).alias("rest")
    )


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_lines, n_removed and the cleaned ``text``."""
    spans = kept_spans(later_places(line_windows(docs, id_col, text_col)))
    rows = docs.select(*_row_key(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans = spans.withColumnsRenamed({"doc_id": "span_doc", "text_md5": "span_md5"})
    same = F.col("doc_id").eqNullSafe(F.col("span_doc")) & (F.col("text_md5") == F.col("span_md5"))
    joined = rows.join(spans, same, "left")
    lines = _lines("text")
    between = F.flatten(F.transform("spans", lambda s: F.slice(F.col("lines"), s["start"] + 1, s["length"])))
    rest = F.slice("lines", F.col("rest") + 1, F.col("n_lines"))
    kept = F.when(F.col("rest").isNull(), F.col("lines")).otherwise(F.concat(between, rest))
    return (
        joined.select("doc_id", "spans", "rest", lines.alias("lines"))
        .withColumn("n_lines", F.size("lines"))
        .withColumn("kept", kept)
        .select(
            "doc_id",
            F.col("n_lines").cast("bigint").alias("n_lines"),
            (F.col("n_lines") - F.size("kept")).cast("bigint").alias("n_removed"),
            F.array_join("kept", "\n").alias("text"),
        )
    )

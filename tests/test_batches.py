"""Slices of Arrow batches, and the functions that give results back slice by slice."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuskiln.functions.batches import SLICE_ROWS, slices
from corpuskiln.operators.minhash import signature_of
from corpuskiln.operators.prompts import functions_of


def test_slices_are_bounded_and_complete():
    texts = ["ab", None, "c" * 30, "", "d" * 9, "é" * 4, "e"]
    cut = [part.to_pylist() for part in slices(pa.array(texts), rows=3, size=10)]
    assert sum(cut, []) == texts
    assert cut == [["ab", None, "c" * 30], ["", "d" * 9, "é" * 4], ["e"]]
    assert list(slices(pa.array([], pa.string()))) == []


@pytest.mark.parametrize(
    "column, text, result",
    [
        (lambda c: signature_of(c, 4, 1), "a b c", 4),
        (functions_of, 'def f():\n    """doc"""\n', 1),
    ],
)
def test_a_batch_comes_back_in_slices(spark, monkeypatch, column, text, result):
    made, udf = [], F.arrow_udf
    monkeypatch.setattr(F, "arrow_udf", lambda kind: lambda f: made.append(f) or udf(kind)(f))
    column(F.col("content"))
    batches = [pa.array([text] * (2 * SLICE_ROWS + 5)), pa.array([text, None])]
    parts = list(made[0](iter(batches)))
    assert [len(part) for part in parts] == [SLICE_ROWS, SLICE_ROWS, 5, 2]
    assert {len(value or ()) for part in parts for value in part.to_pylist()} == {result, 0}

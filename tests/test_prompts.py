"""Function extraction, prompts and generations."""

import pytest
from pyspark.sql import functions as F

from corpuskiln.config import GenerationConfig
from corpuskiln.operators import prompts
from corpuskiln.plans.memorization import build_prompts, postprocess_generations

SOURCE = '''import os

@decorated
def outer(a,
          b):
    """Outer doc.

    More."""
    def inner():
        "Inner doc"
        return 1
    return inner

class K:
    def method(self):
        r\'\'\'Method doc\'\'\'

    async def waits(self):
        """not a plain function"""

def bare(): return 1

def blank():
    """   """
'''


@pytest.fixture(scope="module")
def sources(spark):
    rows = [(1, SOURCE), (2, "def broken(:\n"), (3, ""), (4, 'def f():\r\n    """x"""\r\n'), (5, 'def g():\n    """a\x0cb"""\n'), (6, None), (7, "x = '\0'")]
    return spark.createDataFrame(rows, "doc_id long, content string")


def test_functions_in_breadth_first_order(sources):
    rows = prompts.extract_functions(sources).orderBy("doc_id", "position").collect()
    assert [(r.doc_id, r.position, r.function_name) for r in rows] == [
        (1, 1, "outer"),
        (1, 4, "inner"),
        (1, 5, "method"),
        (4, 1, "f"),
        (5, 1, "g"),
    ]
    texts = {r.function_name: r.signature_with_docstring for r in rows}
    assert texts["outer"] == 'def outer(a,\n          b):\n    """Outer doc.\n\n    More."""'
    assert texts["inner"] == '    def inner():\n        "Inner doc"'
    assert texts["f"] == 'def f():\n    """x"""'
    assert texts["g"] == 'def g():\n    """a\x0cb"""'


def test_function_counts_and_totals(sources):
    rows = prompts.function_counts(sources, chunk=2).orderBy("doc_id").collect()
    assert [(r.n_functions, r.n_docstrings) for r in rows] == [(5, 3), (0, 0), (0, 0), (1, 1), (1, 1), (0, 0), (0, 0)]
    assert [(r.total_functions, r.total_docstrings) for r in rows][-1] == (7, 5)
    few = prompts.function_counts(sources, limit=9).orderBy("doc_id").collect()
    assert few[0].n_functions == 5 and few[0].n_docstrings < 3


def test_prompt_table(sources):
    table = build_prompts(sources).orderBy("function_id").collect()
    assert [r.function_id for r in table] == [1, 2, 3, 4, 5]
    assert {r.function_name for r in table[:3]} == {"outer", "method", "inner"}


def test_prompt_expansion(spark):
    df = spark.createDataFrame([(1, "  　def f():\n"), (2, "b"), (3, "c")], "function_id long, signature_with_docstring string")
    rows = prompts.prompt_expand(df, "<s>").collect()
    assert len(rows) == 15 and {r.prompt for r in rows if r.function_id == 1} == {"<s>def f():"}
    config = GenerationConfig(n_samples=12, batch_size=5, num_tasks=2)
    rows = prompts.prompt_expand(df, "<s>", config=config).collect()
    assert sorted((r.function_id, r.copy_id, r.sample_id) for r in rows) == [
        (f, c, s) for f in (1, 2) for c in (1, 2) for s in range(1, 6)
    ]
    assert prompts.prompt_expand(df, "<s>", config=GenerationConfig(n_samples=3)).count() == 0


def test_generation_postprocessing(spark):
    rows = [
        (1, 10, "ab", "abbody\nprint(1)\nclass A"),
        (1, 2, "ab", "xy z"),
        (2, 5, "abc", "ab"),
        (2, 7, "é", "é\n#"),
    ]
    df = spark.createDataFrame(rows, "f long, pos long, prompt string, text string")
    got = postprocess_generations(df, "f", "pos", "prompt", "text").orderBy("function_id", "generation_id").collect()
    assert [tuple(r) for r in got] == [(1, 1, " z"), (1, 2, "body"), (2, 1, ""), (2, 2, "")]


def test_earliest_stop_wins(spark):
    df = spark.createDataFrame([("a\nif b\ndef c",), ("\n@x",), ("no stop",), ("",)], "t string")
    got = df.select(prompts.truncate_at_stop(F.col("t"))).collect()
    assert [r[0] for r in got] == ["a", "", "no stop", ""]


def test_token_limit(spark):
    df = spark.createDataFrame([("a " * 512,), ("a" + " a" * 511,), ("a" + " a" * 512,)], "signature_with_docstring string")
    assert prompts.prompt_token_limit(df).count() == 1


def test_num_tasks_counts_prompts_not_ids(spark):
    rows = spark.createDataFrame([(1002, "a"), (1005, "b"), (2000, "c")], "function_id long, signature_with_docstring string")
    found = prompts.prompt_expand(rows, "|", config=GenerationConfig(num_tasks=2)).collect()
    assert {r.function_id for r in found} == {1002, 1005}


def test_callers_token_counts(spark):
    rows = spark.createDataFrame([("a b c",), ("abcdefghij",)], "signature_with_docstring string")
    by_chars = prompts.prompt_token_limit(rows, limit=5, count_tokens=F.length)
    assert [r[0] for r in by_chars.collect()] == ["a b c"]

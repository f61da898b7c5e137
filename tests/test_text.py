"""Text features against Python's own string methods."""

import re

from pyspark.sql import functions as F

from corpuskiln.config import CleaningConfig
from corpuskiln.functions import text as T
from corpuskiln.operators.features import cast_size, file_features

ODD = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", " ", " ", "　", "\t"]
TEXTS = [f"a{x}b{y}c{x}" for x in ODD for y in ODD] + ["", "\n", "\n\n", "x", "x\n", " \t x = y  é٠中 "]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")


def values(df, column):
    return [row.v for row in df.select("doc_id", column.alias("v")).orderBy("doc_id").collect()]


def test_lines_follow_splitlines(spark):
    assert values(frame(spark, TEXTS), T.lines(F.col("content"))) == [t.splitlines() for t in TEXTS]


def test_line_statistics(spark):
    rows = values(frame(spark, TEXTS), F.struct(T.line_mean(F.col("content")), T.line_max(F.col("content"))))
    for text, (mean, longest) in zip(TEXTS, rows):
        lengths = [len(line) for line in text.splitlines()]
        assert longest == (max(lengths) if lengths else None)
        assert mean == (sum(lengths) / len(lengths) if lengths else None)


def test_white_space_and_letters(spark):
    import hashlib

    df = frame(spark, TEXTS)
    hashes = values(df, T.content_hash(F.col("content")))
    assert hashes == [hashlib.md5(re.sub(r"\s+", "", t).encode()).hexdigest() for t in TEXTS]
    assert values(df, T.strip_spaces(F.col("content"))) == [t.strip() for t in TEXTS]
    shares = values(df, T.alpha_frac(F.col("content")))
    assert shares == [sum(c.isalnum() for c in t) / len(t) if t else None for t in TEXTS]


def test_copies_that_differ_in_white_space_collide(spark):
    a, b = values(frame(spark, ["def f(x):\n\treturn x", "def f(x): return　x\n\n"]), T.content_hash(F.col("content")))
    assert a == b


def test_config_or_test_thresholds(spark):
    texts = [
        "\n" * 19 + "test",  # no occurrence allowed below 20 newlines
        "\n" * 20 + "test",  # one allowed
        "\n" * 20 + "test Test",
        "\n" * 40 + "config CONFIG",
        "a\nb\nc\nd\nUnit Tests here",
        "a\nb\nc\nd\ne\nunit files",
        "testest" + "\n" * 20,  # occurrences do not overlap
    ]
    assert values(frame(spark, texts), T.is_config_or_test(F.col("content"))) == [True, False, True, False, True, False, False]


def test_keyword_scans(spark):
    texts = ["x\n# AUTO-Generated", "1\n2\n3\n4\n5\nautogenerated", "DEF f", "defx", "a==b=c=d", "a==b=c=d=e"]
    df = frame(spark, texts)
    assert values(df, T.is_autogenerated(F.col("content"))) == [True, False, False, False, False, False]
    assert values(df, T.has_no_keywords(F.col("content"))) == [True, True, False, True, True, True]
    assert values(df, T.has_few_assignments(F.col("content"))) == [True, True, True, True, True, False]


def test_one_pass_features_equal_single_ones(spark):
    df = file_features(frame(spark, TEXTS), config=CleaningConfig())
    single = {
        "hash": T.content_hash,
        "line_mean": T.line_mean,
        "line_max": T.line_max,
        "alpha_frac": T.alpha_frac,
        "ratio": T.char_token_ratio,
        "autogenerated": T.is_autogenerated,
        "config_or_test": T.is_config_or_test,
        "has_no_keywords": T.has_no_keywords,
        "has_few_assignments": T.has_few_assignments,
    }
    wrong = None
    for name, feature in single.items():
        differs = ~F.col(name).eqNullSafe(feature(F.col("content")))
        wrong = differs if wrong is None else wrong | differs
    assert df.filter(wrong).count() == 0


def test_token_count_of_another_tokenizer(spark):
    df = file_features(frame(spark, ["abcdef"]), token_count=F.lit(2))
    assert df.first().ratio == 3.0


def test_tokens_keep_the_whole_text(spark):
    texts = ["I'll pay 3 dollars,\n  don't you? café x_1", "", "  "]
    tokens = values(frame(spark, texts), T.pre_tokens(F.col("content")))
    assert ["".join(t) for t in tokens] == texts
    assert tokens[0][:3] == ["I", "'ll", " pay"]
    words = values(frame(spark, texts), T.word_tokens(F.col("content")))
    assert words == [[w for w in re.split("[^A-Za-z_0-9]", t) if w] for t in texts]


def test_size_that_does_not_parse(spark):
    df = cast_size(spark.createDataFrame([("12",), ("x",)], "size string"))
    assert [r.size for r in df.collect()] == [12, None]


def test_jaccard_of_empty_sets_is_null(spark):
    df = spark.createDataFrame([([], []), (["a"], ["a", "b"])], "x array<string>, y array<string>")
    assert [r[0] for r in df.select(T.jaccard(F.col("x"), F.col("y"))).collect()] == [None, 0.5]

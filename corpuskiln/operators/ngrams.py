"""The three ways of training over several owners, with n-gram counts as the model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.functions import text as T
from corpuskiln.scratch import write_scratch

# bytes of text whose n-grams one task counts before the shuffle
SLICE_BYTES = 16 * 1024 * 1024


def sliced(df: DataFrame, text_col: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The same rows, dealt into parts of about ``slice_bytes`` of text, if they have more.

    Before the shuffle a task holds a table of all n-grams of its part, several times the size of the text, so
    the part must not grow with the input. All columns deal the rows (but maps, which have no hash), so copies of a
    text are spread by their ids.
    """
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    if size <= slice_bytes:
        return df
    parts = max(-(-size // slice_bytes), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(parts, *[name for name, kind in df.dtypes if "map<" not in kind])


def ngram_rows(df: DataFrame, text_col: str, n: int, keep: Sequence[str] = ()) -> DataFrame:
    """One row per n-gram occurrence: its context words and its last word.

    The contexts of bigrams are the words themselves, so two shifted arrays are
    zipped; longer contexts are joined per position.
    """
    words = df.select(*keep, T.word_tokens(F.col(text_col)).alias("_words"))
    size = F.greatest(F.size("_words") - (n - 1), F.lit(0))
    last = F.slice("_words", F.lit(n), size)
    if n == 2:
        contexts = F.slice("_words", F.lit(1), size)
    else:
        places = F.slice(F.sequence(F.lit(1), F.size("_words") + 1), F.lit(1), size)
        contexts = F.transform(places, lambda i: F.array_join(F.slice("_words", i, n - 1), " "))
    return words.select(*keep, F.inline(F.arrays_zip(contexts, last)).alias("context", "word"))


def ngram_train(df: DataFrame, text_col: str, n: int = 2) -> DataFrame:
    """(context, word, n): counts over all rows."""
    return ngram_rows(sliced(df, text_col), text_col, n).groupBy("context", "word").agg(F.count("*").alias("n"))


def ngram_perplexity(model: DataFrame, valid: DataFrame, text_col: str, n: int = 2) -> DataFrame:
    """One row: exp of the mean negative log probability, add-one smoothed.

    log p = ln(count(context, word) + 1) - ln(count(context) + V) is summed in
    two parts, each joined on a key that is unique on both sides, so a frequent
    context does not gather its words in one task. V counts the words of the
    model and one for unknown words. Both count tables are stored, since each
    part reads them.
    """
    model = write_scratch(model, "model")
    counted = ngram_rows(sliced(valid, text_col), text_col, n).groupBy("context", "word").agg(F.count("*").alias("_seen"))
    seen = write_scratch(counted, "seen")
    vocabulary = model.select("word").distinct().agg((F.count("*") + 1).alias("v")).scalar()
    pairs = (
        seen.join(model, ["context", "word"], "left")
        .agg(
            F.sum(F.col("_seen") * F.ln(F.coalesce("n", F.lit(0)) + 1.0)).alias("log_sum"),
            F.sum("_seen").alias("n_tokens"),
        )
    )
    contexts = model.groupBy("context").agg(F.sum("n").alias("n"))
    seen_contexts = seen.groupBy("context").agg(F.sum("_seen").alias("_seen"))
    norms = seen_contexts.join(contexts, "context", "left").agg(
        F.sum(F.col("_seen") * F.ln((F.coalesce("n", F.lit(0)) + vocabulary).cast("double"))).alias("norm_sum")
    )
    mean = (F.col("log_sum") - norms.scalar()) / F.col("n_tokens")
    return pairs.select("n_tokens", F.exp(-mean).alias("perplexity"))


def ngram_federated(df: DataFrame, text_col: str, org_col: str, n: int = 2) -> DataFrame:
    """(context, word, probability): relative frequencies per organisation, averaged by examples.

    An organisation without the n-gram adds a zero. The totals, one row per
    organisation, are stored, so the join knows their size.
    """
    rows = ngram_rows(sliced(df, text_col), text_col, n, [org_col])
    counts = rows.groupBy(org_col, "context", "word").agg(F.count("*").alias("n"))
    tokens = F.sum(F.greatest(F.size(T.word_tokens(F.col(text_col))) - n + 1, F.lit(0)))
    per_org = write_scratch(
        df.groupBy(org_col).agg(F.count("*").alias("_examples"), tokens.alias("_grams")), "examples"
    )
    examples = per_org.agg(F.sum("_examples").alias("n")).scalar()
    share = F.sum(F.col("_examples") * F.col("n") / F.col("_grams"))
    return (
        counts.join(per_org, org_col)
        .groupBy("context", "word")
        .agg(share.alias("_share"))
        .select("context", "word", (F.col("_share") / examples).alias("probability"))
    )


def ngram_update(state: DataFrame | None, corpus: DataFrame, text_col: str, step: int, n: int = 2) -> DataFrame:
    """The model after one more organisation: counts, and the steps that first and last changed them."""
    counts = ngram_train(corpus, text_col, n).withColumns({"first_step": F.lit(step), "last_step": F.lit(step)})
    if state is None:
        return counts
    return (
        state.unionByName(counts)
        .groupBy("context", "word")
        .agg(F.sum("n").alias("n"), F.min("first_step").alias("first_step"), F.max("last_step").alias("last_step"))
    )


def ngram_incremental(df: DataFrame, text_col: str, org_col: str, order: Sequence[str], n: int = 2) -> DataFrame:
    """The model after all organisations of ``order``, one after another.

    Counts are added and steps compared, so one pass over the text with the step of each
    organisation gives what the updates give one by one.
    """
    steps: dict[str, list[int]] = {}
    for step, org in enumerate(order, start=1):
        steps.setdefault(org, []).append(step)
    of_org = F.create_map(*[F.lit(x) for org, own in steps.items() for x in (org, own)])
    rows = ngram_rows(sliced(df.filter(F.col(org_col).isin(*steps)), text_col), text_col, n, [org_col])
    # one aggregation: a task holds one table of n-grams, not one for the organisations and one for all
    stepped = rows.select("context", "word", F.explode(of_org[F.col(org_col)]).alias("_step"))
    return stepped.groupBy("context", "word").agg(
        F.count("*").alias("n"), F.min("_step").alias("first_step"), F.max("_step").alias("last_step")
    )

"""Batches of token sequences for training and for evaluation, from several corpora."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from corpuskiln import config
from corpuskiln.operators.collection import union_corpora
from corpuskiln.operators.ordering import buffer_shuffle, seeded_shuffle
from corpuskiln.operators.packing import pack_sequences, sequence_batches
from corpuskiln.scratch import write_scratch

BATCH_SIZE = 2


def shuffled_sequences(
    corpora: list[DataFrame],
    id_col: str,
    text_col: str,
    seed: int,
    packing: config.PackingConfig,
    batch_size: int | None = None,
    order: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(seq_id, tokens): the rows of all corpora in a seeded order, packed in that order. Ids are unique over all corpora.

    ``batch_size`` and ``order`` are those of ``pack_sequences``. Only ids are shuffled for the order; packing joins the texts to their positions. Both are stored, since
    packing reads them twice.
    """
    rows = union_corpora(*[c.select(id_col, text_col) for c in corpora])
    positions = write_scratch(seeded_shuffle(rows.select(id_col), id_col, seed), "order")
    placed = write_scratch(rows.join(positions, id_col).select("position", text_col), "placed")
    return pack_sequences(placed, text_col, "position", packing, batch_size=batch_size, order=order)


def training_batches(
    corpora: list[DataFrame],
    id_col: str = "doc_id",
    text_col: str = "content",
    seed: int = config.TRAIN_SHUFFLE_SEED,
    packing: config.PackingConfig = config.PackingConfig(),
    buffer: int = config.SHUFFLE_BUFFER,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """(batch_id, sequences): union, seeded shuffle, packing, buffer shuffle of the sequences, batches."""

    def moved(ids: DataFrame) -> DataFrame:
        return buffer_shuffle(ids, "seq_id", "seq_id", seed, buffer)

    sequences = shuffled_sequences(corpora, id_col, text_col, seed, packing, batch_size, moved)
    return sequence_batches(sequences, batch_size)


def evaluation_batches(
    corpora: list[DataFrame],
    id_col: str = "doc_id",
    text_col: str = "content",
    seed: int = config.EVAL_SHUFFLE_SEED,
    packing: config.PackingConfig = config.PackingConfig(),
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """(batch_id, sequences): union, seeded shuffle, packing, batches in order."""
    return sequence_batches(shuffled_sequences(corpora, id_col, text_col, seed, packing, batch_size), batch_size)

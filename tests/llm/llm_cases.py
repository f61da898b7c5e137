"""Small tables with the cases every operator has to define."""

from __future__ import annotations

import random

DOC_TYPE = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids binary, keep_id bigint, node int, n bigint"


def documents(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    full = [(i, t, None, "s", None if t is None else len(t), b"x", -1, 0, 0) for i, t in rows]
    return spark.createDataFrame(full, DOC_TYPE)


def words(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(2, 9))) for _ in range(n))


def changed(text: str, seed: int, n: int) -> str:
    """``text`` with ``n`` words replaced."""
    rnd, parts = random.Random(seed), text.split(" ")
    for at in rnd.sample(range(len(parts)), n):
        parts[at] = f"new{rnd.randrange(10**6)}"
    return " ".join(parts)


ODD_TEXTS = [None, "", " ", "\n\n\n", "one", "a\x1cb c", "ΑΣ Σ. don't 12 ²½ <|endoftext|>x é́", "x" * 20_000, "w " * 9_000]

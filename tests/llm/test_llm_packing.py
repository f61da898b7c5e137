import random
import zlib

import numpy as np
from llm_cases import ODD_TEXTS, documents, words
from tokenizers import Tokenizer

from corpuskiln.llm.packing import END_ID, WINDOW, InvertedIndex, pack
from corpuskiln.llm.tokenizer_files import tokenizer_path

PATH = tokenizer_path()
LIBRARY = Tokenizer.from_file(PATH)


def expected_ids(text):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, END_ID], "<u4")


def check(rows, pieces):
    """Each id of each document once, gapless sequences, no padding."""
    want = {i: expected_ids(t) for i, t in rows}
    seen, sequences = {i: 0 for i in want}, {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        ids = want[p["doc_id"]]
        assert p["start"] == seen[p["doc_id"]] and p["length"] > 0
        seen[p["doc_id"]] += p["length"]
        assert p["doc_tokens"] == len(ids)
        assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert seen == {i: len(x) for i, x in want.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= WINDOW and at & (at - 1) == 0


def test_every_id_once(spark):
    rows = [*enumerate(ODD_TEXTS)] + [(100 + i, words(i, 50 + 13 * (i % 40))) for i in range(200)]
    rows += [(500 + i, "copy of a text") for i in range(300)] + [(900, words(9, 30_000))]
    check(rows, pack(documents(spark, rows), PATH).collect())


def test_index_scores_equal_the_formula():
    rnd = np.random.default_rng(1)
    docs = [rnd.integers(0, 40, rnd.integers(1, 60)).astype("<u2") for _ in range(30)]
    idf = rnd.random(1 << 16)
    mean = float(np.mean([len(d) for d in docs]))
    index = InvertedIndex(docs, idf, mean)
    for q in range(30):
        found = index.scores(q)
        for d, ids in enumerate(docs):
            score = 0.0
            for token in set(docs[q].tolist()):
                n = (ids == token).sum()
                score += idf[token] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(ids) / mean)) if n else 0
            assert abs(score - found[d]) < 1e-9


def test_neighbours_share_a_window(spark):
    """Documents of two subjects with no words in common: windows hold one subject, but for the seams."""
    rnd = random.Random(3)
    subjects = [[f"{c}{k}" for k in range(60)] for c in ("alpha", "omega")]
    rows = [(i, " ".join(rnd.choice(subjects[i % 2]) for _ in range(150))) for i in range(120)]
    pieces = pack(documents(spark, rows), PATH).collect()
    check(rows, pieces)
    mixed, windows = 0, {}
    for p in pieces:
        windows.setdefault(p["sequence_id"], set()).add(p["doc_id"] % 2)
    mixed = sum(len(x) == 2 for x in windows.values())
    assert mixed <= len(windows) / 3


def test_repeated_null_and_empty(spark):
    rows = [(1, "same"), (1, "same"), (None, "lone")]
    found = pack(documents(spark, rows), PATH).collect()
    assert sum(p["length"] for p in found) == sum(len(expected_ids(t)) for _, t in rows)
    assert pack(documents(spark, []), PATH).count() == 0

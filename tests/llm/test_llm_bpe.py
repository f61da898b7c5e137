import hashlib
import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import ODD_TEXTS, documents
from tokenizers import Tokenizer

from corpuskiln.llm.bpe import WordBpe, decode_ids, encode_texts, loaded, round_trip_digests
from corpuskiln.llm.edit_counts import (
    SegmentTree,
    apply_edits,
    attach_edits,
    build_trees,
    count_with_edits,
    counter,
    split_leaves,
)
from corpuskiln.llm.tokenizer_files import tokenizer_path

PATH = tokenizer_path()
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aeiou 's<|>\x1c\x85ΣİéÁ"))))
def test_ids_and_text_equal_the_library(text):
    bpe, ids = loaded(PATH), library(text)
    assert np.frombuffer(bpe.encode(text), "<u4").tolist() == ids
    assert bpe.decode(bpe.encode(text)) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_batches_equal_the_library():
    rnd, bpe = random.Random(9), loaded(PATH)
    parts = ["the ", "word", "s. ", "Éa", "é", "'s", "\x1c", "²", "İ", "<|endoftext|>", "<|x", "\n", "-_", "ß", "K", "\0"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(40))) for _ in range(1500)] + ODD_TEXTS
    flat, n = bpe.encode_batch(pa.array([*texts, None], pa.string()))
    assert n.sum() == len(flat) and n[-1] == 0
    for text, ids in zip(texts, np.split(flat, n.cumsum()[:-1]), strict=False):
        wanted = library(text or "")
        assert ids.tolist() == wanted, text
        assert bpe.decode_bytes(ids).decode() == LIBRARY.decode(wanted, skip_special_tokens=False)


def test_different_words_are_merged_once(monkeypatch):
    bpe, merged = WordBpe(PATH), []
    monkeypatch.setattr(bpe, "merge", lambda ids: merged.append(1) or list(ids))
    bpe.encode_batch(pa.array(["one two, two three. " * 50] * 20))
    assert len(merged) <= 5  # three words and two marks


def test_digests_of_odd_texts(spark):
    docs = documents(spark, list(enumerate(ODD_TEXTS)))
    for row in round_trip_digests(docs, PATH).collect():
        ids = library(ODD_TEXTS[row["doc_id"]] or "")
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert round_trip_digests(docs.limit(0), PATH).count() == 0
    repeated = round_trip_digests(documents(spark, [(None, "a"), (1, "a"), (1, "a")]), PATH).collect()
    assert len(repeated) == 3 and len({r["ids_sha256"] for r in repeated}) == 1


def test_encode_and_decode_as_tables(spark):
    found = decode_ids(encode_texts(documents(spark, [(1, "Hello world"), (2, None)]), PATH), PATH).collect()
    assert {r["doc_id"]: r["text"] for r in found} == {1: "hello</w> world</w>", 2: ""}


ALPHABET = "ab c.'s\n\x1c é 9$<|endoftext|>"


def random_text(rnd, n):
    return "".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(0, n)))


def test_tree_follows_random_edits():
    rnd, count = random.Random(5), counter(PATH)
    for _ in range(400):
        text = random_text(rnd, 200)
        tree = SegmentTree(count, split_leaves(text, 8))
        assert tree.tokens[1] == len(library(text))
        for _ in range(5):
            at, length, new = rnd.randrange(0, len(text) + 3), rnd.randrange(0, 30), random_text(rnd, 25)
            tree.edit(at, length, new)
            text = text[: min(at, len(text))] + new + text[at + length :]
            assert (tree.text, tree.tokens[1], tree.chars[1]) == (text, len(library(text)), len(text))


def test_an_edit_encodes_its_region_only():
    text = "word " * 20_000
    tree = SegmentTree(counter(PATH), split_leaves(text))
    tree.encoded_chars = 0
    tree.edit(50_001, 3, "changed")
    assert tree.encoded_chars < 3_000
    assert tree.tokens[1] == len(library(text[:50_001] + "changed" + text[50_004:]))


def test_edits_by_table(spark):
    docs = documents(spark, [(1, "The quick brown fox"), (2, None), (3, "untouched"), (None, "x y")])
    edits = spark.createDataFrame(
        [(1, 1, 4, 5, "slow"), (1, 0, 0, 3, "A"), (2, 0, 9, 9, "new words"), (2, 1, -5, -5, None), (9, 0, 0, 0, "gone"), (None, 0, None, None, "é ")],
        "doc_id bigint, seq bigint, start bigint, length bigint, replacement string",
    )
    after = {1: "A quslowrown fox", 2: "new words", 3: "untouched", None: "é x y"}
    counts = {r["doc_id"]: r for r in count_with_edits(attach_edits(docs, edits), PATH).collect()}
    trees = {r["doc_id"]: r for r in apply_edits(attach_edits(build_trees(docs, PATH), edits), PATH).collect()}
    assert counts.keys() == trees.keys() == after.keys()
    for i, text in after.items():
        assert counts[i]["n_tokens_edited"] == trees[i]["tokens"][1] == len(library(text)), (i, text)
        assert "".join(trees[i]["segments"]) == text
    assert counts[3]["n_edits"] == 0 and counts[3]["encoded_chars"] == 0
    assert build_trees(documents(spark, []), PATH).count() == 0


def test_query_edits_equal_brute_force(spark):
    from corpuskiln.llm.queries import with_sample_edits

    docs = documents(spark, [*enumerate(ODD_TEXTS), (50, "some words of a text, to be changed a little. " * 80)])
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for row in count_with_edits(with_sample_edits(docs), PATH).collect():
        text = texts[row["doc_id"]]
        n, first = len(text), text[:20]
        edited = text[: n // 3] + first + text[n // 3 + 7 :]
        edited = edited[: n // 2] + edited[n // 2 + 5 :]
        edited = "Draft: " + edited + " the end."
        assert (row["n_tokens"], row["n_tokens_edited"]) == (len(library(text)), len(library(edited)))
        assert (row["n_chars"], row["n_chars_edited"]) == (n, len(edited))

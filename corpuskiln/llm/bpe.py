"""Encoding and decoding with a byte-pair vocabulary of words with end marks.

A pre-token's symbols form a doubly linked list. A heap holds the merge rank of
every neighbouring pair; an entry whose symbols have changed since it was pushed
is stale and skipped. Normal form and pre-tokens, which depend on a version of
Unicode, are those of the library that reads the same file. Decoding joins the vocabulary strings of the ids by one
space, as the library does for a file that names no decoder.

Long pre-tokens cost n log n. A batch is numbered in Arrow first, so that each different plain word
of it is normalised, split and merged once; ids of words and short chunks are kept per Python
worker, with a bound on the entries.

Defined cases: a null text is empty and has no tokens. Ids outside the vocabulary
are skipped when decoding. Rows are independent of each other, so repeated rows
give repeated results; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuskiln.llm.wordbpe import ANY_SPECIAL, ID_TYPE, ChunkCache, PendingCache, numbered_ids, slices, text_ids


class Batch(NamedTuple):
    words: PendingCache
    rest: PendingCache


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = 1 + max(*vocab.values(), *self.special.values())
        self.strings: list[str | None] = [None] * size
        for string, i in {**vocab, **self.special}.items():
            self.strings[i] = string
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.inner = {s: i for s, i in vocab.items() if len(s) == 1}
        self.last = {s: vocab[s + end] for s in self.inner if s + end in vocab}
        library = Tokenizer.from_file(path)
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.words = ChunkCache(self.encode_word)
        self.chunks = ChunkCache(self.encode_chunk)
        # what a batch asks for: plain words and other chunks, each different one once
        self.plain, self.rest = PendingCache(self.encode_plain), PendingCache(self.encode_chunks)
        self.decoded = [None if s is None else s.encode("utf-8") for s in self.strings]

    def encode_word(self, word: str) -> bytes:
        """Ids of one pre-token, given as the symbols of its bytes."""
        ids = [self.inner[s] for s in word[:-1]] + [self.last[word[-1]]]
        return np.asarray(self.merge(ids), ID_TYPE).tobytes()

    def merge(self, ids: list[int]) -> list[int]:
        n, found = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = enumerate(zip(ids, ids[1:], strict=False))
        heap = [(merge[0], i, *pair, merge[1]) for i, pair in pairs if (merge := found(pair))]
        heapq.heapify(heap)
        while heap:
            _, i, left, right, merged = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # stale: a symbol of the pair has been merged since
            ids[i], ids[j] = merged, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if merge := found((merged, ids[k])):
                    heapq.heappush(heap, (merge[0], i, merged, ids[k], merge[1]))
            h = before[i]
            if h >= 0 and (merge := found((ids[h], merged))):
                heapq.heappush(heap, (merge[0], h, ids[h], merged, merge[1]))
        return [x for x in ids if x >= 0]

    def encode_chunk(self, chunk: str) -> bytes:
        """Ids of one stretch without white space, special tokens first."""
        out = []
        for piece in ANY_SPECIAL.split(chunk) if "<|" in chunk else (chunk,):
            if piece in self.special:
                out.append(np.asarray([self.special[piece]], ID_TYPE).tobytes())
            else:
                out += [self.words[word] for word, _ in self.split(self.normalize(piece))]
        return b"".join(out)

    def encode_plain(self, words: list[str]) -> list[bytes]:
        """Words of letters are one pre-token each, so all of them are normalised and split in two calls."""
        pieces = self.split(self.normalize(" ".join(words)))
        if len(pieces) != len(words):
            return self.encode_chunks(words)
        return [self.encode_word(word) for word, _ in pieces]

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        self.words.trim()
        return list(map(self.encode_chunk, chunks))

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        return numbered_ids(Batch(self.plain, self.rest), texts)

    def encode(self, text: str) -> bytes:
        self.words.trim()
        return text_ids(self.chunks, text)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The decoded text in UTF-8; every id of a vocabulary string is one of these bytes objects."""
        return b" ".join(map(self.decoded.__getitem__, ids.tolist()))

    def decode(self, ids: bytes) -> str:
        strings = self.strings
        found = [strings[i] for i in np.frombuffer(ids, ID_TYPE).tolist() if i < len(strings)]
        return " ".join(found if None not in found else [x for x in found if x is not None])


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """One tokenizer per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers in one binary value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [bpe.encode(x or "") for x in batch["text"]]})

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id bigint, ids binary")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text): the text that the ids stand for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path)
        for batch in batches:
            yield batch.assign(text=[bpe.decode(x) for x in batch["ids"]])

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id bigint, ids binary, text string")


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of whole texts; nothing but digests leaves the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            texts = batch.column("text")
            for first, end in slices(texts):
                flat, n = bpe.encode_batch(texts.slice(first, end - first))
                parts = np.split(flat, n.cumsum()[:-1])
                columns = {
                    "doc_id": batch.column("doc_id").slice(first, end - first),
                    "n_tokens": pa.array(n.astype(np.int64)),
                    "ids_sha256": pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in parts]),
                    "decoded_sha256": pa.array([hashlib.sha256(bpe.decode_bytes(x)).hexdigest() for x in parts]),
                }
                yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

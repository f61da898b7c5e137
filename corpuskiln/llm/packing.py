"""Packing by lexical retrieval: windows are filled with documents that share rare tokens.

1. Every document's ids are computed once and stored, with a MinHash of its token set.
2. Document frequencies are counted over the whole corpus. There is one row a
   token of the vocabulary at most, so this table has a fixed bound and is shared.
3. Documents are range-partitioned by (MinHash, id), so lexically close ones meet and
   copies, however many, spread over partitions. A partition is cut into shards of
   ``SHARD_DOCS`` documents or ``SHARD_TOKENS`` tokens. Each shard has a BM25 inverted index:
   postings of documents with weights by the corpus-wide frequencies.
4. In a shard, full windows of long documents go out as they are. Then a seed takes
   a window; the index returns its unused neighbours by BM25 score, and they fill the window
   greedily. The neighbour that no longer fits is cut; its rest seeds the next
   window. What is left over at the end of a shard moves on to the next one.
5. The last window of a partition is written as sequences whose lengths are powers
   of two, so that no sequence needs padding.

Defined cases: a null text is empty, a document of one end token. Ties of scores go to
the earlier document in (MinHash, id) order. Rows that repeat an id are documents
of their own. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.llm.wordbpe import batch_ids, slices
from corpuskiln.scratch import write_scratch

WINDOW = 4096
END_ID = 2
SHARD_DOCS = 512
SHARD_TOKENS = 4_000_000
K1, B = 1.2, 0.75
MAX_ID = 1 << 16

PIECE_TYPE = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
)
PIECE_NAMES = [part.split()[0] for part in PIECE_TYPE.split(", ")]


def tokenized(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Stored rows (doc_id, ids, n, near): unsigned 16-bit ids with the end id, their number, a MinHash of their set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = np.random.default_rng(0).permutation(MAX_ID)
        for batch in batches:
            doc_id, text = batch.column(0), batch.column(1)
            for a, b in slices(text):
                ids, n = batch_ids(path, text.slice(a, b - a))
                if len(ids) and ids.max() >= MAX_ID:
                    raise ValueError("ids beyond 16 bits")
                ends = n.cumsum()
                near = [_near(ids[end - size : end], ranks) for end, size in zip(ends.tolist(), n.tolist(), strict=True)]
                ended = np.insert(ids.astype("<u2"), ends, end_id)
                offsets = np.concatenate(([0], (n + 1).cumsum() * 2)).astype(np.int32)
                packed = pa.BinaryArray.from_buffers(
                    pa.binary(), b - a, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ended.tobytes())]
                )
                columns = [doc_id.slice(a, b - a), packed, pa.array(n + 1, pa.int64()), pa.array(near, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "n", "near"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return write_scratch(rows.mapInArrow(run, "doc_id bigint, ids binary, n bigint, near bigint"), "packing-ids")


def _near(ids: np.ndarray, ranks: np.ndarray) -> int:
    """A MinHash of the pairs of neighbouring tokens: equal for two texts as often as they share pairs."""
    if len(ids) < 2:
        return int(ranks[ids].min(initial=0))
    pairs = (ids[:-1].astype(np.uint64) << np.uint64(16) | ids[1:]) * np.uint64(0x9E3779B97F4A7C15)
    return int((pairs ^ (pairs >> np.uint64(29))).min() >> np.uint64(1))


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different tokens of a document and their numbers; 16-bit ids are sorted by radix."""
    ordered = np.sort(ids, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))[: len(ordered)])
    return ordered[first], np.append(first[1:], len(ordered)) - first


def document_frequencies(rows: DataFrame) -> np.ndarray:
    """Documents that hold each token, over all rows; the array has one place a token, whatever the corpus.

    Every task adds up its own documents first and passes on only one row a token.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(MAX_ID, np.int64)
        for batch in batches:
            for ids in batch["ids"]:
                total[distinct(np.frombuffer(ids, "<u2"))[0]] += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"token": at, "n": total[at]})

    counted = rows.select("ids").mapInPandas(run, "token int, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    found = counted.toPandas()
    total = np.zeros(MAX_ID, np.int64)
    total[found["token"].to_numpy(np.int64)] = found["n"]
    return total


class InvertedIndex:
    """BM25 postings of one shard: for each token the documents that hold it and their weights."""

    def __init__(self, documents: list[np.ndarray], idf: np.ndarray, mean_length: float):
        tokens, counts, owner, lengths = [], [], [], np.array([len(d) for d in documents], float)
        for i, ids in enumerate(documents):
            token, n = distinct(ids)
            tokens.append(token)
            counts.append(n)
            owner.append(np.full(len(token), i, np.int64))
        self.terms = list(zip(tokens, counts, strict=True))
        token, n, doc = (np.concatenate(x) for x in (tokens, counts, owner))
        norm = K1 * (1 - B + B * lengths / max(mean_length, 1.0))
        weight = idf[token] * n * (K1 + 1) / (n + norm[doc])
        order = np.argsort(token, kind="stable")
        self.docs, self.weights = doc[order], weight[order]
        self.starts = np.searchsorted(token[order], np.arange(MAX_ID + 1))
        self.size = len(documents)

    def scores(self, doc: int) -> np.ndarray:
        """The score of every document of the shard for the tokens of one of them."""
        token, _ = self.terms[doc]
        start = self.starts[token]
        size = self.starts[token.astype(np.int64) + 1] - start
        at = np.repeat(start - np.concatenate(([0], size.cumsum()[:-1])), size) + np.arange(size.sum())
        return np.bincount(self.docs[at], weights=self.weights[at], minlength=self.size)


class _Packer:
    """Windows of one partition. A piece is (doc, start, length); ``open`` is the window not yet full."""

    def __init__(self, idf: np.ndarray, mean_length: float, first_sequence: int):
        self.idf, self.mean_length, self.sequence = idf, mean_length, first_sequence
        self.rows: list[tuple] = []
        self.left: list[tuple] = []  # (doc_id, ids, start): pieces that wait for a window

    def emit(self, pieces: list[tuple]) -> None:
        """One sequence of pieces (doc_id, ids, start, length)."""
        offset = 0
        for doc_id, ids, start, length in pieces:
            crc = zlib.crc32(ids[start : start + length].astype("<u4").tobytes())
            self.rows.append((doc_id, start, length, crc, len(ids), self.sequence, offset))
            offset += length
        self.sequence += 1

    def shard(self, documents: list[tuple]) -> None:
        """Pack documents (doc_id, ids, start) with what is left of the last shard."""
        waiting = self.left + documents
        pool = []
        for doc_id, ids, start in waiting:
            while len(ids) - start >= WINDOW:
                self.emit([(doc_id, ids, start, WINDOW)])
                start += WINDOW
            if start < len(ids):
                pool.append([doc_id, ids, start])
        self.left = []
        if not pool:
            return
        index = InvertedIndex([ids for _, ids, _ in pool], self.idf, self.mean_length)
        unused = np.ones(len(pool), bool)
        rest = sum(len(ids) - start for _, ids, start in pool)
        seed = 0
        while rest >= WINDOW:
            while not unused[seed]:
                seed += 1
            first = seed if self._cut is None else self._cut
            pieces, room, self._cut = [], WINDOW, None
            room = self._take(pool, unused, first, room, pieces)
            if room:
                ranked = np.argsort(np.where(unused, -index.scores(first), np.inf), kind="stable")
                for k in ranked:
                    room = self._take(pool, unused, int(k), room, pieces)
                    if not room:
                        break
            self.emit(pieces)
            rest -= WINDOW
        self._cut = None
        self.left = [tuple(pool[i]) for i in np.flatnonzero(unused)]

    _cut: int | None = None

    def _take(self, pool: list, unused: np.ndarray, k: int, room: int, pieces: list[tuple]) -> int:
        """Put document ``k``, or as much as there is room for, into the window; the room that is left."""
        doc_id, ids, start = pool[k]
        length = min(room, len(ids) - start)
        pieces.append((doc_id, ids, start, length))
        if start + length < len(ids):
            pool[k][2], self._cut = start + length, k
        else:
            unused[k] = False
        return room - length

    def finish(self) -> None:
        """The rest, less than a window, as sequences of powers of two."""
        total = sum(len(ids) - start for _, ids, start in self.left)
        left = [list(x) for x in reversed(self.left)]
        self.left = []
        while total:
            size = 1 << (total.bit_length() - 1)
            pieces, room = [], size
            while room:
                doc_id, ids, start = left[-1]
                length = min(room, len(ids) - start)
                pieces.append((doc_id, ids, start, length))
                left[-1][2] += length
                room -= length
                if left[-1][2] == len(ids):
                    left.pop()
            self.emit(pieces)
            total -= size


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = tokenized(docs, path, id_col, text_col)
    totals = rows.agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")).first()
    n_docs, n_tokens = totals["docs"], totals["tokens"] or 0
    found = document_frequencies(rows)
    idf = np.log1p((n_docs - found + 0.5) / (found + 0.5))
    mean_length = n_tokens / max(1, n_docs)
    shared = rows.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = _Packer(shared.value, mean_length, TaskContext.get().partitionId() << 40)
        shard, tokens = [], 0
        for batch in batches:
            for doc_id, packed in zip(batch["doc_id"], batch["ids"], strict=True):
                ids = np.frombuffer(packed, "<u2")
                shard.append((None if pd.isna(doc_id) else int(doc_id), ids, 0))
                tokens += len(ids)
                if len(shard) >= SHARD_DOCS or tokens >= SHARD_TOKENS:
                    packer.shard(shard)
                    shard, tokens = [], 0
                    yield _frame(packer)
        if shard:
            packer.shard(shard)
        packer.finish()
        yield _frame(packer)

    # a scan of the stored ids, so a lost partition is cut and packed the same way again
    dealt = rows.repartitionByRange("near", "doc_id").sortWithinPartitions("near", "doc_id", "n")
    return dealt.select("doc_id", "ids").mapInPandas(run, PIECE_TYPE)


def _frame(packer: _Packer) -> pd.DataFrame:
    frame = pd.DataFrame(packer.rows, columns=PIECE_NAMES).astype({"doc_id": "Int64"})
    packer.rows = []
    return frame

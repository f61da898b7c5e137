"""Token counts that follow edits, from a segment tree of pre-tokens per document.

A document is cut before white space into leaves of about ``LEAF_CHARS``
characters. No pre-token crosses a leaf border, so a document's count is the sum
of its leaves. A tree in heap order keeps the characters and tokens below every
node. An edit descends by characters to the leaves it touches, takes the
neighbouring leaf as context where the new text no longer starts with white space,
encodes that region only, and updates the sums on the way up. A tree whose
leaves have grown too large or too many is laid out anew without encoding.

Edits of one document are applied in the order of ``seq``, each to the text that
the edits before it left. Positions count code points; a position or length
beyond the text is cut to it, and a negative one is 0.

Defined cases: a null text is empty; a null replacement inserts nothing; a null
position or length is 0; ties of ``seq`` go by position, length, replacement. A
document without edits keeps its counts, edits of unknown documents are ignored.
Rows that repeat a doc_id each get its edits. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.llm.wordbpe import WHITE, chunks, library

LEAF_CHARS = 512
EDIT_TYPE = "array<struct<seq:bigint,start:bigint,length:bigint,replacement:string>>"
TREE_TYPE = "doc_id bigint, segments array<string>, chars array<bigint>, tokens array<bigint>"

_BEFORE_WHITE = regex.compile(f"(?=[{WHITE}])")
_WHITE = regex.compile(f"[{WHITE}]")


def split_leaves(text: str, leaf_chars: int = LEAF_CHARS) -> list[str]:
    """Pieces of at least ``leaf_chars`` characters, cut right before white space."""
    leaves, start = [], 0
    while len(text) - start > leaf_chars:
        found = _BEFORE_WHITE.search(text, start + leaf_chars)
        if not found:
            break
        leaves.append(text[start : found.start()])
        start = found.start()
    return [*leaves, text[start:]]


class SegmentTree:
    """Leaves with their sums of characters and tokens in heap order: node i has children 2i and 2i + 1."""

    def __init__(self, count, segments, chars=None, tokens=None):
        self.count = count  # text -> number of tokens, for text cut at white space
        self.encoded_chars = 0
        if chars is None:
            self._build(list(segments))
        else:
            self.segments, self.chars, self.tokens = list(segments), list(chars), list(tokens)
            self.size = len(self.chars) // 2

    def _count(self, text: str) -> int:
        self.encoded_chars += len(text)
        return self.count(text)

    def _build(self, segments: list[str], counted: list[int] | None = None) -> None:
        self.segments = segments
        self.size = 1 << max(0, len(segments) - 1).bit_length()
        pad = [0] * (self.size - len(segments))
        self.chars = [0] * self.size + [len(s) for s in segments] + pad
        self.tokens = [0] * self.size + (counted or [self._count(s) for s in segments]) + pad
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one for the end), and where it starts."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if at >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def _set(self, leaf: int, text: str) -> None:
        node = leaf + self.size
        self.segments[leaf], self.chars[node], self.tokens[node] = text, len(text), self._count(text) if text else 0
        while node > 1:
            node //= 2
            self._sum(node)

    def edit(self, start: int, length: int, replacement: str) -> None:
        total = self.chars[1]
        start = min(max(start, 0), total)
        end = min(start + max(length, 0), total)
        first, at = self._find(start)
        last, last_at = self._find(end) if end > start else (first, at)
        region = self.segments[first][: start - at] + replacement + self.segments[last][end - last_at :]
        # boundary context: text that now joins the word before it belongs to that leaf
        while first > 0 and not (region and _WHITE.match(region)):
            first -= 1
            region = self.segments[first] + region
        # and the leaf after it must still begin with white space: it does, unless it was never cut there
        pieces = split_leaves(region) if region else [""]
        if len(pieces) <= last - first + 1:
            for k in range(first, last + 1):
                self._set(k, pieces[k - first] if k - first < len(pieces) else "")
            return
        counted = self.tokens[self.size : self.size + len(self.segments)]
        fresh = [self._count(p) for p in pieces]
        self._build(
            self.segments[:first] + pieces + self.segments[last + 1 :],
            counted[:first] + fresh + counted[last + 1 :],
        )

    @property
    def text(self) -> str:
        return "".join(self.segments)


def counter(path: str):
    cache = library(path).cache

    def count(text: str) -> int:
        cache.trim()
        return sum(map(len, map(cache.__getitem__, chunks(text)))) // 4

    return count


def build_trees(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, segments, chars, tokens): the tree of every document; ``tokens[1]`` is its count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(path)
        for batch in batches:
            trees = [SegmentTree(count, split_leaves(x or "")) for x in batch["text"]]
            yield _columns(batch["doc_id"], trees)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, TREE_TYPE)


def _columns(ids: pd.Series, trees: list[SegmentTree]) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "doc_id": ids,
            "segments": [t.segments for t in trees],
            "chars": [t.chars for t in trees],
            "tokens": [t.tokens for t in trees],
        }
    )


def attach_edits(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """``rows`` (doc_id, ...) with an array column ``edits`` from rows (doc_id, seq, start, length, replacement)."""
    step = F.struct(*[F.col(c) for c in ("seq", "start", "length", "replacement")])
    grouped = edits.groupBy(F.col("doc_id").alias("__edited")).agg(
        F.array_sort(F.collect_list(step)).cast(EDIT_TYPE).alias("edits")
    )
    return rows.join(grouped, rows["doc_id"].eqNullSafe(grouped["__edited"]), "left").drop("__edited")


def _number(value) -> int:
    return 0 if value is None or pd.isna(value) else int(value)


def _apply(tree: SegmentTree, edits) -> int:
    n = 0
    for e in edits if edits is not None else ():
        tree.edit(_number(e["start"]), _number(e["length"]), e["replacement"] or "")
        n += 1
    return n


def apply_edits(trees: DataFrame, path: str) -> DataFrame:
    """The trees after their ``edits``; ``encoded_chars`` is the text that had to be encoded for them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(path)
        for batch in batches:
            done = []
            for segments, chars, tokens, edits in batch[["segments", "chars", "tokens", "edits"]].itertuples(index=False):
                tree = SegmentTree(count, segments, chars, tokens)
                _apply(tree, edits)
                done.append(tree)
            yield _columns(batch["doc_id"], done).assign(encoded_chars=[t.encoded_chars for t in done])

    rows = trees.select("doc_id", "segments", "chars", "tokens", F.col("edits").cast(EDIT_TYPE))
    return rows.mapInPandas(run, f"{TREE_TYPE}, encoded_chars bigint")


def count_with_edits(docs: DataFrame, path: str) -> DataFrame:
    """Counts before and after the ``edits`` of each row (doc_id, text, edits), in one pass.

    Returns doc_id, n_edits, n_tokens, n_tokens_edited, n_chars, n_chars_edited, encoded_chars.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(path)
        for batch in batches:
            out = []
            for text, edits in zip(batch["text"], batch["edits"], strict=True):
                tree = SegmentTree(count, split_leaves(text or ""))
                before, tree.encoded_chars = (tree.tokens[1], tree.chars[1]), 0
                n = _apply(tree, edits)
                out.append((n, before[0], tree.tokens[1], before[1], tree.chars[1], tree.encoded_chars))
            names = ["n_edits", "n_tokens", "n_tokens_edited", "n_chars", "n_chars_edited", "encoded_chars"]
            yield pd.concat([batch[["doc_id"]], pd.DataFrame(out, columns=names, index=batch.index)], axis=1)

    rows = docs.select(F.col("doc_id").cast("bigint"), "text", F.col("edits").cast(EDIT_TYPE))
    return rows.mapInPandas(
        run,
        "doc_id bigint, n_edits bigint, n_tokens bigint, n_tokens_edited bigint, n_chars bigint, "
        "n_chars_edited bigint, encoded_chars bigint",
    )

"""How a text falls into chunks whose ids do not depend on each other, for a word-level BPE tokenizer file.

White space separates: no pre-token crosses it and Unicode composition does not
either, so a text's ids are the ids of its white-space-delimited chunks in order.
A bounded cache of chunks per Python worker therefore gives the ids of whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Fixed values of the tokenizer file: white space of its patterns (without the
# separators 1C to 1F that str.split() also takes) and special tokens.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPECIAL = ("<|startoftext|>", "<|endoftext|>")

ID_TYPE = "<u4"
SEPARATORS = re.compile("[\x1c-\x1f]")
CHUNKS = re.compile(f"[^{WHITE}]+")
ANY_SPECIAL = re.compile("(" + "|".join(map(re.escape, SPECIAL)) + ")")
# words of letters that every version of Unicode has, and marks that are one pre-token behind them
PLAIN = r"\A[A-Za-zÀ-ÖØ-öø-ÿ]+\z"
MARKS = ".,;:!?*$%&#|)]}/+=_-"
END_OF_WORD = "</w>"
MAX_CACHED_CHARS = 48
MAX_CACHED = 150_000
GROUP_BYTES = 8_000_000


def chunks(text: str) -> list[str]:
    return CHUNKS.findall(text) if SEPARATORS.search(text) else text.split()


class ChunkCache(dict):
    """chunk -> value of ``encode(chunk)``, in two generations of at most ``MAX_CACHED`` entries (see ``trim``).

    What is in use moves to the young generation, so frequent chunks are never encoded again.
    """

    def __init__(self, encode):
        self.encode, self.old = encode, {}

    def __missing__(self, chunk: str):
        value = self.old.get(chunk)
        if value is None:
            value = self.encode(chunk)
        if len(chunk) <= MAX_CACHED_CHARS:
            self[chunk] = value
        return value

    def trim(self) -> None:
        if len(self) > MAX_CACHED:
            self.old = dict(self)
            self.clear()


class PendingCache(ChunkCache):
    """A cache that hands out empty values for new chunks and fills all of them at once."""

    def __init__(self, encode_many):
        super().__init__(self._later)
        self.encode_many, self.new = encode_many, []

    def _later(self, chunk: str) -> bytearray:
        value = bytearray()
        self.new.append((chunk, value))
        return value

    def all(self, found: pa.Array) -> list[bytearray]:
        """The values of different chunks."""
        values = list(map(self.__getitem__, found.to_pylist()))
        if self.new:
            for (_, value), ids in zip(self.new, self.encode_many([c for c, _ in self.new]), strict=True):
                value += ids
            self.new = []
        self.trim()
        return values


class Library:
    """The tokenizers library on chunks: little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache = ChunkCache(self.encode)
        self.words, self.rest = PendingCache(self._encode_words), PendingCache(self._encode_rest)
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(1 + max(vocab.values()), bool)
        self.ends_word[[i for string, i in vocab.items() if string.endswith(END_OF_WORD)]] = True

    def encode(self, chunk: str) -> bytes:
        return np.asarray(self.tokenizer.encode(chunk, add_special_tokens=False).ids, ID_TYPE).tobytes()

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Words of letters are one pre-token each, so in one text their ids part behind each end-of-word token."""
        (one,) = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ids = np.asarray(one.ids, ID_TYPE)
        cuts = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
        if len(cuts) != len(words):
            return [self.encode(w) for w in words]
        return [ids[a:b].tobytes() for a, b in zip([0, *cuts], cuts)]

    def _encode_rest(self, found: list[str]) -> list[bytes]:
        return [self.encode(c) for c in found]


_LIBRARY: dict[str, Library] = {}


def library(path: str) -> Library:
    """One tokenizer per Python worker."""
    if path not in _LIBRARY:
        _LIBRARY[path] = Library(path)
    return _LIBRARY[path]


def text_ids(cache: ChunkCache, text: str) -> bytes:
    cache.trim()
    return b"".join(map(cache.__getitem__, chunks(text)))


def batch_ids(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts of an Arrow batch in a row, and how many each text has, by the library."""
    return numbered_ids(library(path), texts)


def numbered_ids(known, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same by any encoder ``known`` whose ``words`` and ``rest`` give the ids of different chunks.

    Arrow splits the texts at ASCII white space, makes ASCII letters small (the tokenizer would), parts
    plain words from the marks behind them and numbers what is left, so Python sees each different
    word once. Chunks that are no plain word with marks go to the library whole.
    """
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    raw = split.flatten()
    chunk = pc.ascii_lower(raw)
    word = pc.ascii_rtrim(chunk, characters=MARKS)
    numbered = word.dictionary_encode()
    number = numbered.indices.to_numpy()
    plain = pc.match_substring_regex(numbered.dictionary, PLAIN).to_numpy(zero_copy_only=False)
    place = np.where(plain, plain.cumsum() - 1, -1)[number]
    is_plain = place >= 0
    words = known.words.all(numbered.dictionary.filter(pa.array(plain)))
    rest = raw.filter(pa.array(~is_plain)).dictionary_encode()
    marks = _behind(chunk.filter(pa.array(is_plain)), word.filter(pa.array(is_plain))).dictionary_encode()
    values = words + known.rest.all(rest.dictionary) + known.rest.all(marks.dictionary) + [b""]
    # a plain word takes two values, its own and that of its marks; another chunk takes one and nothing
    order = np.full((len(place), 2), len(values) - 1)
    order[:, 0] = place
    order[~is_plain, 0] = len(words) + rest.indices.to_numpy()
    order[is_plain, 1] = len(words) + len(rest.dictionary) + marks.indices.to_numpy()
    order = order.ravel()
    size = np.fromiter(map(len, values), np.int64, len(values)) // 4
    ids, start = np.frombuffer(b"".join(values), ID_TYPE), size.cumsum() - size
    n = size[order]
    before = np.concatenate(([0], n.cumsum()))
    flat = ids[np.repeat(start[order] - before[:-1], n) + np.arange(before[-1])]
    return flat, np.diff(before[2 * (split.offsets.to_numpy() - split.offsets[0].as_py())])


def _behind(chunk: pa.Array, word: pa.Array) -> pa.Array:
    """What each chunk has behind the word that it begins with."""
    length = pc.binary_length(chunk).to_numpy().astype(np.int64)
    behind = length - pc.binary_length(word).to_numpy()
    data = np.frombuffer(b"".join(x for x in [chunk.buffers()[2]] if x is not None), np.uint8)
    end = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset + 1 : chunk.offset + 1 + len(chunk)]
    stop = behind.cumsum()
    taken = data[np.repeat(end - stop, behind) + np.arange(stop[-1] if len(stop) else 0)]
    offsets = np.concatenate(([0], stop)).astype(np.int32)
    return pa.StringArray.from_buffers(len(chunk), pa.py_buffer(offsets.tobytes()), pa.py_buffer(taken.tobytes()))


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``GROUP_BYTES`` of text, or of one longer text."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first = total = 0
    for i, n in enumerate(size.tolist()):
        if i > first and total + n > GROUP_BYTES:
            yield first, i
            first, total = i, 0
        total += n
    if len(size):
        yield first, len(size)

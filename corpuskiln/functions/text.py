"""Per-file text features as built-in column expressions.

The classes below spell out the Unicode line breaks and white space, since
the regex shorthands of the JVM cover ASCII only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line breaks and white space.
BREAK_CLASS = r"\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029"
LINE_BREAK = rf"\r\n|[{BREAK_CLASS}]"
SPACE_CLASS = r"\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
SPACE_CHARS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)])
) + "\u2028\u2029\u202f\u205f\u3000"

# The pieces a subword tokenizer starts from.
PRE_TOKEN = (
    r"'(?:s|t|re|ve|m|ll|d)"
    r"| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE_CLASS}\p{{L}}\p{{N}}]+"
    rf"|[{SPACE_CLASS}]+"
)
WORD = "[A-Za-z_0-9]+"
WORD_BREAK = "[^A-Za-z_0-9]+"

# Keyword lists of the file heuristics.
GENERATED_KEYWORDS = ("auto-generated", "autogenerated", "automatically generated")
CONFIG_OR_TEST_KEYWORDS = ("unit tests", "test file", "configuration file")
CODE_KEYWORDS = ("def ", "class ", "for ", "while ")


def strip_spaces(text: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def content_hash(text: Column) -> Column:
    """md5 of the text without any white space."""
    return F.md5(F.translate(text, SPACE_CHARS, ""))


def split_breaks(text: Column) -> Column:
    """Pieces between line breaks; a final break leaves an empty last piece."""
    return F.split(text, LINE_BREAK, -1)


def line_total(pieces: Column) -> Column:
    """Number of lines, given the pieces between line breaks."""
    return F.size(pieces) - (F.element_at(pieces, -1) == "").cast("int")


def lines(text: Column) -> Column:
    """The lines of a text; neither a final break nor an empty text adds one."""
    pieces = split_breaks(text)
    return F.slice(pieces, F.lit(1), line_total(pieces))


def piece_lengths(pieces: Column) -> Column:
    return F.transform(pieces, lambda piece: F.length(piece))


def mean_length(pieces: Column) -> Column:
    total = F.length(F.array_join(pieces, ""))
    return F.try_divide(total.cast("double"), line_total(pieces).cast("double"))


def max_length(pieces: Column) -> Column:
    return F.when(line_total(pieces) > 0, F.array_max(piece_lengths(pieces)))


def line_mean(text: Column) -> Column:
    return mean_length(split_breaks(text))


def line_max(text: Column) -> Column:
    return max_length(split_breaks(text))


def alpha_frac(text: Column) -> Column:
    """Share of characters that are letters or numbers; NULL for an empty text."""
    kept = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))
    return F.try_divide(kept.cast("double"), F.length(text).cast("double"))


def pre_token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(PRE_TOKEN))


def pre_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PRE_TOKEN), F.lit(0))


def char_token_ratio(text: Column, token_count: Column | None = None) -> Column:
    """Characters per token; ``token_count`` takes the count of another tokenizer."""
    tokens = pre_token_count(text) if token_count is None else token_count
    return F.try_divide(F.length(text).cast("double"), tokens.cast("double"))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def count_of(text: Column, word: str) -> Column:
    """Occurrences of ``word`` that do not overlap."""
    return F.regexp_count(text, F.lit(rf"\Q{word}\E"))


def head_of(pieces: Column, scan_width: int) -> Column:
    return F.lower(F.array_join(F.slice(pieces, 1, scan_width), "\n"))


def generated_head(head: Column) -> Column:
    return contains_any(head, GENERATED_KEYWORDS)


def config_or_test(head: Column, lowered: Column, coeff: float) -> Column:
    """Keyword in the head, or 'config'/'test' more often than ``coeff`` per newline."""
    allowed = F.floor(F.lit(float(coeff)) * count_of(lowered, "\n"))
    frequent = (count_of(lowered, "config") > allowed) | (count_of(lowered, "test") > allowed)
    return contains_any(head, CONFIG_OR_TEST_KEYWORDS) | frequent


def is_autogenerated(text: Column, scan_width: int = 5) -> Column:
    return generated_head(head_of(split_breaks(text), scan_width))


def is_config_or_test(text: Column, scan_width: int = 5, coeff: float = 0.05) -> Column:
    return config_or_test(head_of(split_breaks(text), scan_width), F.lower(text), coeff)


def has_no_keywords(text: Column) -> Column:
    return ~contains_any(F.lower(text), CODE_KEYWORDS)


def has_few_assignments(text: Column, minimum: int = 4) -> Column:
    return count_of(text, "=") <= minimum


def word_tokens(text: Column) -> Column:
    """Words in text order, duplicates kept."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(word_tokens(text))


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard similarity of two token sets (arrays without duplicates); NULL if both are empty.

    |union| follows from the sizes, so only the intersection is built.
    """
    common = F.size(F.array_intersect(left, right))
    return F.try_divide(
        common.cast("double"), (F.size(left) + F.size(right) - common).cast("double")
    )

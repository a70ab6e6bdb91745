"""Tokens and projections of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is a run of letters and digits of the text in lower case.
TOKEN = r"([\p{L}\p{N}]+)"
#: English function words that an analyzer may leave out.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")


def tokens(text: Column) -> Column:
    """Array of tokens; empty for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1)), F.array().cast("array<string>"))


def without_stop_words(words: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    return F.filter(words, lambda w: ~w.isin(*stop))


def without_special(words: Column, special: tuple[str, ...], mask: Column | None = None) -> Column:
    """Tokens that are not special, and where a mask is given (an array of 0 and 1 beside the tokens), not masked; the order stays."""
    kept = words if mask is None else F.filter(words, lambda w, i: F.get(mask, i) != 0)
    return F.filter(kept, lambda w: ~w.isin(*special)) if special else kept


def truncated(words: Column, most: int) -> Column:
    return F.slice(words, 1, most)


def joined_text(title: Column, text: Column, separator: str = " ", strip: bool = False) -> Column:
    """title + separator + text; the text alone where there is no title."""
    whole = F.when(F.coalesce(title, F.lit("")) == "", F.coalesce(text, F.lit(""))).otherwise(F.concat(title, F.lit(separator), F.coalesce(text, F.lit(""))))
    return F.trim(whole) if strip else whole

"""Cleaning and quality rules for generated answers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerloom.functions.text import WS, lexical_words, safe_text, trimmed

# Leading texts to drop, in order. (?d) keeps "." from stopping at
# any line end but \n; (?iu) ignores case for all letters.
LEADING_JUNK = (
    rf"(?iu)^Answer{WS}*:{WS}*",
    rf"(?iu)^A\.{WS}*",
    rf"(?iu)^Q\.{WS}*",
    r"^[.?\-:;,!\t-\r\x{1c}-\x{20}\x{85}\p{Z}]+",
    rf"(?iud)^\(Note:.*?\){WS}*",
    rf"(?d)^\[.*?\]{WS}*",
)

# Fixed values of the output rules.
MIN_TOKENS = 10
TOKEN_LIMIT = 256
PUNCTUATION_ONLY = ("!", "!!", ".", "..", "?", "??", "-", "--")
BAD_STARTS = (
    "answer:",
    "question:",
    "note:",
    "here are the details",
    "let me know when you're ready",
    "in my response",
)
BAD_PHRASES = (
    "## step",
    "step 1",
    "let me explain",
    "here is",
    "here's",
    "doctor:",
    "dr.",
    "dear ",
    "i'm concerned",
    "i'll ",
    "i will ",
    "my family",
    "i might",
    "i would",
)


def clean_output(c: Column) -> Column:
    """Drop leading labels, punctuation, notes and brackets of a generated answer."""
    return trimmed(reduce(lambda text, junk: F.regexp_replace(text, junk, ""), LEADING_JUNK, safe_text(c)))


def _holds(text: Column, rules: Callable[[Column], list[Column]]) -> Column:
    """Whether any rule holds for a text; the text is worked out once for all of them."""
    return F.exists(F.array(text), lambda t: reduce(lambda a, b: a | b, rules(t)))


def _basic_rules(t: Column) -> list[Column]:
    return [t == "", t.isin(*PUNCTUATION_ONLY)] + [t.startswith(start) for start in BAD_STARTS]


def _strict_rules(t: Column) -> list[Column]:
    return _basic_rules(t) + [t.contains(phrase) for phrase in BAD_PHRASES]


def is_bad_basic(answer: Column, token_count: Column) -> Column:
    """Too short, blank, only punctuation, or opening with a giveaway."""
    return (token_count < MIN_TOKENS) | _holds(F.lower(safe_text(answer)), _basic_rules)


def is_bad_strict(answer: Column, token_count: Column) -> Column:
    """The basic rules, or any phrase that marks an assistant or a made-up person."""
    return (token_count < MIN_TOKENS) | _holds(F.lower(safe_text(answer)), _strict_rules)


def hit_limit(token_count: Column, max_new_tokens=TOKEN_LIMIT) -> Column:
    return token_count >= max_new_tokens


def distinct_words(c: Column) -> Column:
    return F.array_distinct(lexical_words(F.lower(c)))


def overlap_of_words(generated_words: Column, reference_words: Column) -> Column:
    """Share of distinct generated words that the reference also has; 0 if either is empty."""
    shared = F.size(F.array_intersect(generated_words, reference_words))
    either_empty = (F.size(generated_words) == 0) | (F.size(reference_words) == 0)
    share = F.try_divide(shared.cast("double"), F.size(generated_words).cast("double"))
    return F.when(either_empty, F.lit(0.0)).otherwise(share)

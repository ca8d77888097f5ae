"""Text cleaning, counting, windowing and truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerloom.functions.seeding import draw

# The 29 code points that count as whitespace (the Python str.strip set).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a character class, for Java and RE2 alike.
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
NOT_WS = r"[^\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]+"

_NO_TEXTS = "array<string>"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def safe_text(c: Column) -> Column:
    """Null becomes empty, anything else its text without outer whitespace."""
    return trimmed(F.coalesce(c.cast("string"), F.lit("")))


def or_default(c: Column, default: str) -> Column:
    """Cleaned text, or the default where it is blank."""
    text = safe_text(c)
    return F.when(text == "", F.lit(default)).otherwise(text)


def no_texts() -> Column:
    return F.array().cast(_NO_TEXTS)


def text_list(c: Column, is_list: bool) -> Column:
    """Cleaned non-blank texts of a list column, or of a plain text column as a list."""
    texts = F.coalesce(c.cast(_NO_TEXTS), no_texts()) if is_list else F.array(c.cast("string"))
    return F.filter(F.transform(texts, safe_text), lambda t: t != "")


def pick(texts: Column, seed: int, split: Column, row_id: Column, salt) -> Column:
    """Seeded choice from a cleaned list: struct ``(text, pick_index)``, ``("", null)`` if empty."""
    index = draw(F.size(texts), seed, split, row_id, salt).cast("int")
    return F.struct(
        F.coalesce(F.get(texts, index), F.lit("")).alias("text"),
        F.when(F.size(texts) > 0, index).alias("pick_index"),
    )


def split_words(text: Column) -> Column:
    """Whitespace-separated words of a trimmed text."""
    return F.when(text == "", no_texts()).otherwise(F.split(text, WS + "+"))


def count_words(c: Column) -> Column:
    return F.size(split_words(safe_text(c)))


def lexical_words(c: Column) -> Column:
    """Runs of letters, numbers and underscores."""
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def count_lexical_words(c: Column) -> Column:
    return F.size(lexical_words(c))


def window_span(
    word_count: Column, window_words: int | None, seed: int, split: Column, row_id: Column, source_key
) -> Column:
    """Seeded span ``(start, stop)`` of ``window_words`` words; the full text where it fits."""
    if window_words is None:
        return F.struct(F.lit(0).alias("start"), word_count.alias("stop"))
    if window_words <= 0:
        raise ValueError("window_words must be positive when set.")
    start = draw(
        word_count - window_words + 1, seed, split, row_id, source_key, "answer_window", window_words
    ).cast("int")
    longer = word_count > window_words
    return F.struct(
        F.when(longer, start).otherwise(0).alias("start"),
        F.when(longer, start + window_words).otherwise(word_count).alias("stop"),
    )


def windowed_text(text: Column, words: Column, start: Column, stop: Column) -> Column:
    """The words of the span joined by one space, or the text itself for a full span."""
    whole = (stop - start) >= F.size(words)
    return F.when(whole, text).otherwise(F.array_join(F.slice(words, start + 1, stop - start), " "))


def model_text(question: Column, answer: Column, text_mode: str = "answer") -> Column:
    """Text given to a classifier: the answer, or the question and answer layout."""
    if text_mode == "answer":
        return answer
    if text_mode != "question_answer":
        raise ValueError("text_mode must be 'answer' or 'question_answer'.")
    both = F.concat(F.lit("Question: "), question, F.lit("\n\nAnswer: "), answer)
    return F.when(question == "", answer).otherwise(both)


# Default target length, the range a target is clamped to, the
# shares of the target that give the bounds, and the limits of the bounds.
DEFAULT_TARGET_WORDS = 55
TARGET_RANGE = (12, 95)
BOUND_SHARES = (0.75, 1.25)
LOWEST_MIN_WORDS = 8
LOWEST_MAX_WORDS = 14
HIGHEST_MAX_WORDS = 110


def word_bounds(*reference_counts: Column) -> Column:
    """Length target and bounds from the first reference that has any words."""
    present = [F.when(n > 0, n) for n in reference_counts]
    base = F.coalesce(*present, F.lit(DEFAULT_TARGET_WORDS))
    target = F.least(F.lit(TARGET_RANGE[1]), F.greatest(F.lit(TARGET_RANGE[0]), base))
    low, high = (F.bround(target * share, 0).cast("int") for share in BOUND_SHARES)
    return F.struct(
        target.cast("int").alias("target_word_count"),
        F.greatest(F.lit(LOWEST_MIN_WORDS), low).alias("target_min_words"),
        F.least(F.lit(HIGHEST_MAX_WORDS), F.greatest(F.lit(LOWEST_MAX_WORDS), high)).alias("target_max_words"),
    )


def truncate(c: Column, max_chars: int | None) -> Column:
    """Cleaned text of at most ``max_chars`` characters, cut texts ending in ``...``."""
    text = safe_text(c)
    if max_chars is None or max_chars <= 0:
        return text
    if max_chars < 3:
        # A slice bound below zero counts from the end of the text.
        head = F.substring(text, F.lit(1), F.greatest(F.length(text) + (max_chars - 3), F.lit(0)))
    else:
        head = F.substring(text, 1, max_chars - 3)
    cut = F.concat(F.rtrim(head, F.lit(WHITESPACE)), F.lit("..."))
    return F.when(F.length(text) > max_chars, cut).otherwise(text)


def hard_cut(c: Column, max_chars: int) -> Column:
    return F.substring(safe_text(c), 1, max_chars)


def preview(c: Column, max_chars: int = 500) -> Column:
    """The text, or its first characters followed by ``...``."""
    return F.when(F.length(c) <= max_chars, c).otherwise(F.concat(F.substring(c, 1, max_chars), F.lit("...")))


def indent_lines(c: Column, by: str = "  ") -> Column:
    """Indent every line after the first."""
    return F.replace(c, F.lit("\n"), F.lit("\n" + by))


def head_answers(texts: Column, max_answers: int) -> Column:
    return F.slice(texts, 1, max_answers)


def omitted_answers(texts: Column, max_answers: int) -> Column:
    return F.greatest(F.size(texts) - max_answers, F.lit(0))

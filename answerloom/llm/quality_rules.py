"""Quality rules: counts of a text, and how far its histograms lie from those of its language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.session import stage

#: Frequent words of the languages that have a reference.
COMMON_WORDS = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "des", "sich", "auf", "für", "ist", "im", "nicht"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "no", "con", "una", "para"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "au"),
}
#: Classes of characters, as patterns of what belongs to each; all other characters are a class too.
CHAR_CLASSES = ("[a-z]", "[A-Z]", "[0-9]", "[ \t-\r]", "[.,;:'\"?()-]", "[#*$%&|<>!]")
SYMBOLS, SYMBOL_CLASS = "[#*$%&|<>]", CHAR_CLASSES[5]
SPACES = "[\x20\x09-\x0d]"
#: Words and share of repeated words of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Jensen-Shannon distances from which a text is too far off. The histogram of n draws strays from its own source by
#: about 1 / sqrt(n), so each limit is widened by a multiple of that. And the sizes from which a text is judged.
MAX_CHAR_DISTANCE, CHAR_SPREAD, MIN_CHARS = 0.20, 2.2, 200
MAX_WORD_DISTANCE, WORD_SPREAD, MIN_JUDGED_WORDS = 0.12, 2.0, 50


def text_words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES + "+"), "")


#: Order in which the classes are taken out of a text: the most common ones first, so that little is left for the others.
_TAKEN = (0, 3, 1, 4, 2, 5)


def with_char_classes(df: DataFrame, text: str) -> DataFrame:
    """Adds chars (characters of each class) and n_symbols, taking one class after the other out of the text."""
    left = F.col(text)
    for i in _TAKEN:
        if CHAR_CLASSES[i] == SYMBOL_CLASS:
            df = df.withColumn("__quiet", F.regexp_replace(left, SYMBOLS + "+", ""))
        df = df.withColumn(f"__left{i}", F.regexp_replace(left, CHAR_CLASSES[i] + "+", ""))
        df = df.withColumn(f"__n{i}", (F.length(left) - F.length(f"__left{i}")).cast("long"))
        if CHAR_CLASSES[i] == SYMBOL_CLASS:
            df = df.withColumn("n_symbols", (F.length(left) - F.length("__quiet")).cast("long"))
        left = F.col(f"__left{i}")
    own = [f"__n{i}" for i in range(len(CHAR_CLASSES))]
    return df.withColumn("chars", F.array(*own)).drop("__quiet", *own, *[f"__left{i}" for i in _TAKEN])


def vocabulary(common: dict[str, tuple[str, ...]]) -> list[str]:
    return sorted({w for words in common.values() for w in words})


def repeated_words(df: DataFrame, words: str) -> DataFrame:
    """Adds n_repeat_words: words of `words` inside 3-word windows that occur twice or more in the array.

    Windows are sorted by a digest that carries the position in its low bits; those with an equal neighbour are
    compared as text, so the count is exact. Arrays stay in their row and cost n log n.
    """
    n = F.size(words)
    bits = F.greatest(F.ceil(F.log2(n + 1.0)).cast("int"), F.lit(1))
    firsts = F.slice(words, 1, F.greatest(n - 2, F.lit(0)))

    def digest(w: Column, i: Column) -> Column:
        mixed = F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
        return F.call_function("shiftleft", mixed, F.col("__bits")).bitwiseOR(i.cast("long"))

    high = lambda x: F.call_function("shiftright", x, F.col("__bits"))
    position = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__bits")) - 1).cast("int")
    df = df.withColumn("__bits", bits)
    df = df.withColumn("__sorted", F.sort_array(F.transform(firsts, digest)))
    df = df.withColumn(
        "__near",
        F.filter(
            "__sorted",
            lambda x, i: F.coalesce(high(F.get("__sorted", i - 1)) == high(x), F.lit(False))
            | F.coalesce(high(F.get("__sorted", i + 1)) == high(x), F.lit(False)),
        ),
    ).drop("__sorted")
    window = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    df = df.withColumn(
        "__near", F.array_sort(F.transform("__near", lambda x: F.struct(window(position(x)).alias("s"), position(x).alias("i"))))
    )
    df = df.withColumn(
        "__twice",
        F.sort_array(
            F.transform(
                F.filter(
                    "__near",
                    lambda x, j: F.coalesce(F.get("__near", j - 1).s == x.s, F.lit(False))
                    | F.coalesce(F.get("__near", j + 1).s == x.s, F.lit(False)),
                ),
                lambda x: x.i,
            )
        ),
    )
    gaps = F.transform("__twice", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("__twice", j + 1) - p, F.lit(3))))
    counted = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", counted).drop("__bits", "__near", "__twice")


def text_features(
    docs: DataFrame,
    common: dict[str, tuple[str, ...]] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """Counts and histograms of each text: id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    chars (per class of characters, others last), common (per frequent word, others last)."""
    frequent = vocabulary(COMMON_WORDS if common is None else common)
    df = docs.select(
        F.col(id_col).alias("id"),
        F.col(lang_col).cast("string").alias("lang"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    df = df.withColumn("words", text_words(F.col("text")))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\x20\x09-\x0d]")))
    df = df.withColumn("hits", F.array_join(F.transform(F.filter(F.transform("words", F.lower), lambda w: w.isin(frequent)), lambda w: F.concat(F.lit("\x01"), w, F.lit("\x02"))), ""))
    found = [
        ((F.length("hits") - F.length(F.replace("hits", F.lit(f"\x01{w}\x02"), F.lit("")))) / (len(w) + 2)).cast("long")
        for w in frequent
    ]
    df = repeated_words(with_char_classes(df, "text"), "words").select(
        *("id", "lang", "n_repeat_words", "n_symbols", "chars"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length("text").cast("long").alias("n_chars"),
        F.array(*found).alias("common"),
    )
    rest = lambda a, total: F.concat(a, F.array(total - F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)))
    return df.withColumn("chars", rest(F.col("chars"), F.col("n_chars"))).withColumn("common", rest(F.col("common"), F.col("n_words")))


def language_references(features: DataFrame, bins: dict[str, int]) -> DataFrame:
    """Histograms of all texts of a language: lang, and shares for each of the columns of `bins` (name, size)."""
    sums = [F.sum(F.get(name, F.lit(i))).cast("double").alias(f"{name}_{i}") for name, n in bins.items() for i in range(n)]
    total = features.groupBy("lang").agg(*sums)
    each = {name: F.array(*[F.col(f"{name}_{i}") for i in range(n)]) for name, n in bins.items()}
    total = total.select("lang", *[a.alias(name) for name, a in each.items()])
    shares = lambda a: F.transform(a, lambda c: c / F.greatest(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.lit(1.0)))
    return total.select(F.col("lang").alias("ref_lang"), *[shares(F.col(name)).alias(f"ref_{name}") for name in bins])


def jensen_shannon(counts: Column, reference: Column) -> Column:
    """Distance in [0, 1] between a histogram of counts and a distribution: the root of the divergence in bits."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x).cast("double")

    def term(q: Column, r: Column) -> Column:
        middle = (q + r) / 2
        part = lambda x: F.when(x > 0, x * F.log2(x / middle)).otherwise(0.0)
        return (part(q) + part(r)) / 2

    terms = F.zip_with(counts, reference, lambda c, r: term(c / total, r))
    divergence = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.sqrt(F.greatest(divergence, F.lit(0.0)))).otherwise(0.0)


def quality_verdicts(
    docs: DataFrame,
    common: dict[str, tuple[str, ...]] | None = None,
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """Counts, distances and verdict of each text: id, lang, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, char_distance, word_distance, base_failed, kept.

    The reference of a language is the histogram of all texts of that language, so it follows the corpus. A text is
    too far off if the Jensen-Shannon distance of its character classes passes `max_char_distance`, judged from 200
    characters on, or that of its frequent words passes `max_word_distance`, judged from 50 words on, each limit
    widened by a multiple of 1 / sqrt(n) for the noise of a short text. The base rules fail texts of under 50 words or with over half of the words repeated.

    Nulls: a null text is empty and fails the base rules; null languages are a language; null ids stay. Empty texts
    have distance 0. Repeated rows give equal rows. Extra columns are ignored. Texts are read whole, in their row. An
    empty table gives an empty result. The features are written once to the shared folder and read twice.
    """
    frequent = vocabulary(COMMON_WORDS if common is None else common)
    features = stage(text_features(docs, common, id_col, text_col, lang_col))
    references = language_references(features, {"chars": len(CHAR_CLASSES) + 1, "common": len(frequent) + 1})
    judged = features.join(stage(references), F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    base_failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    too_far = lambda distance, limit, spread, n: F.col(distance) > limit + spread / F.sqrt(n)
    far = (too_far("char_distance", max_char_distance, CHAR_SPREAD, "n_chars") & (F.col("n_chars") >= MIN_CHARS)) | (
        too_far("word_distance", max_word_distance, WORD_SPREAD, "n_words") & (F.col("n_words") >= MIN_JUDGED_WORDS)
    )
    return (
        judged.withColumn("char_distance", jensen_shannon(F.col("chars"), F.col("ref_chars")))
        .withColumn("word_distance", jensen_shannon(F.col("common"), F.col("ref_common")))
        .select(
            *("id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
            *("char_distance", "word_distance"),
            base_failed.alias("base_failed"),
            (~base_failed & ~far).alias("kept"),
        )
    )

"""Wide rows to labelled examples: one human and one AI example per row and AI column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.columns import AI, CORPUS, HUMAN, LABEL_NAMES, Corpus
from answerloom.functions.seeding import draw
from answerloom.functions.text import (
    model_text,
    or_default,
    safe_text,
    split_words,
    window_span,
    windowed_text,
)
from answerloom.operators.corpus import texts_of, with_human_answer

EXAMPLE_COLUMNS = (
    "example_id",
    "row_id",
    "split",
    "ai_column",
    "origin_split",
    "origin_index",
    "question",
    "answer",
    "full_answer",
    "answer_window_start",
    "answer_window_end",
    "answer_original_word_count",
    "text",
    "source",
    "author_type",
    "answer_source_column",
    "label",
)


def answers_long(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per input row and answer column: ``answer_column`` and its cleaned ``answers``."""
    entries = [F.struct(F.lit(c).alias("answer_column"), texts_of(df, c).alias("answers")) for c in columns]
    return df.select(*keep, F.inline(F.array(*entries)))


def _prepared(df: DataFrame, ai_columns: Sequence[str], seed: int, names: Corpus) -> DataFrame:
    """Row and AI column pairs with the answers chosen, complete or not."""
    has = set(df.columns)
    rows = with_human_answer(df, seed, "_human", names).select(
        F.col(names.row_id).alias("row_id"),
        F.col(names.split).alias("split"),
        safe_text(F.col(names.origin_split) if names.origin_split in has else F.lit("")).alias("origin_split"),
        (F.col(names.origin_index) if names.origin_index in has else F.lit(None)).cast("long").alias("origin_index"),
        safe_text(F.col(names.question)).alias("question"),
        or_default(F.col(names.source) if names.source in has else F.lit(""), "unknown").alias("source"),
        F.col("_human").alias("human_answer"),
        *ai_columns,
    )
    keep = ["row_id", "split", "origin_split", "origin_index", "question", "source", "human_answer"]
    index = draw(F.size("answers"), seed, F.col("split"), F.col("row_id"), F.col("answer_column")).cast("int")
    return answers_long(rows, ai_columns, keep).select(
        *keep,
        F.col("answer_column").alias("ai_column"),
        F.coalesce(F.get("answers", index), F.lit("")).alias("ai_answer"),
    )


def _complete() -> Column:
    return (F.col("question") != "") & (F.col("human_answer") != "") & (F.col("ai_answer") != "")


def flatten_counts(df: DataFrame, ai_columns: Sequence[str], seed: int, names: Corpus = CORPUS) -> DataFrame:
    """Rows that give examples and rows skipped for a blank part, per split and AI column."""
    counts = (
        _prepared(df, ai_columns, seed, names)
        .groupBy("split", "ai_column")
        .agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(_complete()).alias("kept_rows"))
    )
    return counts.withColumn("skipped_rows", F.col("total_rows") - F.col("kept_rows"))


def flatten(
    df: DataFrame,
    ai_columns: Sequence[str],
    seed: int,
    text_mode: str = "answer",
    window_words: int | None = None,
    names: Corpus = CORPUS,
) -> DataFrame:
    """Labelled examples of all AI columns in one pass over the corpus, without a shuffle.

    The human window is keyed by the human column, so it is the same text for every AI column.
    """
    pairs = _prepared(df, ai_columns, seed, names).where(_complete())

    def author(label: int, source_column: Column, answer: str) -> Column:
        return F.struct(
            F.lit(LABEL_NAMES[label]).alias("author_type"),
            F.lit(label).alias("label"),
            source_column.alias("answer_source_column"),
            F.col(answer).alias("full_answer"),
        )

    shared = ["row_id", "split", "ai_column", "origin_split", "origin_index", "question", "source"]
    authors = F.array(
        author(HUMAN, F.lit(names.selected_human), "human_answer"), author(AI, F.col("ai_column"), "ai_answer")
    )
    examples = pairs.select(*shared, F.inline(authors)).withColumn("_words", split_words(F.col("full_answer")))
    span = window_span(
        F.size("_words"), window_words, seed, F.col("split"), F.col("row_id"), F.col("answer_source_column")
    )
    return (
        examples.withColumn("_span", span)
        .withColumn(
            "answer",
            F.col("full_answer")
            if window_words is None
            else windowed_text(F.col("full_answer"), F.col("_words"), F.col("_span.start"), F.col("_span.stop")),
        )
        .withColumns(
            {
                "example_id": F.concat_ws("-", "split", "row_id", "answer_source_column", "author_type"),
                "answer_window_start": F.col("_span.start"),
                "answer_window_end": F.col("_span.stop"),
                "answer_original_word_count": F.size("_words"),
                "text": model_text(F.col("question"), F.col("answer"), text_mode),
            }
        )
        .select(*EXAMPLE_COLUMNS)
    )


def paired(
    df: DataFrame,
    ai_columns: Sequence[str],
    seed: int,
    fields: Sequence[str] = ("answer", "text"),
    text_mode: str = "answer",
    window_words: int | None = None,
    names: Corpus = CORPUS,
) -> DataFrame:
    """Human and AI example of each complete row side by side, as ``pair_examples`` gives them, without a shuffle.

    Both answers stand in one row before they are flattened, so each is cut to its window in place.
    """
    pairs = _prepared(df, ai_columns, seed, names).where(_complete())
    shown = []
    for label, column, full in (
        (HUMAN, F.lit(names.selected_human), "human_answer"),
        (AI, F.col("ai_column"), "ai_answer"),
    ):
        who = LABEL_NAMES[label]
        words, span, cut = f"_{who}_words", f"_{who}_span", f"_{who}_cut"
        pairs = pairs.withColumn(words, split_words(F.col(full)))
        key = (F.col("split"), F.col("row_id"), column)
        pairs = pairs.withColumn(span, window_span(F.size(words), window_words, seed, *key))
        whole = F.col(full)
        answer = (
            whole
            if window_words is None
            else windowed_text(whole, F.col(words), F.col(f"{span}.start"), F.col(f"{span}.stop"))
        )
        pairs = pairs.withColumn(cut, answer)
        made = {
            "example_id": F.concat_ws("-", "split", "row_id", column, F.lit(who)),
            "answer": F.col(cut),
            "full_answer": whole,
            "text": model_text(F.col("question"), F.col(cut), text_mode),
        }
        shown += [made[f].alias(f"{who}_{f}") for f in ("example_id", *fields)]
    return pairs.select("split", "ai_column", "row_id", "source", *shown)


def require_examples(examples: DataFrame, ai_columns: Sequence[str], splits: Sequence[str]) -> DataFrame:
    """Fail where a split and AI column give no example at all."""
    found = {(r["split"], r["ai_column"]) for r in examples.select("split", "ai_column").distinct().collect()}
    for column in ai_columns:
        for split in splits:
            if (split, column) not in found:
                raise ValueError(f"No usable classification examples for split={split} column={column}")
    return examples


def pair_examples(examples: DataFrame, fields: Sequence[str] = ("answer", "text")) -> DataFrame:
    """Human and AI example of a row side by side; rows with only one of them drop out.

    For subsampled examples; ``paired`` gives the pairs of a whole corpus without a shuffle.
    """

    def side(label: int) -> Column:
        example = F.struct("example_id", *fields)
        return F.max(F.when(F.col("label") == label, example)).alias(LABEL_NAMES[label])

    paired = examples.groupBy("split", "ai_column", "row_id").agg(
        F.max("source").alias("source"), side(HUMAN), side(AI)
    )
    return paired.where(F.col("human").isNotNull() & F.col("ai").isNotNull()).select(
        "split",
        "ai_column",
        "row_id",
        "source",
        *[F.col(f"{who}.{f}").alias(f"{who}_{f}") for who in ("human", "ai") for f in ("example_id", *fields)],
    )

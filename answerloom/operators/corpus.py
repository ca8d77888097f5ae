"""Splits, required columns, usable rows, lineage, frozen human answers, column discovery."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerloom.columns import CORPUS, Corpus
from answerloom.functions.text import pick, safe_text, text_list


def normalize(df: DataFrame, names: Corpus = CORPUS) -> DataFrame:
    """A table without splits becomes the single split ``train``."""
    return df if names.split in df.columns else df.withColumn(names.split, F.lit("train"))


def available_splits(df: DataFrame, names: Corpus = CORPUS) -> list[str]:
    """The few split names, by one pass over the split column (a partition column holds no bytes of the files)."""
    return sorted(row[0] for row in df.select(names.split).distinct().collect())


def resolve_splits(df: DataFrame, requested: Sequence[str] | None = None, names: Corpus = CORPUS) -> DataFrame:
    """Rows of the requested splits, all by default; an unknown split is an error."""
    if not requested:
        return df
    available = available_splits(df, names)
    missing = sorted(set(requested) - set(available))
    if missing:
        raise ValueError(f"No rows in split {', '.join(missing)}; the corpus has {', '.join(available)}.")
    return df.where(F.col(names.split).isin(list(requested)))


def default_split(splits: Sequence[str]) -> str:
    """The split reports use when none is named."""
    for preferred in ("eval", "validation", "train"):
        if preferred in splits:
            return preferred
    return splits[0]


def choose_split(df: DataFrame, requested: str | None = None, names: Corpus = CORPUS) -> str:
    splits = available_splits(df, names)
    if requested is None:
        return default_split(splits)
    if requested not in splits:
        raise ValueError(f"Split '{requested}' not found. Available splits: {', '.join(splits)}")
    return requested


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    return df


def require_answer_columns(df: DataFrame, names: Corpus = CORPUS) -> DataFrame:
    """A question, and a frozen human answer or the list of human answers."""
    missing = {names.question} - set(df.columns)
    if names.selected_human not in df.columns and names.human_answers not in df.columns:
        missing.add(f"{names.selected_human} or {names.human_answers}")
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(sorted(missing))}")
    return df


def union_splits(tables: dict[str, DataFrame], names: Corpus = CORPUS) -> DataFrame:
    """Stack tables of one schema, tagging each with its split name."""
    if not tables:
        raise ValueError("No source splits were selected.")
    tagged = [df.withColumn(names.split, F.lit(split)) for split, df in tables.items()]
    result = tagged[0]
    for df in tagged[1:]:
        result = result.unionByName(df)
    return result


def drop_if_present(df: DataFrame, columns: Iterable[str | None]) -> DataFrame:
    return df.drop(*[c for c in columns if c])


def is_list(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.ArrayType)


def texts_of(df: DataFrame, column: str) -> Column:
    """Cleaned texts of a column; its type, text or list, is read from the schema once."""
    return text_list(F.col(column), is_list(df, column))


def usable(df: DataFrame, names: Corpus = CORPUS) -> Column:
    """A question that is not blank and at least one human answer that is not blank."""
    answers = F.col(names.human_answers)
    if is_list(df, names.human_answers):
        # Stops at the first answer that has text.
        answered = F.coalesce(F.exists(answers, lambda a: safe_text(a) != ""), F.lit(False))
    else:
        answered = safe_text(answers) != ""
    return (safe_text(F.col(names.question)) != "") & answered


def usable_rows(df: DataFrame, names: Corpus = CORPUS) -> DataFrame:
    require_columns(df, [names.question, names.human_answers])
    return df.where(usable(df, names))


def row_counts(df: DataFrame, names: Corpus = CORPUS) -> DataFrame:
    """Rows, usable rows and skipped rows per split."""
    counts = df.groupBy(names.split).agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(usable(df, names)).alias("usable_rows")
    )
    return counts.withColumn("skipped_rows", F.col("total_rows") - F.col("usable_rows"))


def with_origin(df: DataFrame, names: Corpus = CORPUS) -> DataFrame:
    """Remember the split and position a row had before any filter."""
    return df.withColumns({names.origin_split: F.col(names.split), names.origin_index: F.col(names.row_id)})


def freeze_human(df: DataFrame, seed: int, names: Corpus = CORPUS) -> DataFrame:
    """Fix one seeded human answer per row, with its place in the cleaned list (-1 if none)."""
    if names.selected_human == names.selected_index:
        raise ValueError("Selected human text and index columns must be different.")
    chosen = pick(F.col("_texts"), seed, F.col(names.split), F.col(names.row_id), names.selected_human)
    return (
        drop_if_present(df, [names.selected_human, names.selected_index])
        .withColumn("_texts", texts_of(df, names.human_answers))
        .withColumn("_pick", chosen)
        .withColumns(
            {
                names.selected_human: F.col("_pick.text"),
                names.selected_index: F.coalesce(F.col("_pick.pick_index"), F.lit(-1)),
            }
        )
        .drop("_texts", "_pick")
    )


def with_human_answer(df: DataFrame, seed: int, out: str = "human_answer", names: Corpus = CORPUS) -> DataFrame:
    """The frozen human answer, or the seeded choice from the list where it is blank."""
    has_list = names.human_answers in df.columns
    frozen = safe_text(F.col(names.selected_human)) if names.selected_human in df.columns else None
    if not has_list:
        if frozen is None:
            raise ValueError(f"Missing required columns: {names.selected_human} or {names.human_answers}")
        return df.withColumn(out, frozen)
    chosen = pick(F.col("_texts"), seed, F.col(names.split), F.col(names.row_id), names.selected_human)["text"]
    answer = chosen if frozen is None else F.when(frozen != "", frozen).otherwise(chosen)
    return df.withColumn("_texts", texts_of(df, names.human_answers)).withColumn(out, answer).drop("_texts")


def listed(names_or_csv: Iterable[str]) -> list[str]:
    """Names given one by one or comma separated, without repeats, in order."""
    flat = (part.strip() for value in names_or_csv for part in value.split(","))
    return list(dict.fromkeys(part for part in flat if part))


def filled_columns(df: DataFrame, columns: Sequence[str], splits: Sequence[str], names: Corpus = CORPUS) -> list[str]:
    """Columns holding a value in every one of the splits.

    One table has one schema, so a column missing from a split shows as all null. One aggregate counts the values
    of all columns in all splits.
    """
    if not columns:
        return []
    rows = df.where(F.col(names.split).isin(list(splits)))
    counts = rows.groupBy(names.split).agg(*[F.count(c).alias(f"_{i}") for i, c in enumerate(columns)]).collect()
    found = {r[0]: r for r in counts}
    return [c for i, c in enumerate(columns) if all(s in found and found[s][f"_{i}"] for s in splits)]


def _common(df, requested, candidates, splits, names, what):
    if requested:
        wanted = listed(requested)
        present = [c for c in wanted if c in df.columns]
        if splits:
            present = filled_columns(df, present, splits, names)
        missing = sorted(set(wanted) - set(present))
        if missing:
            raise ValueError(f"{what} column(s) not found: {', '.join(missing)}")
        return wanted
    found = filled_columns(df, candidates, splits, names) if splits else candidates
    if not found:
        raise ValueError(f"No {what} columns found. Name them explicitly.")
    return found


def _prefixed(df: DataFrame, prefix: str, names: Corpus) -> list[str]:
    return sorted(c for c in df.columns if c.startswith(prefix) and not c.startswith(names.prompt_prefix))


def resolve_ai_columns(
    df: DataFrame,
    requested: Sequence[str] | None = None,
    splits: Sequence[str] = ("train", "eval"),
    prefix: str | None = None,
    names: Corpus = CORPUS,
) -> list[str]:
    """Generated answer columns to classify: those asked for, or all prefixed ones, in every split."""
    candidates = _prefixed(df, prefix or names.ai_prefix, names)
    return _common(df, requested, candidates, splits, names, "AI answer")


def resolve_example_columns(
    df: DataFrame,
    requested: Sequence[str] | None = None,
    include_original: bool = True,
    prefix: str | None = None,
    names: Corpus = CORPUS,
) -> list[str]:
    """Answer columns of the example report: the original AI answers first, then the generated ones."""
    first = [names.original_ai] if include_original and names.original_ai in df.columns else []
    candidates = first + _prefixed(df, prefix or names.ai_prefix, names)
    return _common(df, requested, candidates, (), names, "AI answer")


def resolve_answer_columns(
    df: DataFrame,
    requested: Sequence[str] | None = None,
    splits: Sequence[str] = (),
    prefix: str | None = None,
    names: Corpus = CORPUS,
) -> list[str]:
    """Every answer column for length profiles, human and generated, sorted by name."""
    human = {names.human_answers, names.selected_human, names.original_ai} & set(df.columns)
    candidates = sorted(human | set(_prefixed(df, prefix or names.ai_prefix, names)))
    return _common(df, requested, candidates, splits, names, "Answer")

"""Model in the loop: batch generation, retry, merging answers back, completeness."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Collection, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerloom.columns import CORPUS, Corpus
from answerloom.functions.naming import generated_column_name
from answerloom.functions.quality import clean_output, is_bad_basic
from answerloom.functions.text import safe_text
from answerloom.operators.workers import held, key_of
from answerloom.session import map_pandas, stage
from answerloom.sources.prompts import PromptSpec

# A generator takes prompts (texts, or chat messages where these are asked for), the prompt style they share and the attempt number (1 or 2), and gives
# per prompt a text, a list of texts, or a pair of these and the number of tokens made.
Generator = Callable[[list[str], str, int], list]
GeneratorFactory = Callable[..., Generator]

_GENERATED = [
    T.StructField("answers", T.ArrayType(T.StringType())),
    T.StructField("token_count", T.IntegerType()),
]


def with_settings(make_generator: GeneratorFactory, settings: dict[str, dict]) -> GeneratorFactory:
    """Hand the generation values of each prompt style to a factory that takes an argument."""
    if not inspect.signature(make_generator).parameters:
        return make_generator
    return lambda: make_generator(settings)


def _unpack(made) -> tuple[list[str], int]:
    texts, tokens = made if isinstance(made, tuple) else (made, None)
    texts = [t.strip() for t in ([texts] if isinstance(texts, str) else list(texts))]
    return texts, len(texts[0].split()) if tokens is None and texts else int(tokens or 0)


def _plain(prompt):
    """A text as it is; chat messages as a list of role and content."""
    return prompt if isinstance(prompt, str) else [{"role": m["role"], "content": m["content"]} for m in prompt]


def _run_batches(generator, frame: pd.DataFrame, prompt: str, attempt: int, batch_size: int) -> tuple[list, list]:
    """Call the generator on batches of one prompt style each; results in row order."""
    answers: list = [None] * len(frame)
    tokens: list = [None] * len(frame)
    place = pd.Series(range(len(frame)), index=frame.index)
    for style, group in frame.groupby("prompt_name", sort=False):
        for start in range(0, len(group), batch_size):
            batch = group.iloc[start : start + batch_size]
            made = generator([_plain(p) for p in batch[prompt]], style, attempt)
            if len(made) != len(batch):
                raise RuntimeError(f"Expected {len(batch)} answers, got {len(made)}.")
            for row, result in zip(place.loc[batch.index], made):
                answers[row], tokens[row] = _unpack(result)
    return answers, tokens


def generate(
    prompts: DataFrame,
    make_generator: GeneratorFactory,
    batch_size: int = 8,
    prompt: str = "prompt",
    partitions: int | None = None,
    attempt: int = 1,
) -> DataFrame:
    """Append ``answers`` and ``token_count``.

    The factory runs once per Python worker and not per task: what it gives is kept in the worker process, under a
    digest of the factory and its settings, and serves all tasks there and both attempts. The result must be written
    before it is used twice, as every action would generate again.
    """
    if batch_size <= 0:
        raise ValueError("batch_size must be positive.")
    if partitions:
        prompts = prompts.repartition(partitions, "split", "row_id", "prompt_name")

    key = key_of(make_generator)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            generator = held(key, make_generator)
            answers, tokens = _run_batches(generator, frame, prompt, attempt, batch_size)
            yield frame.assign(answers=answers, token_count=tokens)

    return map_pandas(prompts, run, T.StructType(prompts.schema.fields + _GENERATED))


def generate_with_retry(
    prompts: DataFrame,
    make_generator: GeneratorFactory,
    is_bad: Callable[[Column, Column], Column] = is_bad_basic,
    batch_size: int = 8,
    prompt: str = "prompt",
    partitions: int | None = None,
) -> DataFrame:
    """Generate, clean, and generate once more where the output is bad; the second result stays.

    The first results are staged, so only the bad rows go to the generator again, in workers that hold it already.
    Columns added: ``answer``, ``token_count``, ``retried``, ``bad_output``.
    """

    def cleaned(made: DataFrame) -> DataFrame:
        text = F.coalesce(F.get("answers", F.lit(0)), F.lit(""))
        return made.withColumn("answer", clean_output(text)).drop("answers")

    bad = F.coalesce(is_bad(F.col("answer"), F.col("token_count")), F.lit(False))
    first = cleaned(generate(prompts, make_generator, batch_size, prompt, partitions)).withColumn("retried", bad)
    first = stage(first)
    second = cleaned(generate(first.where("retried").select(*prompts.columns), make_generator, batch_size, prompt, attempt=2))
    return (
        first.where("not retried")
        .withColumn("bad_output", F.lit(False))
        .unionByName(second.withColumn("retried", F.lit(True)).withColumn("bad_output", bad))
    )


def scalar_answer(answers: Column, sequences: int) -> Column:
    """One answer per prompt as text, several as a list."""
    return F.coalesce(F.get(answers, F.lit(0)), F.lit("")) if sequences == 1 else answers


@dataclass(frozen=True)
class Task:
    """A prompt style and the columns its answers go to."""

    spec: PromptSpec
    answer_column: str
    prompt_column: str | None = None

    @property
    def prompt_name(self) -> str:
        return self.spec.name


def filled_in(rows: DataFrame, columns: Sequence[str]) -> set[str]:
    """Columns that hold a value in any of the given rows, by one aggregate over all of them."""
    here = [c for c in dict.fromkeys(columns) if c in rows.columns]
    if not here:
        return set()
    counts = rows.agg(*[F.count(c).alias(f"_{i}") for i, c in enumerate(here)]).first()
    return {c for i, c in enumerate(here) if counts[i]}


def plan_tasks(
    rows: DataFrame,
    specs: Sequence[PromptSpec],
    model_name: str,
    model_alias: str | None = None,
    prefix: str = "ai",
    save_prompts: bool = False,
    on_conflict: str = "error",
    names: Corpus = CORPUS,
    filled: Collection[str] = (),
) -> list[Task]:
    """Tasks to run on the rows of the target splits.

    A task is in conflict where its answer or prompt column already holds a value in these rows; a column that other
    splits filled is not. ``filled`` names columns known to hold values that the rows don't carry. Conflicts are
    refused, left out, or run again.
    """
    if on_conflict not in ("error", "skip", "overwrite"):
        raise ValueError("on_conflict must be 'error', 'skip' or 'overwrite'.")

    def task(spec: PromptSpec) -> Task:
        column = generated_column_name(model_name, spec.name, model_alias, prefix)
        return Task(spec, column, names.prompt_prefix + column if save_prompts else None)

    tasks = [task(spec) for spec in specs]
    if on_conflict == "overwrite":
        return tasks
    taken = filled_in(rows, [c for t in tasks for c in (t.answer_column, t.prompt_column) if c]) | set(filled)
    clashing = [t for t in tasks if {t.answer_column, t.prompt_column} & taken]
    if clashing and on_conflict == "error":
        columns = sorted({t.answer_column for t in clashing})
        raise ValueError(f"Column conflict: the target splits already hold answers in {', '.join(columns)}.")
    return [t for t in tasks if t not in clashing]


def latest_records(generations: DataFrame) -> DataFrame:
    """The last record per row and prompt style: highest rank, then latest line."""
    newest = F.max_by(F.struct("answer", "prompt"), F.struct("rank", "line_no"))
    return (
        generations.groupBy("split", "row_id", "prompt_name")
        .agg(newest.alias("_newest"))
        .select("split", "row_id", "prompt_name", "_newest.*")
    )


def generated_columns(generations: DataFrame, tasks: Sequence[Task]) -> DataFrame:
    """One row per split and row id with the last answer of every task in its column, and its prompt if wanted.

    One aggregate picks the last record of every task, so all tasks cost one shuffle.
    """
    order = F.struct("rank", "line_no")
    picks = [
        F.max_by(F.struct("answer", "prompt"), F.when(F.col("prompt_name") == t.prompt_name, order)).alias(f"_t{i}")
        for i, t in enumerate(tasks)
    ]
    made: dict[str, Column] = {}
    for i, task in enumerate(tasks):
        made[task.answer_column] = F.col(f"_t{i}.answer")
        if task.prompt_column:
            made[task.prompt_column] = F.when(F.col(f"_t{i}").isNotNull(), safe_text(F.col(f"_t{i}.prompt")))
    by_row = generations.groupBy("split", "row_id").agg(*picks)
    return by_row.select("split", "row_id", *[value.alias(column) for column, value in made.items()])


def merge_generations(
    df: DataFrame,
    generations: DataFrame,
    tasks: Sequence[Task],
    names: Corpus = CORPUS,
    splits: Sequence[str] | None = None,
) -> DataFrame:
    """Add one answer column per task, and its prompt column if wanted, by one join.

    With ``splits`` only rows of these take the new values; all others keep what a column held before. A corpus of
    versions needs no merge: ``sources.columns`` adds the narrow table of ``generated_columns`` beside the wide one.
    """
    made = generated_columns(generations, tasks)
    added = made.columns[2:]
    wide = made.select(
        F.col("split").alias(names.split),
        F.col("row_id").alias(names.row_id),
        *[F.col(column).alias(f"_new_{i}") for i, column in enumerate(added)],
    )
    target = F.lit(True) if splits is None else F.col(names.split).isin(list(splits))
    before = set(df.columns)
    columns = []
    for i, column in enumerate(added):
        new = F.col(f"_new_{i}")
        columns.append((F.when(target, new).otherwise(F.col(column)) if column in before else F.when(target, new)).alias(column))
    joined = df.join(wide, [names.split, names.row_id], "left")
    return joined.select(*[c for c in df.columns if c not in added], *columns)


def missing_answers(
    df: DataFrame, generations: DataFrame, prompt_names: Sequence[str], names: Corpus = CORPUS
) -> DataFrame:
    """Row and prompt style pairs without an answer."""
    expected = df.select(
        F.col(names.split).alias("split"),
        F.col(names.row_id).alias("row_id"),
        F.explode(F.array(*[F.lit(n) for n in prompt_names])).alias("prompt_name"),
    )
    # Only whether the last record has an answer goes through the shuffle, not its text.
    newest = F.max_by(F.col("answer").isNotNull(), F.struct("rank", "line_no"))
    answered = generations.groupBy("split", "row_id", "prompt_name").agg(newest.alias("_answered")).where("_answered")
    return expected.join(answered, ["split", "row_id", "prompt_name"], "left_anti")


def stray_records(df: DataFrame, generations: DataFrame, names: Corpus = CORPUS) -> DataFrame:
    """Generation records whose row is not in the corpus."""
    rows = df.select(F.col(names.split).alias("split"), F.col(names.row_id).alias("row_id"))
    return generations.join(rows, ["split", "row_id"], "left_anti")


def check_complete(
    df: DataFrame, generations: DataFrame, prompt_names: Sequence[str], names: Corpus = CORPUS
) -> None:
    """Fail on records of unknown rows and on rows without an answer, naming the first ten."""
    stray = stray_records(df, generations, names).limit(1).collect()
    if stray:
        raise ValueError(f"Invalid row {stray[0]['row_id']} in split {stray[0]['split']}")
    missing = missing_answers(df, generations, prompt_names, names)
    first = missing.orderBy("split", "prompt_name", "row_id").limit(10).collect()
    if first:
        listed = ", ".join(f"{r['split']}/{r['prompt_name']}/{r['row_id']}" for r in first)
        raise RuntimeError(f"Missing generated answers: {listed}")

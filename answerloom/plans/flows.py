"""The flows a user runs, each a composition of operators."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict
from functools import reduce
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.columns import CORPUS, Corpus
from answerloom.functions.naming import sanitize_name
from answerloom.functions.quality import is_bad_strict
from answerloom.functions.seeding import hash32, order_key
from answerloom.functions.templates import render
from answerloom.operators import corpus as C
from answerloom.operators import metrics as M
from answerloom.operators.flatten import flatten, require_examples
from answerloom.operators.generation import (
    GeneratorFactory,
    check_complete,
    generate,
    generate_with_retry,
    generated_columns,
    plan_tasks,
    scalar_answer,
    with_settings,
)
from answerloom.operators.heads import fit_heads, is_head, load_head, save_head, score_heads
from answerloom.operators.learning import TrainParams, predict, tokenized
from answerloom.operators.lengths import length_cap, length_frequencies, length_histogram, length_stats
from answerloom.operators.prompts import (
    GenerationDefaults,
    build_prompts,
    check_generation_params,
    generation_params,
    prompt_grid,
)
from answerloom.operators.reports import guided_rows, pilot_rows
from answerloom.operators.sampling import bucket_sizes, seeded_positions, subsample, sweep_sizes, train_eval_split
from answerloom.session import stage, unstage
from answerloom.sources import columns as apart
from answerloom.sources import corpus as tables
from answerloom.sources import files, ledger, sinks
from answerloom.sources.generations import pending, read_shards, records, write_records
from answerloom.sources.prompts import PromptSpec, select_specs, specs_frame

# What tells the predictions of several heads apart.
HEAD_COLUMNS = ("model_column", "eval_column", "train_rows")
# Evaluation order of a shuffled set, and of one left as it is.
TRAINING_ORDER = ("eval_order", "example_id")
NATURAL_ORDER = ("split", "row_id", "label")

# Columns of the result files, in the order that readers of these files expect.
SOURCE_CSV = (
    "source",
    "n",
    "accuracy",
    "balanced_accuracy",
    "macro_f1",
    "human_n",
    "human_precision",
    "human_recall",
    "human_f1",
    "ai_n",
    "ai_precision",
    "ai_recall",
    "ai_f1",
    "predicted_human_n",
    "predicted_ai_n",
)
SOURCE_ACCURACY_CSV = ("source", "n", "accuracy", "human_n", "human_accuracy", "ai_n", "ai_accuracy")
LENGTH_CSV = ("answer_column", "n", "min", "mean", "median", "p90", "p95", "p99", "max")
SIZE_SCHEMA = (
    "size_key string, status string, train_rows long, eval_examples long, eval_accuracy double, "
    "eval_balanced_accuracy double, eval_precision double, eval_recall double, eval_f1 double, eval_loss double, "
    "eval_column string, run_output_dir string"
)
SIZE_CSV = (
    "size_key",
    "status",
    "train_rows",
    "eval_column",
    "eval_examples",
    "eval_accuracy",
    "eval_balanced_accuracy",
    "eval_precision",
    "eval_recall",
    "eval_f1",
    "eval_loss",
    "run_output_dir",
)


def create_subset(
    df: DataFrame,
    train_size: int,
    eval_size: int,
    seed: int = 42,
    out: str | None = None,
    splits: Sequence[str] | None = None,
    policy: str = "error",
    names: Corpus = CORPUS,
) -> DataFrame:
    """Exact-size train and eval cut of the usable rows with one human answer frozen per row."""
    chosen = C.resolve_splits(C.normalize(df, names), splits, names)
    rows = C.usable_rows(C.with_origin(chosen, names), names)
    # one pass counts the rows and the buckets of their permutation, one takes the chosen rows
    sizes = stage(bucket_sizes(rows, seed, [names.split, names.row_id]))
    subset = C.freeze_human(train_eval_split(rows, train_size, eval_size, seed, names, sizes), seed, names)
    if out is None or not tables.may_write(df.sparkSession, out, policy):
        return subset
    subset.write.mode("overwrite").partitionBy(names.split).parquet(f"{out}/data")
    config = {
        "source_splits": list(splits) if splits else None,
        "seed": seed,
        "source_rows_after_filtering": sizes.agg(F.sum("_n")).first()[0],
        "train_size": train_size,
        "eval_size": eval_size,
        **asdict(names),
    }
    files.write_small(df.sparkSession, f"{out}/subset_config.json", json.dumps(config, indent=2))
    return files.read_partitioned(df.sparkSession, f"{out}/data", names.split)


def augment(
    df: DataFrame,
    specs: Sequence[PromptSpec],
    make_generator: GeneratorFactory,
    out: str,
    model_name: str,
    model_alias: str | None = None,
    prompt_names: Sequence[str] | None = None,
    splits: Sequence[str] | None = None,
    on_conflict: str = "error",
    save_prompts: bool = False,
    defaults: GenerationDefaults = GenerationDefaults(),
    seed: int = 42,
    batch_size: int = 8,
    partitions: int | None = None,
    parts: int = 1,
    run_id: str | None = None,
    overwrite: bool = False,
    names: Corpus = CORPUS,
    prefix: str = "ai",
    chat: bool = False,
    buckets: int = apart.BUCKETS,
) -> DataFrame:
    """Add one generated column per prompt style and publish the result as a new version.

    The generator factory takes no argument, or one: the generation values of each prompt style. With ``chat`` the
    generator gets lists of messages (role and content) in place of plain texts, for models with a chat template;
    the prompts that are kept are what was sent, messages as JSON.

    The new columns are tables of their own beside the wide rows, which are written once, in ``buckets`` of the row id.
    Only the target splits take new values: a column that another split filled before is kept there, and a conflict is
    an answer in the target splits.
    If ``out`` holds a corpus, columns are added to that one, unless ``overwrite`` is set. Answers go
    to a durable table first; a run started again under the same ``run_id`` generates only what is missing.
    """
    spark = df.sparkSession
    tables.require_versioned(spark, out)
    versioned = not overwrite and files.exists(spark, f"{out}/{tables.POINTER}")
    by_column = versioned and apart.manifest(spark, out) is not None
    if versioned:
        df = tables.load(spark, out, names, [])  # the wide rows; prompts need no generated column
    df = C.normalize(df, names)
    rows = C.resolve_splits(df, splits, names)
    C.require_columns(rows, [names.question])
    targets = list(splits) if splits else C.available_splits(df, names)
    taken = apart.filled_columns(spark, out, targets) if by_column else set()
    tasks = plan_tasks(
        rows, select_specs(specs, prompt_names), model_name, model_alias, prefix, save_prompts, on_conflict, names, taken
    )
    if not tasks:
        return tables.load(spark, out, names) if versioned else df
    chosen = [t.spec for t in tasks]
    params = check_generation_params(generation_params(specs_frame(spark, chosen), defaults))
    settings = {r["name"]: {k: r[k] for k in asdict(defaults)} for r in params.collect()}
    sequences = {name: values["num_return_sequences"] for name, values in settings.items()}
    factory = with_settings(make_generator, settings)
    run_id = run_id or uuid.uuid4().hex
    store, prompt_store = f"{out}/generations/run={run_id}", f"{out}/prompts/run={run_id}"

    if not files.exists(spark, f"{prompt_store}/_SUCCESS"):
        made = build_prompts(rows, chosen, seed, names, staged=True)
        made.write.mode("overwrite").partitionBy("prompt_name").parquet(prompt_store)
    prompts = pending(records(spark, prompt_store), store)
    for task in tasks:
        # Each part is committed when done, so a stopped run loses one part at most.
        for part in range(parts):
            todo = prompts.where(F.col("prompt_name") == task.prompt_name)
            todo = todo.where(F.pmod(hash32("part", F.col("split"), F.col("row_id")), F.lit(parts)) == part)
            todo = todo if chat else todo.drop("messages")
            made = generate(todo, factory, batch_size, "messages" if chat else "prompt", partitions)
            write_records(
                made.select(
                    "split",
                    "row_id",
                    "prompt_name",
                    (F.to_json("messages") if chat else F.col("prompt")).alias("prompt"),
                    "answers",
                    F.lit(0).alias("rank"),
                    F.lit(0).cast("long").alias("line_no"),
                ),
                store,
            )
    stored = records(spark, store)
    many = max(sequences.values()) > 1
    answers = stored.withColumn("answer", F.col("answers") if many else scalar_answer(F.col("answers"), 1))
    check_complete(rows, answers, [t.prompt_name for t in tasks], names)
    made = generated_columns(answers, tasks).withColumnsRenamed({"split": names.split, "row_id": names.row_id})
    if many:
        single = {
            t.answer_column: F.get(t.answer_column, F.lit(0)) for t in tasks if sequences[t.prompt_name] == 1
        }
        made = made.withColumns(single) if single else made
    config: dict[str, Any] = {
        "splits": targets,
        "prompt_names": [t.prompt_name for t in tasks],
        "answer_columns": [t.answer_column for t in tasks],
        "prompt_columns": [t.prompt_column for t in tasks if t.prompt_column],
        "model_name": model_name,
        "model_alias": model_alias,
        "batch_size": batch_size,
        "seed": seed,
        **asdict(defaults),
    }
    if not by_column:
        apart.publish_base(df, out, names=names, buckets=buckets)
    apart.publish_columns(made, out, {"run_id": run_id, **config}, names)
    ledger.append_run(spark, f"{out}/runs", out, config, run_id)
    return tables.load(spark, out, names)


def ingest_shards(
    df: DataFrame,
    shards: str,
    out: str,
    model_name: str,
    model_alias: str | None = None,
    prompt_names: Sequence[str] | None = None,
    splits: Sequence[str] | None = None,
    save_prompts: bool = False,
    on_conflict: str = "error",
    overwrite: bool = False,
    names: Corpus = CORPUS,
    prefix: str = "ai",
    buckets: int = apart.BUCKETS,
) -> DataFrame:
    """Add the answers of shard files (``<split>__<prompt>__rank<n>.jsonl``) as columns, as ``augment`` adds its own.

    ``prompt_names`` defaults to the styles that the files name. Records of other splits are left alone; an unknown row
    or a row without an answer is an error. Only the answers are shuffled and written.
    """
    spark = df.sparkSession
    tables.require_versioned(spark, out)
    versioned = not overwrite and files.exists(spark, f"{out}/{tables.POINTER}")
    by_column = versioned and apart.manifest(spark, out) is not None
    df = C.normalize(tables.load(spark, out, names, []) if versioned else df, names)
    rows = C.resolve_splits(df, splits, names)
    targets = list(splits) if splits else C.available_splits(df, names)
    found = read_shards(spark, shards).where(F.col("split").isin(targets))
    styles = list(prompt_names or sorted(r[0] for r in found.select("prompt_name").distinct().collect()))
    made_before = apart.filled_columns(spark, out, targets) if by_column else set()
    specs = [PromptSpec(style, "{question}") for style in styles]
    tasks = plan_tasks(rows, specs, model_name, model_alias, prefix, save_prompts, on_conflict, names, made_before)
    if not tasks:
        return tables.load(spark, out, names) if versioned else df
    wanted = stage(found.where(F.col("prompt_name").isin([t.prompt_name for t in tasks])))
    check_complete(rows, wanted, [t.prompt_name for t in tasks], names)
    made = generated_columns(wanted, tasks).withColumnsRenamed({"split": names.split, "row_id": names.row_id})
    config = {
        "splits": targets,
        "prompt_names": [t.prompt_name for t in tasks],
        "answer_columns": [t.answer_column for t in tasks],
        "prompt_columns": [t.prompt_column for t in tasks if t.prompt_column],
        "model_name": model_name,
        "model_alias": model_alias,
        "shards": shards,
    }
    run_id = uuid.uuid4().hex
    if not by_column:
        apart.publish_base(df, out, names=names, buckets=buckets)
    apart.publish_columns(made, out, {"run_id": run_id, **config}, names)
    ledger.append_run(spark, f"{out}/runs", out, config, run_id)
    unstage(wanted)
    return tables.load(spark, out, names)


def classification_examples(
    df: DataFrame,
    ai_columns: Sequence[str],
    seed: int = 42,
    text_mode: str = "answer",
    window_words: int | None = None,
    max_samples: dict[str, int | None] | None = None,
    names: Corpus = CORPUS,
) -> DataFrame:
    """Labelled examples of the AI columns with their evaluation order, subsampled per split if asked."""
    examples = flatten(df, ai_columns, seed, text_mode, window_words, names)
    limits = {split: k for split, k in (max_samples or {}).items() if k is not None}
    if limits:
        parts = [subsample(examples.where(F.col("split") == s), k, seed) for s, k in limits.items()]
        rest = examples.where(~F.col("split").isin(list(limits)))
        for part in parts:
            rest = rest.unionByName(part)
        examples = rest
    return examples.withColumn("eval_order", order_key(seed, F.col("example_id"), F.col("ai_column")))


def write_eval_bundle(
    predictions: DataFrame,
    out: str,
    max_bad: int = 200,
    max_chars: int = 1200,
    all_rows: bool = False,
    order: Sequence[str] = TRAINING_ORDER,
) -> DataFrame:
    """Metrics, report, confusion matrix, source metrics, misclassified rows and, if asked, all predictions.

    The predictions are counted once per source; every metric table is summed from those counts.
    """
    scored = stage(predictions)
    counts = stage(M.source_counts(scored))
    overall = M.summed_counts(counts)
    sinks.write_json(M.eval_metrics_of(overall), f"{out}/metrics")
    sinks.write_json(M.classification_report_of(overall, ["ai_column"]), f"{out}/classification_report")
    sinks.write_json(M.confusion_matrix_of(overall, ["ai_column"]), f"{out}/confusion_matrix")
    by_source = M.source_metrics_of(counts.drop("loss_sum")).orderBy("ai_column", "source")
    # Sources may be many, so these tables are not gathered in one file.
    sinks.write_jsonl(by_source, f"{out}/source_metrics_json")
    sinks.write_csv(by_source, f"{out}/source_metrics", ["ai_column", *SOURCE_CSV], one_file=False)
    sinks.write_csv(by_source, f"{out}/source_accuracy", ["ai_column", *SOURCE_ACCURACY_CSV], one_file=False)
    sinks.write_jsonl(M.source_chart(by_source), f"{out}/source_chart")
    sinks.write_jsonl(M.bad_rows(scored, max_bad, max_chars, order), f"{out}/bad_classifications")
    if all_rows:
        sinks.write_jsonl(M.prediction_rows(scored), f"{out}/eval_predictions")
    unstage(scored)
    return M.eval_metrics_of(overall)


def train_and_evaluate(
    df: DataFrame,
    out: str,
    ai_columns: Sequence[str] | None = None,
    splits: tuple[str, str] = ("train", "eval"),
    params: TrainParams = TrainParams(),
    text_mode: str = "answer",
    window_words: int | None = None,
    max_samples: dict[str, int | None] | None = None,
    policy: str = "error",
    all_rows: bool = False,
    names: Corpus = CORPUS,
) -> DataFrame:
    """Train one classifier per AI column, save it, and evaluate all of them in one bundle.

    All classifiers learn in the same passes; each keeps its best epoch by F1 on rows held out of the train split.
    """
    C.require_answer_columns(df, names)
    columns = C.resolve_ai_columns(df, ai_columns, splits, names=names)
    examples = classification_examples(df, columns, params.seed, text_mode, window_words, max_samples, names)
    spark = df.sparkSession
    folders = {c: f"{out}/{sanitize_name(c, 'ai_column')}" for c in columns}
    open_ = [c for c in columns if tables.may_write(spark, folders[c], policy)]
    if not open_:
        return spark.createDataFrame([], "ai_column string")
    # The corpus is flattened and tokenized once.
    data = stage(tokenized(examples.where(F.col("ai_column").isin(open_)), params))
    require_examples(data, open_, splits)  # two narrow columns of what is written already
    heads = fit_heads(data.where(F.col("split") == splits[0]), open_, params)
    for i, column in enumerate(open_):
        save_head(spark, heads.only(i), f"{folders[column]}/model")
    predictions = score_heads(heads, data.where(F.col("split") == splits[1]), own_column_only=True).drop(*HEAD_COLUMNS)
    metrics = write_eval_bundle(predictions, f"{out}/eval_logs/run={uuid.uuid4().hex[:8]}", all_rows=all_rows)
    unstage(data)
    return metrics


def evaluate_checkpoint(
    df: DataFrame,
    model_path: str,
    ai_columns: Sequence[str],
    eval_split: str = "eval",
    params: TrainParams = TrainParams(),
    text_mode: str = "answer",
    window_words: int | None = None,
    max_eval_samples: int | None = None,
    out: str | None = None,
    policy: str = "error",
    all_rows: bool = False,
    names: Corpus = CORPUS,
) -> DataFrame:
    """Metrics of a saved classifier on other AI columns, without training; the whole bundle if ``out`` is given.

    Misclassified rows come in evaluation order: the natural one, or the shuffled one if a cap is set.
    """
    columns = C.resolve_ai_columns(df, ai_columns, [eval_split], names=names)
    rows = C.resolve_splits(df, [eval_split], names)
    examples = classification_examples(
        rows, columns, params.seed, text_mode, window_words, {eval_split: max_eval_samples}, names
    )
    require_examples(examples, columns, [eval_split])
    if out is None:
        return M.eval_metrics(predictions_of(model_path, examples, params), ["ai_column"])
    if not tables.may_write(df.sparkSession, out, policy):
        return df.sparkSession.read.json(f"{out}/eval_logs/metrics")
    for used in [model_path, *df.inputFiles()[:1]]:
        if files.inside(df.sparkSession, used, out):
            raise ValueError(f"{out} holds {used}, which this evaluation reads; choose another output folder.")
    files.clear(df.sparkSession, out)
    config = {
        "checkpoint": model_path,
        "eval_split": eval_split,
        "ai_columns": columns,
        "text_mode": text_mode,
        "answer_window_words": window_words,
        "max_length": params.max_length,
        "max_eval_samples": max_eval_samples,
        "seed": params.seed,
    }
    files.write_small(df.sparkSession, f"{out}/eval_config.json", json.dumps(config, indent=2))
    order = NATURAL_ORDER if max_eval_samples is None else TRAINING_ORDER
    predictions = predictions_of(model_path, examples, params)
    return write_eval_bundle(predictions, f"{out}/eval_logs", all_rows=all_rows, order=order)


def predictions_of(path: str, examples: DataFrame, params: TrainParams) -> DataFrame:
    """Examples with the predictions of a saved classifier: a head, or a pipeline."""
    if is_head(examples.sparkSession, path):
        head = load_head(examples.sparkSession, path)
        return score_heads(head, tokenized(examples, params)).drop(*HEAD_COLUMNS)
    return predict(PipelineModel.load(path), examples, params)


def sweep_train_sizes(
    df: DataFrame,
    ai_column: str,
    sizes: Sequence[int],
    splits: tuple[str, str] = ("train", "eval"),
    params: TrainParams = TrainParams(),
    text_mode: str = "answer",
    window_words: int | None = None,
    out: str | None = None,
    policy: str = "error",
    names: Corpus = CORPUS,
) -> DataFrame:
    """Metrics of classifiers trained on nested subsets of the train rows, one row per size.

    With ``out`` each size gets a folder with its model, its evaluation bundle and its metric row, and the table of
    all sizes is written anew after each one. A size whose folder is already there follows the policy: refused, run
    again, or skipped, so that a stopped sweep goes on under ``skip``; its row then has the status ``skipped`` and
    the metrics of the earlier run.
    """
    columns = C.listed([ai_column])
    if len(columns) != 1:
        raise ValueError("The size sweep trains exactly one AI column.")
    columns = C.resolve_ai_columns(df, columns, splits, names=names)
    spark = df.sparkSession
    sizes = sweep_sizes(sizes, df.where(F.col(names.split) == splits[0]).count())
    rows = df.where(F.col(names.split) == splits[0]).select(
        F.col(names.split).alias("split"), F.col(names.row_id).alias("row_id")
    )
    folders = {size: f"{out}/train_rows_{size}" for size in sizes} if out else {}
    open_ = [s for s in sizes if not out or tables.may_write(spark, folders[s], policy)]
    examples = classification_examples(df, columns, params.seed, text_mode, window_words, None, names)
    # One tokenized table, with the place of each train row in the permutation that all sizes share.
    place = seeded_positions(rows, params.seed, ["split", "row_id"], out="_place", below=max(sizes))
    data = stage(tokenized(examples, params).join(place, ["split", "row_id"], "left"))
    tested = data.where(F.col("split") == splits[1])
    done: dict[int, DataFrame] = {}
    train = data.where((F.col("split") == splits[0]) & (F.col("_place") < max(sizes)))
    # all sizes learn in the same passes, each from the rows placed below it
    heads = fit_heads(train, columns, params, open_, "_place") if open_ else None
    for size in sizes:
        folder = folders.get(size)
        if size not in open_:
            done[size] = spark.read.schema(SIZE_SCHEMA).json(f"{folder}/metric_row").withColumn("status", F.lit("skipped"))
            continue
        head = heads.only(open_.index(size))
        scored = stage(score_heads(head, tested).drop("model_column", "eval_column"))
        row = M.sweep_metrics(scored, [size]).withColumns(
            {"eval_column": F.lit(columns[0]), "run_output_dir": F.lit(folder).cast("string")}
        )
        done[size] = stage(row)
        if out:
            files.clear(spark, folder)
            save_head(spark, head, f"{folder}/model")
            write_eval_bundle(scored.drop("train_rows", "_place"), f"{folder}/eval_logs")
            unstage(scored)
            done[size].coalesce(1).write.mode("overwrite").json(f"{folder}/metric_row")
            table = reduce(DataFrame.unionByName, done.values())
            files.clear(spark, f"{out}/size_metrics")
            files.clear(spark, f"{out}/size_chart")
            sinks.write_csv(table.orderBy("train_rows"), f"{out}/size_metrics", SIZE_CSV)
            sinks.write_json(M.size_chart(table), f"{out}/size_chart")
    unstage(data)
    return reduce(DataFrame.unionByName, done.values())


def profile_lengths(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    splits: Sequence[str] | None = None,
    unit: str = "words",
    bins: int = 80,
    max_length: int | None = None,
    percentile_cap: float = 99.5,
    token_length: Callable[[Column], Column] | None = None,
    out: str | None = None,
    names: Corpus = CORPUS,
) -> tuple[DataFrame, DataFrame]:
    """Length statistics and density curves per answer column, from one pass over the corpus."""
    rows = C.resolve_splits(C.normalize(df, names), splits, names)
    columns = C.resolve_answer_columns(rows, columns, splits or C.available_splits(rows, names), names=names)
    freq = stage(length_frequencies(rows, columns, unit, token_length))
    stats = length_stats(freq, columns)
    curve = length_histogram(freq, length_cap(freq, max_length, percentile_cap), bins)
    if out:
        rounded = [F.bround(c, 3).alias(c) if c in ("mean", "median", "p90", "p95", "p99") else c for c in LENGTH_CSV]
        sinks.write_csv(stats.select(*rounded).orderBy("answer_column"), f"{out}/stats", LENGTH_CSV)
        sinks.write_csv(curve.orderBy("answer_column", "bin"), f"{out}/curves", curve.columns)
    return stats, curve


def pilot_grid(
    questions: DataFrame,
    specs: Sequence[PromptSpec],
    make_generator: GeneratorFactory,
    model_name: str,
    batch_size: int = 8,
    out: str | None = None,
    parts: int = 1,
) -> DataFrame:
    """Every question in every prompt style, retried once where the output is bad.

    With ``out`` the results are kept there: only questions and styles without a result are generated, in ``parts``
    that are saved one by one, so a stopped pilot goes on and a second one makes no call.
    """
    cases = F.lit(None).cast("string")
    for spec in specs:
        text = render(spec.user, {"question": F.col("question")})
        cases = F.when(F.col("prompt_name") == spec.name, text).otherwise(cases)
    grid = prompt_grid(questions, [s.name for s in specs]).withColumn("prompt", cases)

    def run(todo: DataFrame) -> DataFrame:
        return pilot_rows(generate_with_retry(todo, make_generator, batch_size=batch_size), model_name)

    return run(grid) if out is None else saved_in_parts(grid, run, out, parts)


def guided_pilot(
    pairs: DataFrame,
    spec: PromptSpec,
    make_generator: GeneratorFactory,
    model_name: str,
    max_new_tokens: int = 180,
    batch_size: int = 8,
    out: str | None = None,
    parts: int = 1,
) -> DataFrame:
    """Questions with a human answer as style reference, retried once under the strict rules; see ``pilot_grid``."""
    fields = {"question": F.col("question"), "human_answer": F.col("human_answer")}
    grid = prompt_grid(pairs, [spec.name]).withColumn("prompt", render(spec.user, fields))

    def run(todo: DataFrame) -> DataFrame:
        made = generate_with_retry(todo, make_generator, is_bad_strict, batch_size)
        return guided_rows(made, model_name, max_new_tokens)

    return run(grid) if out is None else saved_in_parts(grid, run, out, parts)


def saved_in_parts(
    grid: DataFrame, run: Callable[[DataFrame], DataFrame], path: str, parts: int = 1, key: str = "question_id"
) -> DataFrame:
    """Results of all prompts of a grid; those that ``path`` lacks are made and appended, part by part."""
    spark: SparkSession = grid.sparkSession
    part_of = F.pmod(hash32("part", F.col(key), F.col("prompt_name")), F.lit(parts))
    for part in range(parts):
        todo = grid.where(part_of == part)
        if files.exists(spark, path) and "_SUCCESS" in files.child_names(spark, path):
            done = spark.read.parquet(path).select(key, F.col("prompt_style").alias("prompt_name"))
            todo = todo.join(done, [key, "prompt_name"], "left_anti")
        run(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)

"""Classification metrics from confusion counts.

Every metric starts from one partial-and-final aggregate over the predictions
(``tp fp fn tn`` per group), so a hot group costs no more than any other.
AI is the positive class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.columns import AI, HUMAN, LABEL_NAMES
from answerloom.functions.scores import cross_entropy, label_name, prediction, softmax_of
from answerloom.functions.text import hard_cut, or_default, safe_text
from answerloom.operators.sampling import first_n

_COUNTS = ("tp", "fp", "fn", "tn")


def with_scores(df: DataFrame) -> DataFrame:
    """Prediction, class probabilities and confidence from ``logit_human`` and ``logit_ai``."""
    human, ai = F.col("logit_human"), F.col("logit_ai")
    return df.withColumns(
        {
            "prediction": prediction(human, ai),
            "prob_human": softmax_of(human, ai),
            "prob_ai": softmax_of(ai, human),
        }
    ).withColumn("confidence", F.greatest("prob_human", "prob_ai"))


def attach_predictions(
    examples: DataFrame, predictions: DataFrame, ids: Sequence[str] = ("example_id", "ai_column")
) -> DataFrame:
    """Predictions joined to their examples by identity; columns known to both come from the examples.

    A human example has one id under every AI column, so the column belongs to the identity. The query fails on an
    example with no prediction, and on one with several; the check costs no pass of its own.
    """
    extra = [c for c in predictions.columns if c not in examples.columns]
    own = predictions.groupBy(*ids).agg(
        F.count("*").alias("_found"), F.first(F.struct(*extra)).alias("_made")
    )
    problem = F.when(F.col("_found").isNull(), "Example without a prediction: ").otherwise("Several predictions for ")
    checked = F.when(F.col("_found") == 1, F.col("_made")).otherwise(
        F.raise_error(F.concat(problem, F.concat_ws(" ", *ids)))
    )
    joined = examples.join(own, list(ids), "left").withColumn("_made", checked)
    return joined.select(*examples.columns, *[F.col(f"_made.{c}").alias(c) for c in extra])


def _counting() -> list[Column]:
    label, predicted = F.col("label"), F.col("prediction")
    return [
        F.count_if((label == AI) & (predicted == AI)).alias("tp"),
        F.count_if((label == HUMAN) & (predicted == AI)).alias("fp"),
        F.count_if((label == AI) & (predicted == HUMAN)).alias("fn"),
        F.count_if((label == HUMAN) & (predicted == HUMAN)).alias("tn"),
    ]


def confusion_counts(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return predictions.groupBy(*by).agg(*_counting())


def _ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` with 0 for an empty whole."""
    return F.when(whole > 0, F.try_divide(part.cast("double"), whole.cast("double"))).otherwise(F.lit(0.0))


def _c(name: str) -> Column:
    return F.col(name)


def _actual(label: int) -> Column:
    """Examples that carry the label."""
    return _c("tp") + _c("fn") if label == AI else _c("tn") + _c("fp")


def _predicted(label: int) -> Column:
    """Examples predicted as the label."""
    return _c("tp") + _c("fp") if label == AI else _c("tn") + _c("fn")


def _correct(label: int) -> Column:
    return _c("tp") if label == AI else _c("tn")


def _rows() -> Column:
    return _actual(AI) + _actual(HUMAN)


def _accuracy() -> Column:
    return _ratio(_c("tp") + _c("tn"), _rows())


def _precision(label: int) -> Column:
    return _ratio(_correct(label), _predicted(label))


def _recall(label: int) -> Column:
    return _ratio(_correct(label), _actual(label))


def _f1(label: int) -> Column:
    return _ratio(2 * _correct(label), _predicted(label) + _actual(label))


def _balanced_accuracy() -> Column:
    """Mean recall over the classes that occur among the labels."""
    classes = (F.when(_actual(AI) > 0, 1).otherwise(0) + F.when(_actual(HUMAN) > 0, 1).otherwise(0)).cast("double")
    return _ratio(_recall(AI) + _recall(HUMAN), classes)


def binary_metrics_of(counts: DataFrame) -> DataFrame:
    return counts.withColumns(
        {
            "n": _rows(),
            "accuracy": _accuracy(),
            "balanced_accuracy": _balanced_accuracy(),
            "precision": _precision(AI),
            "recall": _recall(AI),
            "f1": _f1(AI),
        }
    ).drop(*_COUNTS)


def binary_metrics(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, balanced accuracy, precision, recall and F1 per group; 0 where undefined."""
    return binary_metrics_of(confusion_counts(predictions, by))


def column_metrics(predictions: DataFrame) -> DataFrame:
    """Metrics of every AI column in one job, with loss and example count."""
    return eval_metrics(predictions, ["ai_column"])


def eval_metrics(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Binary metrics with mean loss, from one aggregate."""
    loss = cross_entropy(F.col("label"), F.col("logit_human"), F.col("logit_ai"))
    counts = predictions.groupBy(*by).agg(*_counting(), F.avg(loss).alias("loss"))
    return binary_metrics_of(counts)


def eval_loss(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    loss = cross_entropy(F.col("label"), F.col("logit_human"), F.col("logit_ai"))
    return predictions.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(loss).alias("loss"))


def _class_columns(label: int) -> dict[str, Column]:
    name = LABEL_NAMES[label]
    actual = _actual(label)
    return {
        f"{name}_n": actual,
        f"{name}_accuracy": F.when(actual > 0, _recall(label)),
        f"{name}_precision": _precision(label),
        f"{name}_recall": _recall(label),
        f"{name}_f1": _f1(label),
        f"{name}_support": actual,
    }


def source_metrics_of(counts: DataFrame) -> DataFrame:
    return counts.withColumns(
        {
            "n": _rows(),
            "accuracy": _accuracy(),
            "balanced_accuracy": _balanced_accuracy(),
            "macro_f1": (_f1(HUMAN) + _f1(AI)) / 2,
            "predicted_human_n": _predicted(HUMAN),
            "predicted_ai_n": _predicted(AI),
            **_class_columns(HUMAN),
            **_class_columns(AI),
        }
    ).drop(*_COUNTS)


def _with_source(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("source", or_default(F.col("source"), "unknown"))


def source_metrics(predictions: DataFrame, by: Sequence[str] = ("ai_column",)) -> DataFrame:
    """Metrics per source, with both classes spelled out; class accuracy is null for an absent class."""
    return source_metrics_of(confusion_counts(_with_source(predictions), [*by, "source"]))


def source_and_overall_metrics(predictions: DataFrame) -> DataFrame:
    """Per source and overall metrics of every AI column from one grouping-sets aggregate.

    Overall rows carry a null source.
    """
    keys = [F.col("ai_column"), F.col("source")]
    grouped = _with_source(predictions).groupingSets([keys, keys[:1]], *keys)
    return source_metrics_of(grouped.agg(*_counting()))


def source_counts(predictions: DataFrame) -> DataFrame:
    """Confusion counts and summed loss per AI column and source: all other metrics derive from it."""
    loss = cross_entropy(F.col("label"), F.col("logit_human"), F.col("logit_ai"))
    return (
        _with_source(predictions).groupBy("ai_column", "source").agg(*_counting(), F.sum(loss).alias("loss_sum"))
    )


def summed_counts(counts: DataFrame, by: Sequence[str] = ("ai_column",)) -> DataFrame:
    """Counts of a coarser grouping."""
    return counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in (*_COUNTS, "loss_sum")])


def eval_metrics_of(counts: DataFrame) -> DataFrame:
    return binary_metrics_of(counts.withColumn("loss", _ratio(F.col("loss_sum"), _rows()))).drop("loss_sum")


def confusion_matrix_of(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    def cell(label: int, predicted: int, count: str) -> Column:
        return F.struct(
            F.lit(LABEL_NAMES[label]).alias("label"),
            F.lit(LABEL_NAMES[predicted]).alias("prediction"),
            F.col(count).alias("n"),
        )

    cells = [cell(HUMAN, HUMAN, "tn"), cell(HUMAN, AI, "fp"), cell(AI, HUMAN, "fn"), cell(AI, AI, "tp")]
    return counts.select(*by, F.inline(F.array(*cells)))


def confusion_matrix(predictions: DataFrame, by: Sequence[str] = ("ai_column",)) -> DataFrame:
    """The four cells of label and prediction per group, zeros kept."""
    return confusion_matrix_of(confusion_counts(predictions, by), by)


def classification_report_of(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    def entry(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("entry"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1_score"),
            support.alias("support"),
        )

    none = F.lit(None).cast("double")

    def average(measure, weights: bool) -> Column:
        if not weights:
            return (measure(HUMAN) + measure(AI)) / 2
        return _ratio(measure(HUMAN) * _actual(HUMAN) + measure(AI) * _actual(AI), _rows())

    entries = [
        entry(LABEL_NAMES[label], _precision(label), _recall(label), _f1(label), _actual(label))
        for label in (HUMAN, AI)
    ]
    entries.append(entry("accuracy", none, none, _accuracy(), _rows()))
    for name, weights in (("macro avg", False), ("weighted avg", True)):
        entries.append(entry(name, *[average(m, weights) for m in (_precision, _recall, _f1)], _rows()))
    return counts.select(*by, F.inline(F.array(*entries)))


def classification_report(predictions: DataFrame, by: Sequence[str] = ("ai_column",)) -> DataFrame:
    """Five entries per group: human, ai, accuracy, macro avg, weighted avg."""
    return classification_report_of(confusion_counts(predictions, by), by)


def transfer_metrics(predictions: DataFrame) -> DataFrame:
    """Metrics of every model on every evaluated AI column."""
    return eval_metrics(predictions, ["model_column", "eval_column"])


def sweep_metrics(predictions: DataFrame, sizes: Sequence[int], prefix: str = "train_rows_") -> DataFrame:
    """One row per requested training size; a size without predictions is ``skipped``."""
    spark = predictions.sparkSession
    wanted = spark.createDataFrame([(int(s),) for s in dict.fromkeys(sizes)], "train_rows long")
    measured = eval_metrics(predictions, ["train_rows"])
    return wanted.join(measured, "train_rows", "left").select(
        F.concat(F.lit(prefix), F.col("train_rows")).alias("size_key"),
        F.when(F.col("n").isNull(), "skipped").otherwise("completed").alias("status"),
        "train_rows",
        F.col("n").alias("eval_examples"),
        *[F.col(m).alias(f"eval_{m}") for m in ("accuracy", "balanced_accuracy", "precision", "recall", "f1", "loss")],
    )


def source_chart(metrics: DataFrame, by: Sequence[str] = ("ai_column",)) -> DataFrame:
    """Long form of the per-source chart: accuracy and the AI metrics, null as 0."""
    series = ("accuracy", "ai_precision", "ai_recall", "ai_f1")
    points = [F.struct(F.lit(s).alias("metric"), F.coalesce(F.col(s), F.lit(0.0)).alias("value")) for s in series]
    return metrics.select(*by, "source", F.inline(F.array(*points)))


def size_chart(sweep: DataFrame) -> DataFrame:
    """Long form of the training-size chart: accuracy and F1 of completed sizes."""
    points = [F.struct(F.lit(s).alias("metric"), F.col(f"eval_{s}").alias("value")) for s in ("accuracy", "f1")]
    done = sweep.where((F.col("status") == "completed") & F.col("eval_accuracy").isNotNull())
    return done.select("train_rows", F.inline(F.array(*points)))


def misclassified(predictions: DataFrame) -> DataFrame:
    return predictions.where(F.col("label") != F.col("prediction"))


def bad_rows(
    predictions: DataFrame,
    n: int = 200,
    max_chars: int = 1200,
    order: Sequence[str] = ("eval_order", "example_id"),
    by: Sequence[str] = ("ai_column",),
) -> DataFrame:
    """First misclassified rows per group in evaluation order, texts cut, labels spelled out."""
    worst = first_n(misclassified(with_scores(predictions)), n, order, by)
    cut = [c for c in ("answer", "full_answer") if c in predictions.columns]
    text = [c for c in ("question",) if c in predictions.columns]
    same = [
        c
        for c in (
            "row_id",
            "answer_source_column",
            "answer_window_start",
            "answer_window_end",
            "answer_original_word_count",
        )
        if c in predictions.columns
    ]
    return worst.select(
        *by,
        "example_id",
        or_default(F.col("source"), "unknown").alias("source"),
        label_name(F.col("label")).alias("label"),
        label_name(F.col("prediction")).alias("prediction"),
        "confidence",
        "prob_human",
        "prob_ai",
        *[safe_text(F.col(c)).alias(c) for c in text],
        *[hard_cut(F.col(c), max_chars).alias(c) for c in cut],
        *same,
    )


def prediction_rows(predictions: DataFrame, by: Sequence[str] = ("ai_column",)) -> DataFrame:
    """All predictions, labels spelled out, with window facts where they exist."""
    same = [
        c
        for c in (
            "answer_source_column",
            "answer_window_start",
            "answer_window_end",
            "answer_original_word_count",
        )
        if c in predictions.columns
    ]
    return with_scores(predictions).select(
        *by,
        "example_id",
        label_name(F.col("label")).alias("label"),
        label_name(F.col("prediction")).alias("prediction"),
        "prob_human",
        "prob_ai",
        or_default(F.col("source"), "unknown").alias("source"),
        *same,
    )

"""Train, apply, evaluate and sweep text classifiers with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.columns import AI
from answerloom.operators.metrics import binary_metrics, eval_metrics, sweep_metrics, with_scores
from answerloom.operators.reports import truncated_tokens
from answerloom.functions.seeding import order_key
from answerloom.operators.sampling import seeded_positions
from answerloom.session import stage, unstage


@dataclass(frozen=True)
class TrainParams:
    """Classifier settings; ``reg_params`` are tried in turn and the best F1 is kept."""

    max_length: int = 256
    features: int = 1 << 16
    max_iter: int = 20
    reg_params: tuple[float, ...] = (0.01,)
    held_out_share: float = 0.2
    seed: int = 42


def tokenized(examples: DataFrame, params: TrainParams = TrainParams()) -> DataFrame:
    """Examples with their tokens, cut at the model's length."""
    lowered = examples.withColumn("_lower", F.lower("text"))
    return truncated_tokens(lowered, "_lower", params.max_length, "tokens").drop("_lower", "token_total")


def _pipeline(params: TrainParams, reg_param: float) -> Pipeline:
    return Pipeline(
        stages=[
            HashingTF(inputCol="tokens", outputCol="_tf", numFeatures=params.features),
            IDF(inputCol="_tf", outputCol="_features", minDocFreq=1),
            LogisticRegression(
                featuresCol="_features",
                labelCol="label",
                predictionCol="_ml_prediction",
                probabilityCol="_ml_probability",
                rawPredictionCol="_raw",
                maxIter=params.max_iter,
                regParam=reg_param,
            ),
        ]
    )


def fit(examples: DataFrame, params: TrainParams = TrainParams()) -> PipelineModel:
    """Fit one classifier; with several settings, the one with the best F1 on held-out examples.

    The tokens are staged once, as the optimizer passes over them many times.
    """
    data = stage(_training_data(examples, params))
    model = fit_tokenized(data, params)
    unstage(data)
    return model


def _training_data(examples: DataFrame, params: TrainParams) -> DataFrame:
    return tokenized(examples, params).select("split", "row_id", "ai_column", "tokens", "label")


def fit_tokenized(data: DataFrame, params: TrainParams = TrainParams()) -> PipelineModel:
    """Fit on tokenized examples, which the caller has staged."""
    if len(params.reg_params) == 1:
        return _pipeline(params, params.reg_params[0]).fit(data)
    # Human and AI example of a row stay on the same side of the cut.
    share = F.conv(F.substring(order_key(params.seed, F.col("row_id")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    held = share < params.held_out_share
    scored = []
    for reg_param in params.reg_params:
        model = _pipeline(params, reg_param).fit(data.where(~held))
        f1 = binary_metrics(predict_tokenized(model, data.where(held))).first()["f1"]
        scored.append((f1, -reg_param, reg_param))
    return _pipeline(params, max(scored)[2]).fit(data)


def predict_tokenized(model: PipelineModel, tokenized: DataFrame) -> DataFrame:
    """Tokenized examples with logits, probabilities and prediction, without the tokens."""
    raw = vector_to_array("_raw")
    applied = model.transform(tokenized).withColumns({"logit_human": raw[1 - AI], "logit_ai": raw[AI]})
    return with_scores(applied).drop("_tf", "_features", "_raw", "_ml_probability", "_ml_prediction", "tokens")


def predict(model: PipelineModel, examples: DataFrame, params: TrainParams = TrainParams()) -> DataFrame:
    """Examples with logits, probabilities and prediction."""
    return predict_tokenized(model, tokenized(examples, params))


def fit_per_column(
    examples: DataFrame, ai_columns: Sequence[str], params: TrainParams = TrainParams()
) -> dict[str, PipelineModel]:
    """One classifier per AI column; the examples are tokenized once, and each fit is a distributed job."""
    data = stage(_training_data(examples, params))
    models = {c: fit_tokenized(data.where(F.col("ai_column") == c), params) for c in ai_columns}
    unstage(data)
    return models


def evaluate_models(
    models: dict[str, PipelineModel], examples: DataFrame, params: TrainParams = TrainParams()
) -> DataFrame:
    """Predictions of every model on all given examples, tagged by model and evaluated column.

    The tokens are staged once for all models.
    """
    data = stage(tokenized(examples, params))
    scored = [
        predict_tokenized(model, data).withColumns({"model_column": F.lit(name), "eval_column": F.col("ai_column")})
        for name, model in models.items()
    ]
    return reduce(DataFrame.unionByName, scored)


def evaluate_saved(path: str, examples: DataFrame, params: TrainParams = TrainParams()) -> DataFrame:
    """Metrics of a saved classifier on other AI columns."""
    return eval_metrics(predict(PipelineModel.load(path), examples, params), ["ai_column"])


def size_sweep(
    train: DataFrame,
    evaluation: DataFrame,
    train_rows: DataFrame,
    sizes: Sequence[int],
    params: TrainParams = TrainParams(),
) -> DataFrame:
    """Metrics of classifiers trained on nested row subsets of growing size.

    Sizes count ``train_rows`` (``split``, ``row_id``), the rows before incomplete ones drop out;
    both examples of a row go together. Tokens are staged once, with the place of each row in the permutation.
    """
    keys = ["split", "row_id"]
    place = seeded_positions(train_rows.select(*keys), params.seed, keys, out="_place", below=max(sizes))
    nested = stage(_training_data(train, params).join(place, keys))
    tested = stage(tokenized(evaluation, params))
    scored = [
        predict_tokenized(fit_tokenized(nested.where(F.col("_place") < size), params), tested).withColumn(
            "train_rows", F.lit(size).cast("long")
        )
        for size in dict.fromkeys(sizes)
    ]
    return sweep_metrics(reduce(DataFrame.unionByName, scored), sizes)

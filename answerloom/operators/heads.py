"""Many classifiers trained at once: logistic heads over one table of hashed words.

A head is one classifier: an AI column, a strength of regularisation, and a limit on the train rows. All heads see the
same examples, so one pass over the staged features gives the loss and gradient of every head at its own point, and the
counts of right and wrong answers on held-out rows at that point. A pass is an epoch; after the last one each column
keeps the snapshot with the best held-out F1.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerloom.columns import AI
from answerloom.functions.seeding import hash32, order_key
from answerloom.operators.learning import TrainParams, tokenized
from answerloom.operators.metrics import with_scores
from answerloom.session import map_arrow, ship, stage, unstage
from answerloom.sources import files

#: Numbers in one row of a summed vector; the rows of a vector are summed in different tasks.
CHUNK = 1 << 13
#: Steps that the quasi-Newton direction remembers, the least gain of a step, and how often a step is halved.
MEMORY, GAIN, HALVINGS = 6, 1e-4, 12
FEATURES = "head int, label int, held boolean, place long, words array<int>, counts array<float>"


@dataclass(frozen=True)
class Heads:
    """Trained heads: one AI column, epoch and weight vector (the last entry is the intercept) for each."""

    columns: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    epochs: tuple[int, ...]
    reg_params: tuple[float, ...]
    held_out_f1: tuple[float | None, ...]
    limits: tuple[int | None, ...]

    def only(self, i: int) -> Heads:
        """The head with one number as a model of its own."""
        parts = ("columns", "epochs", "reg_params", "held_out_f1", "limits")
        return Heads(idf=self.idf, weights=self.weights[i : i + 1], **{p: getattr(self, p)[i : i + 1] for p in parts})


def bucket_of(word: Column, features: int) -> Column:
    """Feature of a word; a portable digest, so other engines can name it too."""
    return (hash32(word) % features).cast("int")


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each row to distinct words with their counts."""
    for batch in batches:
        words = batch.column(4)
        offsets, values = words.offsets.to_numpy().astype(np.int64), words.values.to_numpy(zero_copy_only=False).astype(np.int64)
        values = values[offsets[0] : offsets[-1]]
        row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        width = int(values.max()) + 1 if len(values) else 1
        key, n = np.unique(row * width + values, return_counts=True)
        cuts = pa.array(np.searchsorted(key, np.arange(batch.num_rows + 1) * width).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in ((key % width).astype(np.int32), n.astype(np.float32))]
        yield pa.record_batch([*batch.columns[:4], *lists], names=["head", "label", "held", "place", "words", "counts"])


def featured(data: DataFrame, ai_columns: Sequence[str], params: TrainParams, place: str | None = None) -> DataFrame:
    """Hashed words of tokenized examples with their counts: head (number of the AI column), label, held, place, words,
    counts. Human and AI example of a row are held out together."""
    number = F.array_position(F.array(*[F.lit(c) for c in ai_columns]), F.col("ai_column")).cast("int") - 1
    share = F.conv(F.substring(order_key(params.seed, F.col("row_id")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = data.where(F.col("ai_column").isin(list(ai_columns))).select(
        number.alias("head"),
        F.col("label").cast("int").alias("label"),
        (share < params.held_out_share).alias("held"),
        (F.col(place) if place else F.lit(0)).cast("long").alias("place"),
        F.transform("tokens", lambda w: bucket_of(w, params.features)).alias("words"),
    )
    return map_arrow(rows, _compressed, FEATURES)


@dataclass
class _Flat:
    """A batch of features as flat arrays: row, word and weighted value of each entry."""

    row: np.ndarray
    words: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, idf: np.ndarray, words: int = 4, counts: int = 5) -> _Flat:
        lists = batch.column(words)
        offsets = lists.offsets.to_numpy()
        own = slice(offsets[0], offsets[-1])
        at = lists.values.to_numpy(zero_copy_only=False)[own].astype(np.int64)
        value = batch.column(counts).values.to_numpy(zero_copy_only=False)[own] * idf[at]
        row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        size = np.sqrt(np.bincount(row, weights=value * value, minlength=batch.num_rows))
        return cls(row, at, value / np.maximum(size, 1e-12)[row])

    def margins(self, weights: np.ndarray, head: np.ndarray) -> np.ndarray:
        own = weights[head[self.row], self.words] * self.values
        return np.bincount(self.row, weights=own, minlength=len(head)) + weights[head, -1]


def _pieces(vector: np.ndarray) -> pa.RecordBatch:
    """A vector as rows of CHUNK numbers."""
    starts = range(0, len(vector), CHUNK)
    return pa.record_batch(
        [pa.array([s // CHUNK for s in starts], pa.int32()), pa.array([vector[s : s + CHUNK].tobytes() for s in starts], pa.binary())],
        names=["chunk", "numbers"],
    )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the pieces of each chunk; a task holds one piece for each of its chunks."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, numbers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(numbers)
            total[chunk] = total[chunk] + own if chunk in total else own
    for chunk, own in total.items():
        yield pa.record_batch([pa.array([chunk], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["chunk", "numbers"])


def summed(rows: DataFrame, function, size: int) -> np.ndarray:
    """Sum over all tasks of the vector that each task makes of its batches; only the sum comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _pieces(function(batches))

    schema = "chunk int, numbers binary"
    out = np.zeros(size)
    parts = map_arrow(rows, run, schema).repartition(min(32, -(-size // CHUNK)), "chunk")
    for row in map_arrow(parts, _added, schema).collect():
        own = np.frombuffer(row["numbers"])
        out[row["chunk"] * CHUNK : row["chunk"] * CHUNK + len(own)] += own
    return out


def inverse_frequencies(features: DataFrame, size: int) -> np.ndarray:
    """Log of how rare each feature is among the examples."""

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(size + 1)
        for batch in batches:
            out[:size] += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
            out[size] += batch.num_rows
        return out

    total = summed(features.select("words"), count, size + 1)
    return np.log((total[size] + 1) / (total[:size] + 1))


class _Descent:
    """One head's way down: the point tried next, what was learned of the curvature, and the best snapshot."""

    def __init__(self, size: int):
        self.at = self.tried = np.zeros(size)
        self.value, self.slope, self.direction, self.step, self.halved = None, None, None, 1.0, 0
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []
        self.epoch, self.done = 0, False
        self.best: tuple[float, int, np.ndarray] | None = None

    def told(self, value: float, slope: np.ndarray, f1: float | None) -> None:
        """Loss, gradient and held-out F1 at the point tried."""
        if self.done:
            return
        if self.value is not None and value > self.value + GAIN * self.step * float(self.slope @ self.direction):
            self.halved += 1
            self.step /= 2
            self.done = self.halved >= HALVINGS
            self.tried = self.at + self.step * self.direction
            return
        if self.value is not None:
            moved, turned = self.tried - self.at, slope - self.slope
            if float(moved @ turned) > 1e-12:
                self.steps = [*self.steps[-MEMORY + 1 :], (moved, turned)]
            self.epoch += 1
        self.at, self.value, self.slope, self.halved = self.tried, value, slope, 0
        if self.epoch and (f1 is not None or self.best is None or self.best[0] < 0):
            score = -1.0 if f1 is None else f1
            if self.best is None or score > self.best[0] or score < 0:
                self.best = (score, self.epoch, self.at)
        if float(np.abs(slope).max()) < 1e-7:
            self.done = True
            return
        self.direction = -self._bent(slope)
        self.step = 1.0
        self.tried = self.at + self.step * self.direction

    def _bent(self, slope: np.ndarray) -> np.ndarray:
        """The gradient through the inverse curvature that the last steps showed."""
        if not self.steps:
            return slope / max(1e-12, float(np.linalg.norm(slope)))
        out, shares = slope.copy(), []
        for moved, turned in reversed(self.steps):
            share = float(moved @ out) / float(moved @ turned)
            shares.append(share)
            out -= share * turned
        moved, turned = self.steps[-1]
        out *= float(moved @ turned) / float(turned @ turned)
        for (moved, turned), share in zip(self.steps, reversed(shares), strict=True):
            out += (share - float(turned @ out) / float(moved @ turned)) * moved
        return out


#: What a pass learns of a head beside its gradient: loss and rows of the train part, then tp, fp, fn of the held-out part.
_FACTS = 5


def evaluate_points(features: DataFrame, idf: np.ndarray, points: np.ndarray, variants: int, limits: Sequence[int | None], hold: bool):
    """Mean loss, gradient and held-out (tp, fp, fn) of every head at its point, in one pass.

    Points are ordered by AI column and variant; a variant sees the train rows whose place is below its limit.
    """
    n_heads, size = points.shape
    shared = features.sparkSession.sparkContext.broadcast((idf, points))  # as large as the model

    def learn(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        weights_idf, weights = shared.value
        out = np.zeros((n_heads, size + _FACTS))
        for batch in batches:
            flat = _Flat.of(batch, weights_idf)
            column, label, place = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 3))
            held = batch.column(2).to_numpy(zero_copy_only=False) & hold
            for v in range(variants):
                head = column * variants + v
                margin = flat.margins(weights, head)
                train = ~held if limits[v] is None else ~held & (place < limits[v])
                chance = 1 / (1 + np.exp(-margin))
                error = np.where(train, chance - label, 0.0)
                loss = np.where(train, np.logaddexp(0, margin) - label * margin, 0.0)
                key = head[flat.row] * (size + _FACTS) + flat.words
                flat_out = out.reshape(-1)
                flat_out += np.bincount(key, weights=error[flat.row] * flat.values, minlength=flat_out.size)
                says = margin > 0
                facts = (error, loss, train, held & says & (label == AI), held & says & (label != AI), held & ~says & (label == AI))
                for j, fact in enumerate(facts):
                    out[:, size - 1 + j] += np.bincount(head, weights=fact, minlength=n_heads)
        return out.reshape(-1)

    total = summed(features, learn, n_heads * (size + _FACTS)).reshape(n_heads, size + _FACTS)
    shared.unpersist()
    n = np.maximum(total[:, size + 1], 1)
    return total[:, size] / n, total[:, :size] / n[:, None], total[:, size + 2 :]


def f1_of(counts: np.ndarray) -> float:
    tp, fp, fn = counts
    return 2 * tp / (2 * tp + fp + fn) if tp else 0.0


def fit_heads(
    data: DataFrame,
    ai_columns: Sequence[str],
    params: TrainParams = TrainParams(),
    limits: Sequence[int | None] = (None,),
    place: str | None = None,
) -> Heads:
    """One head for each AI column and limit, in the order of columns, then limits.

    ``data`` is tokenized examples. Every pass is an epoch of all heads, and of every value of ``reg_params``; a head
    keeps the setting and epoch with the best F1 on the held-out share of its rows (``held_out_share``; 0 holds out
    nothing and keeps the last epoch of the first setting). With ``limits`` a head learns from the rows whose ``place``
    is below its own, so nested train sizes cost one table and one pass too.
    """
    hold = params.held_out_share > 0
    variants = [(limit, reg) for limit in limits for reg in params.reg_params]
    features = stage(featured(data, ai_columns, params, place))
    idf = inverse_frequencies(features, params.features)
    ways = [_Descent(params.features + 1) for _ in ai_columns for _ in variants]
    regs = np.array([reg for _ in ai_columns for _, reg in variants])
    own_limits = [limit for limit, _ in variants]
    for _ in range(params.max_iter + 1):  # the first pass only tells the start
        points = np.array([w.tried for w in ways])
        loss, slope, counts = evaluate_points(features, idf, points, len(variants), own_limits, hold)
        penalty = points.copy()
        penalty[:, -1] = 0.0
        for i, way in enumerate(ways):
            f1 = f1_of(counts[i]) if hold and counts[i].sum() else None
            way.told(loss[i] + regs[i] / 2 * float(penalty[i] @ penalty[i]), slope[i] + regs[i] * penalty[i], f1)
        if all(w.done for w in ways):
            break
    unstage(features)
    chosen, n_regs = [], len(params.reg_params)
    for first in range(0, len(ways), n_regs):
        rank = lambda i: (ways[i].best[0] if ways[i].best else -2.0, -i)
        chosen.append(max(range(first, first + n_regs), key=rank))
    best = [ways[i].best or (-1.0, 0, ways[i].at) for i in chosen]
    return Heads(
        columns=tuple(c for c in ai_columns for _ in limits),
        idf=idf,
        weights=np.array([b[2] for b in best]),
        epochs=tuple(b[1] for b in best),
        reg_params=tuple(float(regs[i]) for i in chosen),
        held_out_f1=tuple(b[0] if b[0] >= 0 else None for b in best),
        limits=tuple(limit for _ in ai_columns for limit in limits),
    )


def score_heads(heads: Heads, data: DataFrame, own_column_only: bool = False) -> DataFrame:
    """Tokenized examples with logits, probabilities and prediction of every head, in one pass: a row for each example
    and head, with ``model_column``, ``eval_column`` and ``train_rows`` (the head's limit).

    With ``own_column_only`` a head scores the examples of its own AI column.
    """
    ship(data.sparkSession)
    shared = data.sparkSession.sparkContext.broadcast((heads.idf, heads.weights))  # as large as the model
    size = len(heads.idf)
    rest = [f for f in data.schema.fields if f.name != "tokens"]
    rows = data.select(*[f"`{f.name}`" for f in rest], F.transform("tokens", lambda w: bucket_of(w, size)).alias("__words"))
    n = len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, weights = shared.value
        for batch in batches:
            flat = _Flat.of(_merged(batch.column(n)), idf, 0, 1)
            margins = [flat.margins(weights, np.full(batch.num_rows, h)) for h in range(len(weights))]
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(weights)), pa.array(np.stack(margins, axis=1).ravel())
            )
            yield pa.record_batch([*batch.columns[:n], lists], names=[*[f.name for f in rest], "__margins"])

    schema = T.StructType([*rest, T.StructField("__margins", T.ArrayType(T.DoubleType()))])
    scored = rows.mapInArrow(run, schema).select("*", F.posexplode("__margins").alias("__head", "logit_ai")).drop("__margins")
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("__head") + 1)
    scored = scored.withColumns(
        {
            "logit_human": F.lit(0.0),
            "model_column": pick(heads.columns, "string"),
            "eval_column": F.col("ai_column"),
            "train_rows": pick(heads.limits, "long"),
        }
    ).drop("__head")
    scored = scored.where("model_column = eval_column") if own_column_only else scored
    return with_scores(scored)


def _merged(words: pa.Array) -> pa.RecordBatch:
    """Lists of words with repeats to lists of distinct words and their counts."""
    n = len(words)
    raw = pa.record_batch([pa.nulls(n)] * 4 + [words], names=[*"abcd", "words"])
    made = next(_compressed(iter([raw])))
    return made.select(["words", "counts"])


def save_head(spark: SparkSession, heads: Heads, path: str) -> None:
    """Write a model of one head: its facts, and the features that any example has."""
    if len(heads.columns) != 1:
        raise ValueError("Save one head at a time.")
    rare = float(heads.idf.max())  # of features that no example has
    idf = np.append(heads.idf, rare)
    used = np.flatnonzero((heads.weights[0] != 0) | (idf != rare))
    table = pa.table({"feature": used, "weight": heads.weights[0][used], "idf": idf[used]})
    spark.createDataFrame(table).coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")
    facts = {"ai_column": heads.columns[0], "features": len(heads.idf), "epoch": heads.epochs[0], "reg_param": heads.reg_params[0]}
    facts |= {"held_out_f1": heads.held_out_f1[0], "limit": heads.limits[0], "rare": rare}
    files.write_small(spark, f"{path}/head.json", json.dumps(facts, indent=2))


def is_head(spark: SparkSession, path: str) -> bool:
    return files.exists(spark, f"{path}/head.json")


def load_head(spark: SparkSession, path: str) -> Heads:
    facts = json.loads(files.read_small(spark, f"{path}/head.json"))
    size = facts["features"]
    weights, idf = np.zeros((1, size + 1)), np.full(size + 1, facts["rare"])
    for row in spark.read.parquet(f"{path}/weights").collect():  # as large as the model
        weights[0, row["feature"]], idf[row["feature"]] = row["weight"], row["idf"]
    return Heads((facts["ai_column"],), idf[:size], weights, (facts["epoch"],), (facts["reg_param"],), (facts["held_out_f1"],), (facts["limit"],))

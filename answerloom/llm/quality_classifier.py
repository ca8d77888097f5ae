"""Quality classification by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm.arrays import NULL_ID, flat, mix, pair, slices, word_names
from answerloom.llm.mixing import uniform
from answerloom.session import fresh, quoted, ship, stage

#: Buckets of the n-gram models; the model is that many rows, whatever the corpus.
BUCKETS = 1 << 16
#: Labelled target documents that the target model is fitted on at most (chosen by a digest of the id).
MAX_TARGETS = 20_000
#: Pseudo-counts of an average bucket: uniform in the raw model, in the target model in proportion to the raw one, so
#: that a small target sample says little about rare n-grams and nothing false about frequent ones.
RAW_SMOOTHING, TARGET_SMOOTHING = 1.0, 4.0
#: Nats that each n-gram is granted, so that the models' noise rejects no ordinary text, and the floor of what is kept.
TOLERANCE, FLOOR = 0.12, -3.0
#: Rows of a histogram bin that are sorted to find the last selected row.
BIN_ROWS = 10_000

_CLASS = np.full(256, 2, dtype=np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_SAME, _SAME_BUT_ONE = np.uint64(1), np.uint64(2)


def token_names(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Names of the tokens of each text, and the offset of each text in tokens.

    A token is a run of letters and digits (A-Z in lower case, characters beyond ASCII count as letters) or a run of
    other signs. One that repeats the token before, or the one before that, is named as a repetition: so repetitive
    text looks alike whatever it repeats.
    """
    data, offsets = flat(column)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    kind = _CLASS[data]
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    edge = np.ones(len(data), dtype=bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(data))
    inside = kind[starts] > 0
    starts, ends = starts[inside], ends[inside]
    first = np.searchsorted(starts, offsets)
    names = word_names(data, starts, ends)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    out = names.copy()
    if len(names) > 2:
        back = (names[2:] == names[:-2]) & (text[2:] == text[:-2])
        out[2:][back] = _SAME_BUT_ONE
    if len(names) > 1:
        back = (names[1:] == names[:-1]) & (text[1:] == text[:-1])
        out[1:][back] = _SAME
    return out, first


def gram_buckets(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of each single token and each pair of neighbours."""
    names, first = token_names(column)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pairs = pair(names[:-1], names[1:])[text[1:] == text[:-1]] if len(names) > 1 else names[:0]
    pair_text = text[1:][text[1:] == text[:-1]] if len(names) > 1 else text[:0]
    grams = np.concatenate([mix(names), mix(pairs + np.uint64(7))])
    return (grams % np.uint64(buckets)).astype(np.int64), np.concatenate([text, pair_text])


def gram_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """Hashed n-gram counts over all texts: bucket, n. Each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in slices(batches, "text"):
            np.add.at(total, gram_buckets(batch.column(0), buckets)[0], 1)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    ship(docs.sparkSession)
    return docs.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bounded_sample(ids: DataFrame, limit: int, seed: int) -> DataFrame:
    """At most `limit` distinct ids (column id), by a digest of seed and id."""
    return ids.select("id").distinct().orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), "id").limit(limit)


def log_ratios(docs: DataFrame, targets: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log of the target's over the raw text's share of each bucket; `docs` and `targets` have a column text."""

    def counted(texts: DataFrame) -> np.ndarray:
        out = np.zeros(buckets)
        for row in gram_counts(texts, buckets).collect():  # one row per bucket at most
            out[row["bucket"]] = row["n"]
        return out

    raw = counted(docs) + RAW_SMOOTHING
    raw /= raw.sum()
    target = counted(targets) + TARGET_SMOOTHING * buckets * raw
    return np.log(target / target.sum()) - np.log(raw)


def importance_weights(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Log weight of each text under the two models: id, n_grams, log_weight."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # one number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, "text"):
            bucket, text = gram_buckets(batch.column(1), len(own))
            n = np.bincount(text, minlength=batch.num_rows)
            weight = np.bincount(text, weights=own[bucket], minlength=batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(n), pa.array(weight)], names=["id", "n_grams", "log_weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ship(docs.sparkSession)
    return rows.mapInArrow(run, "id long, n_grams long, log_weight double")


def last_selected(rows: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a column, by histograms of ever narrower ranges; no task sorts more than a bin."""
    row = rows.agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count("*").alias("n")).first()
    if k <= 0 or not row["n"]:
        return float("inf")
    if k >= row["n"]:
        return float("-inf")
    low, high, need, inside = row["low"], row["high"], k, row["n"]
    bins = 4096
    while inside > BIN_ROWS and high > low:
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            break
        number = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
        within = rows.where((F.col(column) >= low) & (F.col(column) <= high))
        counts = within.groupBy(number.alias("bin")).agg(
            F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")
        )
        for b in sorted(counts.collect(), key=lambda r: -r["bin"]):  # one row per bin at most
            if need <= b["n"]:
                low, high, inside = b["low"], b["high"], b["n"]
                break
            need -= b["n"]
    if high == low:
        return low
    within = rows.where((F.col(column) >= low) & (F.col(column) <= high)).select(column)
    return within.orderBy(F.desc(column)).limit(need).agg(F.min(column)).first()[0]


def resampled(
    docs: DataFrame,
    labels: DataFrame,
    k: int | None = None,
    tolerance: float = TOLERANCE,
    floor: float = FLOOR,
    buckets: int = BUCKETS,
    max_targets: int = MAX_TARGETS,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """Importance resampling of a corpus towards its good documents: id, n_grams, log_weight, sample_key, selected.

    Two models over hashed tokens and token pairs, one of all texts and one of those labelled 1 (at most
    `max_targets` of them, by a digest of the id), give each text the log of how much likelier the target makes it.
    Adding Gumbel noise to it and taking the k largest keys draws k documents without replacement, with chances in
    proportion to the weights, each n-gram being granted `tolerance`. The noise comes from a digest of seed and id.
    Without `k` as many are drawn as have a granted log weight of at least `floor`; weights of texts are sums over
    many n-grams, so noise only moves what lies near the border. Rows whose keys are equal to the last selected one are selected too.

    Nulls: a null text has no n-grams and weight 0; null ids are drawn as one id; null labels are no targets. Empty
    texts have weight 0. Repeated rows get equal keys. Extra columns are ignored. An empty table gives an empty
    result; without any target both models are the same. Texts are read whole; the models are as large as the
    number of buckets.
    """
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text_col).alias("text"))
    good = labels.where(F.col(label_col) == 1).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"))
    chosen = stage(bounded_sample(good, max_targets, seed))
    targets = texts.join(F.broadcast(chosen), "id", "left_semi")  # at most max_targets ids
    ratios = log_ratios(texts.select("text"), targets.select("text"), buckets)
    weights = importance_weights(texts, ratios, "id", "text")
    draw = uniform(seed, F.col("id"), "gumbel") + F.lit(0.5 / 16**13)
    granted = F.col("log_weight") + F.col("n_grams") * tolerance
    keyed = stage(weights.withColumn("sample_key", granted - F.log(-F.log(draw))))
    size = keyed.where(granted >= floor).count() if k is None else k
    border = last_selected(keyed, "sample_key", size)
    return keyed.select(
        F.when(F.col("id") != NULL_ID, F.col("id")).alias("id"),
        *("n_grams", "log_weight", "sample_key"),
        (F.col("sample_key") >= border).alias("selected"),
    )


def accepted(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows whose id isn't rejected, with all their columns; rows with a null id stay."""
    name = fresh("__rejected", docs)
    rejected = stage(sample.where("not selected and id is not null").select(F.col("id").alias(name)).distinct())
    return docs.join(rejected, quoted(id_col).cast("long") == F.col(name), "left_anti")

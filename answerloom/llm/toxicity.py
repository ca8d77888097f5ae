"""Toxicity scores by votes of the nearest labelled examples under TF-IDF cosine, through a block-max index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.llm.arrays import NULL_ID, slices, word_names, words
from answerloom.llm.quality_classifier import _CLASS, bounded_sample
from answerloom.session import ship, stage

#: Labelled rows of each kind that the examples are taken from at most (by a digest of the id), terms that tell the
#: kinds apart, and documents from which a term counts.
MAX_TOXIC, MAX_OTHER, MAX_TERMS, MIN_DOCS = 4000, 8000, 1024, 4
#: Standard errors by which a term's share must differ between the kinds.
MIN_Z = 6.0
#: Examples of a block of the index, and neighbours that vote.
BLOCK, NEIGHBOURS = 512, 24
#: Weight of the overall rate in a vote.
PRIOR_WEIGHT = 0.25
#: Bytes of a word's beginning that are a term of their own, for words that go on.
STEM_BYTES = 6
_NO_WORD = _CLASS != 1


def held_out(id_: Column) -> Column:
    """Whether a row is kept out of learning: crc32 of the id as text is a multiple of 5."""
    return F.crc32(id_.cast("string").cast("binary")) % 5 == 0


def text_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of all texts (words in lower case, and the beginnings of longer ones), the text of each, words per text."""
    data, starts, ends, names, offsets = words(column, _NO_WORD, lower=True)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    longer = ends - starts > STEM_BYTES
    stems = word_names(data, starts[longer], starts[longer] + STEM_BYTES) + np.uint64(1)
    return np.concatenate([names, stems]).view(np.int64), np.concatenate([text, text[longer]]), np.diff(offsets)


def _document_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct terms of each text: (toxic, term)."""
    for batch in slices(batches, "text"):
        term, text, _ = text_terms(batch.column(1))
        by = np.lexsort((term, text))
        new = np.ones(len(by), dtype=bool)
        new[1:] = (term[by][1:] != term[by][:-1]) | (text[by][1:] != text[by][:-1])
        toxic = batch.column(0).to_numpy(zero_copy_only=False)[text[by][new]]
        yield pa.record_batch([pa.array(toxic), pa.array(term[by][new])], names=["toxic", "term"])


def telling_terms(examples: DataFrame, sizes: dict[int, int]) -> list[tuple[int, int, int]]:
    """At most MAX_TERMS terms (term, toxic documents, other documents) whose shares differ most between the kinds."""
    n1, n0 = max(sizes.get(1, 0), 1), max(sizes.get(0, 0), 1)
    counts = examples.select("toxic", "text").mapInArrow(_document_terms, "toxic int, term long")
    counts = counts.groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    pooled = (F.col("a") + F.col("b") + 1.0) / (n1 + n0 + 2.0)
    gap = F.abs(F.col("a") / n1 - F.col("b") / n0)
    z = gap / F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0))
    best = counts.where(F.col("a") + F.col("b") >= MIN_DOCS).withColumn("z", z).where(F.col("z") >= MIN_Z)
    return [(r["term"], r["a"], r["b"]) for r in best.orderBy(F.desc("z"), "term").limit(MAX_TERMS).collect()]


@dataclass
class Vocabulary:
    """Terms in ascending order with their inverse document frequencies; all other words are one term more, the last."""

    terms: np.ndarray
    idf: np.ndarray

    def vectors(self, column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Term numbers and weights of each text: unit vectors, or empty ones for texts without any of the terms."""
        term, text, n_words = text_terms(column)
        at = np.searchsorted(self.terms, term)
        at = np.minimum(at, max(len(self.terms) - 1, 0))
        known = np.flatnonzero(self.terms[at] == term) if len(self.terms) else np.zeros(0, dtype=np.int64)
        known = known[np.argsort(text[known], kind="stable")]
        bounds = np.searchsorted(text[known], np.arange(len(n_words) + 1))
        out = []
        for words_, a, b in zip(n_words, bounds[:-1], bounds[1:], strict=True):
            if a == b:
                out.append((np.zeros(0, dtype=np.int64), np.zeros(0)))
                continue
            number, count = np.unique(at[known[a:b]], return_counts=True)
            weight = np.append((1 + np.log(count)) * self.idf[number], (1 + np.log(words_)) * np.log(2))
            out.append((np.append(number, len(self.terms)), weight / np.sqrt((weight**2).sum())))
        return out


class BlockMaxIndex:
    """Inverted lists over example vectors, in blocks of which each term's largest weight is known."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray, np.ndarray]], n_terms: int):
        """Rows are (id, toxic, term numbers, weights); examples of like terms stand together."""
        rows = sorted(rows, key=lambda r: (r[2][np.argsort(-r[3], kind="stable")].tolist(), r[0]))
        self.ids = np.array([r[0] for r in rows], dtype=np.int64)
        self.toxic = np.array([r[1] for r in rows], dtype=np.float64)
        self.lists: list[list[tuple[np.ndarray, np.ndarray]]] = []
        blocks = -(-len(rows) // BLOCK)
        self.most = np.zeros((n_terms, blocks))
        for block in range(blocks):
            own = rows[block * BLOCK : (block + 1) * BLOCK]
            at = np.repeat(np.arange(len(own)), [len(r[2]) for r in own])
            term = np.concatenate([r[2] for r in own])
            weight = np.concatenate([r[3] for r in own])
            by = np.argsort(term, kind="stable")
            bounds = np.searchsorted(term[by], np.arange(n_terms + 1))
            self.lists.append([(at[by[a:b]], weight[by[a:b]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
            np.maximum.at(self.most[:, block], term, weight)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, but: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k nearest examples, exactly: a block is skipped only if its bound is no better
        than the k-th best so far. An example with the id `but` doesn't count."""
        bounds = weights @ self.most[terms]
        found, cosines = np.zeros(0, dtype=np.int64), np.zeros(0)
        for block in np.argsort(-bounds, kind="stable"):
            if bounds[block] <= (cosines[-1] if len(cosines) == k else 0):
                break
            scores = np.zeros(BLOCK)
            for t, w in zip(terms, weights, strict=True):
                at, own = self.lists[block][t]
                scores[at] += w * own
            at = np.flatnonzero(scores > 0)
            at = at[self.ids[block * BLOCK + at] != but] if but is not None else at
            found = np.append(found, block * BLOCK + at)
            cosines = np.append(cosines, scores[at])
            by = np.lexsort((found, -cosines))[:k]
            found, cosines = found[by], cosines[by]
        return found, cosines


@dataclass
class Model:
    """Examples by index, how many labelled rows one example of a kind stands for, and the calibration."""

    vocabulary: Vocabulary
    index: BlockMaxIndex
    scale: dict[int, float]
    rate: float
    blank_rate: float
    steps: np.ndarray
    levels: np.ndarray

    def vote(self, terms: np.ndarray, weights: np.ndarray, but: int | None = None):
        """Votes for toxic, weighted by squared cosine; and the nearest example's position and cosine."""
        if not len(terms) or not len(self.index.ids):
            return self.blank_rate, -1, 0.0
        found, cosines = self.index.nearest(terms, weights, NEIGHBOURS, but)
        if not len(found):
            return self.blank_rate, -1, 0.0
        toxic = self.index.toxic[found]
        share = cosines**2 * np.where(toxic > 0, self.scale[1], self.scale[0])
        raw = ((share * toxic).sum() + PRIOR_WEIGHT * self.rate) / (share.sum() + PRIOR_WEIGHT)
        return float(raw), int(found[0]), float(min(cosines[0], 1.0))

    def calibrated(self, raw: float) -> float:
        return float(np.interp(raw, self.steps, self.levels)) if len(self.steps) else raw


def monotone(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: mean x and mean y of the pools of adjacent violators."""
    by = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, w in zip(x[by], y[by], weight[by], strict=True):
        pools.append([a * w, b * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    p = np.array(pools).reshape(-1, 3)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


def fit(docs: DataFrame, labels: DataFrame, seed: int = 42, label_col: str = "toxic") -> Model:
    """Examples, index and calibration from labelled rows that aren't held out; `docs` has id and text.

    At most MAX_TOXIC toxic and MAX_OTHER other rows, chosen by a digest of the id, are examples; each stands for as
    many labelled rows as there are to one example of its kind.
    """
    known = labels.where(F.col("id").isNotNull() & ~held_out(F.col("id")) & F.col(label_col).isin(0, 1))
    known = known.groupBy("id").agg(F.max(label_col).cast("int").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = bounded_sample(known.where("toxic = 1"), MAX_TOXIC, seed).withColumn("toxic", F.lit(1))
    chosen = stage(chosen.unionByName(bounded_sample(known.where("toxic = 0"), MAX_OTHER, seed).withColumn("toxic", F.lit(0))))
    examples = stage(docs.join(F.broadcast(chosen), "id"))  # at most MAX_TOXIC + MAX_OTHER ids
    sizes = {r["toxic"]: r["count"] for r in examples.groupBy("toxic").count().collect()}
    scale = {kind: totals.get(kind, 0) / sizes[kind] if sizes.get(kind) else 1.0 for kind in (0, 1)}
    found = sorted(telling_terms(examples, sizes))
    df = np.array([a * scale[1] + b * scale[0] for _, a, b in found])
    n = sum(scale[k] * sizes.get(k, 0) for k in (0, 1))
    vocabulary = Vocabulary(np.array([t for t, _, _ in found], dtype=np.int64), np.log(1 + n / np.maximum(df, 1)))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            own = vocabulary.vectors(batch.column(1))
            terms = pa.array([t.tolist() for t, _ in own], pa.list_(pa.int64()))
            weights = pa.array([w.tolist() for _, w in own], pa.list_(pa.float64()))
            yield pa.record_batch([batch.column(0), batch.column(2), terms, weights], names=["id", "toxic", "terms", "weights"])

    rows = examples.select("id", "text", "toxic").mapInArrow(vectors, "id long, toxic int, terms array<long>, weights array<double>")
    rows = [(r["id"], r["toxic"], np.array(r["terms"], dtype=np.int64), np.array(r["weights"])) for r in rows.collect()]
    weight = {k: scale[k] for k in (0, 1)}
    rate = weight[1] * sizes.get(1, 0) / n if n else 0.0
    blank = [sum(weight[k] for r in rows if r[1] == k and not len(r[2])) for k in (0, 1)]
    blank_rate = (blank[1] + PRIOR_WEIGHT * rate) / (sum(blank) + PRIOR_WEIGHT)
    index = BlockMaxIndex([r for r in rows if len(r[2])], len(found) + 1)
    model = Model(vocabulary, index, scale, rate, blank_rate, np.zeros(0), np.zeros(0))
    if rows:
        raw = np.array([model.vote(t, w, but=i)[0] for i, _, t, w in rows])
        toxic = np.array([float(r[1]) for r in rows])
        model.steps, model.levels = monotone(raw, toxic, np.where(toxic > 0, scale[1], scale[0]))
    return model


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """Score of each text: id, held_out, score, predicted, nearest_id, nearest_toxic, nearest_cosine.

    Texts and labelled examples are unit vectors of TF-IDF weights over the terms (words and their beginnings) that
    tell the kinds apart in the examples, and one term for all other words. A text's NEIGHBOURS nearest examples, found exactly by cosine, vote with their squared cosines; an
    isotonic map, fitted on the examples with each one left out of its own vote, calibrates the vote. A text without
    any such term has the rate of examples without any. The nearest example is given as evidence (null if none).

    Only rows whose id isn't held out (crc32 of the id as text is no multiple of 5) are learned from; ids, labels,
    languages and sources are no inputs. The model is bounded (MAX_TOXIC, MAX_OTHER, MAX_TERMS) and broadcast.

    Nulls: a null text is empty, a null id is scored and not held out, null labels are ignored; of several labels of
    an id the larger holds. Empty texts get the rate of examples without terms. Repeated rows give equal rows. Extra
    columns are ignored. An empty table gives an empty result; without labels every score is 0.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text_col).alias("text"))
    model = fit(texts, labels.select(F.col(id_col).cast("long").alias("id"), label_col), seed, label_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, "text"):
            votes = [own.vote(t, w) for t, w in own.vocabulary.vectors(batch.column(1))]
            near = [v[1] for v in votes]
            columns = [
                pa.array([own.calibrated(v[0]) for v in votes]),
                pa.array([int(own.index.ids[i]) if i >= 0 else None for i in near], pa.int64()),
                pa.array([int(own.index.toxic[i]) if i >= 0 else None for i in near], pa.int32()),
                pa.array([v[2] if v[1] >= 0 else None for v in votes], pa.float64()),
            ]
            yield pa.record_batch([batch.column(0), *columns], names=["id", "score", "nearest_id", "nearest_toxic", "nearest_cosine"])

    scored = texts.mapInArrow(run, "id long, score double, nearest_id long, nearest_toxic int, nearest_cosine double")
    id_ = F.when(F.col("id") != NULL_ID, F.col("id"))
    return scored.select(
        id_.alias("id"),
        F.coalesce(held_out(id_), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        *("nearest_id", "nearest_toxic", "nearest_cosine"),
    )

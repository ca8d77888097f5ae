"""Classification metrics over the scored view."""

from pyspark.sql import functions as F

from answerloom.functions.seeding import hash32
from answerloom.operators import metrics as M
from answerloom.operators.sampling import size_subsets
from answerloom.queries import sql as q
from answerloom.queries.corpus import FLAT, flat_examples
from answerloom.queries.registry import query
from answerloom.queries.views import MODEL_COLUMNS, SCORED, SEED, documents, rounded, scored, table

COUNTS_SQL = (
    "count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp, "
    "count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 0 AND prediction = 0) AS tn"
)
_N = "(tp + fp + fn + tn)"
_P = {"ai": q.ratio("tp", "(tp + fp)"), "human": q.ratio("tn", "(tn + fn)")}
_R = {"ai": q.ratio("tp", "(tp + fn)"), "human": q.ratio("tn", "(tn + fp)")}
_F = {"ai": q.ratio("2 * tp", "(2 * tp + fp + fn)"), "human": q.ratio("2 * tn", "(2 * tn + fn + fp)")}
_SUPPORT = {"ai": "(tp + fn)", "human": "(tn + fp)"}
_ACC = q.ratio("tp + tn", _N)
_BAL = (
    f"CASE WHEN {_SUPPORT['ai']} > 0 AND {_SUPPORT['human']} > 0 THEN ({_R['ai']} + {_R['human']}) / 2 "
    f"WHEN {_SUPPORT['ai']} > 0 THEN {_R['ai']} ELSE {_R['human']} END"
)
_LOSS = (
    "avg(greatest(CASE WHEN label = 1 THEN logit_human - logit_ai ELSE logit_ai - logit_human END, 0) "
    "+ ln(1 + exp(-abs(logit_ai - logit_human)))) AS loss"
)


def _r(x: str, name: str) -> str:
    return f"round({x}, 6) AS {name}"


BINARY_SQL = ", ".join(
    [f"{_N} AS n", _r(_ACC, "accuracy"), _r(_BAL, "balanced_accuracy"), _r(_P["ai"], '"precision"'), _r(_R["ai"], "recall"), _r(_F["ai"], "f1")]
)
SOURCE_SQL = ", ".join(
    [
        f"{_N} AS n",
        _r(_ACC, "accuracy"),
        _r(_BAL, "balanced_accuracy"),
        _r(f"({_F['human']} + {_F['ai']}) / 2", "macro_f1"),
        "tn + fn AS predicted_human_n",
        "tp + fp AS predicted_ai_n",
    ]
    + [
        part
        for c in ("human", "ai")
        for part in (
            f"{_SUPPORT[c]} AS {c}_n",
            _r(f"CASE WHEN {_SUPPORT[c]} > 0 THEN {_R[c]} END", f"{c}_accuracy"),
            _r(_P[c], f"{c}_precision"),
            _r(_R[c], f"{c}_recall"),
            _r(_F[c], f"{c}_f1"),
            f"{_SUPPORT[c]} AS {c}_support",
        )
    ]
)
_SRC = f"CASE WHEN {q.safe('source')} = '' THEN 'unknown' ELSE {q.safe('source')} END"
PRED = f"{SCORED}, sourced AS (SELECT * REPLACE ({_SRC} AS source) FROM pred)"


def predictions(spark, sf_dir):
    return M.with_scores(scored(spark, sf_dir))


@query(
    "source_metrics",
    f"""WITH {PRED}, c AS (SELECT ai_column, source, {COUNTS_SQL} FROM sourced GROUP BY ai_column, source)
        SELECT ai_column, source, {SOURCE_SQL} FROM c""",
)
def source_metrics(spark, sf_dir):
    return rounded(M.source_metrics(predictions(spark, sf_dir)))


@query(
    "source_and_overall_metrics",
    f"""WITH {PRED}, c AS (SELECT ai_column, source, {COUNTS_SQL} FROM sourced
          GROUP BY GROUPING SETS ((ai_column, source), (ai_column)))
        SELECT ai_column, source, {SOURCE_SQL} FROM c""",
)
def source_and_overall_metrics(spark, sf_dir):
    return rounded(M.source_and_overall_metrics(predictions(spark, sf_dir)))


@query(
    "binary_metrics",
    f"""WITH {PRED}, c AS (SELECT {COUNTS_SQL} FROM pred) SELECT {BINARY_SQL} FROM c""",
)
def binary_metrics(spark, sf_dir):
    return rounded(M.binary_metrics(predictions(spark, sf_dir)))


@query(
    "per_column_metrics",
    f"""WITH {PRED}, c AS (SELECT ai_column, {COUNTS_SQL}, {_LOSS} FROM pred GROUP BY ai_column)
        SELECT ai_column, {BINARY_SQL}, round(loss, 6) AS loss FROM c""",
)
def per_column_metrics(spark, sf_dir):
    return rounded(M.column_metrics(predictions(spark, sf_dir)))


@query(
    "eval_bundle_metrics",
    f"""WITH {PRED}, c AS (SELECT ai_column, {COUNTS_SQL}, {_LOSS} FROM pred GROUP BY ai_column)
        SELECT ai_column, {BINARY_SQL}, round(loss, 6) AS loss FROM c""",
)
def eval_bundle_metrics(spark, sf_dir):
    """The metrics of the evaluation bundle, summed from its per-source counts."""
    counts = M.source_counts(predictions(spark, sf_dir))
    return rounded(M.eval_metrics_of(M.summed_counts(counts)))


@query(
    "confusion_matrix",
    f"""WITH {PRED}, c AS (SELECT ai_column, {COUNTS_SQL} FROM pred GROUP BY ai_column)
        SELECT ai_column, 'human' AS label, 'human' AS prediction, tn AS n FROM c UNION ALL
        SELECT ai_column, 'human', 'ai', fp FROM c UNION ALL SELECT ai_column, 'ai', 'human', fn FROM c UNION ALL
        SELECT ai_column, 'ai', 'ai', tp FROM c""",
)
def confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(predictions(spark, sf_dir))


def _weighted(m: dict[str, str]) -> str:
    return q.ratio(f"{m['human']} * {_SUPPORT['human']} + {m['ai']} * {_SUPPORT['ai']}", _N)


def _entry(name: str, values: list[str], support: str) -> str:
    rounds = [f"round({v}, 6)" if v != "NULL" else "NULL::DOUBLE" for v in values]
    return f"SELECT ai_column, '{name}' AS entry, {rounds[0]} AS \"precision\", {rounds[1]} AS recall, {rounds[2]} AS f1_score, {support} AS support FROM c"


@query(
    "classification_report",
    f"""WITH {PRED}, c AS (SELECT ai_column, {COUNTS_SQL} FROM pred GROUP BY ai_column) """
    + " UNION ALL ".join(
        [_entry(c, [_P[c], _R[c], _F[c]], _SUPPORT[c]) for c in ("human", "ai")]
        + [
            _entry("accuracy", ["NULL", "NULL", _ACC], _N),
            _entry("macro avg", [f"({m['human']} + {m['ai']}) / 2" for m in (_P, _R, _F)], _N),
            _entry("weighted avg", [_weighted(m) for m in (_P, _R, _F)], _N),
        ]
    ),
)
def classification_report(spark, sf_dir):
    return rounded(M.classification_report(predictions(spark, sf_dir)))


@query(
    "eval_loss",
    f"WITH {PRED} SELECT ai_column, n, round(loss, 6) AS loss FROM (SELECT ai_column, count(*) AS n, {_LOSS} FROM pred GROUP BY ai_column)",
)
def eval_loss(spark, sf_dir):
    return rounded(M.eval_loss(predictions(spark, sf_dir), ["ai_column"]))


# Every model scores the examples of every column; the second column reads as slightly more AI-like.
@query(
    "transfer_matrix",
    f"""WITH {SCORED}, columns(eval_column, shift) AS (VALUES ('{MODEL_COLUMNS[0]}', 0.0::DOUBLE), ('{MODEL_COLUMNS[1]}', 0.25::DOUBLE)),
        moved AS (SELECT ai_column AS model_column, eval_column, label, logit_human, logit_ai + shift AS logit_ai
          FROM scored, columns),
        pred2 AS (SELECT *, CASE WHEN logit_ai > logit_human THEN 1 ELSE 0 END AS prediction FROM moved),
        c AS (SELECT model_column, eval_column, {COUNTS_SQL}, {_LOSS} FROM pred2 GROUP BY model_column, eval_column)
        SELECT model_column, eval_column, {BINARY_SQL}, round(loss, 6) AS loss FROM c""",
)
def transfer_matrix(spark, sf_dir):
    shifts = F.array(
        *[
            F.struct(F.lit(c).alias("eval_column"), F.lit(s).alias("shift"))
            for c, s in zip(MODEL_COLUMNS, (0.0, 0.25))
        ]
    )
    moved = scored(spark, sf_dir).select("*", F.inline(shifts)).withColumnRenamed("ai_column", "model_column")
    return rounded(M.transfer_metrics(M.with_scores(moved.withColumn("logit_ai", F.col("logit_ai") + F.col("shift")))))


@query(
    "size_sweep",
    f"""WITH {SCORED}, placed AS (SELECT doc_id, toxic AS label, row_number() OVER
          (ORDER BY md5({q.key(str(SEED), 'doc_id')}), doc_id) - 1 AS position, count(*) OVER () AS total FROM labels),
        sizes(train_rows) AS (SELECT unnest([n // 4, n // 2, n]) FROM (SELECT count(*) AS n FROM labels)),
        nested AS (SELECT s.train_rows, p.label, 0.0::DOUBLE AS logit_human,
            ((d.n_chars - 1500) / 1000.0)::DOUBLE + s.train_rows / 4000.0 AS logit_ai
          FROM placed p JOIN sizes s ON p.position < s.train_rows JOIN documents d ON d.doc_id = p.doc_id),
        pred2 AS (SELECT *, CASE WHEN logit_ai > logit_human THEN 1 ELSE 0 END AS prediction FROM nested),
        c AS (SELECT train_rows, {COUNTS_SQL}, {_LOSS} FROM pred2 GROUP BY train_rows),
        m AS (SELECT train_rows, {BINARY_SQL}, round(loss, 6) AS loss FROM c),
        wanted AS (SELECT train_rows FROM sizes UNION ALL SELECT count(*) + 1 FROM labels)
        SELECT 'train_rows_' || w.train_rows AS size_key, CASE WHEN n IS NULL THEN 'skipped' ELSE 'completed' END AS status,
          w.train_rows, n AS eval_examples, accuracy AS eval_accuracy, balanced_accuracy AS eval_balanced_accuracy,
          "precision" AS eval_precision, recall AS eval_recall, f1 AS eval_f1, loss AS eval_loss
        FROM wanted w LEFT JOIN m ON m.train_rows = w.train_rows""",
)
def size_sweep(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    n = labels.count()
    sizes = [n // 4, n // 2, n]
    nested = size_subsets(labels, sizes, SEED, ["doc_id"])
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    trained = nested.join(docs, "doc_id").withColumns(
        {
            "logit_human": F.lit(0.0),
            "logit_ai": ((F.col("n_chars") - 1500) / F.lit(1000.0)).cast("double") + F.col("train_rows") / F.lit(4000.0),
        }
    )
    return rounded(M.sweep_metrics(M.with_scores(trained), [*sizes, n + 1]))


@query(
    "chart_tables",
    f"""WITH {PRED}, c AS (SELECT ai_column, source, {COUNTS_SQL} FROM sourced GROUP BY ai_column, source)
        SELECT ai_column, source, metric, round(coalesce(value, 0), 6) AS value FROM (
          SELECT ai_column, source, unnest(['accuracy', 'ai_precision', 'ai_recall', 'ai_f1']) AS metric,
            unnest([{_ACC}, {_P['ai']}, {_R['ai']}, {_F['ai']}]) AS value FROM c)""",
)
def chart_tables(spark, sf_dir):
    charted = M.source_chart(M.source_metrics(predictions(spark, sf_dir)))
    return rounded(charted).orderBy("ai_column", "source", "metric")


BAD_ROWS, BAD_CHARS = 200, 1200
_NAMED = "CASE {} WHEN 0 THEN 'human' ELSE 'ai' END AS {}"
_DECODED = ", ".join(_NAMED.format(c, c) for c in ("label", "prediction"))
_PROBS = ", ".join(_r(c, c) for c in ("prob_human", "prob_ai"))


@query(
    "misclassified_top",
    f"""WITH {PRED}, wrong AS (SELECT *, row_number() OVER (PARTITION BY ai_column ORDER BY eval_order, example_id) AS place
          FROM sourced WHERE label <> prediction)
        SELECT ai_column, example_id, source, {_DECODED}, round(greatest(prob_human, prob_ai), 6) AS confidence, {_PROBS},
          substr({q.safe('text')}, 1, {BAD_CHARS}) AS answer
        FROM (SELECT w.*, d.text FROM wrong w JOIN documents d ON d.doc_id = w.example_id WHERE place <= {BAD_ROWS})""",
)
def misclassified_top(spark, sf_dir):
    texts = documents(spark, sf_dir).select(F.col("doc_id").alias("example_id"), F.col("text").alias("answer"))
    # Only the rows shown are joined to their texts.
    top = M.bad_rows(scored(spark, sf_dir), BAD_ROWS, BAD_CHARS)
    return rounded(top.join(texts, "example_id").withColumn("answer", M.hard_cut(F.col("answer"), BAD_CHARS)))


@query(
    "predictions",
    f"""WITH {PRED} SELECT p.ai_column, p.example_id, p.source, {_DECODED}, {_PROBS}
        FROM sourced p JOIN documents d ON d.doc_id = p.example_id""",
)
def all_predictions(spark, sf_dir):
    made = scored(spark, sf_dir).drop("source")
    examples = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("example_id"), "source")
    examples = examples.join(made.select("example_id", "ai_column"), "example_id")
    return rounded(M.prediction_rows(M.attach_predictions(examples, made)))


_DRAWN = {"logit_human": "'human'", "logit_ai": "'ai'"}


@query(
    "attached_examples",
    f"""WITH {FLAT} SELECT example_id, ai_column, author_type, label::BIGINT AS label, source,
        {', '.join(f"{q.hash32('example_id', 'ai_column', side)} % 1000 / 100.0 AS {c}" for c, side in _DRAWN.items())}
        FROM flat""",
)
def attached_examples(spark, sf_dir):
    """Examples of two AI columns with logits drawn for each; a human example has one id under both columns."""
    examples = flat_examples(spark, sf_dir).withColumn("label", F.col("label").cast("long"))
    examples = examples.select("example_id", "ai_column", "author_type", "label", "source")
    drawn = {c: (hash32(F.col("example_id"), F.col("ai_column"), side.strip("'")) % 1000) / 100.0 for c, side in _DRAWN.items()}
    predictions = examples.select("example_id", "ai_column", *[value.alias(c) for c, value in drawn.items()])
    return M.attach_predictions(examples, predictions.repartition(F.col("example_id")))

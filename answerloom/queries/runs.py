"""Run ledger and classifier training."""

from pyspark.sql import functions as F

from answerloom.operators import metrics as M
from answerloom.operators.heads import fit_heads, score_heads
from answerloom.operators.learning import TrainParams, tokenized
from answerloom.plans.flows import classification_examples
from answerloom.queries import sql as q
from answerloom.queries.corpus import FLAT, flat_examples
from answerloom.queries.registry import query
from answerloom.queries.views import AI_COLUMNS, SEED, qa, rounded, table
from answerloom.session import stage
from answerloom.sources.ledger import latest_runs

#: Features of the classifiers that the queries train.
FEATURES = 1 << 14


@query(
    "latest_run",
    """SELECT source AS output, max(doc_id) AS run_seq, 'run-' || max(doc_id) AS run_id,
         arg_max(lang, doc_id) AS config FROM documents GROUP BY source""",
)
def latest_run(spark, sf_dir):
    """A ledger with one run per document, its source being the output written to."""
    runs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("output"),
        F.col("doc_id").alias("run_seq"),
        F.concat(F.lit("run-"), "doc_id").alias("run_id"),
        F.col("lang").alias("config"),
    )
    return latest_runs(runs)


@query(
    "training_totals",
    f"""WITH {FLAT}, cut AS (SELECT split, ai_column, label, row_id, {q.words("lower('Question: ' || question || chr(10) || chr(10) || 'Answer: ' || answer)")}[1:256] AS tokens FROM flat)
        SELECT split, ai_column, label::BIGINT AS label, count(*) AS n_examples, sum(len(tokens))::BIGINT AS n_tokens,
          sum(len(list_distinct(tokens)))::BIGINT AS n_terms FROM cut GROUP BY split, ai_column, label""",
)
def training_totals(spark, sf_dir):
    """What the classifiers learn from: examples, tokens and distinct terms per example, by split, column and label."""
    data = tokenized(flat_examples(spark, sf_dir))
    return data.groupBy("split", "ai_column", F.col("label").cast("long").alias("label")).agg(
        F.count("*").alias("n_examples"),
        F.sum(F.size("tokens")).alias("n_tokens"),
        F.sum(F.size(F.array_distinct("tokens"))).alias("n_terms"),
    )


def trained_heads(examples, epochs, held_out_share):
    """Predictions for the eval split of heads of all AI columns that learned from the train split."""
    params = TrainParams(max_iter=epochs, held_out_share=held_out_share, features=FEATURES, seed=SEED)
    data = stage(tokenized(examples, params))
    heads = fit_heads(data.where("split = 'train'"), AI_COLUMNS, params)
    return score_heads(heads, data.where("split = 'eval'"))


@query("train_per_column")
def train_per_column(spark, sf_dir):
    """Train on the train split, then evaluate every model on every AI column of the eval split."""
    examples = classification_examples(qa(spark, sf_dir), AI_COLUMNS, SEED, window_words=50)
    return rounded(M.transfer_metrics(trained_heads(examples, 10, 0.2)))


#: Words of the examples as features, the share of each feature, and the first step down from zero: against the gradient.
ONE_STEP = f"""{FLAT},
cut AS (SELECT *, row_number() OVER () AS i, {q.words("lower(answer)")}[1:256] AS tokens FROM flat),
bag AS (
  SELECT i, split, ai_column, label, w, count(*)::DOUBLE AS tf FROM (
    SELECT i, split, ai_column, label, ('0x' || substr(md5(t), 1, 8))::BIGINT % {FEATURES} AS w
    FROM (SELECT i, split, ai_column, label, unnest(tokens) AS t FROM cut)) GROUP BY ALL),
rare AS (
  SELECT w, ln(((SELECT count(*) FROM cut WHERE split = 'train') + 1) / (count(*) + 1)) AS idf FROM bag WHERE split = 'train' GROUP BY w),
unseen AS (SELECT ln((SELECT count(*) FROM cut WHERE split = 'train') + 1) AS idf),
weighed AS (SELECT b.*, tf * coalesce(r.idf, (SELECT idf FROM unseen)) AS x FROM bag b LEFT JOIN rare r ON r.w = b.w),
unit AS (SELECT *, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY i)), 1e-12) AS v FROM weighed),
sizes AS (SELECT ai_column, count(*) AS n, sum(0.5 - label) / count(*) AS b FROM cut WHERE split = 'train' GROUP BY ai_column),
slope AS (SELECT u.ai_column, w, sum((0.5 - label) * v) / any_value(n) AS g FROM unit u JOIN sizes s ON s.ai_column = u.ai_column
  WHERE split = 'train' GROUP BY u.ai_column, w),
norms AS (SELECT s.ai_column, sqrt(sum(g * g) + any_value(b) * any_value(b)) AS length FROM slope s JOIN sizes z ON z.ai_column = s.ai_column GROUP BY s.ai_column),
scored AS (
  SELECT c.i, c.ai_column AS eval_column, z.ai_column AS model_column, any_value(c.label) AS label,
    (-any_value(z.b) - coalesce(sum(u.v * s.g), 0)) / any_value(l.length) AS logit_ai
  FROM cut c CROSS JOIN sizes z JOIN norms l ON l.ai_column = z.ai_column LEFT JOIN unit u ON u.i = c.i
  LEFT JOIN slope s ON s.ai_column = z.ai_column AND s.w = u.w
  WHERE c.split = 'eval' GROUP BY c.i, c.ai_column, z.ai_column)"""


@query(
    "heads_first_epoch",
    f"""WITH {ONE_STEP} SELECT model_column, eval_column, label::BIGINT AS label, count(*) AS n, round(sum(logit_ai), 6) AS sum_logit,
          round(sum(ln(1 + exp(CASE WHEN label = 1 THEN -logit_ai ELSE logit_ai END))), 6) AS sum_loss
        FROM scored GROUP BY model_column, eval_column, label""",
)
def heads_first_epoch(spark, sf_dir):
    """Coefficients after the first epoch from zero, which have a closed form, applied to all columns of the eval split."""
    scored = trained_heads(flat_examples(spark, sf_dir, "answer"), 1, 0.0)
    loss = F.log1p(F.exp(F.when(F.col("label") == 1, -F.col("logit_ai")).otherwise(F.col("logit_ai"))))
    return scored.groupBy("model_column", "eval_column", F.col("label").cast("long").alias("label")).agg(
        F.count("*").alias("n"), F.round(F.sum("logit_ai"), 6).alias("sum_logit"), F.round(F.sum(loss), 6).alias("sum_loss")
    )

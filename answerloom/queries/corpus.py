"""Corpus shape: splits, cleaning, usable rows, lineage, flattening."""

from pyspark.sql import functions as F

from answerloom.functions.text import safe_text
from answerloom.operators import corpus as C
from answerloom.operators.flatten import flatten, flatten_counts, paired
from answerloom.queries import sql as q
from answerloom.queries.registry import query
from answerloom.queries.views import AI_COLUMNS, QA, SEED, qa
from answerloom.sources import corpus as tables

WINDOW = 50


@query(
    "load_splits",
    """SELECT split, count(*) AS n FROM
       (SELECT CASE WHEN doc_id % 5 = 0 THEN 'eval' ELSE 'train' END AS split FROM documents) GROUP BY split""",
)
def load_splits(spark, sf_dir):
    rows = tables.load(spark, f"{sf_dir}/documents.parquet")
    tagged = rows.withColumn("split", F.when(F.col("doc_id") % 5 == 0, "eval").otherwise(F.col("split")))
    return tables.split_counts(C.resolve_splits(tagged, ["train", "eval"]))


@query(
    "clean_lists",
    f"""WITH {QA} SELECT row_id, {q.safe('question')} AS question, len(answers)::BIGINT AS n_answers,
        md5(array_to_string(answers, '|')) AS answers_digest, len(basic)::BIGINT AS n_basic
        FROM (SELECT *, {q.texts('human_answers')} AS answers, {q.one_text('ai_m1_basic')} AS basic FROM qa)""",
)
def clean_lists(spark, sf_dir):
    df = qa(spark, sf_dir)
    return df.select(
        "row_id",
        safe_text(F.col("question")).alias("question"),
        C.texts_of(df, "human_answers").alias("answers"),
        F.size(C.texts_of(df, "ai_m1_basic")).cast("long").alias("n_basic"),
    ).select(
        "row_id",
        "question",
        F.size("answers").cast("long").alias("n_answers"),
        F.md5(F.array_join("answers", "|")).alias("answers_digest"),
        "n_basic",
    )


USABLE_SQL = f"({q.safe('question')} <> '' AND len({q.texts('human_answers')}) > 0)"


@query("usable_rows", f"WITH {QA} SELECT row_id, split, source FROM qa WHERE {USABLE_SQL}")
def usable_rows(spark, sf_dir):
    return C.usable_rows(qa(spark, sf_dir)).select("row_id", "split", "source")


@query(
    "row_counts",
    f"""WITH {QA} SELECT split, count(*) AS total_rows, count(*) FILTER ({USABLE_SQL}) AS usable_rows,
        count(*) FILTER (NOT {USABLE_SQL}) AS skipped_rows FROM qa GROUP BY split""",
)
def row_counts(spark, sf_dir):
    return C.row_counts(qa(spark, sf_dir))


@query(
    "origin_lineage",
    f"""WITH {QA} SELECT row_id, split, split AS origin_split, row_id AS origin_index, source
        FROM qa WHERE {USABLE_SQL}""",
)
def origin_lineage(spark, sf_dir):
    df = C.drop_if_present(qa(spark, sf_dir), ["origin_split", "origin_index", "chatgpt_answers"])
    parts = {s: df.where(F.col("split") == s).drop("split") for s in ("train", "eval")}
    stacked = C.with_origin(C.union_splits(parts))
    return C.usable_rows(stacked).select("row_id", "split", "origin_split", "origin_index", "source")


def _pick(texts: str, salt: str) -> str:
    h = q.hash32(str(SEED), "split", "row_id", salt)
    return f"coalesce({texts}[({h} % greatest(len({texts}), 1)) + 1], '')"


PREPARED = f"""{QA},
long AS (
  SELECT row_id, split, source, question, human_answers, '{AI_COLUMNS[0]}' AS ai_column,
    {q.one_text('ai_m1_basic')} AS ai_texts, {q.texts('human_answers')} AS human_texts FROM qa
  UNION ALL
  SELECT row_id, split, source, question, human_answers, '{AI_COLUMNS[1]}' AS ai_column,
    {q.texts('ai_m1_guided')} AS ai_texts, {q.texts('human_answers')} AS human_texts FROM qa),
prepared AS (
  SELECT row_id, split, ai_column, {q.safe('question')} AS question,
    CASE WHEN {q.safe('source')} = '' THEN 'unknown' ELSE {q.safe('source')} END AS source,
    {_pick('human_texts', "'selected_human_answer'")} AS human_answer,
    {_pick('ai_texts', 'ai_column')} AS ai_answer
  FROM long)"""

COMPLETE = "question <> '' AND human_answer <> '' AND ai_answer <> ''"

_START = (
    f"CASE WHEN n > {WINDOW} THEN {q.hash32(str(SEED), 'split', 'row_id', 'answer_source_column', chr(39) + 'answer_window' + chr(39), str(WINDOW))}"
    f" % (n - {WINDOW} + 1) ELSE 0 END"
)

FLAT = f"""{PREPARED},
authored AS (
  SELECT row_id, split, ai_column, question, source, 'human' AS author_type, 0 AS label,
    'selected_human_answer' AS answer_source_column, human_answer AS full_answer FROM prepared WHERE {COMPLETE}
  UNION ALL
  SELECT row_id, split, ai_column, question, source, 'ai', 1, ai_column, ai_answer FROM prepared WHERE {COMPLETE}),
worded AS (SELECT *, {q.words('full_answer')} AS words FROM authored),
counted AS (SELECT *, len(words)::BIGINT AS n FROM worded),
started AS (SELECT *, {_START} AS win FROM counted),
flat AS (
  SELECT *, split || '-' || row_id || '-' || answer_source_column || '-' || author_type AS example_id,
    CASE WHEN n > {WINDOW} THEN array_to_string(words[win + 1 : win + {WINDOW}], ' ') ELSE full_answer END AS answer
  FROM started)"""


def flat_examples(spark, sf_dir, text_mode="question_answer"):
    return flatten(qa(spark, sf_dir), AI_COLUMNS, SEED, text_mode, WINDOW)


@query(
    "flatten_examples",
    f"""WITH {FLAT} SELECT example_id, row_id, split, ai_column, '' AS origin_split, NULL::BIGINT AS origin_index,
        question, answer, md5(full_answer) AS full_answer_digest, win::BIGINT AS answer_window_start,
        (win + least(n, {WINDOW}))::BIGINT AS answer_window_end, n AS answer_original_word_count,
        md5('Question: ' || question || chr(10) || chr(10) || 'Answer: ' || answer) AS text_digest,
        source, author_type, answer_source_column, label::BIGINT AS label FROM flat""",
)
def flatten_examples(spark, sf_dir):
    flat = flat_examples(spark, sf_dir)
    longs = ["answer_window_start", "answer_window_end", "answer_original_word_count", "label"]
    return (
        flat.withColumns({c: F.col(c).cast("long") for c in longs})
        .withColumns({"full_answer_digest": F.md5("full_answer"), "text_digest": F.md5("text")})
        .drop("full_answer", "text")
    )


@query(
    "flatten_counts",
    f"""WITH {PREPARED} SELECT split, ai_column, count(*) AS total_rows, count(*) FILTER ({COMPLETE}) AS kept_rows,
        count(*) FILTER (NOT ({COMPLETE})) AS skipped_rows FROM prepared GROUP BY split, ai_column""",
)
def flatten_totals(spark, sf_dir):
    return flatten_counts(qa(spark, sf_dir), AI_COLUMNS, SEED)


@query(
    "paired_examples",
    f"""WITH {FLAT} SELECT h.split, h.ai_column, h.row_id, h.source, h.example_id AS human_example_id,
        h.answer AS human_answer, a.example_id AS ai_example_id, a.answer AS ai_answer
        FROM flat h JOIN flat a ON h.split = a.split AND h.row_id = a.row_id AND h.ai_column = a.ai_column
        WHERE h.author_type = 'human' AND a.author_type = 'ai'""",
)
def paired_examples(spark, sf_dir):
    return paired(qa(spark, sf_dir), AI_COLUMNS, SEED, ["answer"], "answer", WINDOW)

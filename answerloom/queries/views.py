"""Corpus-shaped views over the given tables, in Spark and in SQL.

Every view keeps all rows and whole texts of its tables. Some rows get blank or
missing parts, so that the queries meet the cases their rules are about.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.queries import sql as _sql

SEED = 42
AI_COLUMNS = ["ai_m1_basic", "ai_m1_guided"]
MODEL_COLUMNS = ["ai_m1_basic", "ai_m2_basic"]


# Fixed schemas, so that no job has to look for them.
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
    "pages": "page_id long, url string, html string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide corpus: the first line of a document is the question, the others are human answers."""
    items = table(spark, sf_dir, "benchmark")
    doc = F.col("doc_id")
    lines = documents(spark, sf_dir).select(
        "doc_id",
        "source",
        F.split("text", "\n").alias("_lines"),
        (doc % items.select(F.count(F.lit(1))).scalar()).alias("item_id"),
    )
    rest = F.slice("_lines", F.lit(2), F.size("_lines"))
    return lines.join(items, "item_id", "left").select(
        doc.alias("row_id"),
        F.when(doc % 5 == 0, "eval").otherwise("train").alias("split"),
        F.when(doc % 53 == 0, "").otherwise(F.col("source")).alias("source"),
        F.when(doc % 97 == 0, "  ").otherwise(F.col("_lines")[0]).alias("question"),
        F.when(doc % 7 == 0, F.concat(F.array(F.lit("  ")), rest)).otherwise(rest).alias("human_answers"),
        F.when(F.size("_lines") > 1, F.array(F.element_at("_lines", -1)))
        .otherwise(F.array().cast("array<string>"))
        .alias("chatgpt_answers"),
        F.when(doc % 89 != 0, F.col("text")).alias("ai_m1_basic"),
        F.split("text", r"\. ").alias("ai_m1_guided"),
    )


QA = """bench AS (SELECT count(*) AS n FROM benchmark),
doc_lines AS (
  SELECT d.doc_id, d.source, string_split(d.text, chr(10)) AS lines, d.doc_id % bench.n AS item_id
  FROM documents d, bench),
qa AS (
  SELECT d.doc_id AS row_id,
    CASE WHEN d.doc_id % 5 = 0 THEN 'eval' ELSE 'train' END AS split,
    CASE WHEN d.doc_id % 53 = 0 THEN '' ELSE d.source END AS source,
    CASE WHEN d.doc_id % 97 = 0 THEN '  ' ELSE d.lines[1] END AS question,
    CASE WHEN d.doc_id % 7 = 0 THEN list_concat(['  '], d.lines[2:]) ELSE d.lines[2:] END AS human_answers,
    CASE WHEN len(d.lines) > 1 THEN [d.lines[len(d.lines)]] ELSE [] END AS chatgpt_answers,
    CASE WHEN d.doc_id % 89 = 0 THEN NULL ELSE b.text END AS ai_m1_basic,
    string_split(b.text, '. ') AS ai_m1_guided
  FROM doc_lines d LEFT JOIN benchmark b ON b.item_id = d.item_id)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' scores of the labelled documents; the second one scores ties."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    by_length = ((F.col("n_chars") - 1500) / F.lit(1000.0)).cast("double")
    by_rest = (F.col("doc_id") % 7 - 3).cast("double")
    models = F.array(
        F.struct(F.lit(MODEL_COLUMNS[0]).alias("ai_column"), by_length.alias("logit_ai")),
        F.struct(F.lit(MODEL_COLUMNS[1]).alias("ai_column"), by_rest.alias("logit_ai")),
    )
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        F.col("doc_id").alias("example_id"),
        "source",
        F.col("toxic").alias("label"),
        F.lit(0.0).alias("logit_human"),
        F.md5(F.concat(F.lit(f"{SEED}:"), F.col("doc_id"))).alias("eval_order"),
        F.inline(models),
    )


SCORED = f"""scored AS (
  SELECT d.doc_id AS example_id, d.source, l.toxic AS label, 0.0::DOUBLE AS logit_human,
    md5('{SEED}:' || d.doc_id) AS eval_order, m.ai_column,
    CASE WHEN m.ai_column = '{MODEL_COLUMNS[0]}' THEN ((d.n_chars - 1500) / 1000.0)::DOUBLE
         ELSE (d.doc_id % 7 - 3)::DOUBLE END AS logit_ai
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id,
    (VALUES ('{MODEL_COLUMNS[0]}'), ('{MODEL_COLUMNS[1]}')) m(ai_column)),
pred AS (
  SELECT *, CASE WHEN logit_ai > logit_human THEN 1 ELSE 0 END AS prediction,
    1.0 / (1.0 + exp(logit_ai - logit_human)) AS prob_human,
    1.0 / (1.0 + exp(logit_human - logit_ai)) AS prob_ai
  FROM scored)"""


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Floating-point columns rounded, as summation order may move the last digits."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


STUB_PROMPTS = ["plain", "casual"]


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation records of the corpus: one per row and prompt style for rows with a question, revised
    records of labelled rows (null where the quality is low), and records of rows that do not exist."""
    from answerloom.functions.text import safe_text, split_words

    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), "quality", "toxic")
    rows = qa(spark, sf_dir).select("split", "row_id", safe_text(F.col("question")).alias("question"))
    first_words = F.array_join(F.slice(split_words(F.col("question")), 1, 12), " ")
    rows = rows.withColumn("stub", first_words).join(labels, "row_id", "left")

    def record(prompt_name, rank, row_id, answer, wanted):
        return F.struct(
            wanted.alias("wanted"),
            row_id.alias("row_id"),
            F.lit(prompt_name).alias("prompt_name"),
            F.lit(rank).alias("rank"),
            F.col("row_id").alias("line_no"),
            answer.alias("answer"),
            F.concat(F.lit("Q: "), "question").alias("prompt"),
        )

    asked, labelled = F.col("question") != "", F.col("quality").isNotNull()
    plain = F.concat(F.lit("Answer: "), "stub")
    revised = F.when(F.col("quality") == 1, F.concat(F.lit("Revised: "), "stub"))
    row_id = F.col("row_id")
    records = F.array(
        record("plain", 0, row_id, plain, asked),
        record("casual", 0, row_id, F.reverse(plain), asked),
        record("plain", 1, row_id, revised, asked & labelled),
        record("casual", 2, -1 - row_id, plain, F.coalesce(F.col("toxic") == 1, F.lit(False))),
    )
    made = rows.select("split", F.inline(F.filter(records, lambda r: r["wanted"])))
    return made.drop("wanted")


GENERATIONS = f"""asked AS (
  SELECT split, row_id, {_sql.safe('question')} AS question,
    array_to_string({_sql.words(_sql.safe('question'))}[1:12], ' ') AS stub, quality, toxic
  FROM qa LEFT JOIN labels ON doc_id = row_id),
generations AS (
  SELECT split, row_id, 'plain' AS prompt_name, 0 AS rank, row_id AS line_no, 'Answer: ' || stub AS answer,
    'Q: ' || question AS prompt FROM asked WHERE question <> ''
  UNION ALL
  SELECT split, row_id, 'casual', 0, row_id, reverse('Answer: ' || stub), 'Q: ' || question
    FROM asked WHERE question <> ''
  UNION ALL
  SELECT split, row_id, 'plain', 1, row_id, CASE WHEN quality = 1 THEN 'Revised: ' || stub END, 'Q: ' || question
    FROM asked WHERE question <> '' AND quality IS NOT NULL
  UNION ALL
  SELECT split, -1 - row_id, 'casual', 2, row_id, 'Answer: ' || stub, 'Q: ' || question FROM asked WHERE toxic = 1),
latest AS (
  SELECT split, row_id, prompt_name, answer, prompt FROM (
    SELECT *, row_number() OVER (PARTITION BY split, row_id, prompt_name ORDER BY rank DESC, line_no DESC) AS place
    FROM generations) WHERE place = 1)"""


class StubGenerator:
    """Deterministic stand-in for a model: the first words of the prompt, then the prompt backwards."""

    def __call__(self, prompts: list[str], prompt_name: str, attempt: int) -> list:
        made = []
        for prompt in prompts:
            words = prompt.split()
            text = "Answer: " + " ".join(words[:12]) if attempt == 1 else " ".join(words[::-1])
            made.append((text, len(text.split())))
        return made

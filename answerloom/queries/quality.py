"""Output cleaning, output rules, retry, word overlap, pilot grids."""

import uuid

from pyspark.sql import functions as F

from answerloom.functions import quality as Q
from answerloom.functions.text import count_words, safe_text
from answerloom.functions.text import preview as preview_of
from answerloom.operators import corpus as C
from answerloom.operators.generation import generate_with_retry
from answerloom.operators.lengths import explode_answers
from answerloom.plans.flows import guided_pilot, pilot_grid
from answerloom.queries import sql as q
from answerloom.queries.corpus import COMPLETE, PREPARED
from answerloom.queries.registry import query
from answerloom.queries.sampling import FROZEN
from answerloom.queries.views import QA, SEED, StubGenerator, documents, qa
from answerloom.session import checkpoint_dir
from answerloom.sources.prompts import PromptSpec
from answerloom.streaming.incremental import arriving_rows, incremental_generation

# Openings put before the texts, so that every cleaning rule meets its case.
OPENINGS = (
    "",
    "Answer : ",
    "answer:A. ",
    "Q.  ",
    " ...?! ",
    "(note: seen twice) ",
    "[draft 1]　[x",
    "ANSWER: q.(Note: a) [b] ",
    "(Note: open\n) ",
)


def _opened(c):
    openings = F.array(*[F.lit(o) for o in OPENINGS])
    return F.concat(F.get(openings, F.pmod(F.col("doc_id"), F.lit(len(OPENINGS))).cast("int")), c)


_OPENED_SQL = "([" + ", ".join(f"'{o}'" for o in OPENINGS) + f"])[doc_id % {len(OPENINGS)} + 1] || text"


def clean_sql(x: str) -> str:
    x = q.safe(x)
    for junk in Q.LEADING_JUNK:
        x = f"regexp_replace({x}, '{junk.replace('(?iud)', '(?i)').replace('(?iu)', '(?i)').replace('(?d)', '')}', '')"
    return q.strip(x)


@query(
    "clean_outputs",
    f"""SELECT doc_id, length(cleaned)::BIGINT AS chars, md5(cleaned) AS digest, substr(cleaned, 1, 20) AS opening
        FROM (SELECT doc_id, {clean_sql(_OPENED_SQL)} AS cleaned FROM documents)""",
)
def clean_outputs(spark, sf_dir):
    cleaned = documents(spark, sf_dir).select("doc_id", Q.clean_output(_opened(F.col("text"))).alias("cleaned"))
    return cleaned.select(
        "doc_id",
        F.length("cleaned").cast("long").alias("chars"),
        F.md5("cleaned").alias("digest"),
        F.substring("cleaned", 1, 20).alias("opening"),
    )


def _either(conditions) -> str:
    return "(" + " OR ".join(conditions) + ")"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def bad_basic_sql(answer: str, tokens: str) -> str:
    text = f"lower({q.safe(answer)})"
    listed = ", ".join(_quoted(p) for p in Q.PUNCTUATION_ONLY)
    return _either(
        [f"{tokens} < {Q.MIN_TOKENS}", f"{text} = ''", f"{text} IN ({listed})"]
        + [f"starts_with({text}, {_quoted(s)})" for s in Q.BAD_STARTS]
    )


def bad_strict_sql(answer: str, tokens: str) -> str:
    text = f"lower({q.safe(answer)})"
    return _either([bad_basic_sql(answer, tokens)] + [f"contains({text}, {_quoted(p)})" for p in Q.BAD_PHRASES])


# Rule texts put before or after the answers: every start, phrase and punctuation text takes its turn.
_MARKS = [""] * 3 + [s + " " for s in Q.BAD_STARTS] + [p.strip() + " " for p in Q.BAD_PHRASES]
_ONLY = list(Q.PUNCTUATION_ONLY) + ["   ", "fine words"]
_MARKS_SQL = "[" + ", ".join(_quoted(m) for m in _MARKS) + "]"
_ONLY_SQL = "[" + ", ".join(_quoted(m) for m in _ONLY) + "]"
_MARKED = (
    f"CASE WHEN length(answer) % 5 = 0 THEN ({_ONLY_SQL})[row_id % {len(_ONLY)} + 1] "
    f"ELSE ({_MARKS_SQL})[row_id % {len(_MARKS)} + 1] || answer END"
)
_TOKENS = "CASE WHEN length(answer) % 5 = 0 THEN length(answer) ELSE len(words) END"


@query(
    "bad_outputs",
    f"""WITH {QA}, a AS (SELECT row_id, unnest({q.texts('human_answers')}) AS answer FROM qa),
        w AS (SELECT *, {q.words('answer')} AS words FROM a),
        m AS (SELECT row_id, {_MARKED} AS answer, {_TOKENS} AS tokens FROM w)
        SELECT row_id, md5(answer) AS digest, tokens::BIGINT AS tokens, {bad_basic_sql('answer', 'tokens')} AS bad_basic,
          {bad_strict_sql('answer', 'tokens')} AS bad_strict, tokens >= 256 AS over_256 FROM m""",
)
def bad_outputs(spark, sf_dir):
    answers = explode_answers(qa(spark, sf_dir), ["human_answers"], ["row_id"])
    counted = answers.withColumn("words", count_words(F.col("answer")))
    only = F.array(*[F.lit(o) for o in _ONLY])
    marks = F.array(*[F.lit(m) for m in _MARKS])
    bare = F.length("answer") % 5 == 0
    marked = counted.select(
        "row_id",
        F.when(bare, F.get(only, (F.col("row_id") % len(_ONLY)).cast("int")))
        .otherwise(F.concat(F.get(marks, (F.col("row_id") % len(_MARKS)).cast("int")), "answer"))
        .alias("answer"),
        F.when(bare, F.length("answer")).otherwise(F.col("words")).cast("long").alias("tokens"),
    )
    answer, tokens = F.col("answer"), F.col("tokens")
    return marked.select(
        "row_id",
        F.md5("answer").alias("digest"),
        "tokens",
        Q.is_bad_basic(answer, tokens).alias("bad_basic"),
        Q.is_bad_strict(answer, tokens).alias("bad_strict"),
        Q.hit_limit(tokens).alias("over_256"),
    )


# The stub generator in SQL: first attempt, then the words backwards where the first one is bad.
def retried_sql(source: str, prompt: str, bad) -> str:
    return f"""first AS (
  SELECT *, {q.words(prompt)} AS words, 'Answer: ' || array_to_string({q.words(prompt)}[1:12], ' ') AS raw FROM {source}),
cleaned AS (SELECT *, {clean_sql('raw')} AS one, {q.n_words('raw')} AS one_tokens FROM first),
judged AS (SELECT *, {bad('one', 'one_tokens')} AS retried FROM cleaned),
settled AS (
  SELECT *, CASE WHEN retried THEN {clean_sql("array_to_string(list_reverse(words), ' ')")} ELSE one END AS answer,
    CASE WHEN retried THEN len(words) ELSE one_tokens END AS token_count FROM judged)"""


@query(
    "retry_once",
    f"""WITH {QA}, asked AS (SELECT row_id, split, {q.safe('question')} AS prompt FROM qa),
        {retried_sql('asked', 'prompt', bad_basic_sql)}
        SELECT row_id, split, answer, token_count::BIGINT AS token_count, retried,
          {bad_basic_sql('answer', 'token_count')} AS bad_output FROM settled""",
)
def retry_once(spark, sf_dir):
    asked = qa(spark, sf_dir).select(
        "row_id", "split", F.lit("plain").alias("prompt_name"), safe_text(F.col("question")).alias("prompt")
    )
    made = generate_with_retry(asked, StubGenerator)
    return made.select(
        "row_id", "split", "answer", F.col("token_count").cast("long").alias("token_count"), "retried", "bad_output"
    )


@query(
    "incremental_answers",
    f"""WITH {QA}, asked AS (SELECT row_id, split, {q.safe('question')} AS prompt FROM qa),
        {retried_sql('asked', 'prompt', bad_basic_sql)}
        SELECT row_id, split, CASE WHEN row_id % 3 = 0 THEN 1 ELSE 0 END AS batch, answer, token_count::BIGINT AS token_count, retried
        FROM settled""",
)
def incremental_answers(spark, sf_dir):
    """Rows that arrive as files, some of them twice, answered by a stream that is run after each arrival."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/arrivals-{uuid.uuid4().hex}"
    asked = qa(spark, sf_dir).select("row_id", "split", F.lit("plain").alias("prompt_name"), safe_text(F.col("question")).alias("prompt"))
    for arrival in (asked.where("row_id % 3 <> 0"), asked.where("row_id % 3 = 0 OR row_id % 2 = 0")):
        arrival.write.mode("append").parquet(f"{path}/in")
        rows = arriving_rows(spark, f"{path}/in", asked.schema, files_per_batch=1_000_000)
        stream = incremental_generation(rows, lambda batch: batch, StubGenerator, f"{path}/out", f"{path}/state")
        stream.awaitTermination()
    return spark.read.parquet(f"{path}/out").select(
        "row_id", "split", F.col("batch").cast("int").alias("batch"), "answer", F.col("token_count").cast("long").alias("token_count"), "retried"
    )


@query(
    "word_overlap",
    f"""WITH {PREPARED}, w AS (SELECT row_id, ai_column, list_distinct({q.lexical('lower(ai_answer)')}) AS g,
          list_distinct({q.lexical('lower(human_answer)')}) AS r FROM prepared WHERE {COMPLETE})
        SELECT row_id, ai_column, len(g)::BIGINT AS generated_words, len(r)::BIGINT AS reference_words,
          round(CASE WHEN len(g) = 0 OR len(r) = 0 THEN 0.0 ELSE len(list_intersect(g, r))::DOUBLE / len(g) END, 6)
          AS overlap FROM w""",
)
def word_overlap(spark, sf_dir):
    from answerloom.operators.flatten import paired
    from answerloom.queries.views import AI_COLUMNS

    pairs = paired(qa(spark, sf_dir), AI_COLUMNS, SEED, ["answer"])
    worded = pairs.select(
        "row_id",
        "ai_column",
        Q.distinct_words(F.col("ai_answer")).alias("g"),
        Q.distinct_words(F.col("human_answer")).alias("r"),
    )
    return worded.select(
        "row_id",
        "ai_column",
        F.size("g").cast("long").alias("generated_words"),
        F.size("r").cast("long").alias("reference_words"),
        F.round(Q.overlap_of_words(F.col("g"), F.col("r")), 6).alias("overlap"),
    )


PILOT_SPECS = (
    PromptSpec("brief", "Reply briefly.\n\n{question}"),
    PromptSpec("chatty", "Reply the way a friend would, in a few lines.\n\n{question}"),
    PromptSpec("terse", "{question}"),
)
GUIDED_SPEC = PromptSpec("guided", "Question:\n{question}\n\nSomebody wrote:\n{human_answer}\n\nYour turn:")


def _literal(text: str) -> str:
    return _quoted(text).replace("\n", "' || chr(10) || '")


def _pilot_prompt(spec: PromptSpec) -> str:
    text = spec.user.replace("{question}", "\x00")
    before, after = text.split("\x00")
    return q.strip(f"({_literal(before)} || question || {_literal(after)})")


@query(
    "prompt_grid",
    f"""WITH {QA}, q AS (SELECT row_id AS question_id, {q.safe('question')} AS question FROM qa),
        grid AS ({' UNION ALL '.join(f"SELECT question_id, question, '{s.name}' AS prompt_style, {_pilot_prompt(s)} AS prompt FROM q" for s in PILOT_SPECS)}),
        {retried_sql('grid', 'prompt', bad_basic_sql)}
        SELECT question_id, question, prompt_style, answer, token_count::BIGINT AS token_count,
          token_count >= 256 AS over_256, {bad_basic_sql('answer', 'token_count')} AS bad_output,
          'stub' AS model_name, CASE WHEN length(answer) <= 500 THEN answer ELSE substr(answer, 1, 500) || '...' END
          AS preview FROM settled""",
)
def pilot_prompt_grid(spark, sf_dir):
    questions = qa(spark, sf_dir).select(F.col("row_id").alias("question_id"), safe_text(F.col("question")).alias("question"))
    grid = pilot_grid(questions, PILOT_SPECS, StubGenerator, "stub")
    return grid.withColumn("preview", preview_of(F.col("answer"))).withColumn(
        "token_count", F.col("token_count").cast("long")
    )


_GUIDED_PROMPT = q.strip(
    "('Question:' || chr(10) || question || chr(10) || chr(10) || 'Somebody wrote:' || chr(10) || human_answer "
    "|| chr(10) || chr(10) || 'Your turn:')"
)


@query(
    "guided_grid",
    f"""WITH {QA}, {FROZEN},
        pairs AS (SELECT row_id AS question_id, {q.safe('question')} AS question,
          selected_human_answer AS human_answer FROM frozen),
        grid AS (SELECT *, {_GUIDED_PROMPT} AS prompt FROM pairs),
        {retried_sql('grid', 'prompt', bad_strict_sql)},
        w AS (SELECT *, list_distinct({q.lexical('lower(answer)')}) AS g,
          list_distinct({q.lexical('lower(human_answer)')}) AS r FROM settled)
        SELECT question_id, question, md5(human_answer) AS reference_digest, 'guided' AS prompt_style,
          md5(answer) AS answer_digest, token_count::BIGINT AS token_count, token_count >= 180 AS hit_limit,
          {bad_strict_sql('answer', 'token_count')} AS bad_output, 'stub' AS model_name,
          round(CASE WHEN len(g) = 0 OR len(r) = 0 THEN 0.0 ELSE len(list_intersect(g, r))::DOUBLE / len(g) END, 6)
          AS word_overlap_with_human FROM w""",
)
def guided_grid(spark, sf_dir):
    rows = C.with_human_answer(qa(spark, sf_dir), SEED)
    pairs = rows.select(
        F.col("row_id").alias("question_id"), safe_text(F.col("question")).alias("question"), "human_answer"
    )
    grid = guided_pilot(pairs, GUIDED_SPEC, StubGenerator, "stub")
    return grid.select(
        "question_id",
        "question",
        F.md5("human_answer_reference").alias("reference_digest"),
        "prompt_style",
        F.md5("generated_answer").alias("answer_digest"),
        F.col("token_count").cast("long").alias("token_count"),
        "hit_limit",
        "bad_output",
        "model_name",
        F.round("word_overlap_with_human", 6).alias("word_overlap_with_human"),
    )

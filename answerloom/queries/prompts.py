"""Prompt selection, context, rendering, generation values, merging generated answers."""

import uuid
from string import Formatter

from pyspark.sql import functions as F

from answerloom.operators import corpus as C
from answerloom.operators import generation as G
from answerloom.operators import prompts as P
from answerloom.queries import sql as q
from answerloom.queries.registry import query
from answerloom.queries.sampling import FROZEN, order_sql
from answerloom.queries.views import GENERATIONS, QA, SEED, STUB_PROMPTS, documents, generations, qa, table
from answerloom.session import checkpoint_dir, stage
from answerloom.sources import columns as apart
from answerloom.sources import corpus
from answerloom.sources.generations import read_shards, write_shards
from answerloom.sources.prompts import EXAMPLE_SPECS

NAMES = [s.name for s in EXAMPLE_SPECS]


@query(
    "select_prompts",
    """SELECT 'conv_' || conv_id AS name, max(text) FILTER (role = 'system') AS system, arg_min(text, turn) FILTER
          (role = 'user') AS "user" FROM conversations GROUP BY conv_id
       HAVING 'conv_' || conv_id IN (SELECT 'conv_' || doc_id FROM labels WHERE quality = 1)""",
)
def select_prompts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    specs = turns.groupBy("conv_id").agg(
        F.max(F.when(F.col("role") == "system", F.col("text"))).alias("system"),
        F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("user"),
    )
    specs = specs.select(F.concat(F.lit("conv_"), "conv_id").alias("name"), "system", "user")
    wanted = table(spark, sf_dir, "labels").where("quality = 1")
    return P.select_prompts(specs, wanted.select(F.concat(F.lit("conv_"), "doc_id").alias("name")))


RANDOM_OTHER = f"""{QA}, {FROZEN},
pool AS (
  SELECT split, row_id, question, source, selected_human_answer, selected_human_answer <> '' AS has,
    count(*) FILTER (selected_human_answer <> '') OVER (PARTITION BY split) AS pool_n FROM frozen),
ranked AS (
  SELECT *, CASE WHEN has THEN row_number() OVER (PARTITION BY split, has
    ORDER BY {order_sql('split', 'row_id')}, split, row_id) - 1 END AS rank FROM pool),
styles(prompt_name) AS (VALUES {', '.join(f"('{n}')" for n in NAMES)}),
tickets AS (
  SELECT *, {q.hash60(str(SEED), 'split', 'row_id', 'prompt_name', "'random_human'")} AS ticket FROM ranked, styles),
drawn AS (
  SELECT *, CASE WHEN pool_n = 0 THEN NULL WHEN rank IS NULL THEN ticket % pool_n WHEN pool_n = 1 THEN 0
    ELSE ticket % (pool_n - 1) + (CASE WHEN ticket % (pool_n - 1) >= rank THEN 1 ELSE 0 END) END AS target
  FROM tickets),
met AS (
  SELECT d.*, coalesce(o.selected_human_answer, '') AS random_human_answer
  FROM drawn d LEFT JOIN ranked o ON o.split = d.split AND o.rank = d.target)"""


@query("random_other_answer", f"WITH {RANDOM_OTHER} SELECT row_id, split, prompt_name, random_human_answer FROM met")
def random_other_answer(spark, sf_dir):
    rows = C.with_human_answer(qa(spark, sf_dir), SEED)
    return P.random_other_answer(stage(rows.select("split", "row_id", "human_answer")), SEED, NAMES)


_OTHER_FIRST = "contains(prompt_name, 'random_human')"
_BOUNDS = q.bounds(
    f"(CASE WHEN {_OTHER_FIRST} THEN random_human_word_count ELSE selected_human_word_count END)",
    f"(CASE WHEN {_OTHER_FIRST} THEN selected_human_word_count ELSE random_human_word_count END)",
)

CONTEXT = f"""{RANDOM_OTHER},
counted AS (
  SELECT row_id, split, prompt_name, {q.safe('question')} AS question, {q.safe('source')} AS source,
    row_id AS row_index, selected_human_answer, selected_human_answer AS actual_human_answer,
    {q.n_words('selected_human_answer')} AS selected_human_word_count, random_human_answer,
    {q.n_words('random_human_answer')} AS random_human_word_count FROM met),
context AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _BOUNDS.items())} FROM counted)"""

_COUNTS = ["selected_human_word_count", "random_human_word_count", *_BOUNDS]


@query(
    "prompt_context",
    f"""WITH {CONTEXT} SELECT row_id, prompt_name, split, question, source, row_index,
        md5(selected_human_answer) AS selected_digest, md5(actual_human_answer) AS actual_digest,
        md5(random_human_answer) AS random_digest, {', '.join(f'{c}::BIGINT AS {c}' for c in _COUNTS)} FROM context""",
)
def prompt_context(spark, sf_dir):
    context = P.prompt_context(qa(spark, sf_dir), NAMES, SEED, staged=True)
    digests = {"selected_digest": "selected_human_answer", "actual_digest": "actual_human_answer", "random_digest": "random_human_answer"}
    return (
        context.withColumns({d: F.md5(c) for d, c in digests.items()})
        .withColumns({c: F.col(c).cast("long") for c in _COUNTS})
        .drop(*digests.values())
    )


def _render_sql(template: str) -> str:
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append("'" + literal.replace("'", "''") + "'")
        if name:
            parts.append(q.safe(f"{name}::VARCHAR"))
    return q.strip("(" + " || ".join(parts) + ")")


def _by_style(template_of) -> str:
    cases = [
        f"WHEN '{s.name}' THEN {_render_sql(template_of(s)) if template_of(s) else 'NULL'}" for s in EXAMPLE_SPECS
    ]
    return f"CASE prompt_name {' '.join(cases)} END"


_PLAIN = (
    "CASE WHEN coalesce(system_prompt, '') = '' THEN user_prompt ELSE 'System:' || chr(10) || system_prompt || "
    "chr(10) || chr(10) || 'User:' || chr(10) || user_prompt || chr(10) || chr(10) || 'Assistant:' || chr(10) END"
)


@query(
    "rendered_prompts",
    f"""WITH {CONTEXT}, filled AS (SELECT row_id, split, prompt_name, {_by_style(lambda s: s.user)} AS user_prompt,
          {_by_style(lambda s: s.system)} AS system_prompt FROM context)
        SELECT row_id, split, prompt_name, md5(user_prompt) AS user_digest, system_prompt, md5({_PLAIN}) AS prompt_digest,
          CASE WHEN coalesce(system_prompt, '') = '' THEN 'user' ELSE 'system,user' END AS roles FROM filled""",
)
def rendered_prompts(spark, sf_dir):
    made = P.build_prompts(qa(spark, sf_dir), EXAMPLE_SPECS, SEED, staged=True)
    return made.select(
        "row_id",
        "split",
        "prompt_name",
        F.md5("user_prompt").alias("user_digest"),
        "system_prompt",
        F.md5("prompt").alias("prompt_digest"),
        F.array_join("messages.role", ",").alias("roles"),
    )


_SPEC_VALUES = {
    "max_new_tokens": "CASE WHEN quality IS NOT NULL THEN CAST(n_chars - 150 AS INT) END",
    "do_sample": "quality = 1",
    "temperature": "CASE WHEN toxic = 0 THEN CAST((n_chars - 200) / 1000.0 AS DOUBLE) END",
    "top_p": "CASE WHEN doc_id % 2 = 0 THEN CAST(n_chars / 4000.0 AS DOUBLE) END",
    "num_beams": "CAST(n_chars % 5 AS INT)",
    "num_return_sequences": "CASE WHEN toxic = 1 THEN 3 WHEN doc_id % 31 = 0 THEN 0 END",
}


@query(
    "generation_params",
    f"""WITH specs AS (SELECT 'doc_' || d.doc_id AS name, {', '.join(f'{v} AS {k}' for k, v in _SPEC_VALUES.items())}
          FROM documents d LEFT JOIN (SELECT doc_id AS id, quality, toxic FROM labels) l ON l.id = d.doc_id),
        m AS (SELECT name, coalesce(max_new_tokens, 170) AS max_new_tokens, coalesce(do_sample, true) AS do_sample,
          coalesce(temperature, 0.7) AS temperature, coalesce(top_p, 0.9) AS top_p, coalesce(num_beams, 1) AS num_beams,
          coalesce(num_return_sequences, 1) AS num_return_sequences FROM specs)
        SELECT name, max_new_tokens, do_sample, num_return_sequences,
          CASE WHEN do_sample THEN round(temperature::DOUBLE, 6) END AS temperature,
          CASE WHEN do_sample THEN round(top_p::DOUBLE, 6) END AS top_p,
          CASE WHEN NOT do_sample THEN greatest(num_beams, num_return_sequences) END AS num_beams,
          CASE WHEN max_new_tokens <= 0 THEN 'max_new_tokens must be > 0.'
            WHEN num_return_sequences <= 0 THEN 'num_return_sequences must be > 0.'
            WHEN do_sample AND temperature <= 0 THEN 'temperature must be > 0 when sampling.'
            WHEN do_sample AND (top_p <= 0 OR top_p > 1) THEN 'top_p must be in (0, 1].'
            WHEN NOT do_sample AND num_beams <= 0 THEN 'num_beams must be > 0.' END AS problem FROM m""",
)
def generation_params(spark, sf_dir):
    labelled = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    specs = labelled.select(
        F.concat(F.lit("doc_"), "doc_id").alias("name"), *[F.expr(v).alias(k) for k, v in _SPEC_VALUES.items()]
    )
    params = P.generation_params(specs)
    return params.withColumns({c: F.round(c, 6) for c in ("temperature", "top_p")})


@query(
    "merge_generations",
    f"""WITH {QA}, {GENERATIONS} SELECT qa.row_id, qa.split, p.answer AS ai_stub_plain, c.answer AS ai_stub_casual,
          p.prompt AS prompt_ai_stub_plain FROM qa
        LEFT JOIN latest p ON p.split = qa.split AND p.row_id = qa.row_id AND p.prompt_name = 'plain'
        LEFT JOIN latest c ON c.split = qa.split AND c.row_id = qa.row_id AND c.prompt_name = 'casual'""",
)
def merge_generations(spark, sf_dir):
    rows = qa(spark, sf_dir).select("split", "row_id")
    specs = {s.name: s for s in EXAMPLE_SPECS}
    tasks = [
        G.Task(specs["plain"], "ai_stub_plain", "prompt_ai_stub_plain"),
        G.Task(specs["casual"], "ai_stub_casual"),
    ]
    return G.merge_generations(rows, generations(spark, sf_dir), tasks)


@query(
    "merge_one_split",
    f"""WITH {QA}, {GENERATIONS} SELECT qa.row_id, qa.split,
          CASE WHEN qa.split = 'eval' THEN p.answer ELSE 'before ' || qa.row_id END AS ai_stub_plain,
          CASE WHEN qa.split = 'eval' THEN c.answer END AS ai_stub_casual FROM qa
        LEFT JOIN latest p ON p.split = qa.split AND p.row_id = qa.row_id AND p.prompt_name = 'plain'
        LEFT JOIN latest c ON c.split = qa.split AND c.row_id = qa.row_id AND c.prompt_name = 'casual'""",
)
def merge_one_split(spark, sf_dir):
    """One split overwritten, the answers of the other one kept; a new column filled in one split only."""
    rows = qa(spark, sf_dir).select("split", "row_id", F.concat(F.lit("before "), "row_id").alias("ai_stub_plain"))
    specs = {s.name: s for s in EXAMPLE_SPECS}
    tasks = [G.Task(specs["plain"], "ai_stub_plain"), G.Task(specs["casual"], "ai_stub_casual")]
    return G.merge_generations(rows, generations(spark, sf_dir), tasks, splits=["eval"])


@query(
    "versioned_columns",
    f"""WITH {QA}, {GENERATIONS} SELECT qa.row_id, qa.split, qa.question,
          CASE WHEN qa.split = 'eval' THEN c.answer ELSE p.answer END AS ai_stub,
          CASE WHEN qa.split = 'eval' THEN c.answer END AS ai_stub_casual FROM qa
        LEFT JOIN latest p ON p.split = qa.split AND p.row_id = qa.row_id AND p.prompt_name = 'plain'
        LEFT JOIN latest c ON c.split = qa.split AND c.row_id = qa.row_id AND c.prompt_name = 'casual'""",
)
def versioned_columns(spark, sf_dir):
    """Three versions: the wide rows, a column for all rows, and one split of it replaced along with a new column."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/versions-{uuid.uuid4().hex}"
    specs = {s.name: s for s in EXAMPLE_SPECS}
    made = generations(spark, sf_dir)
    apart.publish_base(qa(spark, sf_dir).select("row_id", "split", "question"), path, buckets=8)
    apart.publish_columns(G.generated_columns(made, [G.Task(specs["plain"], "ai_stub")]), path)
    both = [G.Task(specs["casual"], "ai_stub"), G.Task(specs["casual"], "ai_stub_casual")]
    apart.publish_columns(G.generated_columns(made.where("split = 'eval'"), both), path)
    return corpus.load(spark, path, columns=["ai_stub", "ai_stub_casual"])


@query(
    "ingest_shards",
    f"""WITH {QA}, {GENERATIONS} SELECT qa.row_id, qa.split, qa.question, p.answer AS ai_stub_plain, p.prompt AS prompt_ai_stub_plain,
          c.answer AS ai_stub_casual FROM qa
        LEFT JOIN latest p ON p.split = qa.split AND p.row_id = qa.row_id AND p.prompt_name = 'plain'
        LEFT JOIN latest c ON c.split = qa.split AND c.row_id = qa.row_id AND c.prompt_name = 'casual'""",
)
def ingest_shards(spark, sf_dir):
    """Records written as line files by split, style and rank, read again, and added to the corpus as columns."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    specs = {s.name: s for s in EXAMPLE_SPECS}
    tasks = [G.Task(specs["plain"], "ai_stub_plain", "prompt_ai_stub_plain"), G.Task(specs["casual"], "ai_stub_casual")]
    write_shards(generations(spark, sf_dir), f"{path}/shards")
    apart.publish_base(qa(spark, sf_dir).select("row_id", "split", "question"), f"{path}/corpus", buckets=8)
    apart.publish_columns(G.generated_columns(read_shards(spark, f"{path}/shards/*.jsonl"), tasks), f"{path}/corpus")
    return corpus.load(spark, f"{path}/corpus")


@query(
    "missing_answers",
    f"""WITH {QA}, {GENERATIONS}, styles(prompt_name) AS (VALUES {', '.join(f"('{n}')" for n in STUB_PROMPTS)})
        SELECT qa.split, qa.row_id, styles.prompt_name FROM qa CROSS JOIN styles WHERE NOT EXISTS (
          SELECT 1 FROM latest l WHERE l.split = qa.split AND l.row_id = qa.row_id
            AND l.prompt_name = styles.prompt_name AND l.answer IS NOT NULL)""",
)
def missing_answers(spark, sf_dir):
    return G.missing_answers(qa(spark, sf_dir), generations(spark, sf_dir), STUB_PROMPTS)


@query(
    "stray_records",
    f"""WITH {QA}, {GENERATIONS} SELECT split, row_id, prompt_name, answer FROM generations g WHERE NOT EXISTS
        (SELECT 1 FROM qa WHERE qa.split = g.split AND qa.row_id = g.row_id)""",
)
def stray_records(spark, sf_dir):
    stray = G.stray_records(qa(spark, sf_dir), generations(spark, sf_dir))
    return stray.select("split", "row_id", "prompt_name", "answer")

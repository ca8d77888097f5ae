"""Seeded choices, exact-size cuts and samples."""

from pyspark.sql import functions as F

from answerloom.functions.text import head_answers, omitted_answers, pick
from answerloom.operators import corpus as C
from answerloom.operators import sampling as S
from answerloom.operators.reports import example_report
from answerloom.queries import sql as q
from answerloom.queries.corpus import FLAT, USABLE_SQL, flat_examples
from answerloom.queries.registry import query
from answerloom.queries.views import AI_COLUMNS, QA, SEED, qa
from answerloom.session import stage

SUBSAMPLE = 500
SHOWN_ROWS = 25
HEAD = 3


def order_sql(*ids: str) -> str:
    return f"md5({q.key(str(SEED), *ids)})"


FROZEN = f"""frozen_texts AS (SELECT *, {q.texts('human_answers')} AS answers FROM qa),
frozen_index AS (
  SELECT *, {q.hash32(str(SEED), 'split', 'row_id', "'selected_human_answer'")} % greatest(len(answers), 1) AS pos
  FROM frozen_texts),
frozen AS (
  SELECT *, coalesce(answers[pos + 1], '') AS selected_human_answer,
    CASE WHEN len(answers) > 0 THEN pos ELSE -1 END AS selected_human_answer_index FROM frozen_index)"""


@query(
    "seeded_pick",
    f"""WITH {QA},
        t AS (SELECT row_id, split, {q.texts('chatgpt_answers')} AS c, {q.texts('ai_m1_guided')} AS g FROM qa),
        h AS (SELECT *, {q.hash32(str(SEED), 'split', 'row_id', "'chatgpt_answers'")} AS hc,
          {q.hash32(str(SEED), 'split', 'row_id', "'ai_m1_guided'")} AS hg FROM t)
        SELECT row_id, coalesce(c[hc % greatest(len(c), 1) + 1], '') AS original_text,
          coalesce(g[hg % greatest(len(g), 1) + 1], '') AS guided_text,
          CASE WHEN len(g) > 0 THEN hg % len(g) END AS guided_index FROM h""",
)
def seeded_pick(spark, sf_dir):
    df = qa(spark, sf_dir)
    ids = (F.col("split"), F.col("row_id"))
    listed = df.select("row_id", "split", *[C.texts_of(df, c).alias(c) for c in ("chatgpt_answers", "ai_m1_guided")])
    return listed.select(
        "row_id",
        pick(F.col("chatgpt_answers"), SEED, *ids, "chatgpt_answers").alias("c"),
        pick(F.col("ai_m1_guided"), SEED, *ids, "ai_m1_guided").alias("g"),
    ).select(
        "row_id",
        F.col("c.text").alias("original_text"),
        F.col("g.text").alias("guided_text"),
        F.col("g.pick_index").cast("long").alias("guided_index"),
    )


@query(
    "freeze_human",
    f"""WITH {QA}, {FROZEN} SELECT row_id, split, selected_human_answer,
        selected_human_answer_index::BIGINT AS selected_human_answer_index FROM frozen""",
)
def freeze_human(spark, sf_dir):
    frozen = C.freeze_human(qa(spark, sf_dir), SEED)
    return frozen.select(
        "row_id", "split", "selected_human_answer", F.col("selected_human_answer_index").cast("long").alias("selected_human_answer_index")
    )


@query(
    "permuted_rows",
    f"""WITH {QA} SELECT row_id, split,
        row_number() OVER (ORDER BY {order_sql('split', 'row_id')}, split, row_id) - 1 AS position FROM qa""",
)
def permuted_rows(spark, sf_dir):
    return S.permute(qa(spark, sf_dir).select("split", "row_id"), SEED)


@query(
    "train_eval_split",
    f"""WITH {QA},
        placed AS (SELECT *, row_number() OVER (ORDER BY {order_sql('split', 'row_id')}, split, row_id) - 1 AS position,
          count(*) OVER () AS available FROM qa WHERE {USABLE_SQL}),
        sized AS (SELECT *, available * 6 // 10 AS t, available * 2 // 10 AS e FROM placed)
        SELECT CASE WHEN position < t THEN 'train' ELSE 'eval' END AS split,
          CASE WHEN position < t THEN position ELSE position - t END AS row_id,
          split AS origin_split, row_id AS origin_index, source FROM sized WHERE position < t + e""",
)
def train_eval_split(spark, sf_dir):
    rows = C.usable_rows(C.with_origin(qa(spark, sf_dir)))
    sizes = stage(S.bucket_sizes(rows, SEED, ["split", "row_id"]))
    available = sizes.agg(F.sum("_n")).first()[0]
    cut = S.train_eval_split(rows, available * 6 // 10, available * 2 // 10, SEED, sizes=sizes)
    return cut.select("split", "row_id", "origin_split", "origin_index", "source")


@query(
    "subsample_examples",
    f"""WITH {FLAT}, placed AS (SELECT *, row_number() OVER (PARTITION BY split, ai_column
          ORDER BY {order_sql('example_id', 'ai_column')}, example_id, ai_column) AS place FROM flat)
        SELECT example_id, split, ai_column, source, label::BIGINT AS label FROM placed WHERE place <= {SUBSAMPLE}""",
)
def subsample_examples(spark, sf_dir):
    drawn = S.subsample(flat_examples(spark, sf_dir), SUBSAMPLE, SEED)
    return drawn.select("example_id", "split", "ai_column", "source", F.col("label").cast("long").alias("label"))


@query(
    "sample_rows",
    f"""WITH {QA} SELECT row_id, source FROM qa WHERE split = 'eval'
        ORDER BY {order_sql('split', 'row_id')}, split, row_id LIMIT {SHOWN_ROWS}""",
)
def sample_rows(spark, sf_dir):
    rows = C.resolve_splits(qa(spark, sf_dir), ["eval"])
    return S.sample_rows(rows, SHOWN_ROWS, SEED).orderBy("row_id").select("row_id", "source")


@query(
    "answer_list_head",
    f"""WITH {QA}, t AS (SELECT row_id, {q.texts('human_answers')} AS answers FROM qa)
        SELECT row_id, array_to_string(answers[1:{HEAD}], ' | ') AS shown,
          greatest(len(answers) - {HEAD}, 0)::BIGINT AS omitted FROM t""",
)
def answer_list_head(spark, sf_dir):
    df = qa(spark, sf_dir)
    listed = df.select("row_id", C.texts_of(df, "human_answers").alias("answers"))
    return listed.select(
        "row_id",
        F.array_join(head_answers(F.col("answers"), HEAD), " | ").alias("shown"),
        omitted_answers(F.col("answers"), HEAD).cast("long").alias("omitted"),
    )


_BLOCK_CUT = 200


def _cut(x: str) -> str:
    return f"CASE WHEN length({x}) > {_BLOCK_CUT} THEN rtrim({x}[1:{_BLOCK_CUT - 3}], '{q._TRIM_SET}') || '...' ELSE {x} END"


def _block(label: str, answers: str, most: int) -> str:
    shown = f"{answers}[1:{most}]"
    numbered = (
        f"list_transform(range(1, len({shown}) + 1), lambda i: CASE WHEN len({shown}) = 1 THEN '  ' "
        f"ELSE '  [' || i || '] ' END || {_cut(f'({shown})[i]')})"
    )
    more = (
        f"CASE WHEN len({answers}) > {most} THEN ['  [... ' || (len({answers}) - {most}) || ' more answer(s) omitted]'] "
        "ELSE []::VARCHAR[] END"
    )
    body = f"CASE WHEN len({answers}) = 0 THEN ['  [missing]'] ELSE list_concat({numbered}, {more}) END"
    return f"list_concat(['{label}:'], {body})"


@query(
    "example_report",
    f"""WITH {QA}, {FROZEN},
        sampled AS (SELECT *, {q.safe('question')} AS asked,
            CASE WHEN {q.safe('source')} = '' THEN 'unknown' ELSE {q.safe('source')} END AS src,
            {q.texts('chatgpt_answers')} AS c, {q.one_text('ai_m1_basic')} AS b, {q.texts('ai_m1_guided')} AS g,
            CASE WHEN selected_human_answer = '' THEN []::VARCHAR[] ELSE [selected_human_answer] END AS h
          FROM frozen WHERE split = 'eval' ORDER BY {order_sql('split', 'row_id')}, split, row_id LIMIT {SHOWN_ROWS}),
        body AS (SELECT row_id AS sample_no, list_concat(
            [repeat('=', 100), 'row=' || row_id || ' | source=' || src, '', 'Question:', '  ' || {_cut('asked')}, ''],
            {_block('Human answer', 'h', 1)},
            [''], {_block('AI answer - chatgpt_answers', 'c', 2)}, [''], {_block('AI answer - ai_m1_basic', 'b', 2)},
            [''], {_block('AI answer - ai_m1_guided', 'g', 2)}, ['']) AS lines FROM sampled),
        head AS (SELECT -1 AS sample_no, ['Random Dataset Examples', 'Split: eval',
            'Rows in split: ' || format('{{:,}}', (SELECT count(*) FROM qa WHERE split = 'eval')),
            'AI columns: chatgpt_answers, ai_m1_basic, ai_m1_guided'] AS lines)
        SELECT sample_no, line_no - 1 AS line_no, lines[line_no] AS line FROM
          (SELECT sample_no, lines, unnest(range(1, len(lines) + 1)) AS line_no
           FROM (SELECT * FROM body UNION ALL SELECT * FROM head))
        UNION ALL SELECT -1, row_id + 4, 'Sampled row: ' || row_id FROM sampled""",
)
def sampled_report(spark, sf_dir):
    df = qa(spark, sf_dir)
    columns = C.resolve_example_columns(df)
    lines = example_report(df, "eval", columns, SHOWN_ROWS, SEED, max_answers=2, max_chars=_BLOCK_CUT)
    return lines.withColumn("line_no", F.col("line_no").cast("long"))


__all__ = ["AI_COLUMNS", "FROZEN", "order_sql"]

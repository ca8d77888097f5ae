"""Windows, counts, bounds, identifiers, truncation, invisible characters, tokens."""

from pyspark.sql import functions as F

from answerloom.functions import text as T
from answerloom.functions.invisible import describe_invisibles, invisible_count
from answerloom.functions.naming import generated_column, sanitize
from answerloom.operators.reports import input_facts, input_report, truncated_tokens
from answerloom.queries import sql as q
from answerloom.queries.corpus import FLAT, flat_examples
from answerloom.queries.corpus import WINDOW as FLAT_WINDOW
from answerloom.queries.registry import query
from answerloom.queries.sampling import order_sql
from answerloom.queries.views import AI_COLUMNS, SEED, documents, qa, table

WINDOW = 40
CUT = 120
HARD_CUT = 1200
MAX_TOKENS = 64
SHOWN_TOKENS = 16


@query(
    "answer_windows",
    f"""WITH w AS (SELECT doc_id, source, {q.safe('text')} AS answer, {q.words(q.safe('text'))} AS words FROM documents),
        n AS (SELECT *, len(words)::BIGINT AS n FROM w),
        s AS (SELECT *, CASE WHEN n > {WINDOW} THEN
            {q.hash32(str(SEED), 'source', 'doc_id', "'text'", "'answer_window'", str(WINDOW))} % (n - {WINDOW} + 1)
            ELSE 0 END AS win FROM n)
        SELECT doc_id, win::BIGINT AS window_start, (win + least(n, {WINDOW}))::BIGINT AS window_end, n AS word_count,
          CASE WHEN n > {WINDOW} THEN array_to_string(words[win + 1 : win + {WINDOW}], ' ') ELSE answer END AS answer
        FROM s""",
)
def answer_windows(spark, sf_dir):
    worded = documents(spark, sf_dir).select("doc_id", "source", T.safe_text(F.col("text")).alias("text"))
    worded = worded.withColumn("words", T.split_words(F.col("text")))
    span = T.window_span(F.size("words"), WINDOW, SEED, F.col("source"), F.col("doc_id"), "text")
    return worded.withColumn("span", span).select(
        "doc_id",
        F.col("span.start").cast("long").alias("window_start"),
        F.col("span.stop").cast("long").alias("window_end"),
        F.size("words").cast("long").alias("word_count"),
        T.windowed_text(F.col("text"), F.col("words"), F.col("span.start"), F.col("span.stop")).alias("answer"),
    )


@query(
    "word_counts",
    f"""SELECT doc_id, {q.n_words(q.safe('text'))}::BIGINT AS whitespace_words,
        len({q.lexical('text')})::BIGINT AS lexical_words, length(text)::BIGINT AS chars FROM documents""",
)
def word_counts(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id",
        T.count_words(F.col("text")).cast("long").alias("whitespace_words"),
        T.count_lexical_words(F.col("text")).cast("long").alias("lexical_words"),
        F.length("text").cast("long").alias("chars"),
    )


_BOUNDS = q.bounds("first_line", "all_words")


@query(
    "word_bounds",
    f"""WITH c AS (SELECT doc_id, {q.n_words(q.safe("string_split(text, chr(10))[2]"))} AS first_line,
          {q.n_words(q.safe('text'))} AS all_words FROM documents)
        SELECT doc_id, {', '.join(f'({v})::BIGINT AS {k}' for k, v in _BOUNDS.items())} FROM c""",
)
def word_bounds(spark, sf_dir):
    second = F.get(F.split("text", "\n"), F.lit(1))
    counted = documents(spark, sf_dir).select(
        "doc_id", T.count_words(second).alias("a"), T.count_words(F.col("text")).alias("b")
    )
    bounded = counted.select("doc_id", T.word_bounds(F.col("a"), F.col("b")).alias("w")).select("doc_id", "w.*")
    return bounded.select("doc_id", *[F.col(c).cast("long").alias(c) for c in _BOUNDS])


def _sanitize_sql(x: str, fallback: str) -> str:
    base = f"lower(trim(regexp_replace({x}, '[^0-9A-Za-z]+', '_', 'g'), '_'))"
    named = f"CASE WHEN {base} = '' THEN '{fallback}' ELSE {base} END"
    safe = f"CASE WHEN regexp_matches({named}, '^[0-9]') THEN '{fallback}_' || {named} ELSE {named} END"
    cut = f"rtrim(substr({safe}, 1, 96), '_')"
    return f"CASE WHEN {cut} = '' THEN '{fallback}' ELSE {cut} END"


@query(
    "sanitize_names",
    f"""SELECT page_id, {_sanitize_sql('url', 'value')} AS url_name, {_sanitize_sql('html', 'value')} AS html_name,
        'ai_' || {_sanitize_sql('reverse(url)', 'model')} || '_' || {_sanitize_sql('html', 'prompt')} AS column_name
        FROM pages""",
)
def sanitize_names(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        "page_id",
        sanitize(F.col("url")).alias("url_name"),
        sanitize(F.col("html")).alias("html_name"),
        generated_column(F.reverse("url"), F.col("html")).alias("column_name"),
    )


@query(
    "truncate_text",
    f"""WITH t AS (SELECT doc_id, {q.safe('text')} AS x FROM documents)
        SELECT doc_id, CASE WHEN length(x) > {CUT} THEN rtrim(substr(x, 1, {CUT - 3}), '{q._TRIM_SET}') || '...' ELSE x END
          AS short, md5(substr(x, 1, {HARD_CUT})) AS hard_digest,
          md5(replace(x, chr(10), chr(10) || '  ')) AS indented_digest FROM t""",
)
def truncate_text(spark, sf_dir):
    text = F.col("text")
    return documents(spark, sf_dir).select(
        "doc_id",
        T.truncate(text, CUT).alias("short"),
        F.md5(T.hard_cut(text, HARD_CUT)).alias("hard_digest"),
        F.md5(T.indent_lines(T.safe_text(text))).alias("indented_digest"),
    )


# Invisible characters placed into the whole texts: zero-width space, byte order mark,
# a control character, a private-use character.
_PLANTED = {" the ": " ​the ", " de ": " de﻿ ", "ing ": "ing\x1f ", ", ": ", "}


def _planted(c):
    for plain, marked in _PLANTED.items():
        c = F.replace(c, F.lit(plain), F.lit(marked))
    return c


def _planted_sql(x: str) -> str:
    for plain, marked in _PLANTED.items():
        x = f"replace({x}, '{plain}', '{marked}')"
    return x


_INVISIBLE_SQL = r"[\p{Cc}\p{Cf}\p{Co}]"
_NAMES_SQL = "CASE cp WHEN 8203 THEN 'ZERO WIDTH SPACE' WHEN 65279 THEN 'ZERO WIDTH NO-BREAK SPACE' ELSE 'UNKNOWN' END"


@query(
    "invisible_chars",
    rf"""WITH m AS (SELECT doc_id, {_planted_sql('text')} AS x FROM documents),
        h AS (SELECT doc_id, string_split(x, '') AS chars FROM m),
        p AS (SELECT doc_id, unnest(chars) AS ch, unnest(range(0, len(chars))) AS position FROM h),
        k AS (SELECT *, unicode(ch) AS cp FROM p WHERE regexp_matches(ch, '{_INVISIBLE_SQL}')
              AND unicode(ch) NOT IN (9, 10, 13))
        SELECT doc_id, position, 'U+' || lpad(upper(to_hex(cp)), greatest(4, length(to_hex(cp)))::INT, '0') AS code_point,
          CASE WHEN regexp_matches(ch, '\p{{Cc}}') THEN 'Cc' WHEN regexp_matches(ch, '\p{{Cf}}') THEN 'Cf' ELSE 'Co' END
          AS category, {_NAMES_SQL} AS character_name FROM k""",
)
def invisible_chars(spark, sf_dir):
    marked = documents(spark, sf_dir).select("doc_id", _planted(F.col("text")).alias("text"))
    found = describe_invisibles(marked, "text", ["doc_id"])
    return found.withColumn("position", F.col("position").cast("long"))


@query(
    "invisible_counts",
    rf"""SELECT doc_id, (length(x) - length(regexp_replace(x, '{_INVISIBLE_SQL}', '', 'g'))
          - len(regexp_extract_all(x, '[\t\n\r]')))::BIGINT AS invisible
        FROM (SELECT doc_id, {_planted_sql('text')} AS x FROM documents)""",
)
def invisible_counts(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", invisible_count(_planted(F.col("text"))).cast("long").alias("invisible")
    )


@query(
    "tokens_truncated",
    f"""WITH t AS (SELECT doc_id, {q.words(q.safe('text'))} AS words FROM documents)
        SELECT doc_id, array_to_string(words[1:{MAX_TOKENS}], ' ') AS tokens, len(words)::BIGINT AS token_total FROM t""",
)
def tokens_truncated(spark, sf_dir):
    cut = truncated_tokens(documents(spark, sf_dir), "text", MAX_TOKENS)
    return cut.select(
        "doc_id", F.array_join("tokens", " ").alias("tokens"), F.col("token_total").cast("long").alias("token_total")
    )


@query(
    "input_inspection",
    rf"""WITH {FLAT},
        t AS (SELECT *, 'Question: ' || question || chr(10) || chr(10) || 'Answer: ' || answer AS text FROM flat),
        w AS (SELECT *, {q.words('text')} AS tokens FROM t)
        SELECT example_id, ai_column, length(text)::BIGINT AS raw_character_count,
          len(tokens)::BIGINT AS whitespace_word_count, least(len(tokens), {MAX_TOKENS})::BIGINT AS token_count,
          len(tokens) > {MAX_TOKENS} AS truncated,
          array_to_string(tokens[1:{SHOWN_TOKENS}], ' ') AS shown_tokens,
          array_to_string(list_transform(tokens[1:{SHOWN_TOKENS}], lambda e: {q.hash32('e')}), ' ') AS shown_ids,
          md5(array_to_string(tokens[1:{MAX_TOKENS}], ' ')) AS decoded_digest,
          (length(text) - length(regexp_replace(text, '{_INVISIBLE_SQL}', '', 'g'))
          - len(regexp_extract_all(text, '[\t\n\r]')))::BIGINT AS invisible_control_chars FROM w""",
)
def input_inspection(spark, sf_dir):
    facts = input_facts(flat_examples(spark, sf_dir), MAX_TOKENS)
    longs = ["raw_character_count", "whitespace_word_count", "token_count", "invisible_control_chars"]
    return facts.select(
        "example_id",
        "ai_column",
        *[F.col(c).cast("long").alias(c) for c in longs],
        "truncated",
        F.array_join(F.slice("_audit.tokens", 1, SHOWN_TOKENS), " ").alias("shown_tokens"),
        F.array_join(F.slice("_audit.input_ids", 1, SHOWN_TOKENS), " ").alias("shown_ids"),
        F.md5("_audit.decoded").alias("decoded_digest"),
    )


SAMPLED, FACT_LINES = 4, 16


@query(
    "input_report_lines",
    rf"""WITH {FLAT},
        pairs AS (SELECT DISTINCT ai_column, split, row_id FROM flat WHERE split = 'eval'),
        placed AS (SELECT *, count(*) OVER (PARTITION BY ai_column) AS available,
          row_number() OVER (PARTITION BY ai_column ORDER BY {order_sql('split', 'row_id')}, split, row_id) AS place FROM pairs),
        chosen AS (SELECT * FROM placed WHERE place <= {SAMPLED}),
        t AS (SELECT f.*, 'Question: ' || question || chr(10) || chr(10) || 'Answer: ' || answer AS text
          FROM flat f JOIN chosen c ON c.ai_column = f.ai_column AND c.split = f.split AND c.row_id = f.row_id),
        w AS (SELECT *, {q.words('text')} AS tokens FROM t),
        facts AS (SELECT *, [repeat('-', 120), 'row=' || row_id || ' | source=' || source, 'QUESTION:',
          '  ' || replace(question, chr(10), chr(10) || '  '), upper(author_type) || ' EXAMPLE', '  label_id: ' || label,
          '  answer_source_column: ' || answer_source_column, '  source: ' || source, '  raw_character_count: ' || length(text),
          '  whitespace_word_count: ' || len(tokens), '  answer_window_start: ' || win, '  answer_window_end: ' || (win + least(n, {FLAT_WINDOW})),
          '  answer_original_word_count: ' || n, '  token_count_with_specials: ' || least(len(tokens), {MAX_TOKENS}),
          '  truncated_at_max_length_{MAX_TOKENS}: ' || (len(tokens) > {MAX_TOKENS}), '  invisible_control_chars: ' ||
          (length(text) - length(regexp_replace(text, '{_INVISIBLE_SQL}', '', 'g')) - len(regexp_extract_all(text, '[\t\n\r]')))] AS lines FROM w)
        SELECT ai_column, row_id AS sample_no, label::INT AS label, i::BIGINT AS line_no, lines[i + 1] AS line
          FROM facts, range({FACT_LINES}) r(i)
        UNION ALL SELECT ai_column, -1, -1, row_id + 3, 'Sampled row: ' || row_id FROM chosen
        UNION ALL SELECT ai_column, -1, -1, i, CASE i WHEN 0 THEN 'AI column: ' || ai_column WHEN 1 THEN 'Split: eval'
          ELSE 'Paired rows available: ' || format('{{:,}}', available) END
          FROM (SELECT DISTINCT ai_column, available FROM placed), range(3) r(i)""",
)
def input_report_lines(spark, sf_dir):
    """Headings and facts of the classifier input report: sampled pairs of every AI column."""
    lines = input_report(qa(spark, sf_dir), "eval", AI_COLUMNS, SAMPLED, SEED, MAX_TOKENS, "question_answer", FLAT_WINDOW)
    return lines.where(f"label = -1 OR line_no < {FACT_LINES}")

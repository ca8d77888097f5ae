"""Readable reports as rows of lines: sampled examples, classifier inputs, pilot grids."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.columns import CORPUS, Corpus
from answerloom.functions.invisible import describe_invisibles, invisible_count
from answerloom.functions.quality import distinct_words, hit_limit, is_bad_basic, is_bad_strict, overlap_of_words
from answerloom.functions.seeding import hash32
from answerloom.functions.text import (
    head_answers,
    indent_lines,
    omitted_answers,
    or_default,
    safe_text,
    split_words,
    truncate,
)
from answerloom.operators.corpus import texts_of, with_human_answer
from answerloom.operators.flatten import flatten, paired
from answerloom.operators.sampling import first_n, sample_rows, seeded_positions
from answerloom.session import stage, unstage

_TEXT = "array<string>"


def answer_block(label: str, texts: Column, max_answers: int, max_chars: int | None) -> Column:
    """Lines of one answer list: the first answers, numbered if several, and how many are left out."""
    shown = F.transform(head_answers(texts, max_answers), lambda t: truncate(t, max_chars))
    numbered = F.transform(shown, lambda t, i: F.concat(F.lit("  ["), i + 1, F.lit("] "), t))
    plain = F.transform(shown, lambda t: F.concat(F.lit("  "), t))
    left_out = omitted_answers(texts, max_answers)
    more = F.array(F.concat(F.lit("  [... "), left_out, F.lit(" more answer(s) omitted]")))
    nothing = F.array().cast(_TEXT)
    body = F.when(F.size(texts) == 0, F.array(F.lit("  [missing]"))).otherwise(
        F.concat(F.when(F.size(shown) == 1, plain).otherwise(numbered), F.when(left_out > 0, more).otherwise(nothing))
    )
    return F.concat(F.array(F.lit(f"{label}:")), body)


def example_report(
    df: DataFrame,
    split: str,
    ai_columns: Sequence[str],
    k: int,
    seed: int,
    max_answers: int = 3,
    max_chars: int | None = None,
    title: str = "Random Dataset Examples",
    names: Corpus = CORPUS,
) -> DataFrame:
    """Lines ``(sample_no, line_no, line)`` of ``k`` sampled rows; sample 0 is the heading."""
    rows = df.where(F.col(names.split) == split)
    sampled = with_human_answer(sample_rows(rows, k, seed, [names.split, names.row_id]), seed, "_human", names)
    source = F.col(names.source) if names.source in df.columns else F.lit("")
    blank = F.array(F.lit(""))
    human = F.filter(F.array("_human"), lambda t: t != "")
    blocks = [answer_block("Human answer", human, 1, max_chars)]
    for column in ai_columns:
        blocks += [blank, answer_block(f"AI answer - {column}", texts_of(df, column), max_answers, max_chars)]
    lines = F.concat(
        F.array(
            F.lit("=" * 100),
            F.concat(F.lit("row="), F.col(names.row_id), F.lit(" | source="), or_default(source, "unknown")),
            F.lit(""),
            F.lit("Question:"),
            F.concat(F.lit("  "), truncate(F.col(names.question), max_chars)),
            F.lit(""),
        ),
        *blocks,
        blank,
    )
    body = sampled.select(F.col(names.row_id).alias("sample_no"), F.posexplode(lines).alias("line_no", "line"))
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    heading = F.array(
        F.lit(title),
        F.lit(f"Split: {split}"),
        F.concat(F.lit("Rows in split: "), F.format_number("_total", 0)),
        F.lit(f"AI columns: {', '.join(ai_columns)}"),
    )
    head = total.select(F.lit(-1).cast("long").alias("sample_no"), F.posexplode(heading).alias("line_no", "line"))
    # A line for each sampled row, so that no line grows with the sample.
    listed = sampled.select(
        F.lit(-1).cast("long").alias("sample_no"),
        (F.col(names.row_id) + 4).alias("line_no"),
        F.concat(F.lit("Sampled row: "), F.col(names.row_id)).alias("line"),
    )
    return head.unionByName(listed).unionByName(body)


TokenAudit = "struct<input_ids:array<long>,tokens:array<string>,special_tokens_mask:array<int>,decoded:string,truncated:boolean>"


def whitespace_audit(words: Column, max_length: int) -> Column:
    """Token audit of the whitespace words of a text, with hashes for ids, all on the JVM."""
    kept = F.slice(words, 1, max_length)
    return F.struct(
        F.transform(kept, lambda w: hash32(w)).alias("input_ids"),
        kept.alias("tokens"),
        F.transform(kept, lambda w: F.lit(0)).alias("special_tokens_mask"),
        F.array_join(kept, " ").alias("decoded"),
        (F.size(words) > max_length).alias("truncated"),
    )


def token_audit(make_tokenizer: Callable[[], Callable[[str, int], dict]], max_length: int) -> Callable[[Column], Column]:
    """Token audit by a user tokenizer: a factory of ``(text, max_length) -> dict`` with the audit fields."""
    loaded: list = []

    @F.pandas_udf(TokenAudit)
    def audit(texts: pd.Series) -> pd.DataFrame:
        if not loaded:
            loaded.append(make_tokenizer())
        made = [loaded[0](text, max_length) for text in texts]
        fields = ("input_ids", "tokens", "special_tokens_mask", "decoded", "truncated")
        return pd.DataFrame([{f: row[f] for f in fields} for row in made], columns=list(fields))

    return audit


def truncated_tokens(df: DataFrame, text: str, max_length: int, out: str = "tokens") -> DataFrame:
    """Whitespace tokens of a text cut at ``max_length``, with the full count."""
    if max_length <= 0:
        raise ValueError("max_length must be positive.")
    return (
        df.withColumn("_words", split_words(safe_text(F.col(text))))
        .withColumns({out: F.slice("_words", 1, max_length), "token_total": F.size("_words")})
        .drop("_words")
    )


def input_facts(examples: DataFrame, max_length: int, audit: Callable[[Column], Column] | None = None) -> DataFrame:
    """What a classifier gets for each example: counts, window, tokens, truncation, invisible characters."""
    # the words stand in a column of their own, so that a text is split once
    examples = examples.withColumn("text", safe_text(F.col("text"))).withColumn("_words", split_words(F.col("text")))
    audited = audit(F.col("text")) if audit else whitespace_audit(F.col("_words"), max_length)
    return (
        examples.withColumn("_audit", audited)
        .withColumns(
            {
                "raw_character_count": F.length("text"),
                "whitespace_word_count": F.size("_words"),
                "token_count": F.size("_audit.input_ids"),
                "truncated": F.col("_audit.truncated"),
                "invisible_control_chars": invisible_count(F.col("text")),
            }
        )
        .drop("_words")
    )


def _python_repr(text: Column) -> Column:
    @F.pandas_udf("string")
    def quoted(texts: pd.Series) -> pd.Series:
        return texts.map(repr)

    return quoted(text)


def _invisible_lines(sampled: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` first invisible characters of each sampled example as report lines."""
    found = describe_invisibles(sampled, "text", ["example_id", "ai_column"])
    line = F.concat(
        F.lit("    index="), "position", F.lit(" "), "code_point", F.lit(" "), "character_name",
        F.lit(" category="), "category",
    )
    first = first_n(found, cap, ["position"], ["example_id", "ai_column"])
    listed = first.select("example_id", "ai_column", F.struct("position", line.alias("line")).alias("_hit"))
    grouped = listed.groupBy("example_id", "ai_column").agg(F.sort_array(F.collect_list("_hit")).alias("_hits"))
    return grouped.select("example_id", "ai_column", F.col("_hits.line").alias("_invisible"))


def input_report(
    df: DataFrame,
    split: str,
    ai_columns: Sequence[str],
    k: int,
    seed: int,
    max_length: int = 256,
    text_mode: str = "answer",
    window_words: int | None = None,
    max_tokens_shown: int = 160,
    max_chars: int = 3000,
    max_invisible: int = 20,
    audit: Callable[[Column], Column] | None = None,
    names: Corpus = CORPUS,
) -> DataFrame:
    """Lines ``(ai_column, sample_no, label, line_no, line)``: exact classifier texts of sampled pairs.

    Ordered by these columns they read as a report: per AI column a heading (sample -1) with the number of pairs there
    are and one line for each sampled row, then the human and the AI example of each row. Sampling comes before
    tokenizing, so the tokenizer sees only the rows shown. All columns are sampled in one pass and flattened once. A
    column without any pair is an error.
    """
    if max_length <= 0 or max_tokens_shown <= 0:
        raise ValueError("max_length and max_tokens_shown must be positive.")
    if k <= 0:
        raise ValueError("The sample size must be positive.")
    rows = df.where(F.col(names.split) == split)
    # One scan finds the pairs of all columns, as ids; one takes the texts of the sampled ones.
    pair = ["ai_column", "split", "row_id"]
    available = stage(paired(rows, ai_columns, seed, [], names=names).select(*pair))
    counts = {r["ai_column"]: r["count"] for r in available.groupBy("ai_column").count().collect()}
    empty = [c for c in ai_columns if not counts.get(c)]
    if empty:
        raise ValueError(f"No complete human and AI pair in split {split} for {', '.join(empty)}.")
    pairs = stage(seeded_positions(available, seed, pair[1:], pair[:1], "_position", below=k).select(*pair))
    unstage(available)
    examples = flatten(rows, ai_columns, seed, text_mode, window_words, names)
    sampled = examples.join(F.broadcast(pairs), pair, "left_semi")  # k rows for each column at most
    heads = []
    for column in ai_columns:
        fixed = [f"AI column: {column}", f"Split: {split}", f"Paired rows available: {counts[column]:,}"]
        heads += [(column, i, line) for i, line in enumerate(fixed)]
    listed = pairs.select(
        "ai_column",
        (F.col("row_id") + len(fixed)).alias("line_no"),
        F.concat(F.lit("Sampled row: "), "row_id").alias("line"),
    )
    facts = input_facts(sampled, max_length, audit)
    facts = facts.join(_invisible_lines(sampled, max_invisible), ["example_id", "ai_column"], "left")

    def joined(field: str) -> Column:
        return F.concat(F.lit("  "), F.array_join(F.slice(F.col(f"_audit.{field}"), 1, max_tokens_shown), " "))

    def shown(name: str) -> Column:
        count = F.least(F.lit(max_tokens_shown), F.col("token_count"))
        return F.concat(F.lit(f"  {name} first "), count, F.lit("/"), F.col("token_count"), F.lit(":"))

    def fact(name: str, value: str | None = None) -> Column:
        return F.concat(F.lit(f"  {name}: "), F.coalesce(F.col(value or name).cast("string"), F.lit("None")))

    text = truncate(F.col("text"), max_chars)
    more = F.concat(F.lit("    ... "), F.col("invisible_control_chars") - max_invisible, F.lit(" more"))
    lines = F.concat(
        F.array(
            F.lit("-" * 120),
            F.concat(F.lit("row="), "row_id", F.lit(" | source="), "source"),
            F.lit("QUESTION:"),
            F.concat(F.lit("  "), indent_lines(F.col("question"))),
            F.concat(F.upper("author_type"), F.lit(" EXAMPLE")),
            fact("label_id", "label"),
            fact("answer_source_column"),
            fact("source"),
            fact("raw_character_count"),
            fact("whitespace_word_count"),
            fact("answer_window_start"),
            fact("answer_window_end"),
            fact("answer_original_word_count"),
            fact("token_count_with_specials", "token_count"),
            fact(f"truncated_at_max_length_{max_length}", "truncated"),
            fact("invisible_control_chars"),
        ),
        F.coalesce("_invisible", F.array().cast(_TEXT)),
        F.when(F.col("invisible_control_chars") > max_invisible, F.array(more)).otherwise(F.array().cast(_TEXT)),
        F.array(
            F.lit("  EXACT TEXT:"),
            F.concat(F.lit("  "), indent_lines(text)),
            F.lit("  PYTHON repr(TEXT):"),
            F.concat(F.lit("  "), F.col("_repr")),
            shown("TOKENS"),
            joined("tokens"),
            shown("TOKEN IDS"),
            joined("input_ids"),
            shown("SPECIAL TOKEN MASK"),
            joined("special_tokens_mask"),
            F.lit("  DECODED FROM INPUT IDS:"),
            F.concat(F.lit("  "), indent_lines(truncate(F.col("_audit.decoded"), max_chars))),
            F.lit(""),
        ),
    )
    facts = facts.withColumn("_repr", _python_repr(text))
    body = facts.select(
        "ai_column",
        F.col("row_id").alias("sample_no"),
        F.col("label").cast("int").alias("label"),
        F.posexplode(lines).alias("line_no", "line"),
    )
    head = df.sparkSession.createDataFrame(heads, "ai_column string, line_no long, line string").unionByName(listed)
    head = head.select("ai_column", F.lit(-1).cast("long").alias("sample_no"), F.lit(-1).alias("label"), "line_no", "line")
    return head.unionByName(body.withColumn("line_no", F.col("line_no").cast("long")))


def pilot_rows(generated: DataFrame, model_name: str) -> DataFrame:
    """Pilot grid result: question by prompt style, with limit and quality flags."""
    return generated.select(
        "question_id",
        "question",
        F.col("prompt_name").alias("prompt_style"),
        "answer",
        "token_count",
        hit_limit(F.col("token_count")).alias("over_256"),
        is_bad_basic(F.col("answer"), F.col("token_count")).alias("bad_output"),
        F.lit(model_name).alias("model_name"),
    )


def guided_rows(generated: DataFrame, model_name: str, max_new_tokens: int = 180) -> DataFrame:
    """Human-guided pilot result, with strict quality flag and word overlap with the human answer."""
    worded = generated.withColumns(
        {"_made": distinct_words(F.col("answer")), "_human": distinct_words(F.col("human_answer"))}
    )
    return worded.select(
        "question_id",
        "question",
        F.col("human_answer").alias("human_answer_reference"),
        F.col("prompt_name").alias("prompt_style"),
        F.col("answer").alias("generated_answer"),
        "token_count",
        hit_limit(F.col("token_count"), max_new_tokens).alias("hit_limit"),
        is_bad_strict(F.col("answer"), F.col("token_count")).alias("bad_output"),
        overlap_of_words(F.col("_made"), F.col("_human")).alias("word_overlap_with_human"),
        F.lit(model_name).alias("model_name"),
    )

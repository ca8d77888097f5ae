"""Prompt building: random reference answers, row context, rendering, generation values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.columns import CORPUS, Corpus
from answerloom.functions.seeding import hash60
from answerloom.functions.templates import chat_messages, plain_layout, render
from answerloom.functions.text import count_words, safe_text, word_bounds
from answerloom.operators.corpus import with_human_answer
from answerloom.operators.sampling import seeded_positions
from answerloom.session import stage
from answerloom.sources.prompts import PromptSpec

CONTEXT_FIELDS = (
    "question",
    "source",
    "split",
    "row_index",
    "selected_human_answer",
    "actual_human_answer",
    "selected_human_word_count",
    "random_human_answer",
    "random_human_word_count",
    "target_word_count",
    "target_min_words",
    "target_max_words",
)


def select_prompts(specs: DataFrame, requested: DataFrame) -> DataFrame:
    """Specs whose name is among the requested names."""
    return specs.join(requested.select("name"), "name", "left_semi").select(*specs.columns)


def unknown_prompts(specs: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested names without a spec."""
    return requested.select("name").distinct().join(specs, "name", "left_anti")


def prompt_grid(df: DataFrame, prompt_names: Sequence[str]) -> DataFrame:
    """Every row once per prompt style."""
    return df.withColumn("prompt_name", F.explode(F.array(*[F.lit(n) for n in prompt_names])))


def random_other_answer(
    df: DataFrame,
    seed: int,
    prompt_names: Sequence[str],
    answer: str = "human_answer",
    carry: Sequence[str] = (),
    lend: dict[str, str] | None = None,
) -> DataFrame:
    """A seeded answer of another row of the same split, per row and prompt style.

    ``carry`` names columns of the row to keep, ``lend`` columns of the drawn row to bring along
    (name there to name here).

    Rows with an answer get a dense rank per split. A row draws among the ``n - 1`` other ranks, so
    it meets itself only where it is the whole pool; a row without an answer draws among all ``n``.
    Ranks are given and looked up with ids alone, by an equi join in which every rank occurs once; texts are
    fetched at the end, each row's own columns and its answer for others once.
    """
    ids = ["split", "row_id"]
    lend = lend or {}
    narrow = df.select(*ids, (F.col(answer) != "").alias("_has"))
    ranked = seeded_positions(narrow, seed, ids, ["split"], "_rank", counting=F.col("_has"), total="_pool")
    ticket = hash60(seed, F.col("split"), F.col("row_id"), F.col("prompt_name"), "random_human")
    among_others = F.pmod(ticket, F.greatest(F.col("_pool") - 1, F.lit(1)))
    among_all = F.pmod(ticket, F.greatest(F.col("_pool"), F.lit(1)))
    drawn = (
        prompt_grid(ranked, prompt_names)
        .withColumn("_other", among_others)
        .withColumn(
            "_target",
            F.when(F.col("_pool") == 0, F.lit(None))
            .when(F.col("_rank").isNull(), among_all)
            .when(F.col("_pool") == 1, F.lit(0))
            .otherwise(F.col("_other") + (F.col("_other") >= F.col("_rank")).cast("long")),
        )
        .select(*ids, "prompt_name", "_target")
    )
    pool = ranked.where(F.col("_rank").isNotNull()).select("split", F.col("_rank").alias("_target"), F.col("row_id").alias("_from"))
    asked = drawn.join(pool, ["split", "_target"], "left").drop("_target")
    lent = df.select(
        "split",
        F.col("row_id").alias("_from"),
        F.col(answer).alias("random_human_answer"),
        *[F.col(there).alias(here) for there, here in lend.items()],
    )
    found = asked.join(lent, ["split", "_from"], "left").drop("_from")
    kept = [c for c in dict.fromkeys(carry) if c not in ids]
    joined = found.join(df.select(*ids, *kept), ids) if kept else found
    return joined.withColumn("random_human_answer", F.coalesce("random_human_answer", F.lit(""))).select(
        *dict.fromkeys([*ids, *carry]), "prompt_name", "random_human_answer", *lend.values()
    )


def prompt_context(
    df: DataFrame, prompt_names: Sequence[str], seed: int, names: Corpus = CORPUS, staged: bool = False
) -> DataFrame:
    """All template fields of a row, per prompt style.

    Ranking and looking up reference answers pass over the rows several times. ``staged`` first writes
    the few columns prompts need, so that the wide corpus is read once.

    Styles named after the random human answer take their length from it first, all
    others from the row's own human answer; the second one fills in for a blank first.
    """
    source = F.col(names.source) if names.source in df.columns else F.lit("")
    rows = with_human_answer(df, seed, "_human", names).select(
        F.col(names.split).alias("split"),
        F.col(names.row_id).alias("row_id"),
        safe_text(F.col(names.question)).alias("question"),
        safe_text(source).alias("source"),
        F.col("_human").alias("selected_human_answer"),
    )
    # Words are counted once per row, before the rows multiply by prompt styles.
    rows = rows.withColumn("selected_human_word_count", count_words(F.col("selected_human_answer")))
    rows = stage(rows) if staged else rows
    carried = ["question", "source", "selected_human_answer", "selected_human_word_count"]
    lent = {"selected_human_word_count": "random_human_word_count"}
    drawn = random_other_answer(rows, seed, prompt_names, "selected_human_answer", carried, lent)
    counted = drawn.withColumn("random_human_word_count", F.coalesce("random_human_word_count", F.lit(0)))
    own, other = F.col("selected_human_word_count"), F.col("random_human_word_count")
    other_first = F.col("prompt_name").contains("random_human")
    bounds = word_bounds(F.when(other_first, other).otherwise(own), F.when(other_first, own).otherwise(other))
    return (
        counted.withColumn("_bounds", bounds)
        .withColumn("row_index", F.col("row_id"))
        .withColumn("actual_human_answer", F.col("selected_human_answer"))
        .select("row_id", "prompt_name", *CONTEXT_FIELDS[:9], "_bounds.*")
    )


def render_prompts(context: DataFrame, specs: Sequence[PromptSpec]) -> DataFrame:
    """Fill the templates of each prompt style: user and system text, one plain text, chat messages.

    Templates are compiled on the driver, so an unknown field fails before a job starts.
    """
    fields = {name: F.col(name) for name in CONTEXT_FIELDS}

    def by_prompt(template_of) -> Column:
        cases = F.lit(None).cast("string")
        for spec in reversed(specs):
            template = template_of(spec)
            text = render(template, fields) if template else F.lit(None).cast("string")
            cases = F.when(F.col("prompt_name") == spec.name, text).otherwise(cases)
        return cases

    return (
        context.withColumns(
            {"user_prompt": by_prompt(lambda s: s.user), "system_prompt": by_prompt(lambda s: s.system)}
        )
        .withColumns(
            {
                "prompt": plain_layout(F.col("system_prompt"), F.col("user_prompt")),
                "messages": chat_messages(F.col("system_prompt"), F.col("user_prompt")),
            }
        )
        .select("split", "row_id", "prompt_name", "user_prompt", "system_prompt", "prompt", "messages")
    )


def build_prompts(
    df: DataFrame, specs: Sequence[PromptSpec], seed: int, names: Corpus = CORPUS, staged: bool = False
) -> DataFrame:
    return render_prompts(prompt_context(df, [s.name for s in specs], seed, names, staged), specs)


@dataclass(frozen=True)
class GenerationDefaults:
    """Generation values of a run, used where a prompt style gives none."""

    max_new_tokens: int = 170
    do_sample: bool = True
    temperature: float = 0.7
    top_p: float = 0.9
    num_beams: int = 1
    num_return_sequences: int = 1


def generation_params(specs: DataFrame, defaults: GenerationDefaults = GenerationDefaults()) -> DataFrame:
    """Effective generation values per spec, and the ``problem`` with them (null if none).

    Sampling uses temperature and top_p; otherwise beams count, at least one per sequence.
    """
    values = {key: F.coalesce(F.col(key), F.lit(value)) for key, value in asdict(defaults).items()}
    merged = specs.withColumns(values)
    sampling = F.col("do_sample")
    problem = (
        F.when(F.col("max_new_tokens") <= 0, "max_new_tokens must be > 0.")
        .when(F.col("num_return_sequences") <= 0, "num_return_sequences must be > 0.")
        .when(sampling & (F.col("temperature") <= 0), "temperature must be > 0 when sampling.")
        .when(sampling & ((F.col("top_p") <= 0) | (F.col("top_p") > 1)), "top_p must be in (0, 1].")
        .when(~sampling & (F.col("num_beams") <= 0), "num_beams must be > 0.")
    )
    return merged.withColumn("problem", problem).withColumns(
        {
            "temperature": F.when(sampling, F.col("temperature")),
            "top_p": F.when(sampling, F.col("top_p")),
            "num_beams": F.when(~sampling, F.greatest("num_beams", "num_return_sequences")),
        }
    )


def check_generation_params(params: DataFrame) -> DataFrame:
    bad = params.where(F.col("problem").isNotNull()).select("name", "problem").limit(1).collect()
    if bad:
        raise ValueError(f"Prompt '{bad[0]['name']}': {bad[0]['problem']}")
    return params

"""Prompt files: read, check, select."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

SPEC_SCHEMA = (
    "position int, name string, description string, system string, user string, "
    "max_new_tokens int, do_sample boolean, temperature double, top_p double, "
    "num_beams int, num_return_sequences int"
)


@dataclass(frozen=True)
class PromptSpec:
    """A prompt style; generation values override the run's defaults."""

    name: str
    user: str
    system: str | None = None
    description: str | None = None
    generation: dict[str, Any] = field(default_factory=dict)


def _filled(value: Any) -> bool:
    return value is not None and str(value).strip() != ""


def _entries(payload: Any) -> list[Any]:
    """The prompt entries of any of the three layouts; keyed entries get their key as name unless they name one."""
    listed = payload["prompts"] if isinstance(payload, dict) and "prompts" in payload else payload
    if isinstance(listed, dict):
        return [{"name": key} | value if isinstance(value, dict) else value for key, value in listed.items()]
    return listed if isinstance(listed, list) else [listed]


#: What must hold for an entry, each with what is said if it doesn't; checked in this order.
_RULES = (
    (lambda e: isinstance(e, dict), "is not a JSON object"),
    (lambda e: _filled(e.get("name")), "has no name"),
    (lambda e: _filled(e.get("user")), "has no user template"),
    (lambda e: isinstance(e.get("generation") or {}, dict), "has generation values that are no JSON object"),
)


def parse_prompt_specs(payload: Any) -> list[PromptSpec]:
    """Specs from ``{"prompts": ...}``, an object keyed by name, or a list of objects."""
    if not isinstance(payload, (dict, list)):
        raise ValueError("Prompts come as a JSON object or a JSON list.")
    entries = _entries(payload)
    for number, entry in enumerate(entries, 1):
        for holds, problem in _RULES:
            if not holds(entry):
                raise ValueError(f"Prompt entry {number} {problem}.")
    specs = [
        PromptSpec(str(e["name"]).strip(), e["user"], e.get("system"), e.get("description"), e.get("generation") or {})
        for e in entries
    ]
    repeated = sorted({s.name for s in specs if sum(s.name == t.name for t in specs) > 1})
    if repeated:
        raise ValueError(f"Prompt names occur more than once: {', '.join(repeated)}")
    return specs


def load_prompt_specs(spark: SparkSession, path: str) -> list[PromptSpec]:
    """Read a small JSON prompt file from any file system Spark can reach."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"Expected one prompt file at {path}")
    return parse_prompt_specs(json.loads(rows[0][0]))


def select_specs(specs: Sequence[PromptSpec], names: Sequence[str] | None = None) -> list[PromptSpec]:
    """The named specs in file order; all without names; an unknown name is an error."""
    if not names:
        return list(specs)
    missing = sorted(set(names) - {s.name for s in specs})
    if missing:
        raise ValueError(f"Prompt name(s) not found: {', '.join(missing)}")
    return [s for s in specs if s.name in set(names)]


def specs_frame(spark: SparkSession, specs: Sequence[PromptSpec]) -> DataFrame:
    """Specs as a table, one column per generation override (null where not overridden)."""

    def cast(value, kind):
        return None if value is None else kind(value)

    rows = [
        (
            i,
            s.name,
            s.description,
            s.system,
            s.user,
            cast(s.generation.get("max_new_tokens"), int),
            cast(s.generation.get("do_sample"), bool),
            cast(s.generation.get("temperature"), float),
            cast(s.generation.get("top_p"), float),
            cast(s.generation.get("num_beams"), int),
            cast(s.generation.get("num_return_sequences"), int),
        )
        for i, s in enumerate(specs)
    ]
    return spark.createDataFrame(rows, SPEC_SCHEMA)


# Example styles in our own words.
EXAMPLE_SPECS = (
    PromptSpec(
        "plain",
        "Reply to this question in {target_min_words} to {target_max_words} words.\n\n{question}",
        "Give only the reply.",
        "Direct reply with a length target.",
        {"max_new_tokens": 120, "temperature": 0.75, "top_p": 0.9},
    ),
    PromptSpec(
        "casual",
        "Chat about this as you would with a friend, about {target_word_count} words:\n{question}",
        None,
        "Relaxed tone, no system text, default generation values.",
    ),
    PromptSpec(
        "random_human_style",
        "Somebody once wrote ({random_human_word_count} words):\n\n{random_human_answer}\n\n"
        "Keep that tone and answer in {target_min_words}-{target_max_words} words: {question}",
        "Give only the reply. Topic area: {source}.",
        "Takes tone and length from another person's answer.",
        {"max_new_tokens": 140, "temperature": 0.85, "top_p": 0.92},
    ),
    PromptSpec(
        "same_question_ref",
        "One person answered this question ({selected_human_word_count} words):\n\n{selected_human_answer}\n\n"
        "Say it your own way in {target_min_words}-{target_max_words} words. Question: {question}",
        "Give only the reply. Never quote {{the person}}.",
        "Takes length and detail from the answer to the same question.",
        {"max_new_tokens": 120, "temperature": 0.8, "top_p": 0.9, "do_sample": False, "num_return_sequences": 2},
    ),
)

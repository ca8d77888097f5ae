"""Names of the corpus columns, gathered so that callers can rename them once."""

from __future__ import annotations

from dataclasses import dataclass

HUMAN, AI = 0, 1
LABEL_NAMES = {HUMAN: "human", AI: "ai"}


@dataclass(frozen=True)
class Corpus:
    """Column names of a wide corpus table; ``(split, row_id)`` identifies a row."""

    row_id: str = "row_id"
    split: str = "split"
    question: str = "question"
    source: str = "source"
    human_answers: str = "human_answers"
    selected_human: str = "selected_human_answer"
    selected_index: str = "selected_human_answer_index"
    origin_split: str = "origin_split"
    origin_index: str = "origin_index"
    original_ai: str = "chatgpt_answers"
    ai_prefix: str = "ai_"
    prompt_prefix: str = "prompt_"


CORPUS = Corpus()

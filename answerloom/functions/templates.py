"""Prompt templates compiled to column expressions on the driver."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerloom.functions.text import safe_text, trimmed


def template_fields(template: str) -> list[str]:
    return [name for _, name, _, _ in Formatter().parse(template) if name is not None]


def render(template: str, fields: dict[str, Column]) -> Column:
    """Fill ``{name}`` fields with cleaned text; an unknown name fails before any job runs."""
    pieces: list[Column] = []
    for literal, name, spec, conversion in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name is None:
            continue
        if name not in fields:
            raise ValueError(
                f"Unknown template field '{name}'. Available fields: {', '.join(sorted(fields))}"
            )
        if spec or conversion not in (None, "s"):
            raise ValueError(f"Template field '{name}' must not carry a format or conversion.")
        pieces.append(safe_text(fields[name]))
    return trimmed(F.concat(*pieces)) if pieces else F.lit("")


def plain_layout(system: Column, user: Column) -> Column:
    """One text for models without a chat template; just the user text without a system text."""
    laid_out = F.concat(
        F.lit("System:\n"), system, F.lit("\n\nUser:\n"), user, F.lit("\n\nAssistant:\n")
    )
    return F.when(F.coalesce(system, F.lit("")) == "", user).otherwise(laid_out)


def chat_messages(system: Column, user: Column) -> Column:
    """Chat messages ``array<struct<role, content>>``, the system message only where there is one."""
    turns = F.array(
        F.struct(F.lit("system").alias("role"), F.coalesce(system, F.lit("")).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )
    return F.filter(turns, lambda m: (m["role"] == "user") | (m["content"] != ""))

"""Result files: JSON lines, CSV, JSON and text reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.functions.text import safe_text

# A report or metric table this small is worth one file.
_ONE_FILE = 1


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists", one_file: bool = False) -> None:
    """One JSON object per row, nulls written, text as UTF-8."""
    out = df.coalesce(_ONE_FILE) if one_file else df
    out.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str], mode: str = "errorifexists", one_file: bool = True) -> None:
    """Header, the given columns in order, trimmed texts quoted where needed, null as empty."""
    out = df.select(*[safe_text(F.col(c)).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])
    out = out.coalesce(_ONE_FILE) if one_file else out
    writer = out.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "")
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A small table, such as metrics, as one JSON file."""
    write_jsonl(df, path, mode, one_file=True)


def write_text(lines: DataFrame, path: str, order: Sequence[str], mode: str = "errorifexists") -> None:
    """The ``line`` column in the given order; file names follow the order."""
    lines.orderBy(*order).select("line").write.mode(mode).text(path)

"""Audit of control, format, surrogate, private-use and unassigned characters."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Java pattern: any character of category C except newline, tab and carriage return.
INVISIBLE = r"[\p{C}&&[^\n\t\r]]"


def invisible_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(INVISIBLE))


def is_invisible(ch: Column) -> Column:
    """Test of one character; printable ASCII passes without the pattern."""
    return ~ch.between(" ", "~") & ch.rlike(INVISIBLE)


def code_point(ch: Column) -> Column:
    """``U+XXXX`` of a one-character text, at least four digits."""
    digits = F.hex(F.ascii(ch))
    return F.concat(F.lit("U+"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


@cache
def _named_rows() -> list[tuple[str, str, str]]:
    rows = []
    for point in range(sys.maxunicode + 1):
        ch = chr(point)
        category = unicodedata.category(ch)
        if category in ("Cc", "Cf"):
            rows.append((f"U+{point:04X}", category, unicodedata.name(ch, "UNKNOWN")))
    return rows


def named_invisibles(spark: SparkSession) -> DataFrame:
    """Control and format characters with category and name, about 235 rows by rule."""
    return spark.createDataFrame(_named_rows(), "code_point string, named_category string, character_name string")


def residual_category(ch: Column) -> Column:
    """Category of an invisible character that is neither control nor format."""
    point = F.ascii(ch)
    surrogate = point.between(0xD800, 0xDFFF)
    private = point.between(0xE000, 0xF8FF) | point.between(0xF0000, 0xFFFFD) | point.between(0x100000, 0x10FFFD)
    return F.when(surrogate, "Cs").when(private, "Co").otherwise("Cn")


def describe_invisibles(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row per invisible character: keys, position, code point, category, name.

    Characters become rows and are tested by compiled code, which costs as much for each character of a text of many
    hits as of one with few.
    """
    hits = (
        df.where(F.col(text).rlike(INVISIBLE))
        .select(*keys, F.posexplode(F.split(text, "")).alias("position", "_ch"))
        .where(is_invisible(F.col("_ch")))
        .withColumn("code_point", code_point(F.col("_ch")))
    )
    # The dimension has a fixed size given by the Unicode tables, so it may be broadcast.
    named = F.broadcast(named_invisibles(df.sparkSession))
    return hits.join(named, "code_point", "left").select(
        *keys,
        "position",
        "code_point",
        F.coalesce("named_category", residual_category(F.col("_ch"))).alias("category"),
        F.coalesce("character_name", F.lit("UNKNOWN")).alias("character_name"),
    )

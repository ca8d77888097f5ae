"""SQL building blocks for the reference results, mirroring the column helpers."""

from __future__ import annotations

from answerloom.functions.text import NOT_WS, WHITESPACE, WORD, WS

_TRIM_SET = WHITESPACE.replace("'", "''")


def safe(x: str) -> str:
    return f"trim(coalesce({x}, ''), '{_TRIM_SET}')"


def strip(x: str) -> str:
    return f"trim({x}, '{_TRIM_SET}')"


def texts(x: str) -> str:
    """Cleaned non-blank texts of a list."""
    return f"list_filter(list_transform(coalesce({x}, []), lambda e: {safe('e')}), lambda e: e <> '')"


def one_text(x: str) -> str:
    return f"list_filter([{safe(x)}], lambda e: e <> '')"


def key(*parts: str) -> str:
    return "concat_ws(':', " + ", ".join(f"coalesce(({p})::VARCHAR, chr(9216))" for p in parts) + ")"


def hash32(*parts: str) -> str:
    return f"('0x' || substr(md5({key(*parts)}), 1, 8))::BIGINT"


def hash60(*parts: str) -> str:
    return f"('0x' || substr(md5({key(*parts)}), 1, 15))::BIGINT"


def words(x: str) -> str:
    """Whitespace words of a text."""
    return f"regexp_extract_all({x}, '{NOT_WS}+')"


def lexical(x: str) -> str:
    return f"regexp_extract_all({x}, '{WORD}')"


def n_words(x: str) -> str:
    return f"len({words(x)})"


def bounds(count_first: str, count_second: str) -> dict[str, str]:
    target = (
        f"least(95, greatest(12, CASE WHEN {count_first} > 0 THEN {count_first} "
        f"WHEN {count_second} > 0 THEN {count_second} ELSE 55 END))"
    )
    return {
        "target_word_count": target,
        "target_min_words": f"greatest(8, round_even({target} * 0.75, 0)::INT)",
        "target_max_words": f"least(110, greatest(14, round_even({target} * 1.25, 0)::INT))",
    }


def ratio(part: str, whole: str) -> str:
    return f"(CASE WHEN {whole} > 0 THEN ({part})::DOUBLE / ({whole}) ELSE 0.0 END)"


__all__ = ["WS", "bounds", "hash32", "hash60", "key", "lexical", "n_words", "one_text", "ratio", "safe", "strip", "texts", "words"]

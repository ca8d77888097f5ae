import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from answerloom.functions import text as T
from answerloom.functions.invisible import describe_invisibles, invisible_count
from answerloom.functions.naming import generated_column_name, sanitize, sanitize_name

EDGES = [
    None, "", "   ", "\xa0a\xa0", "　全角　", "\x1cx y\x1c", "​z​", "﻿b", "a b  ",
    "👍 ok 👍🏽", "été mangé", "x² ³", "snake‿case under_score", "one\ntwo\tthree\r\n four",
    " mixed  wide spaces ",
]


def clean(v):
    return "" if v is None else v.strip()


def test_safe_text_strips_like_python(column):
    assert column(T.safe_text, EDGES) == [clean(v) for v in EDGES]


def test_whitespace_set_equals_python():
    assert set(T.WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_whitespace_pattern_over_all_code_points(spark):
    points = spark.range(1, 0x110000).where("id < 55296 or id > 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    found = {r[0] for r in points.where(F.col("c").rlike(T.WS)).select("id").collect()}
    assert found == {ord(c) for c in T.WHITESPACE}


def test_text_list_drops_blanks(column):
    lists = [None, [], ["a", None, "  ", " b "], ["\xa0"]]
    assert column(lambda c: T.text_list(c, True), lists, "array<string>") == [[], [], ["a", "b"], []]
    assert column(lambda c: T.text_list(c, False), [None, " ", " q "]) == [[], [], ["q"]]


def test_word_and_character_counts(column):
    assert column(T.count_words, EDGES) == [len(clean(v).split()) for v in EDGES]
    texts = [v for v in EDGES if v]
    assert column(F.length, texts) == [len(v) for v in texts]
    plain = ["a b", "it's x_1 22", "é ñ", "", "x² ³", "snake‿case"]
    assert column(T.count_lexical_words, plain) == [len(re.findall(r"\b\w+\b", v)) for v in plain]


@pytest.mark.parametrize("count, expected", [
    (0, (55, 41, 69)), (1, (12, 9, 15)), (12, (12, 9, 15)), (30, (30, 22, 38)), (55, (55, 41, 69)),
    (88, (88, 66, 110)), (95, (95, 71, 110)), (400, (95, 71, 110)),
])
def test_word_bounds(spark, count, expected):
    row = spark.range(1).select(T.word_bounds(F.lit(count), F.lit(0)).alias("b")).select("b.*").first()
    assert tuple(row) == expected


def test_word_bounds_falls_through_to_the_second_reference(spark):
    row = spark.range(1).select(T.word_bounds(F.lit(0), F.lit(40)).alias("b")).select("b.*").first()
    assert row["target_word_count"] == 40


def _window(spark, text, w, seed=42):
    df = spark.createDataFrame([("train", 7, text)], "split string, row_id long, v string")
    df = df.withColumn("t", T.safe_text(F.col("v"))).withColumn("words", T.split_words(F.col("t")))
    df = df.withColumn("s", T.window_span(F.size("words"), w, seed, F.col("split"), F.col("row_id"), "k"))
    return df.select(
        T.windowed_text(F.col("t"), F.col("words"), F.col("s.start"), F.col("s.stop")), "s.start", "s.stop"
    ).first()


def test_answer_window_cases(spark):
    text = " a  b\tc d "
    assert tuple(_window(spark, text, 5)) == ("a  b\tc d", 0, 4)
    assert tuple(_window(spark, text, 4)) == ("a  b\tc d", 0, 4)
    assert tuple(_window(spark, text, None)) == ("a  b\tc d", 0, 4)
    answer, start, stop = _window(spark, text, 3)
    assert stop - start == 3 and answer == " ".join(text.split()[start:stop])
    starts = {_window(spark, " ".join(map(str, range(50))), 10, seed)[1] for seed in range(12)}
    assert len(starts) > 3 and all(0 <= s <= 40 for s in starts)
    with pytest.raises(ValueError):
        _window(spark, text, 0)


@pytest.mark.parametrize("limit", [None, 0, -1, 1, 2, 3, 4, 6, 100])
def test_truncate(column, limit):
    def expected(v):
        v = v.strip()
        if limit is None or limit <= 0 or len(v) <= limit:
            return v
        return v[: limit - 3].rstrip() + "..."

    texts = ["short", "a  long text", "   ", "👍👍👍👍👍👍👍👍"]
    assert column(lambda c: T.truncate(c, limit), texts) == [expected(v) for v in texts]


def test_preview_cut_and_indent(column):
    assert column(T.preview, ["x" * 500, "x" * 501]) == ["x" * 500, "x" * 500 + "..."]
    assert column(lambda c: T.hard_cut(c, 3), ["  abcd", "a"]) == ["abc", "a"]
    assert column(T.indent_lines, ["a\nb\nc"]) == ["a\n  b\n  c"]


def test_model_text(spark):
    df = spark.createDataFrame([("q", "a"), ("", "a")], "q string, a string")
    both = [r[0] for r in df.select(T.model_text(F.col("q"), F.col("a"), "question_answer")).collect()]
    assert both == ["Question: q\n\nAnswer: a", "a"]
    assert [r[0] for r in df.select(T.model_text(F.col("q"), F.col("a"))).collect()] == ["a", "a"]
    with pytest.raises(ValueError):
        T.model_text(F.col("q"), F.col("a"), "other")


def test_invisible_characters(spark):
    texts = ["plain\n\t\r", "a​b﻿", "\x00\x1f", "🙂\U000e0001", "soft­hyphen"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(r.id, r.position, r.code_point, r.category, r.character_name) for r in describe_invisibles(df, "text", ["id"]).collect()}
    want = {
        (i, p, f"U+{ord(c):04X}", unicodedata.category(c), unicodedata.name(c, "UNKNOWN"))
        for i, t in enumerate(texts)
        for p, c in enumerate(t)
        if unicodedata.category(c).startswith("C") and c not in "\n\t\r"
    }
    assert got == want
    counts = [r[0] for r in df.orderBy("id").select(invisible_count(F.col("text"))).collect()]
    assert counts == [sum(1 for w in want if w[0] == i) for i in range(len(texts))]


def test_invisible_characters_of_a_long_text(spark):
    df = spark.createDataFrame([(1, "a\u200b" * 3000 + "🙂\ufeff")], "id int, text string")
    found = describe_invisibles(df, "text", ["id"])
    places = sorted(r.position for r in found.collect())
    assert places == [*range(1, 6000, 2), 6001]
    # no interpreted function goes over the hits one by one
    assert "lambda" not in found._jdf.queryExecution().executedPlan().toString()


NAMES = ["", "3b-model", "Org/Model-7B", "!!!", "x" * 200, "naïve—Ünï", "a" * 95 + "-b", "__A__b__", "9", "-" * 9]


def test_sanitize_column_equals_driver_twin(column):
    expected = [sanitize_name(v) for v in NAMES]
    assert column(sanitize, NAMES) == expected
    assert expected[:4] == ["value", "value_3b_model", "org_model_7b", "value"]
    assert len(expected[4]) == 96 and expected[6] == "a" * 95


def test_generated_column_name():
    assert generated_column_name("Org/Model-7B", "plain") == "ai_org_model_7b_plain"
    assert generated_column_name("Org/Model-7B", "Plain Style", "m7") == "ai_m7_plain_style"

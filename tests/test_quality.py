import re

import pytest
from pyspark.sql import functions as F

from answerloom.functions import quality as Q
from answerloom.functions.templates import chat_messages, plain_layout, render, template_fields


@pytest.mark.parametrize("raw, cleaned", [
    ("Answer: yes", "yes"), ("ANSWER  :\n yes", "yes"), ("A. first", "first"), ("Q.first", "first"),
    (" ...?! then", "then"), ("(Note: a) b", "b"), ("[tag] c", "c"), ("Answer: A. Q. -(note: z)[k] end", "end"),
    ("[open\nstill] c", "[open\nstill] c"), ("[x y] c", "c"), ("(Note: open\n) z", "(Note: open\n) z"),
    ("Answer: Answer: twice", "Answer: twice"), ("", ""), ("  ", ""), ("Anſwer: long s", "long s"), ("Q. A. x", "A. x"),
])
def test_clean_output(column, raw, cleaned):
    assert column(Q.clean_output, [raw]) == [cleaned]


def _bad(spark, rule, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, n int").orderBy("i")
    return [r[0] for r in df.select(rule(F.col("a"), F.col("n"))).collect()]


def test_bad_output_rules(spark):
    rows = [
        ("good text", 10), ("good text", 9), ("", 50), ("  ", 50), ("??", 50), ("---", 50), ("Note: hm", 50),
        ("In my response I say", 50), ("He said: here's one", 50), ("Dear all", 50), ("oh dear friend", 50),
        ("ten o'clock dr. who", 50), ("fine", 50),
    ]
    basic = [False, True, True, True, True, False, True, True, False, False, False, False, False]
    strict = [False, True, True, True, True, False, True, True, True, True, True, True, False]
    assert _bad(spark, Q.is_bad_basic, rows) == basic
    assert _bad(spark, Q.is_bad_strict, rows) == strict


def test_limit_flags(spark):
    df = spark.createDataFrame([(255,), (256,), (180,)], "n int")
    assert [r[0] for r in df.select(Q.hit_limit(F.col("n"))).collect()] == [False, True, False]
    assert [r[0] for r in df.select(Q.hit_limit(F.col("n"), 180)).collect()] == [True, True, True]


def test_word_overlap(spark):
    rows = [("The cat the CAT", "a cat"), ("", "x"), ("x", ""), ("a b c d", "d c"), ("!!", "x")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, g string, r string").orderBy("i")
    got = df.select(Q.overlap_of_words(Q.distinct_words(F.col("g")), Q.distinct_words(F.col("r")))).collect()

    def expected(g, r):
        gw, rw = set(re.findall(r"\w+", g.lower())), set(re.findall(r"\w+", r.lower()))
        return len(gw & rw) / len(gw) if gw and rw else 0.0

    assert [x[0] for x in got] == [expected(*r) for r in rows]


def test_templates(spark):
    df = spark.createDataFrame([(" q ", None, 3)], "question string, source string, n int")
    fields = {c: F.col(c) for c in df.columns}
    made = df.select(render("  {{x}} {question}-{question} [{source}] {n!s} ", fields)).first()[0]
    assert made == "{x} q-q [] 3"
    assert template_fields("{a} {b}{{c}}") == ["a", "b"]
    with pytest.raises(ValueError, match="Unknown template field 'nope'. Available fields: n, question, source"):
        render("{nope}", fields)
    with pytest.raises(ValueError):
        render("{n:>5}", fields)


def test_layouts(spark):
    df = spark.createDataFrame([("s", "u"), (None, "u"), ("", "u")], "s string, u string")
    got = [r[0] for r in df.select(plain_layout(F.col("s"), F.col("u"))).collect()]
    assert got == ["System:\ns\n\nUser:\nu\n\nAssistant:\n", "u", "u"]
    roles = [[m["role"] for m in r[0]] for r in df.select(chat_messages(F.col("s"), F.col("u"))).collect()]
    assert roles == [["system", "user"], ["user"], ["user"]]


# The rules read from the interface they must match, written out once more so that a changed constant shows.
STARTS = ["Answer: x", "QUESTION: x", "note: x", "Here are the details of x", "Let me know when you're ready x", "in my response x"]
PHRASES = [
    "x ## step y", "so step 1 is", "well let me explain", "so here is it", "so here's it", "the doctor: says", "by dr. who",
    "my dear friend", "now i'm concerned", "then i'll go", "then i will go", "for my family x", "so i might go", "so i would go",
]


def test_every_rule_counts(spark):
    texts = [*STARTS, "!", "!!", ".", "..", "?", "??", "-", "--", *PHRASES, "plain words only", "!!!"]
    rows = [(t, 50) for t in texts]
    n = len(texts) - len(PHRASES) - 2
    assert _bad(spark, Q.is_bad_basic, rows) == [True] * n + [False] * (len(PHRASES) + 2)
    assert _bad(spark, Q.is_bad_strict, rows) == [True] * (n + len(PHRASES)) + [False] * 2


def test_limits_of_the_rules():
    assert (Q.MIN_TOKENS, Q.TOKEN_LIMIT) == (10, 256)
    assert (len(Q.PUNCTUATION_ONLY), len(Q.BAD_STARTS), len(Q.BAD_PHRASES), len(Q.LEADING_JUNK)) == (8, 6, 14, 6)

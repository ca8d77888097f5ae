import pytest
from pyspark.sql import functions as F

from answerloom.operators import corpus as C
from answerloom.operators.flatten import flatten, flatten_counts, pair_examples, require_examples
from answerloom.operators.reports import example_report, input_report, token_audit


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        ("train", 0, " s ", "q0", ["h0 " * 60], "m0 " * 70, ["g0"], None),
        ("train", 1, "", "q1", ["h1"], None, ["", " g1 "], "p"),
        ("eval", 2, None, "q2\nmore", ["h2", "h2b​"], "m2", ["x"], "p"),
        ("eval", 3, "s", " ", ["h3"], "m3", [], "p"),
        ("eval", 4, "s", "q4", ["  "], "m4", None, "p"),
    ]
    schema = (
        "split string, row_id long, source string, question string, human_answers array<string>, "
        "ai_m_one string, ai_m_two array<string>, prompt_ai_m_one string"
    )
    return spark.createDataFrame(rows, schema)


def test_splits(spark, corpus):
    assert C.available_splits(corpus) == ["eval", "train"]
    assert C.resolve_splits(corpus, ["eval"]).count() == 3 and C.resolve_splits(corpus) is corpus
    with pytest.raises(ValueError, match="No rows in split x; the corpus has eval, train"):
        C.resolve_splits(corpus, ["x", "eval"])
    assert C.normalize(spark.range(1)).first().split == "train"
    assert [C.default_split(s) for s in (["a", "eval"], ["validation", "train"], ["b", "train"], ["b", "c"])] == ["eval", "validation", "train", "b"]
    assert C.choose_split(corpus) == "eval" and C.choose_split(corpus, "train") == "train"
    with pytest.raises(ValueError):
        C.choose_split(corpus, "test")
    with pytest.raises(ValueError):
        C.union_splits({})


def test_usable_rows_and_counts(corpus):
    assert {r.row_id for r in C.usable_rows(corpus).collect()} == {0, 1, 2}
    counts = {r.split: (r.total_rows, r.usable_rows, r.skipped_rows) for r in C.row_counts(corpus).collect()}
    assert counts == {"train": (2, 2, 0), "eval": (3, 1, 2)}


def test_required_columns(corpus):
    with pytest.raises(ValueError, match="Missing required columns: a, b"):
        C.require_columns(corpus, ["b", "question", "a"])
    with pytest.raises(ValueError, match="selected_human_answer or human_answers"):
        C.require_answer_columns(corpus.drop("human_answers"))
    C.require_answer_columns(corpus)


def test_column_discovery(corpus):
    assert C.resolve_ai_columns(corpus) == ["ai_m_one", "ai_m_two"]
    assert C.resolve_ai_columns(corpus, ["ai_m_two, ai_m_one", "ai_m_two"]) == ["ai_m_two", "ai_m_one"]
    only_eval = corpus.withColumn("ai_late", F.when(F.col("split") == "eval", "x"))
    assert "ai_late" not in C.resolve_ai_columns(only_eval)
    assert "ai_late" in C.resolve_ai_columns(only_eval, splits=["eval"])
    with pytest.raises(ValueError, match="ai_late"):
        C.resolve_ai_columns(only_eval, ["ai_late"])
    with pytest.raises(ValueError, match="No AI answer"):
        C.resolve_ai_columns(corpus, prefix="zz_")
    chat = corpus.withColumn("chatgpt_answers", F.array(F.lit("c")))
    assert C.resolve_example_columns(chat) == ["chatgpt_answers", "ai_m_one", "ai_m_two"]
    assert C.resolve_example_columns(chat, include_original=False) == ["ai_m_one", "ai_m_two"]
    assert C.resolve_answer_columns(chat) == ["ai_m_one", "ai_m_two", "chatgpt_answers", "human_answers"]


def test_flatten(corpus):
    flat = flatten(corpus, ["ai_m_one", "ai_m_two"], 42, window_words=50).collect()
    by = {(r.row_id, r.ai_column, r.author_type): r for r in flat}
    assert {k[:2] for k in by} == {(0, "ai_m_one"), (0, "ai_m_two"), (1, "ai_m_two"), (2, "ai_m_one"), (2, "ai_m_two")}
    assert by[0, "ai_m_one", "human"].answer == by[0, "ai_m_two", "human"].answer
    assert by[0, "ai_m_one", "human"].answer_window_start == by[0, "ai_m_two", "human"].answer_window_start
    ai = by[0, "ai_m_one", "ai"]
    assert ai.answer_window_end - ai.answer_window_start == 50 and ai.answer_original_word_count == 70
    assert ai.example_id == "train-0-ai_m_one-ai" and ai.label == 1 and ai.source == "s"
    human = by[2, "ai_m_one", "human"]
    assert human.source == "unknown" and human.answer_source_column == "selected_human_answer" and human.label == 0
    assert by[1, "ai_m_two", "ai"].answer == "g1"
    counts = {(r.split, r.ai_column): (r.kept_rows, r.skipped_rows) for r in flatten_counts(corpus, ["ai_m_one", "ai_m_two"], 42).collect()}
    assert counts == {("train", "ai_m_one"): (1, 1), ("train", "ai_m_two"): (2, 0), ("eval", "ai_m_one"): (1, 2), ("eval", "ai_m_two"): (1, 2)}


def test_flatten_keeps_the_frozen_answer_and_origin(corpus):
    frozen = C.with_origin(corpus).withColumn("selected_human_answer", F.lit(" mine "))
    rows = flatten(frozen, ["ai_m_one"], 42, "question_answer").where("label = 0").collect()
    assert all(r.full_answer == "mine" and r.origin_split == r.split and r.origin_index == r.row_id for r in rows)
    assert {r.text for r in rows} >= {"Question: q0\n\nAnswer: mine"}


def test_pairs_and_missing_examples(corpus):
    flat = flatten(corpus, ["ai_m_one"], 42)
    one_sided = flat.where("not (row_id = 0 and label = 1)")
    assert {r.row_id for r in pair_examples(one_sided).collect()} == {2}
    with pytest.raises(ValueError, match="split=train column=ai_m_one"):
        require_examples(flat.where("split = 'eval'"), ["ai_m_one"], ["train", "eval"])


def test_reports(spark, corpus):
    lines = example_report(corpus, "eval", ["ai_m_one", "ai_m_two"], 5, 1, max_answers=1).orderBy("sample_no", "line_no")
    text = [r.line for r in lines.collect()]
    assert text[1:4] == ["Split: eval", "Rows in split: 3", "AI columns: ai_m_one, ai_m_two"]
    assert text[4:7] == ["Sampled row: 2", "Sampled row: 3", "Sampled row: 4"]
    assert "row=2 | source=unknown" in text and "  [missing]" in text

    def make():
        def audit(value, limit):
            tokens = ["<s>", *value.split(), "</s>"]
            kept = tokens[:limit]
            return {
                "input_ids": list(range(len(kept))),
                "tokens": kept,
                "special_tokens_mask": [int(t[0] == "<") for t in kept],
                "decoded": " ".join(kept),
                "truncated": len(tokens) > limit,
            }

        return audit

    for audit in (None, token_audit(make, 3)):
        report = input_report(corpus, "eval", ["ai_m_two"], 2, 1, max_length=3, audit=audit).orderBy("sample_no", "line_no")
        text = [r.line for r in report.collect()]
        assert "HUMAN EXAMPLE" in text and "AI EXAMPLE" in text and "  q2\n  more" in text
        assert any("truncated_at_max_length_3" in t for t in text)
    assert "  <s> x </s>" in text


def test_report_lists_invisible_characters(corpus):
    one = corpus.where("row_id = 2").withColumn("human_answers", F.array(F.lit("a" + "​" * 25)))
    text = [r.line for r in input_report(one, "eval", ["ai_m_one"], 1, 1).orderBy("line_no").collect()]
    assert "    index=1 U+200B ZERO WIDTH SPACE category=Cf" in text and "    ... 5 more" in text
    assert "  invisible_control_chars: 25" in text

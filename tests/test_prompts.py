import json

import pytest
from pyspark.sql import functions as F

from answerloom.functions.seeding import hash60
from answerloom.operators import prompts as P
from answerloom.sources.prompts import EXAMPLE_SPECS, PromptSpec, load_prompt_specs, parse_prompt_specs, select_specs, specs_frame


def _rows(spark, answers):
    rows = [("train", i, a) for i, a in enumerate(answers)]
    return spark.createDataFrame(rows, "split string, row_id long, human_answer string")


def test_random_other_answer_is_never_the_row_itself(spark):
    df = _rows(spark, [f"a{i}" for i in range(40)] + [""] * 5)
    got = P.random_other_answer(df, 1, ["p", "q"]).collect()
    assert len(got) == 90
    assert all(r.random_human_answer not in ("", f"a{r.row_id}") for r in got)
    assert len({r.random_human_answer for r in got}) > 20
    assert {r.random_human_answer for r in got if r.prompt_name == "p"} != {"a0"}


@pytest.mark.parametrize("answers, expected", [
    (["", ""], {0: "", 1: ""}), (["x", ""], {0: "x", 1: "x"}), (["x", "y"], {0: "y", 1: "x"}),
])
def test_random_other_answer_in_small_pools(spark, answers, expected):
    got = P.random_other_answer(_rows(spark, answers), 1, ["p"]).collect()
    assert {r.row_id: r.random_human_answer for r in got} == expected


def test_pools_do_not_mix_splits(spark):
    df = _rows(spark, ["t0", "t1", "t2"]).union(_rows(spark, ["e0", "e1"]).withColumn("split", F.lit("eval")))
    for r in P.random_other_answer(df, 1, ["p"]).collect():
        assert r.random_human_answer[0] == r.split[0]


def test_random_other_answer_draws_evenly(spark):
    df = _rows(spark, [f"a{i}" for i in range(10)])
    got = P.random_other_answer(df, 1, [f"p{i}" for i in range(200)]).groupBy("random_human_answer").count().collect()
    assert all(120 < r["count"] < 280 for r in got) and len(got) == 10


def _corpus(spark):
    rows = [
        ("train", 0, " q0 ", "s", ["one two three"] ), ("train", 1, "q1", None, ["w " * 40, "  "]), ("train", 2, "q2", " ", []),
    ]
    return spark.createDataFrame(rows, "split string, row_id long, question string, source string, human_answers array<string>")


def test_context_bounds_follow_the_prompt_name(spark):
    got = {(r.row_id, r.prompt_name): r for r in P.prompt_context(_corpus(spark), ["plain", "my_random_human_x"], 1).collect()}
    assert got[0, "plain"].target_word_count == 12 and got[0, "my_random_human_x"].target_word_count == 40
    assert got[1, "plain"].target_word_count == 40 and got[1, "my_random_human_x"].target_word_count == 12
    blank = got[2, "plain"]
    assert blank.selected_human_answer == "" and blank.selected_human_word_count == 0
    assert blank.target_word_count == max(12, blank.random_human_word_count) and blank.source == ""


def test_rendering(spark):
    specs = [PromptSpec("a", "{question} {row_index}/{split}", " {source} "), PromptSpec("b", "{{}}{target_min_words}")]
    got = {(r.row_id, r.prompt_name): r for r in P.build_prompts(_corpus(spark), specs, 1).collect()}
    assert got[0, "a"].prompt == "System:\ns\n\nUser:\nq0 0/train\n\nAssistant:\n"
    assert got[1, "a"].prompt == "q1 1/train" and [m.role for m in got[1, "a"].messages] == ["user"]
    assert got[0, "b"].prompt == "{}9"
    with pytest.raises(ValueError, match="Unknown template field 'nope'"):
        P.build_prompts(_corpus(spark), [PromptSpec("c", "{nope}")], 1)


def test_prompt_files(spark, tmp_path):
    one = {"user": "u", "generation": {"top_p": 0.5}}
    for payload in ({"prompts": {"n": one}}, {"n": one}, [{"name": "n", **one}], {"prompts": [{"name": " n ", **one}]}):
        assert parse_prompt_specs(payload) == [PromptSpec("n", "u", None, None, {"top_p": 0.5})]
    bad = ["x", {"n": "x"}, ["x"], [{"user": "u"}], [{"name": "n"}], [{"name": "n", "user": "u"}] * 2, [{"name": "n", "user": "u", "generation": [1]}]]
    for payload in bad:
        with pytest.raises(ValueError):
            parse_prompt_specs(payload)
    (tmp_path / "p.json").write_text(json.dumps({"prompts": {"é": {"user": "u\n{question}"}}}), encoding="utf-8")
    assert load_prompt_specs(spark, str(tmp_path / "p.json"))[0] == PromptSpec("é", "u\n{question}")


def test_draws_reach_beyond_32_bits(spark):
    drawn = [r[0] for r in spark.range(200).select(hash60(1, F.col("id"))).collect()]
    assert max(drawn) > 1 << 59 and min(drawn) >= 0 and len({d >> 32 for d in drawn}) == 200


def test_select_specs():
    assert [s.name for s in select_specs(EXAMPLE_SPECS, ["casual", "plain"])] == ["plain", "casual"]
    assert len(select_specs(EXAMPLE_SPECS)) == len(EXAMPLE_SPECS)
    with pytest.raises(ValueError, match="not found: x, y"):
        select_specs(EXAMPLE_SPECS, ["y", "plain", "x"])


def test_generation_params(spark):
    made = {r.name: r for r in P.generation_params(specs_frame(spark, EXAMPLE_SPECS)).collect()}
    assert (made["plain"].max_new_tokens, made["plain"].temperature, made["plain"].num_beams) == (120, 0.75, None)
    assert made["casual"].max_new_tokens == 170 and made["casual"].top_p == 0.9
    assert made["same_question_ref"].num_beams == 2 and made["same_question_ref"].temperature is None
    for wrong in ({"max_new_tokens": 0}, {"num_return_sequences": 0}, {"temperature": 0}, {"top_p": 1.5}, {"top_p": 0}, {"do_sample": False, "num_beams": 0}):
        with pytest.raises(ValueError, match="Prompt 'w'"):
            P.check_generation_params(P.generation_params(specs_frame(spark, [PromptSpec("w", "u", None, None, wrong)])))
    fine = PromptSpec("w", "u", None, None, {"do_sample": False, "temperature": 0})
    P.check_generation_params(P.generation_params(specs_frame(spark, [fine])))

import pytest
from pyspark.sql import functions as F

from answerloom.functions.quality import is_bad_strict
from answerloom.operators import generation as G
from answerloom.sources.generations import RECORD_SCHEMA, read_records, read_shards
from answerloom.sources.prompts import PromptSpec

SPECS = [PromptSpec("a", "u"), PromptSpec("b", "u")]


def _rows(spark, n=4):
    return spark.range(n).select(F.lit("train").alias("split"), F.col("id").alias("row_id"))


def _records(spark, rows):
    return spark.createDataFrame(rows, RECORD_SCHEMA)


def _tasks(prompts=False):
    return [G.Task(s, f"ai_{s.name}", f"prompt_ai_{s.name}" if prompts else None) for s in SPECS]


def test_merge_takes_the_last_record(spark):
    gen = _records(spark, [
        ("train", 0, "a", 0, 9, "old", "p"), ("train", 0, "a", 1, 1, "mid", "p"), ("train", 0, "a", 1, 2, "new", " p2 "),
        ("train", 1, "a", 0, 1, None, None), ("train", 1, "b", 0, 1, "other", None), ("eval", 0, "a", 5, 5, "no", None),
    ])
    got = {r.row_id: r for r in G.merge_generations(_rows(spark), gen, _tasks(True)).collect()}
    assert (got[0].ai_a, got[0].prompt_ai_a, got[0].ai_b) == ("new", "p2", None)
    assert (got[1].ai_a, got[1].prompt_ai_a, got[1].ai_b, got[1].prompt_ai_b) == (None, "", "other", "")
    assert got[3].ai_a is None and len(got) == 4


def test_merge_replaces_columns(spark):
    df = _rows(spark, 1).withColumn("ai_a", F.lit("before"))
    merged = G.merge_generations(df, _records(spark, [("train", 0, "a", 0, 0, "after", None)]), _tasks()[:1])
    assert merged.columns == ["split", "row_id", "ai_a"] and merged.first().ai_a == "after"


def test_merge_of_one_split_keeps_the_others(spark):
    df = _rows(spark, 2).withColumn("ai_a", F.lit("before"))
    df = df.unionByName(df.withColumn("split", F.lit("eval")))
    gen = _records(spark, [("eval", i, p, 0, 0, "after", None) for i in range(2) for p in "ab"])
    got = {(r.split, r.row_id): (r.ai_a, r.ai_b) for r in G.merge_generations(df, gen, _tasks(), splits=["eval"]).collect()}
    assert got == {(s, i): (("after", "after") if s == "eval" else ("before", None)) for s in ("train", "eval") for i in range(2)}


def test_completeness(spark):
    full = [("train", i, p, 0, 0, "x", None) for i in range(4) for p in "ab"]
    G.check_complete(_rows(spark), _records(spark, full), ["a", "b"])
    with pytest.raises(RuntimeError, match="train/a/2, train/b/1"):
        partial = [(*r[:5], None, None) if r[1:3] == (2, "a") else r for r in full if r[1:3] != (1, "b")]
        G.check_complete(_rows(spark), _records(spark, partial), ["a", "b"])
    with pytest.raises(ValueError, match="Invalid row 99"):
        G.check_complete(_rows(spark), _records(spark, [*full, ("train", 99, "a", 0, 0, "x", None)]), ["a", "b"])


def test_plan_tasks(spark):
    df = _rows(spark).withColumn("ai_m_a", F.lit("x"))
    with pytest.raises(ValueError, match="Column conflict.* ai_m_a"):
        G.plan_tasks(df, SPECS, "M")
    partly = df.withColumn("ai_m_a", F.when(F.col("row_id") == 1, "x"))
    assert len(G.plan_tasks(partly.where("row_id <> 1"), SPECS, "M")) == 2  # no answer in the target rows
    assert [t.answer_column for t in G.plan_tasks(df, SPECS, "M", on_conflict="skip")] == ["ai_m_b"]
    over = G.plan_tasks(df, SPECS, "M", on_conflict="overwrite", save_prompts=True)
    assert [(t.answer_column, t.prompt_column) for t in over] == [("ai_m_a", "prompt_ai_m_a"), ("ai_m_b", "prompt_ai_m_b")]
    with pytest.raises(ValueError):
        G.plan_tasks(df, SPECS, "M", on_conflict="other")


def test_generate_batches_by_prompt_style(spark):
    def make():
        def run(prompts, style, attempt):
            assert len(prompts) <= 3
            return [([f"{style}:{p}:{len(prompts)}", "second"], 7) for p in prompts]

        return run

    df = spark.createDataFrame([(str(i), "ab"[i % 2]) for i in range(10)], "prompt string, prompt_name string").coalesce(1)
    got = {r.prompt: r for r in G.generate(df, make, batch_size=3).collect()}
    assert got["4"].answers == ["a:4:3", "second"] and got["8"].answers[0] == "a:8:2" and got["9"].token_count == 7
    assert df.select(G.scalar_answer(F.array(F.lit("x")), 1)).first()[0] == "x"
    with pytest.raises(ValueError):
        G.generate(df, make, batch_size=0)


def test_wrong_number_of_answers_fails(spark):
    df = spark.createDataFrame([("p", "a")], "prompt string, prompt_name string")
    with pytest.raises(Exception, match="Expected 1 answers, got 0"):
        G.generate(df, lambda: lambda prompts, style, attempt: []).collect()


def test_retry_once_keeps_the_second_result(spark):
    good = "this answer has clearly more than ten words in it, so it stays"

    def make():
        def run(prompts, style, attempt):
            out = {"good": good, "bad": "short", "worse": "Answer: !"}
            return [out[p] if attempt == 1 else {"bad": "Answer: " + good, "worse": "?"}[p] for p in prompts]

        return run

    df = spark.createDataFrame([("good", "a"), ("bad", "a"), ("worse", "a")], "prompt string, prompt_name string")
    got = {r.prompt: r for r in G.generate_with_retry(df, make).collect()}
    assert (got["good"].answer, got["good"].retried, got["good"].bad_output) == (good, False, False)
    assert (got["bad"].answer, got["bad"].retried, got["bad"].bad_output) == (good, True, False)
    assert (got["worse"].answer, got["worse"].retried, got["worse"].bad_output) == ("", True, True)
    strict = G.generate_with_retry(df.where("prompt = 'bad'"), make, is_bad_strict).first()
    assert strict.retried


def test_one_model_for_each_worker(spark, tmp_path):
    builds = str(tmp_path)

    def make():
        import os
        import uuid

        open(os.path.join(builds, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda prompts, style, attempt: ["short" if int(p) % 3 == 0 else "word " * 12 for p in prompts]

    df = spark.range(64).select(F.col("id").cast("string").alias("prompt"), F.lit("a").alias("prompt_name")).repartition(16)
    rows = G.generate_with_retry(df, make).collect()
    assert sum(r.retried for r in rows) == 22 and len(rows) == 64
    G.generate(df, make).collect()
    made = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    workers = int(spark.sparkContext.defaultParallelism)
    assert len(made) == len(set(made)) <= workers  # at least 16 + 16 tasks, and those of the retry


def test_kept_objects_are_bounded():
    from answerloom.operators import workers

    closed = []

    class Model:
        def close(self):
            closed.append(self)

    first = workers.held("one", Model)
    assert workers.held("one", Model) is first and not closed
    workers.held("two", Model)
    assert closed == [first] and len(workers._HELD) == 1
    settings = {"a": 1}
    assert workers.key_of(lambda: settings) != workers.key_of(lambda: {"a": 2})


def test_record_files(spark, tmp_path):
    (tmp_path / "train__my__style__rank0.jsonl").write_text('{"index": 1, "answer": "é"}\n\n{"index": 1, "answer": "z", "prompt": " p "}\n', encoding="utf-8")
    (tmp_path / "train__my__style__rank1.jsonl").write_text('{"index": 0, "answer": "y"}\n')
    shards = read_shards(spark, str(tmp_path / "*.jsonl"))
    assert dict(shards.dtypes) == dict(_records(spark, []).dtypes)  # both sources can be put together
    latest = {r.row_id: r for r in G.latest_records(shards).collect()}
    assert latest[1].answer == "z" and latest[1].prompt == "p" and latest[1].prompt_name == "my__style"
    assert latest[0].answer == "y" and latest[0].split == "train"
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "x.json").write_text('{"split":"train","row_id":3,"prompt_name":"a","rank":0,"line_no":1,"answer":"k"}\n')
    assert read_records(spark, str(tmp_path / "r")).first().answer == "k"

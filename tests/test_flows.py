import json

import pytest
from pyspark.sql import functions as F

from answerloom.functions.seeding import hash32
from answerloom.operators import metrics as M
from answerloom.operators.learning import TrainParams
from answerloom.plans import flows
from answerloom.queries.views import AI_COLUMNS, StubGenerator, qa
from answerloom.sources import columns as apart
from answerloom.sources import corpus as tables
from answerloom.sources import files, ledger
from answerloom.sources.prompts import EXAMPLE_SPECS, PromptSpec

PARAMS = TrainParams(max_iter=3, features=1 << 10)


@pytest.fixture(scope="module")
def subset(spark, sf_dir, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("subset") / "s")
    made = flows.create_subset(qa(spark, sf_dir), 60, 30, 7, out)
    assert json.loads(files.read_small(spark, f"{out}/subset_config.json"))["source_rows_after_filtering"] == 171
    return made


def test_create_subset(spark, sf_dir, subset):
    rows = subset.collect()
    assert {(r.split, r.row_id) for r in rows} == {("train", i) for i in range(60)} | {("eval", i) for i in range(30)}
    assert len({(r.origin_split, r.origin_index) for r in rows}) == 90
    assert all(r.selected_human_answer and r.selected_human_answer_index >= 0 for r in rows)
    only = flows.create_subset(qa(spark, sf_dir), 5, 5, 7, splits=["eval"])
    assert {r.origin_split for r in only.collect()} == {"eval"}
    with pytest.raises(ValueError):
        flows.create_subset(qa(spark, sf_dir), 200, 5, 7)


def test_augment_appends_columns(spark, subset, tmp_path):
    out = str(tmp_path / "aug")
    plain = dict(make_generator=StubGenerator, out=out, model_name="Org/Tiny", model_alias="tiny")
    first = flows.augment(subset, EXAMPLE_SPECS, prompt_names=["plain"], save_prompts=True, parts=2, **plain)
    assert {"ai_tiny_plain", "prompt_ai_tiny_plain"} <= set(first.columns)
    assert first.where("ai_tiny_plain is null").count() == 0 and first.count() == 90
    with pytest.raises(ValueError, match="Column conflict"):
        flows.augment(subset, EXAMPLE_SPECS, prompt_names=["plain"], **plain)
    both = flows.augment(subset, EXAMPLE_SPECS, prompt_names=["plain", "same_question_ref"], on_conflict="skip", splits=["eval"], **plain)
    types = dict(both.dtypes)
    assert types["ai_tiny_plain"] == "string" and types["ai_tiny_same_question_ref"] == "array<string>"
    filled = both.groupBy("split").agg(F.count("ai_tiny_same_question_ref").alias("n")).collect()
    assert {r.split: r.n for r in filled} == {"eval": 30, "train": 0}
    latest = ledger.latest_runs(ledger.read_runs(spark, f"{out}/runs")).first()
    assert json.loads(latest.config)["answer_columns"] == ["ai_tiny_same_question_ref"]
    assert ledger.read_runs(spark, f"{out}/runs").count() == 2


def test_augment_one_split_after_the_other(spark, subset, tmp_path):
    out = str(tmp_path / "aug")

    def says(word):
        return lambda: lambda prompts, style, attempt: [word] * len(prompts)

    args = dict(out=out, model_name="m", prompt_names=["plain"])
    flows.augment(subset, EXAMPLE_SPECS, says("one"), splits=["train"], **args)
    flows.augment(subset, EXAMPLE_SPECS, says("two"), splits=["eval"], **args)
    before = apart.manifest(spark, out)
    again = flows.augment(subset, EXAMPLE_SPECS, says("three"), splits=["eval"], on_conflict="overwrite", **args)
    assert {tuple(r) for r in again.select("split", "ai_m_plain").distinct().collect()} == {("train", "one"), ("eval", "three")}
    assert again.count() == 90
    now = apart.manifest(spark, out)
    # the wide rows and the other split's answers stay where they were
    assert now["base"] == before["base"] and len(files.child_names(spark, f"{out}/versions")) == 1
    assert now["columns"]["ai_m_plain"]["train"] == before["columns"]["ai_m_plain"]["train"]
    assert now["columns"]["ai_m_plain"]["eval"] != before["columns"]["ai_m_plain"]["eval"]
    with pytest.raises(ValueError, match="Column conflict"):
        flows.augment(subset, EXAMPLE_SPECS, says("four"), splits=["eval"], **args)
    same = flows.augment(subset, EXAMPLE_SPECS, says("four"), splits=["eval"], on_conflict="skip", **args)
    assert {r[0] for r in same.select("ai_m_plain").distinct().collect()} == {"one", "three"}


def test_shards_become_columns(spark, subset, tmp_path):
    from answerloom.sources.generations import write_shards

    shards, out = str(tmp_path / "shards"), str(tmp_path / "aug")
    made = subset.select("split", "row_id", F.explode(F.array(F.lit("plain"), F.lit("my__style"))).alias("prompt_name"))
    made = made.withColumns({"rank": F.col("row_id").cast("int") % 2, "line_no": F.col("row_id"), "answer": F.concat("prompt_name", F.lit(" é "), "row_id"), "prompt": F.lit("p")})
    write_shards(made, shards)
    names = files.child_names(spark, shards)
    assert len(names) == 8 and "train__my__style__rank1.jsonl" in names
    got = flows.ingest_shards(subset, f"{shards}/*.jsonl", out, "M", splits=["eval"], save_prompts=True)
    rows = {(r.split, r.row_id): (r.ai_m_plain, r.ai_m_my_style, r.prompt_ai_m_plain) for r in got.collect()}
    assert len(rows) == 90 and rows["eval", 3] == ("plain é 3", "my__style é 3", "p") and rows["train", 3] == (None, None, None)
    with pytest.raises(ValueError, match="Column conflict"):
        flows.ingest_shards(subset, f"{shards}/*.jsonl", out, "M", splits=["eval"])
    both = flows.ingest_shards(subset, f"{shards}/*.jsonl", out, "M", ["plain"][0], ["plain"], on_conflict="overwrite")
    assert "ai_plain_plain" in both.columns and both.where("ai_plain_plain is null").count() == 0
    with pytest.raises(RuntimeError, match="Missing generated answers"):
        flows.ingest_shards(subset, f"{shards}/*rank0.jsonl", out, "N", prompt_names=["plain"])


def test_chat_messages_reach_the_generator(spark, subset, tmp_path):
    def make():
        def run(prompts, style, attempt):
            assert all([m["role"] for m in p] == ["system", "user"] for p in prompts)
            return [p[-1]["content"][:40] for p in prompts]

        return run

    made = flows.augment(
        subset, EXAMPLE_SPECS, make, str(tmp_path / "aug"), "m", prompt_names=["plain"], chat=True, prefix="bot", save_prompts=True
    )
    row = made.first()
    sent = json.loads(row.prompt_bot_m_plain)
    assert [m["role"] for m in sent] == ["system", "user"] and row.bot_m_plain == sent[1]["content"][:40].strip()


def test_names_of_splits_stay_text(spark, tmp_path):
    df = spark.createDataFrame([("01", 1), ("02", 2)], "split string, row_id long")
    tables.snapshot(df, str(tmp_path / "s"))
    back = tables.load(spark, str(tmp_path / "s"))
    assert dict(back.dtypes)["split"] == "string" and {r.split for r in back.collect()} == {"01", "02"}
    draws = lambda d: {r[0] for r in d.select(hash32(1, F.col("split"), F.col("row_id"))).collect()}
    assert draws(df) == draws(back)


def test_generation_values_reach_the_generator(spark, subset, tmp_path):
    def make(settings):
        return lambda prompts, style, attempt: [f"{style} {settings[style]['max_new_tokens']}"] * len(prompts)

    out = str(tmp_path / "aug")
    made = flows.augment(subset, EXAMPLE_SPECS, make, out, "m", prompt_names=["plain", "casual"])
    assert {tuple(r) for r in made.select("ai_m_plain", "ai_m_casual").distinct().collect()} == {("plain 120", "casual 170")}


def test_augment_resumes_a_stopped_run(spark, subset, tmp_path):
    out, marks = str(tmp_path / "aug"), tmp_path / "marks"
    marks.mkdir()

    def make():
        def run(prompts, style, attempt):
            if style == "casual" and not (marks / "go").exists():
                raise RuntimeError("worker lost")
            with open(marks / style, "a") as log:
                log.write("x" * len(prompts))
            return ["made " + style] * len(prompts)

        return run

    args = dict(specs=EXAMPLE_SPECS, make_generator=make, out=out, model_name="m", prompt_names=["plain", "casual"], run_id="r1")
    with pytest.raises(Exception, match="worker lost"):
        flows.augment(subset, **args)
    assert not files.exists(spark, f"{out}/{tables.POINTER}")
    (marks / "go").write_text("")
    done = flows.augment(subset, **args)
    assert done.where("ai_m_plain = 'made plain' and ai_m_casual = 'made casual'").count() == 90
    assert len((marks / "plain").read_text()) == 90


def test_train_save_and_transfer(spark, sf_dir, tmp_path):
    out = str(tmp_path / "run")
    corpus = qa(spark, sf_dir)
    trained = flows.train_and_evaluate(corpus, out, params=PARAMS, window_words=20, max_samples={"train": 80}, all_rows=True)
    metrics = {r.ai_column: r for r in trained.collect()}
    assert set(metrics) == set(AI_COLUMNS) and all(0 <= r.f1 <= 1 and r.n > 0 for r in metrics.values())
    bundle = f"{out}/eval_logs/" + files.child_names(spark, f"{out}/eval_logs")[0]
    written = {r.ai_column: r for r in spark.read.json(f"{bundle}/metrics").collect()}
    assert written["ai_m1_basic"].accuracy == pytest.approx(metrics["ai_m1_basic"].accuracy)
    csv = spark.read.option("header", True).csv(f"{bundle}/source_metrics")
    assert csv.columns[:3] == ["ai_column", "source", "n"] and csv.count() > 2
    assert spark.read.json(f"{bundle}/eval_predictions").count() == sum(r.n for r in metrics.values())
    assert spark.read.json(f"{bundle}/confusion_matrix").count() == 8
    with pytest.raises(FileExistsError):
        flows.train_and_evaluate(corpus, out, ["ai_m1_basic"], params=PARAMS)
    assert flows.train_and_evaluate(corpus, out, ["ai_m1_basic"], params=PARAMS, policy="skip").count() == 0

    moved = flows.evaluate_checkpoint(corpus, f"{out}/ai_m1_basic/model", ["ai_m1_guided"], params=PARAMS, window_words=20).first()
    assert moved.ai_column == "ai_m1_guided" and moved.n == metrics["ai_m1_guided"].n
    kept = str(tmp_path / "transfer")
    args = dict(params=PARAMS, window_words=20, out=kept)
    flows.evaluate_checkpoint(corpus, f"{out}/ai_m1_basic/model", ["ai_m1_guided"], **args)
    assert json.loads(files.read_small(spark, f"{kept}/eval_config.json"))["answer_window_words"] == 20
    wrong = spark.read.json(f"{kept}/eval_logs/bad_classifications")
    assert wrong.count() == min(200, moved.n - round(moved.accuracy * moved.n)) and "answer_source_column" in wrong.columns
    with pytest.raises(FileExistsError):
        flows.evaluate_checkpoint(corpus, f"{out}/ai_m1_basic/model", ["ai_m1_guided"], **args)
    with pytest.raises(ValueError, match="choose another output folder"):
        flows.evaluate_checkpoint(corpus, f"{out}/ai_m1_basic/model", ["ai_m1_guided"], policy="overwrite", **{**args, "out": out})
    over = flows.evaluate_checkpoint(corpus, f"{out}/ai_m1_basic/model", ["ai_m1_guided"], policy="overwrite", max_eval_samples=10, **args)
    assert over.first().n == 10
    again = flows.evaluate_checkpoint(corpus, f"{out}/ai_m1_basic/model", ["ai_m1_basic"], params=PARAMS, window_words=20).first()
    assert again.f1 == pytest.approx(metrics["ai_m1_basic"].f1)


def test_size_sweep(spark, sf_dir, tmp_path):
    corpus = qa(spark, sf_dir)
    out = str(tmp_path / "sweep")
    rows = flows.sweep_train_sizes(corpus, "ai_m1_basic", [40, 20, 40], params=PARAMS, out=out).collect()
    assert {(r.train_rows, r.status) for r in rows} == {(20, "completed"), (40, "completed")}
    assert spark.read.option("header", True).csv(f"{out}/size_metrics").count() == 2
    assert {r.eval_column for r in rows} == {"ai_m1_basic"} and all(r.run_output_dir.startswith(out) for r in rows)
    assert files.exists(spark, f"{out}/train_rows_20/model") and files.exists(spark, f"{out}/train_rows_40/eval_logs/metrics")
    with pytest.raises(FileExistsError):
        flows.sweep_train_sizes(corpus, "ai_m1_basic", [20, 30], params=PARAMS, out=out)
    on = flows.sweep_train_sizes(corpus, "ai_m1_basic", [20, 40, 30], params=PARAMS, out=out, policy="skip").collect()
    status = {r.train_rows: (r.status, r.eval_f1) for r in on}
    assert {k: v[0] for k, v in status.items()} == {20: "skipped", 40: "skipped", 30: "completed"}
    assert status[20][1] == pytest.approx(next(r.eval_f1 for r in rows if r.train_rows == 20))
    assert spark.read.option("header", True).csv(f"{out}/size_metrics").count() == 3
    for columns, sizes in (("ai_m1_basic,ai_m1_guided", [5]), ("ai_m1_basic", [100_000])):
        with pytest.raises(ValueError):
            flows.sweep_train_sizes(corpus, columns, sizes, params=PARAMS)


def test_held_out_choice_of_settings(spark, sf_dir):
    from answerloom.operators.learning import fit, predict

    examples = flows.classification_examples(qa(spark, sf_dir), ["ai_m1_basic"])
    params = TrainParams(max_iter=3, features=1 << 10, reg_params=(0.01, 50.0))
    model = fit(examples.where("split = 'train'"), params)
    assert model.stages[-1].getRegParam() in params.reg_params
    assert M.binary_metrics(predict(model, examples.where("split = 'eval'"), params)).first().n > 0


def test_profile(spark, sf_dir, tmp_path):
    stats, curve = flows.profile_lengths(qa(spark, sf_dir), splits=["eval"], bins=10, out=str(tmp_path / "p"))
    assert {r.answer_column for r in stats.collect()} == {"ai_m1_basic", "ai_m1_guided", "chatgpt_answers", "human_answers"}
    assert curve.count() == 40 and spark.read.option("header", True).csv(str(tmp_path / "p" / "stats")).count() == 4


def test_pilots(spark, tmp_path):
    questions = spark.createDataFrame([(1, "what is rain " * 5), (2, "why")], "question_id long, question string")
    specs = [PromptSpec("a", "{question}"), PromptSpec("b", "Say: {question}")]
    grid = flows.pilot_grid(questions, specs, StubGenerator, "stub")
    got = {(r.question_id, r.prompt_style): r for r in grid.collect()}
    assert len(got) == 4 and not got[1, "a"].bad_output and got[2, "a"].bad_output
    path, marks = str(tmp_path / "pilot"), tmp_path / "calls"
    marks.touch()

    def counting():
        stub = StubGenerator()

        def run(prompts, style, attempt):
            with open(marks, "a") as log:
                log.write("x" * len(prompts))
            return stub(prompts, style, attempt)

        return run

    assert flows.pilot_grid(questions.where("question_id = 1"), specs, counting, "stub", out=path).count() == 2
    assert flows.pilot_grid(questions, specs, counting, "stub", out=path, parts=3).count() == 4
    calls = len(marks.read_text())
    assert flows.pilot_grid(questions, specs, counting, "stub", out=path).count() == 4
    assert len(marks.read_text()) == calls

    pairs = questions.withColumn("human_answer", F.lit("rain is water"))
    guided = flows.guided_pilot(pairs, PromptSpec("g", "{question} / {human_answer}"), StubGenerator, "stub").collect()
    assert {r.prompt_style for r in guided} == {"g"} and all(0 <= r.word_overlap_with_human <= 1 for r in guided)

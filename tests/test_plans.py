"""The shape of the plans: what reaches the scan, what is shuffled, where Python runs."""

import re

import pytest
from pyspark.sql import functions as F

from answerloom.operators import corpus as C
from answerloom.operators import metrics as M
from answerloom.operators import sampling as S
from answerloom.operators.flatten import flatten, pair_examples, paired
from answerloom.queries import QUERIES
from answerloom.queries.views import AI_COLUMNS, qa, scored

PYTHON_QUERIES = {"retry_once", "prompt_grid", "guided_grid"}
TRAINING = {"train_per_column"}
# The report shows the repr of its sampled rows.
SAMPLED_PYTHON = {"input_report_lines"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "qa")
    qa(spark, sf_dir).write.partitionBy("split").parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - TRAINING))
def test_no_python_per_row_and_no_single_partition_window(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "BatchEvalPython" not in text and ("ArrowEvalPython" in text) == (name in SAMPLED_PYTHON)
    assert ("MapInPandas" in text) == (name in PYTHON_QUERIES)
    for block in re.findall(r"Window \[.*?\n.*?\n.*?\n.*", text):
        assert "Exchange SinglePartition" not in block or "_bucket" in block
    assert "CartesianProduct" not in text


def test_flatten_does_not_shuffle(stored):
    text = plan(flatten(stored, AI_COLUMNS, 42, window_words=50))
    assert "Exchange" not in text and text.count("FileScan") == 1


def test_pairing_and_plans_without_shuffles(spark, sf_dir, stored):
    pairs = paired(stored, AI_COLUMNS, 42, window_words=50)
    assert "Exchange" not in plan(pairs)
    both = pair_examples(flatten(stored, AI_COLUMNS, 42, window_words=50), ["answer", "text"])
    assert sorted(map(tuple, pairs.select(*both.columns).collect())) == sorted(map(tuple, both.collect()))
    assert all("REPARTITION_BY_NUM" not in plan(QUERIES[n](spark, sf_dir)) for n in ("clean_lists", "input_inspection"))


def test_split_filter_prunes_folders_and_columns(stored):
    text = plan(C.resolve_splits(stored, ["eval"]).select("row_id"))
    assert re.search(r"PartitionFilters: \[[^\]]*split#\d+ = eval", text)
    assert re.search(r"ReadSchema: struct<row_id:bigint>", text)


def test_filters_reach_the_scan(stored):
    text = plan(stored.where(F.col("source") == "src1").select("row_id"))
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src1)]" in text


def test_metrics_aggregate_before_the_shuffle(spark, sf_dir):
    text = plan(M.source_metrics(M.with_scores(scored(spark, sf_dir))))
    assert text.count("HashAggregate") == 2 and "SortAggregate" not in text
    assert "partial_count" in text and text.count("Exchange hashpartitioning") <= 3


def test_small_k_limits_before_the_shuffle(spark, sf_dir):
    assert "BroadcastHashJoin" in plan(S.sample_rows(qa(spark, sf_dir).select("split", "row_id"), 5, 1))
    ranked = plan(S.first_n(scored(spark, sf_dir), 5, ["eval_order"], ["ai_column"]))
    assert ranked.count("WindowGroupLimit") == 4


def test_limited_positions_prune_before_the_shuffle(stored):
    text = plan(S.seeded_positions(stored, 1, ["split", "row_id"], below=10))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_reference_answers_are_ranked_without_their_texts(spark):
    from answerloom.operators.prompts import random_other_answer

    rows = spark.createDataFrame([("train", i, f"answer {i}", "q") for i in range(9)], "split string, row_id long, human_answer string, question string")
    drawn = random_other_answer(rows, 1, ["a", "b"], carry=["question"])
    lines = str(drawn._jdf.queryExecution().optimizedPlan().toString()).split("\n")
    windows = [i for i, line in enumerate(lines) if re.search(r"[+:]- Window|^Window", line)]
    assert windows
    for i in windows:
        own = re.findall(r"Project \[(.*)\]", "\n".join(lines[i:]))[:1]  # what the window reads
        assert own and not any(re.search(r"human_answer#\d+(,|$)|question", columns) for columns in own)
    assert drawn.count() == 18 and drawn.where("random_human_answer = concat('answer ', row_id)").count() == 0

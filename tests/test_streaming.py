from pyspark.sql import functions as F

from answerloom.streaming.incremental import arriving_rows, incremental_generation, read_answers

SCHEMA = "split string, row_id long, question string"


def _prompts(rows):
    return rows.select("split", "row_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("prompt_name"), F.col("question").alias("prompt"))


def test_each_row_is_answered_once(spark, tmp_path):
    arrived, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def make():
        def generate(prompts, style, attempt):
            return [f"a fairly long stub answer number {attempt} for the prompt called {p} in style {style}" for p in prompts]

        return generate

    def arrive(ids):
        rows = spark.createDataFrame([("train", i, f"q{i}") for i in ids], SCHEMA)
        rows.coalesce(1).write.mode("append").parquet(arrived)

    def run():
        rows = arriving_rows(spark, arrived, rows_schema, 1)
        query = incremental_generation(rows, _prompts, make, out, state)
        query.awaitTermination(120)
        assert query.exception() is None

    rows_schema = spark.createDataFrame([], SCHEMA).schema
    arrive([1, 2, 2])
    run()
    assert read_answers(spark, out).count() == 4
    arrive([2, 3])
    run()
    answers = read_answers(spark, out)
    assert answers.count() == 6 and answers.select("row_id", "prompt_name").distinct().count() == 6
    assert not answers.where("bad_output or retried").count()

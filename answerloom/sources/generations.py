"""Generation records: the durable long table, and line files written by other tools."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.functions.text import safe_text
from answerloom.sources import files

# Bits for the lines that one task reads.
TASK_LINES = 33
SHARD_NAME = r"^(.*?)__(.*)__rank(\d+)\.jsonl?(?:\.gz)?$"
RECORD_SCHEMA = (
    "split string, row_id long, prompt_name string, rank int, line_no long, answer string, prompt string"
)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines that name split, row and prompt style; blank lines are skipped."""
    return spark.read.schema(RECORD_SCHEMA).json(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines ``{"index", "answer"[, "prompt"]}`` in files ``<split>__<prompt>__rank<n>.jsonl``.

    Split, prompt style and rank come from the file name; ``line_no`` orders the lines of a file. A task numbers its
    lines in order, and the blocks of a file are at least as far apart as the smaller one of Spark's two settings for
    them, so the block's number and the line's number fit one long for files of any length in use (64 TiB at 64 KiB).
    """
    raw = spark.read.schema("index long, answer string, prompt string").json(path)
    name = F.col("_metadata.file_name")
    conf = spark._jsparkSession.sessionState().conf()
    apart = max(1, min(conf.filesMaxPartitionBytes(), conf.filesOpenCostInBytes()))
    block = F.shiftright(F.col("_metadata.file_block_start"), apart.bit_length() - 1)
    return raw.select(
        F.regexp_extract(name, SHARD_NAME, 1).alias("split"),
        F.col("index").alias("row_id"),
        F.regexp_extract(name, SHARD_NAME, 2).alias("prompt_name"),
        F.regexp_extract(name, SHARD_NAME, 3).cast("int").alias("rank"),
        F.shiftleft(block, TASK_LINES).bitwiseOR(F.monotonically_increasing_id().bitwiseAND((1 << TASK_LINES) - 1)).alias("line_no"),
        "answer",
        safe_text(F.col("prompt")).alias("prompt"),
    )


def write_shards(generated: DataFrame, path: str) -> None:
    """Write records as shards that ``read_shards`` understands, one file for each split, prompt style and rank.

    A rank is what one process made, so its records are one task's; lines go by ``line_no``.
    """
    spark = generated.sparkSession
    draft = f"{path}/.draft-{uuid.uuid4().hex}"
    shard = F.concat("split", F.lit("__"), "prompt_name", F.lit("__rank"), "rank", F.lit(".jsonl"))
    line = F.to_json(F.struct(F.col("row_id").alias("index"), "answer", "prompt"), {"ignoreNullFields": "false"})
    lines = generated.select(shard.alias("shard"), "line_no", line.alias("value"))
    lines.repartition("shard").sortWithinPartitions("shard", "line_no").drop("line_no").write.partitionBy("shard").text(draft)
    for folder in files.child_names(spark, draft):
        if folder.startswith("shard="):
            part = next(n for n in files.child_names(spark, f"{draft}/{folder}") if n.startswith("part-"))
            files.rename(spark, f"{draft}/{folder}/{part}", f"{path}/{files.unescape(folder[6:])}")
    files.clear(spark, draft)


def write_records(generated: DataFrame, path: str) -> None:
    """Append generated answers, one folder per prompt style."""
    generated.write.mode("append").partitionBy("prompt_name").parquet(path)


def records(spark: SparkSession, path: str) -> DataFrame:
    """The durable table, with prompt styles and splits as text."""
    return files.read_partitioned(spark, path, "prompt_name", "split")


def pending(prompts: DataFrame, path: str) -> DataFrame:
    """Prompts without a record yet, so that an interrupted run goes on where it stopped."""
    spark = prompts.sparkSession
    if files.is_empty(spark, path) or "_SUCCESS" not in files.child_names(spark, path):
        return prompts
    done = records(spark, path).select("split", "row_id", "prompt_name")
    return prompts.join(done, ["split", "row_id", "prompt_name"], "left_anti")

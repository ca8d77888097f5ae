"""Run ledger: an append-only table of runs and the latest run per output."""

from __future__ import annotations

import json
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.sources import files

SCHEMA = "run_id string, run_seq long, output string, config string"


def append_run(spark: SparkSession, path: str, output: str, config: dict[str, Any], run_id: str | None = None) -> str:
    """Record a run; earlier records stay. ``config`` is kept as JSON."""
    run_id = run_id or str(uuid.uuid4())
    row = (run_id, time.time_ns(), output, json.dumps(config, ensure_ascii=False, default=str))
    spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").json(path)
    return run_id


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    if files.is_empty(spark, path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).json(path)


def latest_runs(runs: DataFrame, key: str = "output", order: str = "run_seq") -> DataFrame:
    """The newest record per output, without sorting the ledger."""
    rest = [c for c in runs.columns if c != key]
    return runs.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_run")).select(key, "_run.*")

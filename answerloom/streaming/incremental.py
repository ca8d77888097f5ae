"""Generate answers for rows as they arrive, with Structured Streaming.

Which rows have come is keyed state of the stream, so a batch costs what it brings
and not what came before it. Each micro-batch writes its own folder and rewrites it
whole when retried, from the state that the batch before it left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from answerloom.operators.generation import GeneratorFactory, generate_with_retry

#: What identifies a row; the state holds these alone.
ROW = ["split", "row_id"]
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arriving_rows(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """Stream over the parquet files that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def read_answers(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).drop("batch")


def incremental_generation(
    rows: DataFrame,
    build_prompts: Callable[[DataFrame], DataFrame],
    make_generator: GeneratorFactory,
    out: str,
    checkpoint_location: str,
    batch_size: int = 8,
) -> StreamingQuery:
    """Answer all rows that are there now and stop; run again for later arrivals.

    ``build_prompts`` turns the rows of a micro-batch into prompts with ``split``, ``row_id``,
    ``prompt_name`` and ``prompt``; it may use any static table, such as the answer pool. A row that comes again, in the
    same batch or a later one, is dropped by its key in the state store, which is kept on disk. No earlier answer is read.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        made = generate_with_retry(build_prompts(batch), make_generator, batch_size=batch_size)
        made.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    spark = rows.sparkSession
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ON_DISK)  # a query takes its settings when it starts
    try:
        return (
            rows.dropDuplicates(ROW)
            .writeStream.foreachBatch(answer)
            .option("checkpointLocation", checkpoint_location)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)

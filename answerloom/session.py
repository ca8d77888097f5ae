"""Session settings and the few helpers that look at the running session."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """Session for tests and the benchmark; on a cluster use the one spark-submit gives."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("answerloom")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.driver.memory", os.environ.get("ANSWERLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables, as named by the cluster.

    Only a local session without the setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster.")
        current = tempfile.mkdtemp(prefix="answerloom-checkpoint-")
        spark.sparkContext.setCheckpointDir(current)
    return current


def fresh(name: str, df: DataFrame) -> str:
    """A column name that a table doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Setting for the bytes of a batch that goes to a Python worker.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of a session, once for each application.

    The workers import it from the archive that Spark hands out, wherever the driver was started. A worker process
    imports it once and is used for many tasks, so what its modules keep (models, tokenizers) outlives a task.
    Batches of long texts are bounded by 8 MB in place of Spark's 64, unless the session says otherwise, as each is held
    twice, by the JVM and by the worker.
    """
    context = spark.sparkContext
    if spark.conf.get(BATCH_BYTES, None) is None:  # nobody has set it
        spark.conf.set(BATCH_BYTES, "8m")
    if context.applicationId in _SHIPPED:
        return
    home = Path(__file__).resolve().parent
    if home.is_dir():  # otherwise the package itself came in an archive, and the workers have that
        archive = os.path.join(tempfile.mkdtemp(prefix="answerloom-"), f"{home.name}.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for file in sorted(home.rglob("*.py")):
                out.write(file, str(file.relative_to(home.parent)))
        context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def map_arrow(df: DataFrame, function: Callable, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` whose function may use this package on the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def map_pandas(df: DataFrame, function: Callable, schema: T.StructType | str) -> DataFrame:
    """``mapInPandas`` whose function may use this package on the workers."""
    ship(df.sparkSession)
    return df.mapInPandas(function, schema)


def stage(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and go on from there, with one folder per value of ``by`` if given.

    The lineage ends there, so a lost executor costs no recomputation. The staged table is columnar:
    later passes read only the columns they use, and the planner knows its size.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/staged-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_buckets(df: DataFrame, key: str) -> DataFrame:
    """Write a table like `stage`, in buckets of a column: joins on that column move only the other side.

    There are as many buckets as shuffle partitions, so that the other side is dealt in the same way. The catalog keeps
    nothing of the table.
    """
    spark = df.sparkSession
    path, name = f"{checkpoint_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}", f"answerloom_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the tasks are the buckets, so each writes one file
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def unstage(*tables: DataFrame) -> None:
    """Remove the folders of staged tables that are no longer read."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            head, mark, rest = file.partition("/staged-")
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{head}{mark}{rest.split('/')[0]}")
            if mark:
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

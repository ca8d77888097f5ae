"""Small driver-side file operations on any file system Spark can reach."""

from __future__ import annotations

from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _path(spark: SparkSession, path: str):
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    return hadoop_path, hadoop_path.getFileSystem(conf), conf


def exists(spark: SparkSession, path: str) -> bool:
    p, fs, _ = _path(spark, path)
    return fs.exists(p)


def is_empty(spark: SparkSession, path: str) -> bool:
    """True for a missing path and for a folder without entries."""
    p, fs, _ = _path(spark, path)
    return not fs.exists(p) or len(fs.listStatus(p)) == 0


def child_names(spark: SparkSession, path: str) -> list[str]:
    p, fs, _ = _path(spark, path)
    return sorted(status.getPath().getName() for status in fs.listStatus(p)) if fs.exists(p) else []


def clear(spark: SparkSession, path: str) -> None:
    """Remove what an output folder holds, after the output policy has allowed it."""
    p, fs, _ = _path(spark, path)
    if fs.exists(p):
        fs.delete(p, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move a file; fails where the target exists."""
    p, fs, _ = _path(spark, source)
    if not fs.rename(p, _path(spark, target)[0]):
        raise FileExistsError(f"{source} could not be moved to {target}.")


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that readers see the old or the new text, never a part of it."""
    p, fs, conf = _path(spark, path)
    jvm = spark._jvm
    draft = jvm.org.apache.hadoop.fs.Path(path + ".draft")
    fs.mkdirs(p.getParent())
    stream = fs.create(draft, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(draft), context.makeQualified(p), options)


def create(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False if it exists. Of several writers only one succeeds."""
    p, fs, _ = _path(spark, path)
    fs.mkdirs(p.getParent())
    try:
        return fs.createNewFile(p)
    except Py4JJavaError:
        return False


def escape(value: str) -> str:
    """A value as Spark writes it in the name of a partition folder."""
    return SparkContext._active_spark_context._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def unescape(value: str) -> str:
    """The value that a partition folder's name stands for."""
    return unquote(value)


def read_small(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def read_partitioned(spark: SparkSession, path: str, *texts: str) -> DataFrame:
    """A parquet folder whose partition columns named in ``texts`` stay text.

    Without a schema a folder named split=01 would come back as the number 1.
    """
    found = spark.read.parquet(path).schema
    fields = [T.StructField(f.name, T.StringType() if f.name in texts else f.dataType) for f in found]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def inside(spark: SparkSession, path: str, folder: str) -> bool:
    """Whether a path is a folder or lies in it."""
    p, fs, _ = _path(spark, path)
    parent, _, _ = _path(spark, folder)
    inner, outer = (fs.makeQualified(x).toUri().getPath().rstrip("/") + "/" for x in (p, parent))
    return inner.startswith(outer)

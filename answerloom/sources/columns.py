"""Versions of a corpus whose generated columns are tables of their own.

A version is a manifest: the folder of each split's wide rows, and for each generated column and split the folder that has
its values. Every table is in buckets of the row id, so a version gets a column by writing that column alone, and a
reader joins the columns it asks for bucket by bucket, without moving the wide rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from typing import Any
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.columns import CORPUS, Corpus
from answerloom.sources import files

POINTER = "CURRENT"
#: Buckets of a new corpus. Each is a file of every table, and a task of every join; it can't be changed later.
BUCKETS = 64


def manifest_path(path: str, version: str) -> str:
    return f"{path}/metadata/{version.split('/')[-1]}.columns.json"


def current(spark: SparkSession, path: str) -> str | None:
    """The version that the pointer names."""
    pointer = f"{path}/{POINTER}"
    return files.read_small(spark, pointer).strip() if files.exists(spark, pointer) else None


def manifest(spark: SparkSession, path: str, version: str | None = None) -> dict[str, Any] | None:
    """Manifest of a version (the current one by default); None where versions aren't kept by column."""
    version = version or current(spark, path)
    if version is None or not files.exists(spark, manifest_path(path, version)):
        return None
    return json.loads(files.read_small(spark, manifest_path(path, version)))


def next_version(spark: SparkSession, path: str) -> str:
    """A new version name that no other writer has: its number is claimed by a file that only one can create."""
    taken = [n for n in files.child_names(spark, f"{path}/metadata") + files.child_names(spark, f"{path}/versions")]
    number = 1 + max((int(n[1:9]) for n in taken if n.startswith("v") and n[1:9].isdigit()), default=0)
    if not files.create(spark, f"{path}/metadata/v{number:08d}.claim"):
        raise RuntimeError(f"Another run publishes version {number} of {path} now.")
    return f"versions/v{number:08d}-{uuid.uuid4().hex[:8]}"


def move_pointer(spark: SparkSession, path: str, version: str, before: str | None) -> None:
    """Make a version the current one, unless another run has published since ``before`` was read."""
    if current(spark, path) != before:
        raise RuntimeError(f"{path} has a newer version than the one this run started from; nothing was published.")
    files.write_small(spark, f"{path}/{POINTER}", version)


def _write(rows: DataFrame, folder: str, buckets: int, key: str, split: str) -> list[str]:
    """Write rows in buckets, with a folder for each split; the splits written."""
    spark = rows.sparkSession
    name = f"answerloom_{uuid.uuid4().hex}"
    # the tasks are the buckets, so each writes one file of each split
    spread = rows.repartition(buckets, key)
    spread.write.partitionBy(split).bucketBy(buckets, key).sortBy(key).option("path", folder).format("parquet").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
    mark = f"{quote(split)}="
    return [files.unescape(n[len(mark) :]) for n in files.child_names(spark, folder) if n.startswith(mark)]


def _bucketed(spark: SparkSession, folder: str, buckets: int, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The table of one split's folder, known to be in buckets; the catalog keeps nothing of it."""
    schema = spark.read.parquet(folder).schema
    name = f"answerloom_{uuid.uuid4().hex}"
    place = folder.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({schema.toDDL()}) USING parquet CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{place}'")
    try:
        table = spark.table(name)
        return table if columns is None else table.select(F.col(f"`{key}`"), *[F.col(f"`{c}`") for c in columns])
    finally:
        spark.sql(f"DROP TABLE {name}")


def split_folder(folder: str, split_column: str, split: str) -> str:
    return f"{folder}/{quote(split_column)}={files.escape(split)}"


def load_columns(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, names: Corpus = CORPUS, version: str | None = None
) -> DataFrame:
    """A version with the generated columns asked for (all by default), or none of them for an empty list.

    Each split's rows meet its columns by bucket. A column that a split doesn't have is null there; a generated column
    replaces one of the wide rows with its name.
    """
    known = manifest(spark, path, version)
    if known is None:
        raise ValueError(f"{path} doesn't keep its columns apart.")
    asked = [c for c in known["columns"] if columns is None or c in columns]
    buckets, key = known["buckets"], known["key"]
    whole = None
    for split, folder in sorted(known["base"].items()):
        rows = _bucketed(spark, split_folder(f"{path}/{folder}", names.split, split), buckets, key)
        by_folder: dict[str, list[str]] = {}
        for column in asked:
            if split in known["columns"][column]:
                by_folder.setdefault(known["columns"][column][split], []).append(column)
        for source, own in by_folder.items():
            values = _bucketed(spark, split_folder(f"{path}/{source}", names.split, split), buckets, key, own)
            rows = rows.drop(*own).join(values, key, "left")
        rows = rows.withColumn(names.split, F.lit(split))
        whole = rows if whole is None else whole.unionByName(rows, allowMissingColumns=True)
    if whole is None:
        raise ValueError(f"{path} has no split.")
    order = [c for c in known["order"] if c in whole.columns]
    return whole.select(*[F.col(f"`{c}`") for c in order], *[F.col(f"`{c}`") for c in asked if c not in order])


def publish_base(
    df: DataFrame,
    path: str,
    metadata: dict[str, Any] | None = None,
    names: Corpus = CORPUS,
    buckets: int = BUCKETS,
) -> str:
    """Write whole rows as a new version, in buckets of the row id; later columns stand beside them. Returns the version."""
    spark = df.sparkSession
    before = current(spark, path)
    version = next_version(spark, path)
    splits = _write(df, f"{path}/{version}", buckets, names.row_id, names.split)
    made = {"buckets": buckets, "key": names.row_id, "base": {s: version for s in splits}, "columns": {}, "order": df.columns}
    _finish(spark, path, version, before, made, metadata)
    return version


def publish_columns(
    values: DataFrame,
    path: str,
    metadata: dict[str, Any] | None = None,
    names: Corpus = CORPUS,
) -> str:
    """Add or replace columns: a new version that shares all other tables with the current one. Returns the version.

    ``values`` has the split, the row id (each pair once) and one column for each that is added. Only these values are
    shuffled and written; splits without rows in ``values`` keep what they had.
    """
    spark = values.sparkSession
    before = current(spark, path)
    made = manifest(spark, path, before)
    if made is None:
        raise ValueError(f"{path} doesn't keep its columns apart.")
    version = next_version(spark, path)
    folder = f"columns/{version.split('/')[1]}"
    splits = _write(values, f"{path}/{folder}", made["buckets"], names.row_id, names.split)
    for column in values.columns:
        if column not in (names.split, names.row_id):
            made["columns"].setdefault(column, {}).update({s: folder for s in splits})
    _finish(spark, path, version, before, made, metadata)
    return version


def _finish(spark: SparkSession, path: str, version: str, before: str | None, made: dict, metadata: dict | None) -> None:
    files.write_small(spark, manifest_path(path, version), json.dumps(made, indent=2))
    if metadata is not None:
        files.write_small(spark, f"{path}/metadata/{version.split('/')[1]}.json", json.dumps(metadata, indent=2))
    move_pointer(spark, path, version, before)


def filled_columns(spark: SparkSession, path: str, splits: Sequence[str]) -> set[str]:
    """Generated columns that one of the splits has, by the manifest alone."""
    known = manifest(spark, path) or {"columns": {}}
    return {c for c, own in known["columns"].items() if set(own) & set(splits)}

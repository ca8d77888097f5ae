"""Corpus tables: load, snapshot, versions."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.columns import CORPUS, Corpus
from answerloom.operators.corpus import normalize
from answerloom.sources import columns as apart
from answerloom.sources import files

POINTER = "CURRENT"
VERSIONED = (POINTER, "versions", "columns", "metadata", "generations", "prompts", "runs")
POLICIES = ("error", "overwrite", "skip")


def load(spark: SparkSession, path: str, names: Corpus = CORPUS, columns: Sequence[str] | None = None) -> DataFrame:
    """A saved corpus: the current version of a versioned folder, or plain parquet.

    Where generated columns are tables of their own, ``columns`` names those to read (default: all).
    """
    if not files.exists(spark, path):
        raise FileNotFoundError(f"Dataset directory not found: {path}")
    if not files.exists(spark, f"{path}/{POINTER}"):
        return normalize(files.read_partitioned(spark, path, names.split), names)
    version = files.read_small(spark, f"{path}/{POINTER}").strip()
    if apart.manifest(spark, path, version) is not None:
        return normalize(apart.load_columns(spark, path, columns, names, version), names)
    whole = None
    for folder, splits in folders_of(spark, path, version).items():
        part = files.read_partitioned(spark, f"{path}/{folder}", names.split)
        part = part if splits is None else part.where(F.col(names.split).isin(splits))
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    return normalize(whole, names)


def folders_of(spark: SparkSession, path: str, version: str) -> dict[str, list[str] | None]:
    """Folders that make up a version, with the splits that each one gives (None: all of them)."""
    manifest = f"{path}/metadata/{version.split('/')[-1]}.splits.json"
    if not files.exists(spark, manifest):
        return {version: None}
    folders: dict[str, list[str] | None] = {}
    for split, folder in sorted(json.loads(files.read_small(spark, manifest)).items()):
        folders[folder] = [*(folders.get(folder) or []), split]
    return folders


def load_published(
    spark: SparkSession,
    root: str,
    config: str | None = None,
    revision: str | None = None,
    names: Corpus = CORPUS,
) -> DataFrame:
    """A published corpus from staged parquet files, ``root[/revision][/config]``."""
    return load(spark, "/".join(part for part in (root, revision, config) if part), names)


def may_write(spark: SparkSession, path: str, policy: str = "error") -> bool:
    """Apply the output policy to a non-empty folder: fail, replace, or leave as it is."""
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {', '.join(POLICIES)}.")
    if files.is_empty(spark, path) or policy == "overwrite":
        return True
    if policy == "skip":
        return False
    raise FileExistsError(f"{path} already exists and is not empty.")


def split_counts(df: DataFrame, names: Corpus = CORPUS) -> DataFrame:
    return df.groupBy(names.split).agg(F.count(F.lit(1)).alias("n"))


def snapshot(df: DataFrame, path: str, policy: str = "error", names: Corpus = CORPUS) -> DataFrame | None:
    """Write the corpus partitioned by split and count what was written; None if skipped."""
    spark = df.sparkSession
    if not may_write(spark, path, policy):
        return None
    normalize(df, names).write.mode("overwrite").partitionBy(names.split).parquet(path)
    return split_counts(files.read_partitioned(spark, path, names.split), names)


def require_versioned(spark: SparkSession, path: str) -> None:
    """Fail where a folder holds anything but a versioned corpus and its run tables."""
    foreign = [n for n in files.child_names(spark, path) if n not in VERSIONED and not n.startswith(".")]
    if foreign:
        raise FileExistsError(f"{path} exists but is not a versioned corpus.")


def publish(
    df: DataFrame,
    path: str,
    metadata: dict[str, Any] | None = None,
    policy: str = "append",
    names: Corpus = CORPUS,
    changed: Sequence[str] | None = None,
) -> str:
    """Write a new version and then move the pointer to it.

    Readers hold on to a whole version at any time: the old one until the small pointer file is
    replaced in one rename, so a failed write changes nothing, and a job may read the version it
    replaces. With ``changed`` only these splits are written; the others stay where the version before
    has them, and a manifest names the folder of each split. Returns the folder of the version.
    """
    spark = df.sparkSession
    if policy != "append" and not may_write(spark, path, policy):
        return load_version(spark, path)
    if policy == "append":
        require_versioned(spark, path)
    started = apart.current(spark, path)
    version = apart.next_version(spark, path)
    rows = normalize(df, names)
    kept: dict[str, str] = {}
    if changed is not None and apart.manifest(spark, path) is not None:
        raise ValueError(f"{path} keeps its columns apart; add to it with publish_columns.")
    if changed is not None and files.exists(spark, f"{path}/{POINTER}"):
        before = files.read_small(spark, f"{path}/{POINTER}").strip()
        for folder, splits in folders_of(spark, path, before).items():
            kept |= {s: folder for s in (written_splits(spark, f"{path}/{folder}", names) if splits is None else splits)}
        kept = {s: folder for s, folder in kept.items() if s not in changed}
        rows = rows.where(F.col(names.split).isin(list(changed)))
    rows.write.mode("errorifexists").partitionBy(names.split).parquet(f"{path}/{version}")
    if kept:
        here = {s: version for s in written_splits(spark, f"{path}/{version}", names)}
        files.write_small(spark, f"{path}/metadata/{version.split('/')[1]}.splits.json", json.dumps(kept | here, indent=2))
    if metadata is not None:
        files.write_small(spark, f"{path}/metadata/{version.split('/')[1]}.json", json.dumps(metadata, indent=2))
    apart.move_pointer(spark, path, version, started)
    return f"{path}/{version}"


def written_splits(spark: SparkSession, path: str, names: Corpus = CORPUS) -> list[str]:
    """Splits of a folder, by the names of its partition folders; no file is opened."""
    mark = f"{names.split}="
    return [unquote(n[len(mark) :]) for n in files.child_names(spark, path) if n.startswith(mark)]


def load_version(spark: SparkSession, path: str) -> str:
    return f"{path}/{files.read_small(spark, f'{path}/{POINTER}').strip()}"

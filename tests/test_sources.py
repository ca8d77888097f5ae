import json

import pytest
from pyspark.sql import functions as F

from answerloom.sources import corpus as tables
from answerloom.sources import files, ledger, sinks


def _df(spark, n=3):
    return spark.range(n).select(F.when(F.col("id") == 0, "eval").otherwise("train").alias("split"), F.col("id").alias("row_id"))


def test_snapshot_and_load(spark, tmp_path):
    out = str(tmp_path / "snap")
    counts = {r.split: r.n for r in tables.snapshot(_df(spark), out).collect()}
    assert counts == {"eval": 1, "train": 2} and tables.load(spark, out).count() == 3
    with pytest.raises(FileExistsError):
        tables.snapshot(_df(spark), out)
    assert tables.snapshot(_df(spark), out, "skip") is None
    assert tables.snapshot(_df(spark, 5), out, "overwrite").agg(F.sum("n")).first()[0] == 5
    with pytest.raises(FileNotFoundError):
        tables.load(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        tables.may_write(spark, out, "other")
    (tmp_path / "pub" / "r1").mkdir(parents=True)
    spark.range(2).write.parquet(str(tmp_path / "pub" / "r1" / "all"))
    assert tables.load_published(spark, str(tmp_path / "pub"), "all", "r1").first().split == "train"


def test_publish_keeps_old_versions(spark, tmp_path):
    out = str(tmp_path / "corpus")
    first = tables.publish(_df(spark), out, {"k": 1})
    grown = tables.load(spark, out).withColumn("ai_x", F.lit("a"))
    second = tables.publish(grown, out)
    assert first != second and tables.load(spark, out).columns == ["row_id", "ai_x", "split"]
    assert spark.read.parquet(first).columns == ["row_id", "split"]
    assert files.read_small(spark, f"{out}/{tables.POINTER}") == second.removeprefix(out + "/")

    broken = tables.load(spark, out).withColumn("boom", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        tables.publish(broken, out)
    assert tables.load(spark, out).columns == ["row_id", "ai_x", "split"]

    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "file").write_text("x")
    with pytest.raises(FileExistsError):
        tables.publish(_df(spark), str(tmp_path / "other"))


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert ledger.read_runs(spark, path).count() == 0
    for i, output in enumerate(["a", "b", "a"]):
        ledger.append_run(spark, path, output, {"i": i}, f"r{i}")
    assert ledger.read_runs(spark, path).count() == 3
    assert {r.output: (r.run_id, json.loads(r.config)["i"]) for r in ledger.latest_runs(ledger.read_runs(spark, path)).collect()} == {"a": ("r2", 2), "b": ("r1", 1)}


def _read(path, suffix):
    return "".join(p.read_text(encoding="utf-8") for p in sorted(path.glob(f"*.{suffix}")))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ' é "q", x\n', None), (2, "plain", 0.5)], "i int, t string, v double").orderBy("i").coalesce(1)
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert [json.loads(line) for line in _read(tmp_path / "j", "json").splitlines()] == [{"i": 1, "t": ' é "q", x\n', "v": None}, {"i": 2, "t": "plain", "v": 0.5}]
    assert "é" in _read(tmp_path / "j", "json")
    sinks.write_csv(df, str(tmp_path / "c"), ["t", "v", "missing", "i"])
    assert _read(tmp_path / "c", "csv") == 't,v,missing,i\n"é ""q"", x",,,1\nplain,0.5,,2\n'
    sinks.write_json(df.limit(1), str(tmp_path / "m"))
    assert json.loads(_read(tmp_path / "m", "json"))["i"] == 1
    lines = spark.createDataFrame([(2, 0, "c"), (1, 1, "b"), (1, 0, "a")], "s int, n int, line string").repartition(3)
    sinks.write_text(lines, str(tmp_path / "t"), ["s", "n"])
    assert _read(tmp_path / "t", "txt").split() == ["a", "b", "c"]

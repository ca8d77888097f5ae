import pytest
from pyspark.sql import functions as F

from answerloom.sources import columns as apart
from answerloom.sources import corpus as tables
from answerloom.sources import files


def _wide(spark, n=40):
    split = F.when(F.col("id") % 4 == 0, "eval").otherwise("train=a/b")
    return spark.range(n).select(F.col("id").alias("row_id"), F.concat(F.lit("q"), "id").alias("question"), split.alias("split"))


def _values(wide, name, value):
    return wide.select("split", "row_id", value.alias(name))


def _names(spark, path):
    return {n: files.child_names(spark, f"{path}/{n}") for n in ("versions", "columns")}


def test_columns_beside_the_wide_rows(spark, tmp_path):
    out, wide = str(tmp_path / "c"), _wide(spark)
    base = apart.publish_base(wide, out, {"k": 1}, buckets=4)
    before = _names(spark, out)
    apart.publish_columns(_values(wide.where("split = 'eval'"), "ai_x", F.concat(F.lit("x"), "row_id")), out)
    after = _names(spark, out)
    assert after["versions"] == before["versions"] and len(after["columns"]) == 1  # nothing wide was written
    apart.publish_columns(_values(wide, "ai_y", F.array(F.col("question"))), out)
    got = {r.row_id: r for r in tables.load(spark, out).collect()}
    assert len(got) == 40 and tables.load(spark, out).columns == ["row_id", "question", "split", "ai_x", "ai_y"]
    assert got[8].ai_x == "x8" and got[9].ai_x is None and got[9].ai_y == ["q9"] and got[9].split == "train=a/b"
    assert tables.load(spark, out, columns=["ai_y"]).columns == ["row_id", "question", "split", "ai_y"]
    assert tables.load(spark, out, columns=[]).columns == ["row_id", "question", "split"]
    old = apart.load_columns(spark, out, version=base)
    assert old.columns == ["row_id", "question", "split"]
    assert apart.filled_columns(spark, out, ["train=a/b"]) == {"ai_y"}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("answerloom_")]


def test_a_column_is_replaced_per_split(spark, tmp_path):
    out, wide = str(tmp_path / "c"), _wide(spark).withColumn("ai_x", F.lit("wide"))
    apart.publish_base(wide, out, buckets=3)
    apart.publish_columns(_values(wide.where("split = 'eval'"), "ai_x", F.lit("new")), out)
    assert {(r.split, r.ai_x) for r in tables.load(spark, out).collect()} == {("eval", "new"), ("train=a/b", "wide")}


def test_wide_rows_are_not_moved(spark, tmp_path):
    out, wide = str(tmp_path / "c"), _wide(spark, 200)
    apart.publish_base(wide, out, buckets=4)
    for name in ("ai_x", "ai_y"):
        apart.publish_columns(_values(wide, name, F.col("question")), out)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tables.load(spark, out)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_writers_that_meet(spark, tmp_path):
    out, wide = str(tmp_path / "c"), _wide(spark)
    apart.publish_base(wide, out, buckets=2)
    started = apart.current(spark, out)
    apart.publish_columns(_values(wide, "ai_x", F.lit("first")), out)
    with pytest.raises(RuntimeError, match="newer version"):
        apart.move_pointer(spark, out, "versions/v9", started)
    assert tables.load(spark, out).first().ai_x == "first"
    number = max(int(n[1:9]) for n in files.child_names(spark, f"{out}/metadata"))
    assert not files.create(spark, f"{out}/metadata/v{number:08d}.claim")
    with pytest.raises(ValueError, match="publish_columns"):
        tables.publish(wide, out, changed=["eval"])


def test_plain_corpora_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="apart"):
        apart.publish_columns(_wide(spark), str(tmp_path / "none"))

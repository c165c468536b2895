"""The stage runner and the keyed table: failures named, work taken up again, versions whole."""

import os

import pytest
from pyspark.sql import functions as F

from touchline.sources.keyed import KeyedTable
from touchline.stages import StageFailed, report, run_stages


def by_stage(spark, folder):
    return {r["stage"]: (r["status"], r["rows"]) for r in report(spark, folder).collect()}


def test_stages_hand_on_fail_and_resume(spark, tmp_path):
    folder, calls = str(tmp_path), []

    def numbers(spark, _):
        calls.append("numbers")
        return spark.range(10).withColumn("x", F.col("id") * 2)

    def few(spark, df):
        calls.append("few")
        if calls.count("few") == 1:
            return df.withColumn("x", F.raise_error(F.lit("no good")).cast("long"))
        return df.filter("x > 10")

    stages = [("numbers", numbers), ("few", few), ("none", lambda spark, df: df.filter("x < 0"))]
    with pytest.raises(StageFailed, match="stage few failed") as failed:
        run_stages(spark, stages, folder)
    assert failed.value.stage == "few" and failed.value.__cause__ is not None
    assert by_stage(spark, folder) == {"numbers": ("done", 10), "few": ("failed", None)}
    assert "no good" in report(spark, folder).filter("stage = 'few'").first()["error"]
    assert run_stages(spark, stages, folder).columns == ["id", "x"] and calls == ["numbers", "few", "few"]
    assert by_stage(spark, folder) == {"numbers": ("kept", 10), "few": ("done", 4), "none": ("done", 0)}
    assert run_stages(spark, stages[:2], folder).count() == 4 and calls == ["numbers", "few", "few"]
    with pytest.raises(ValueError):
        run_stages(spark, [stages[0], stages[0]], folder)
    assert not spark.sparkContext.getJobTags()


def table(spark, tmp_path, buckets=8):
    return KeyedTable(spark, str(tmp_path / "table"), spark.createDataFrame([], "game_id long, x string").schema, buckets=buckets)


def rows(spark, *pairs, more=""):
    return spark.createDataFrame(list(pairs), f"game_id long, x string{more}")


def held(df):
    return sorted((r["game_id"], r["x"]) for r in df.collect())


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.versions() == [] and t.read().count() == 0
    t.upsert(rows(spark, *((i, f"a{i}") for i in range(200))))
    reader = t.read()
    assert t.upsert(rows(spark, (7, "new", 2), (7, "old", 1), (500, "more", 1), more=", n int"), order="n") == 2
    want = {i: f"a{i}" for i in range(200)}
    assert held(reader) == sorted(want.items()), "a reader keeps its version"
    assert held(t.read()) == sorted((want | {7: "new", 500: "more"}).items()) and held(t.read(1)) == sorted(want.items())
    second = [d for d in os.listdir(tmp_path / "table/data") if len(os.listdir(tmp_path / "table/data" / d)) < 8]
    assert len(second) == 1 and len([d for d in os.listdir(tmp_path / "table/data" / second[0]) if d.startswith("bucket=")]) <= 2
    with pytest.raises(ValueError):
        t.read(9)


def test_nothing_new_a_failed_write_and_two_writers(spark, tmp_path):
    t = table(spark, tmp_path, 2)
    t.upsert(rows(spark, (1, "a"), (None, "n")))
    with pytest.raises(Exception, match="bad"):
        t.upsert(rows(spark, (1, "b")).withColumn("x", F.raise_error(F.lit("bad")).cast("string")))
    assert t.versions() == [1] and set(held(t.read().na.fill(-1))) == {(1, "a"), (-1, "n")}
    assert t.upsert(rows(spark).limit(0)) == 2 and t.read().count() == 2
    with pytest.raises(RuntimeError, match="another"):
        t._publish(2, {})
    t.upsert(rows(spark, (1, "c")))
    t.forget(keep=1)
    assert t.versions() == [3] and (1, "c") in {tuple(r) for r in t.read().collect()}

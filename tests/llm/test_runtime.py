"""What the operators share."""

import pytest

from scrutari.llm import runtime


def test_shared_folder_must_be_named_on_a_cluster():
    class Context:
        applicationId, master = "another-app", "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError):
        runtime.shared_dir(Session())


def test_a_folder_of_ones_own_below_the_setting(spark):
    path = runtime.shared_dir(spark)
    assert spark.sparkContext.applicationId in path and path == runtime.shared_dir(spark)
    df, at = runtime.written(spark.range(3), "some")
    assert at.startswith(path) and df.count() == 3


def test_a_small_table_in_one_file_is_spread(spark, tmp_path, monkeypatch):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    cores = spark.sparkContext.defaultParallelism
    out = runtime.spread(df)
    assert out.rdd.getNumPartitions() == cores and max(map(len, out.rdd.glom().collect())) < 1000
    assert sorted(r["id"] for r in out.collect()) == list(range(1000))
    monkeypatch.setattr(runtime, "SMALL", 1)
    assert runtime.spread(df) is df
    monkeypatch.undo()
    spark.range(1000).repartition(cores).write.parquet(f"{tmp_path}/many")
    many, made = spark.read.parquet(f"{tmp_path}/many"), spark.createDataFrame([(1,)], "id long")
    assert runtime.spread(many) is many and runtime.spread(made) is made

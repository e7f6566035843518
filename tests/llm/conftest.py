import pytest
from awkward_rows import TEXTS, table


@pytest.fixture(scope="session")
def awkward(spark):
    return table(spark, TEXTS)


@pytest.fixture(scope="session")
def nothing(spark):
    return table(spark, [])


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """Small tables in the form of the large ones: real rows, with null, empty and repeated ones."""
    from helpers import DATA
    from pyspark.sql import functions as F

    path = tmp_path_factory.mktemp("tables")
    for name in ("documents", "labels", "benchmark", "conversations", "embeddings", "pages"):
        df = spark.read.parquet(f"{DATA}/sf0.001/{name}.parquet")
        if name == "documents":
            first = df.where("doc_id < 20")
            odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "src0", 0), (9003, "word", "en", None, 4)], df.schema)
            df = df.unionByName(first).unionByName(odd).withColumn("extra", F.lit("e"))
        df.coalesce(2).write.parquet(f"{path}/{name}.parquet")
    return str(path)

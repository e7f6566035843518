"""A table of keys and values, written once, sorted by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyValue:
    """Values by key; both are bytes. Parquet's statistics by row group take the place of an index."""

    def __init__(self, spark: SparkSession, path: str):
        self.rows = spark.read.parquet(path)

    @staticmethod
    def write(rows: DataFrame, path: str) -> None:
        """Write (key, value); an error if ``path`` exists."""
        rows = rows.select(F.col("key").cast("binary"), F.col("value").cast("binary"))
        rows.repartitionByRange("key").sortWithinPartitions("key").write.mode("errorifexists").parquet(path)

    def get(self, key: bytes) -> bytes | None:
        row = self.rows.where(F.col("key") == F.lit(key)).select("value").head()
        return bytes(row[0]) if row and row[0] is not None else None

    def get_many(self, keys: DataFrame) -> DataFrame:
        """``keys`` (key) with the value of each, null where there is none."""
        return keys.join(self.rows, "key", "left")

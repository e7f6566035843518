"""Files of one document a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, text) of every line; numbers begin at 0 in each file.

    Spark splits large files, so a line's number is that of its split's lines
    before it: splits are counted first, and nothing is sorted as a whole.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text")
    )
    # One row a split, whose lines before it are a running sum within its file.
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    split = lines.groupBy("file", "start").agg(F.min("at").alias("least"), F.count("*").alias("n"))
    split = split.select("file", "start", "least", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return lines.join(split, ["file", "start"]).select("file", (F.col("before") + F.col("at") - F.col("least")).alias("line_no"), "text")


def read_jsonl(spark: SparkSession, path: str, fields: tuple[str, ...] = ("url", "title", "body")) -> DataFrame:
    """A row for each line that is a JSON object, its fields as strings; other lines are skipped."""
    schema = StructType([StructField(f, StringType()) for f in fields])
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)

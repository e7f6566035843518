"""Shards that all have the corpus's mixture: proportional stratified interleaving.

Rows are shuffled within each source by a seeded hash and ranked; the row of
rank r of n gets the fraction (2 r - 1) / (2 n). Sorted by that fraction, all
sources are spread evenly over the whole, and any cut into shards of equal
size has of each source its share, to within a row at either end.

No source is ranked in one task, however hot: rows fall into buckets of the
hash (and then of the fraction) in order, of about ``BUCKET`` rows; the counts
of the buckets are summed up, and a row's rank is what lies in earlier buckets
plus its place in its own. All is done by built-in expressions, and only ids
and sources move.

Defined results: a row of null source belongs to a source of its own, null;
a null id is hashed as an empty one; rows of equal id and source take
successive ranks, in no order of their own; shards differ in size by one row
at most, and there are fewer, not empty ones, where there are fewer rows; an
empty table gives an empty result. Further columns are carried on request
and keep their values; to carry a column twice, or one that is named like a
column of the result, is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHARDS = 64
SEED = 42
BUCKET = 100_000


def _offsets(rows: DataFrame, by: list[str], bucket: str) -> DataFrame:
    """By source (if any) and bucket, the rows in earlier buckets."""
    before = Window.partitionBy(*(F.col(b) for b in by)).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy(*by, bucket).agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")


def assign(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", shards: int = SHARDS, seed: int = SEED, bucket: int = BUCKET, carry: list[str] | None = None
) -> DataFrame:
    """(doc_id, source, position, shard) of each row, and the columns in ``carry``; positions begin at 0."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    n = docs.count()
    parts = max(1, -(-n // bucket))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    # What is carried has names of its own meanwhile, as it may have any.
    held = {f"__carried_{i}": c for i, c in enumerate(carry or [])}
    taken = [c.lower() for c in ("doc_id", "source", "position", "shard", *held.values())]
    if len(set(taken)) < len(taken):
        raise ValueError("carried columns must be distinct, and not be named doc_id, source, position or shard")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), *(docs[f"`{c}`"].alias(k) for k, c in held.items()), key.alias("__key"))
    head = F.conv(F.substring("__key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("__b", F.floor(head * parts / float(1 << 32)).cast("long"))
    before = _offsets(rows, ["source"], "__b").withColumnsRenamed({"source": "__s", "__b": "__c"})
    total = rows.groupBy("source").agg(F.count("*").alias("__total")).withColumnRenamed("source", "__t")
    rows = rows.join(before, rows["source"].eqNullSafe(before["__s"]) & (rows["__b"] == before["__c"])).drop("__s", "__c")
    rows = rows.withColumn("__rank", F.col("__before") + F.row_number().over(Window.partitionBy("source", "__b").orderBy("__key"))).drop("__before", "__key", "__b")
    rows = rows.join(total, rows["source"].eqNullSafe(total["__t"])).drop("__t")
    rows = rows.withColumn("__f", (2 * F.col("__rank") - 1).cast("double") / (2 * F.col("__total")).cast("double")).drop("__total")
    rows = rows.withColumn("__b", F.floor(F.col("__f") * parts).cast("long"))
    before = _offsets(rows, [], "__b").withColumnRenamed("__b", "__c")
    rows = rows.join(before, rows["__b"] == before["__c"])
    place = F.row_number().over(Window.partitionBy("__b").orderBy("__f", F.col("source").asc_nulls_first(), "__rank"))
    position = (F.col("__before") + place - 1).cast("long")
    shard = F.expr(f"position * {min(shards, max(n, 1))} div {max(n, 1)}").cast("long")
    out = rows.withColumn("position", position).withColumn("shard", shard)
    return out.select("doc_id", "source", *(F.col(k).alias(c) for k, c in held.items()), "position", "shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place and shard of every document."""
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), ''))) AS k,
                  count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total FROM documents),
f AS (SELECT *, CAST(2 * k - 1 AS DOUBLE) / CAST(2 * n AS DOUBLE) AS f FROM r),
p AS (SELECT doc_id, source, total, row_number() OVER (ORDER BY f, source NULLS FIRST, k) - 1 AS position FROM f)
SELECT doc_id, source, CAST(position AS BIGINT) AS position, CAST(position * least({SHARDS}, total) // total AS BIGINT) AS shard FROM p
"""

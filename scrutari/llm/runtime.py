"""What all operators of this package share: shipping code, shared storage, Arrow helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..sources.shared import ship

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application's own below ``spark.checkpoint.dir``; removed when the driver ends.

    The setting is the cluster's. Only where it is unset and all is on one
    machine, as in tests, a temporary folder takes its place; elsewhere that is
    an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _own:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="scrutari-shared-")
        _own[app] = f"{base.rstrip('/')}/scrutari-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(remove, spark, _own[app])
    return _own[app]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path in shared storage; nothing happens once the session has ended."""
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:
        return


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to shared storage and read it again: its lineage is cut and any executor may be lost.

    Unlike ``checkpoint()`` it computes the plan once and keeps the columns prunable.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:10]}"
    df.write.option("compression", "lz4").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def mapped(df: DataFrame, fn: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` after shipping this package; columns may have any names, also such as Spark can't resolve."""
    ship(df.sparkSession)
    names = df.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(b.rename_columns(names) for b in it)

    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(run, schema)


#: Bytes below which a table that lies in few files is spread over all cores.
SMALL = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df``, in as many partitions as there are cores if it is a small table in fewer files than that.

    A small file is often one row group and so one task, whatever is done with
    each row. Larger tables, and all that aren't read from files, stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(size) >= SMALL or not 0 < len(df.inputFiles()) < cores:
        return df
    return df.repartition(cores)


def added(df: DataFrame, name: str, kind: str) -> StructType:
    """The schema of ``df`` and one more column."""
    return StructType([*df.schema.fields, StructField(name, StructType.fromDDL(f"x {kind}")[0].dataType)])


def batches(
    it: Iterator[pa.RecordBatch], column: str = "text", most: int = 1_500_000
) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Split Arrow batches so that the texts of a piece hold about ``most`` characters, whole rows at a time."""
    for batch in it:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = total[start - 1] if start else 0
            end = max(int(np.searchsorted(total, base + most, side="right")), start + 1)
            piece = batch.slice(start, end - start)
            yield piece, piece.column(piece.schema.get_field_index(column)).to_pylist()
            start = end


def groups(it: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Groups of equal ``key`` from batches sorted by it, also across the ends of batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in it:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


def hash_sample(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """At most ``rows`` rows of ``df``, chosen by a seeded hash of ``key``; for fitting a classifier only.

    A first pass counts, so that the filter leaves a bounded number of rows
    before any of them is sorted.
    """
    n = df.count()
    h = F.xxhash64(F.lit(seed), F.col(key))
    if n > 2 * rows:
        df = df.where(F.pmod(h, F.lit(1 << 30)) < int((1 << 30) * 1.5 * rows / n))
    return df.orderBy(h, F.col(key)).limit(rows)

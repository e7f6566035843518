"""An index on disk: folders of Parquet that never change, and manifests that say which count.

    <path>/manifest-<version>.json
    <path>/data/<folder>/documents|postings|lengths|term_stats|field_stats|extra-<name>/
    <path>/data/<folder>/deletes/

A batch of documents becomes a segment in a folder of its own, whose name no
other attempt has, so a writer that fails leaves everything as it was. The
folder comes first; the next manifest, which names it, comes last and only if
there is none of that version yet: of writers that meet, one wins and the
others get ``ConflictError``. A reader keeps the manifest that it opened and so
sees neither half a batch nor a later one.

A manifest appears whole or not at all: by a rename that doesn't replace, or on
local file systems by a link. Object stores without either need a committer of
their own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import postings, tables
from ..operators import search as ops
from ..plans.query import QueryError, Schema
from . import shared

#: Manifests that are kept, so that a writer who is late by fewer versions is always noticed.
KEPT = 100
#: Half as many bytes of text and postings as by Spark's default, for a little time.
CODEC = "zstd"
_TABLES = {"postings": tables.POSTINGS, "lengths": tables.LENGTHS, "term_stats": tables.TERM_STATS, "field_stats": tables.FIELD_STATS}


class ConflictError(RuntimeError):
    """Another writer has changed the index meanwhile."""


@dataclass(frozen=True)
class Manifest:
    text: tuple[str, ...] = ()
    keyword: tuple[str, ...] = ()
    analyzers: tuple[tuple[str, str], ...] = ()
    version: int = 0
    segments: tuple[int, ...] = ()
    next_segment: int = 0
    folders: tuple[str, ...] = ()
    deletes: tuple[tuple[str, int], ...] = ()  # folders of tombstones, and how many each has
    extra: tuple[str, ...] = ()
    batches: dict[str, int] = field(default_factory=dict)  # by stream, the number of the last batch

    @staticmethod
    def read(spark: SparkSession, path: str) -> Manifest:
        """The newest manifest of an index; an empty one where there is none."""
        versions = _versions(spark, path)
        if not versions:
            return Manifest()
        d = json.loads(shared.read_text(spark, _name(path, versions[-1])))
        return Manifest(**{k: _tuples(v) for k, v in d.items()})

    @property
    def schema(self) -> Schema:
        return Schema(self.text, self.keyword, self.analyzers)


def _tuples(v: object) -> object:
    return tuple(map(_tuples, v)) if isinstance(v, list) else v


def _name(path: str, version: int) -> str:
    return f"{path}/manifest-{version:010d}.json"


def _versions(spark: SparkSession, path: str) -> list[int]:
    names = shared.names(spark, path)
    return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))


def open_index(spark: SparkSession, path: str) -> tables.Tables:
    """The index as it is now; later changes don't show."""
    m = Manifest.read(spark, path)
    return _tables(spark, path.rstrip("/"), m)


def _tables(spark: SparkSession, path: str, m: Manifest) -> tables.Tables:
    def read(name: str, folders: tuple[str, ...], kind: str | None) -> DataFrame:
        at = [f"{path}/data/{f}/{name}" for f in folders]
        if not at:
            return spark.createDataFrame([], kind)
        # Only the folders that the manifest names are listed.
        return spark.read.schema(kind).parquet(*at) if kind else spark.read.option("mergeSchema", len(at) > 1).parquet(*at)

    empty = ", ".join(["segment_id long", "local_id long", *(f"{f} string" for f in m.schema.fields)])
    documents = read("documents", m.folders, None if m.folders else empty)
    own = {n: read(n, m.folders, kind) for n, kind in _TABLES.items()}
    deletes = read("deletes", tuple(f for f, _ in m.deletes), "segment_id long, local_id long") if m.deletes else None
    extra = {n: read(f"extra-{n}", m.folders, None) for n in m.extra if m.folders}
    return tables.Tables(
        m.schema, documents, own["postings"], own["term_stats"], own["field_stats"], own["lengths"], deletes, sum(n for _, n in m.deletes), extra
    )


class Writer:
    """Adds batches to an index, and deletes from it.

    ``extra`` are further tables that are made of each batch, by name: functions
    of its documents, with ``segment_id`` and ``local_id``, that give a DataFrame.
    """

    def __init__(self, spark: SparkSession, path: str, schema: Schema, extra: dict[str, Callable[[DataFrame], DataFrame]] | None = None):
        self.spark, self.path, self.schema, self.extra = spark, path.rstrip("/"), schema, extra or {}
        m = Manifest.read(spark, self.path)
        if m.version and m.schema != schema:
            raise QueryError(f"the index has other fields: {m.schema}")
        if m.version and m.folders and set(m.extra) != set(self.extra):
            raise QueryError(f"the index has other further tables: {m.extra}")

    def _commit(self, old: Manifest, new: Manifest) -> None:
        versions = _versions(self.spark, self.path)
        done = replace(
            new, text=self.schema.text, keyword=self.schema.keyword, analyzers=self.schema.analyzers, extra=tuple(sorted(self.extra)), version=old.version + 1
        )
        if (versions[-1] if versions else 0) != old.version or not shared.create_text(self.spark, _name(self.path, done.version), json.dumps(asdict(done))):
            raise ConflictError(f"the index at {self.path} has changed")
        for v in versions[: -KEPT or None]:
            shared.remove(self.spark, _name(self.path, v))

    def _folder(self) -> tuple[str, str]:
        name = uuid.uuid4().hex
        return name, f"{self.path}/data/{name}"

    def _keep(self, df: DataFrame, at: str, kind: str | None = None) -> DataFrame:
        df.write.option("compression", CODEC).parquet(at)
        return self.spark.read.schema(kind or df.schema).parquet(at)

    def add(self, documents: DataFrame, local_id: str | None = None, batch: tuple[str, int] | None = None) -> int | None:
        """Make ``documents`` a segment and return its number; None if there are none, or if ``batch`` (a stream's name
        and the batch's number) or a later one of that stream is in the index already.

        Places in the segment are counted from 0 in the order of the rows, or
        taken from ``local_id``, a column of distinct numbers from 0 to 2**32 - 1.
        """
        m = Manifest.read(self.spark, self.path)
        if batch is not None and batch[1] <= m.batches.get(batch[0], -1):
            return None
        for f in self.schema.fields:
            if f not in documents.columns:
                raise QueryError(f"no such field: {f!r}")
        folder, at = self._folder()
        segment = m.next_segment
        try:
            if not self._write(documents, local_id, segment, at):
                shared.remove(self.spark, at)
                return None
            batches = m.batches if batch is None else m.batches | {batch[0]: batch[1]}
            self._commit(m, replace(m, segments=(*m.segments, segment), next_segment=segment + 1, folders=(*m.folders, folder), batches=batches))
        except BaseException:
            shared.remove(self.spark, at)
            raise
        return segment

    def _write(self, documents: DataFrame, local_id: str | None, segment: int, at: str) -> bool:
        """The tables of one segment; False if it has no documents."""
        own = F.lit(segment).cast("long").alias("segment_id")
        others = [c for c in documents.columns if c.lower() not in ("segment_id", "local_id")]
        rest = [documents[f"`{c}`"] for c in others]
        if local_id is not None:
            kept = self._keep(documents.select(own, documents[f"`{local_id}`"].cast("long").alias("local_id"), *rest), f"{at}/documents")
            n = kept.agg(F.count("*").alias("n"), F.count("local_id").alias("known"), F.min("local_id").alias("least"), F.max("local_id").alias("most")).head()
            if not n["n"]:
                return False
            if n["known"] < n["n"] or n["least"] < 0 or n["most"] >= 1 << 32:
                raise QueryError(f"places must be numbers from 0 to 2**32 - 1: {local_id!r}")
            if not kept.groupBy("local_id").count().where("count > 1").isEmpty():
                raise QueryError(f"places must be distinct: {local_id!r}")
        else:
            # Written first: a place counted in one run must not differ in the next.
            staged = self._keep(documents.select(F.monotonically_increasing_id().alias("local_id"), *rest), f"{at}/staged")
            part = F.shiftright("local_id", 33)
            count = staged.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
            before = count.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
            # As many rows as the batch has partitions.
            placed = staged.withColumn("part", part).join(F.broadcast(before), "part")
            place = F.col("before") + F.col("local_id").bitwiseAND(F.lit((1 << 33) - 1))
            kept = self._keep(placed.select(own, place.alias("local_id"), *(placed[f"`{c}`"] for c in others)), f"{at}/documents")
            shared.remove(self.spark, f"{at}/staged")
            if kept.isEmpty():
                return False
        # Written, so that texts are analysed once: the exchange by ranges looks at what it moves first.
        counted = self._keep(postings.counted(kept.repartition(spread) if (spread := self._spread(kept)) else kept, self.schema, segment), f"{at}/counted", postings.PIECES)
        lengths = self._keep(postings.lengths(counted, self.schema), f"{at}/lengths", tables.LENGTHS)
        stats = self._keep(tables.field_stats(lengths).coalesce(1), f"{at}/field_stats", tables.FIELD_STATS)
        self._finish(counted, stats, postings.parts(counted, shared.size(self.spark, f"{at}/counted")), at)
        shared.remove(self.spark, f"{at}/counted")
        for name, make in self.extra.items():
            make(kept).write.option("compression", CODEC).parquet(f"{at}/extra-{name}")
        return True

    def _spread(self, rows: DataFrame) -> int:
        """Into how many partitions rows must go so that all cores work, 0 if they have as many: what is small lies in few files."""
        cores = self.spark.sparkContext.defaultParallelism
        return cores if rows.rdd.getNumPartitions() < cores else 0

    def _finish(self, pieces: DataFrame, stats: DataFrame, n: int, at: str) -> None:
        # A term's rows lie together, so that a scan for it skips all other row groups and pages.
        folder = shared.mounted(self.spark, f"{at}/postings")
        if folder:
            shared.make(self.spark, f"{at}/postings")
            # Kept, so that it runs once; files that its rows don't name are of attempts that failed.
            sums = self._keep(postings.stored(pieces, self.schema, stats, n, folder, CODEC), f"{at}/sums", postings.SUMS)
            # As many rows as there are parts.
            named = {r["file"] for r in sums.select("file").distinct().collect()}
            for name in shared.names(self.spark, f"{at}/postings"):
                if name not in named:
                    shared.remove(self.spark, f"{at}/postings/{name}")
        else:
            sums = self._keep(postings.merged(pieces, self.schema, stats, n), f"{at}/postings", tables.POSTINGS)
        self._keep(postings.term_stats(sums, -(-n // 4)).sortWithinPartitions("field", "term"), f"{at}/term_stats", tables.TERM_STATS)
        shared.remove(self.spark, f"{at}/sums")

    def delete(self, field: str, values: list[str]) -> int | None:
        """Mark documents of which ``field`` has any of the terms as deleted; the number of this deletion, None if nothing changes.

        Only what wasn't deleted before is written.
        """
        m = Manifest.read(self.spark, self.path)
        folder, at = self._folder()
        found = ops.exact(_tables(self.spark, self.path, m), field, values, include_deleted=False).select("segment_id", "local_id")
        try:
            n = self._keep(found, f"{at}/deletes").count()
            if not n:
                shared.remove(self.spark, at)
                return None
            self._commit(m, replace(m, deletes=(*m.deletes, (folder, n))))
        except BaseException:
            shared.remove(self.spark, at)
            raise
        return len(m.deletes)

    def compact(self) -> None:
        """Put all segments, and all tombstones, into one folder each; ids, statistics and results stay as they are.

        A stream leaves a folder for each micro-batch, and every folder costs a
        search a few files to open. The old ones stay for readers that have them open, until ``vacuum``.
        """
        m = Manifest.read(self.spark, self.path)
        if len(m.folders) < 2 and len(m.deletes) < 2:
            return
        folder, at = self._folder()
        old = _tables(self.spark, self.path, m)
        try:
            if m.folders:
                self._keep(old.documents, f"{at}/documents")
                self._keep(old.lengths, f"{at}/lengths")
                stats = self._keep(old.field_stats.coalesce(1), f"{at}/field_stats", tables.FIELD_STATS)
                n = postings.parts(stats, shared.size(self.spark, *(f"{self.path}/data/{f}/postings" for f in m.folders)))
                self._finish(postings.unblocked(old.blocks, self.schema), stats, n, at)
                for name, df in old.extra.items():
                    self._keep(df, f"{at}/extra-{name}")
            if old.deletes is not None:
                self._keep(old.deletes, f"{at}/deletes")
            self._commit(m, replace(m, folders=(folder,) if m.folders else (), deletes=((folder, old.tombstones),) if m.deletes else ()))
        except BaseException:
            shared.remove(self.spark, at)
            raise

    def vacuum(self) -> None:
        """Delete folders that the newest manifest doesn't name. Not while others write, or read what is older."""
        m = Manifest.read(self.spark, self.path)
        live = {*m.folders, *(f for f, _ in m.deletes)}
        for name in shared.names(self.spark, f"{self.path}/data"):
            if name not in live:
                shared.remove(self.spark, f"{self.path}/data/{name}")

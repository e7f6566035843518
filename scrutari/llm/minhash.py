"""MinHash near-duplicate detection.

128 universal hash minima over shingles of three words; banding finds
candidates, agreement of signatures verifies them, and alternating large-star
and small-star joins verified pairs into groups.

What moves between executors is small: signatures once (to collapse equal
ones, which 128 bits of a hash tell apart), 16 bytes per band and again for
bands that several have, and again the signatures of only those documents that
share a band with another one. Bands are counted by partial sums and joined, so
that a band that a third of all texts have is spread over tasks. Inside a
bucket every pair of different signatures is decided, but only a spanning
forest of the verified pairs and each signature's number of links are emitted:
n different signatures cost at most n - 1 edges and n numbers rather than
n * (n - 1) / 2 pairs. A pair that meets in several buckets counts in that of its
first common band. There is no cap on the size of a bucket: one of more than
``BLOCK`` signatures is cut into blocks and every pair of blocks is compared,
so what moves for a bucket of n different signatures is n * n / ``BLOCK`` of them.

Defined results: a text without words (null, empty, only punctuation) is in a
group of its own, has no links and always stays; a text of one or two words has one shingle,
all its words; rows with the same id and text are copies of one document; a
null id is allowed and sorts after all others when the row that stays is
chosen; an empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import runtime, tokens

PERMUTATIONS = 128
BANDS = 32
ROWS = PERMUTATIONS // BANDS
SHINGLE = 3
#: Pairs count as near-duplicates from this share of equal minima.
THRESHOLD = 0.5
#: Equal minima of a pair from which it counts.
NEED = int(np.ceil(THRESHOLD * PERMUTATIONS - 1e-9))
#: Signatures compared in one task at a time.
BLOCK = 16_384

_rng = np.random.default_rng(20_240_229)
_A = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_C = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)


def shingles(w: tokens.Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and the offsets by text; one for a shorter text that has words."""
    n = np.diff(w.doc)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(count)))
    h = w.hashes
    if len(h) >= size:
        g = h[: len(h) - size + 1].copy()
        for k in range(1, size):
            g = tokens.mix(g) + h[k : len(h) - size + 1 + k]
        g = tokens.mix(g)
    else:
        g = np.zeros(0, np.uint64)
    out = np.empty(at[-1], np.uint64)
    doc = np.repeat(np.arange(len(n)), count)
    pos = w.doc[:-1][doc] + np.arange(at[-1]) - at[:-1][doc]
    long = n[doc] >= size
    out[long] = g[pos[long]]
    for d in np.flatnonzero((n > 0) & (n < size)):
        x = np.uint64(n[d])
        for v in h[w.doc[d] : w.doc[d + 1]]:
            x = tokens.mix(np.array([x]))[0] ^ v
        out[at[d]] = x
    return out, at


def signatures(texts: list[str | None]) -> np.ndarray:
    """A row of minima for each text, uint32; of a text without words all are the largest value."""
    g, at = shingles(tokens.words(texts))
    x = (g >> np.uint64(32)).astype(np.uint32)
    sig = np.full((len(texts), PERMUTATIONS), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(at))
    first = at[:-1][full]
    i = 0
    while i < len(full):  # pieces that fit the processor's cache, whole texts at a time
        j = max(i + 1, int(np.searchsorted(first, first[i] + 32_768, side="right")) - 1)
        lo, hi = first[i], first[j] if j < len(full) else at[-1]
        part, starts, tmp = x[lo:hi], first[i:j] - lo, np.empty(hi - lo, np.uint32)
        out = np.empty((PERMUTATIONS, j - i), np.uint32)
        for k in range(PERMUTATIONS):
            np.bitwise_xor(part, _C[k], out=tmp)
            np.multiply(tmp, _A[k], out=tmp)
            np.minimum.reduceat(tmp, starts, out=out[k])
        sig[full[i:j]] = out.T
        i = j
    return sig


def _sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in runtime.batches(it):
        sig = signatures(texts)
        empty = (sig == 0xFFFFFFFF).all(axis=1)
        raw = [s.tobytes() for s in sig]
        name = np.frombuffer(b"".join(hashlib.blake2b(s, digest_size=16).digest() for s in raw), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), *(pa.array(name[:, k], mask=empty) for k in (0, 1)), pa.array([None if e else s for e, s in zip(empty, raw)], pa.binary())],
            ["doc_id", "text_hash", "sid", "more", "sig"],
        )


#: Rows and columns of pairs that are compared at a time.
TILE = (128, 4096)
#: Up to so many pairs all minima are compared at a stroke.
SMALL = 2048


def _tiles(n: int, m: int, triangle: bool) -> Iterator[tuple[slice, slice]]:
    for i in range(0, n, TILE[0]):
        for j in range(i + 1 if triangle else 0, m, TILE[1]):
            yield slice(i, min(i + TILE[0], n)), slice(j, min(j + TILE[1], m))


class _Pairs:
    """Verified pairs of a bucket: a forest that joins them, and how many copies each signature is linked to."""

    def __init__(self, nid: np.ndarray, copies: np.ndarray, sig: np.ndarray, least: int):
        self.nid, self.copies, self.sig, self.least = nid, copies.astype(np.float64), sig, least
        self.label = np.arange(len(nid))
        self.links = np.zeros(len(nid))
        self.edges: list[tuple[int, int]] = []

    @cached_property
    def minima(self) -> np.ndarray:
        return np.ascontiguousarray(self.sig.T)

    @cached_property
    def bands(self) -> np.ndarray:
        out = np.zeros((BANDS, len(self.nid)), np.uint64)
        for k in range(ROWS):
            out = tokens.mix(out) ^ self.minima[k::ROWS]
        return out

    def _tile(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs are verified, and which count here: a pair counts in the bucket of the first band that it has in common."""
        if len(i) * len(j) <= SMALL:
            same = self.sig[i][:, None, :] == self.sig[j][None, :, :]
            bands = same.reshape(len(i), len(j), BANDS, ROWS).all(axis=3)
            hit = np.count_nonzero(same, axis=2) >= NEED
            return hit, hit & bands[:, :, self.least] & ~bands[:, :, : self.least].any(axis=2)
        n = np.zeros((len(i), len(j)), np.uint8)
        a, b = self.minima[:, i], self.minima[:, j]
        for k in range(PERMUTATIONS):
            n += a[k][:, None] == b[k][None, :]
        hit = n >= NEED
        if not hit.any():
            return hit, hit
        a, b = self.bands[:, i], self.bands[:, j]
        count = hit & (a[self.least][:, None] == b[self.least][None, :])
        for k in range(self.least):
            count &= a[k][:, None] != b[k][None, :]
        return hit, count

    def compare(self, x: np.ndarray, y: np.ndarray | None = None) -> None:
        """All pairs of places within ``x``, or between ``x`` and ``y``."""
        other = x if y is None else y
        for r, c in _tiles(len(x), len(other), y is None):
            i, j = x[r], other[c]
            hit, count = self._tile(i, j)
            if y is None:
                upper = np.arange(r.start, r.stop)[:, None] < np.arange(c.start, c.stop)[None, :]
                hit, count = hit & upper, count & upper
            if not hit.any():
                continue
            count = count.astype(np.float64)
            self.links[i] += count @ self.copies[j]
            self.links[j] += self.copies[i] @ count
            for row in np.flatnonzero(hit.any(axis=1)):
                u = i[row]
                near = j[hit[row]]
                of = self.label[near]
                if (of == self.label[u]).all():
                    continue
                trees, first = np.unique(of, return_index=True)
                new = trees != self.label[u]
                self.edges.extend((int(self.nid[u]), int(v)) for v in self.nid[near[first[new]]])
                self.label[np.isin(self.label, trees[new])] = self.label[u]


def _verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket, or pair of blocks of a large one: edges (u, v) that join what is linked by verified pairs, and (u, links)."""
    u: list[np.ndarray] = []
    v: list[np.ndarray] = []
    links: list[np.ndarray] = []
    size = 0

    def rows() -> pa.RecordBatch:
        a, b, n = (np.concatenate(x) for x in (u, v, links))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=b < 0), pa.array(n, mask=b >= 0)], ["u", "v", "links"])

    for group in runtime.groups(it, "bid"):
        nid, least, own, cross, copies = (group.column(c).to_numpy() for c in ("nid", "least", "own", "cross", "copies"))
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint32).reshape(-1, PERMUTATIONS)
        for b in np.unique(least):  # one, unless names of buckets collide
            at = np.flatnonzero(least == b)
            pairs = _Pairs(nid[at], copies[at], sig[at], int(b))
            if cross[at[0]]:
                low = own[at] == own[at].min()
                pairs.compare(np.flatnonzero(low), np.flatnonzero(~low))
            else:
                pairs.compare(np.arange(len(at)))
            edges = np.array(pairs.edges, np.int64).reshape(-1, 2)
            some = np.flatnonzero(pairs.links)
            u += [edges[:, 0], pairs.nid[some]]
            v += [edges[:, 1], np.full(len(some), -1)]
            links += [np.zeros(len(edges), np.int64), pairs.links[some].astype(np.int64)]
            size += len(edges) + len(some)
        if size > 50_000:
            yield rows()
            u, v, links, size = [], [], [], 0
    if size:
        yield rows()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of an undirected graph with columns u, v, by alternating large-star and small-star.

    ``root`` is the smallest node of the component. Each round is written to
    shared storage; it ends when a round changes nothing.
    """
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            pairs = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            pairs = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        joined = pairs.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                least.select("u", F.col("m").alias("v"))
            )
        return out.where("u <> v").distinct()

    now, path = runtime.written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        after, new = runtime.written(star(star(now, True), False), "edges")
        runtime.remove(spark, path)
        path = new
        seen = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).head()
        now = after
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


#: The dropped keys are broadcast up to this many (24 bytes each); beyond it the join shuffles.
BROADCAST_KEYS = 2_000_000


def _buckets(classes: DataFrame) -> DataFrame:
    """(nid, bucket, size, least): the buckets of classes that share a band with another one.

    Bands that hold the same classes are one bucket; ``least`` is the first of them.
    """
    bands = classes.select(
        "nid",
        F.posexplode(F.array(*(F.xxhash64(F.lit(i), F.substring("sig", 4 * ROWS * i + 1, 4 * ROWS)) for i in range(BANDS)))).alias("place", "band"),
    )
    shared = bands.groupBy("band").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("nid")).alias("mark")).where("size > 1")
    return bands.join(shared, "band").groupBy("nid", F.xxhash64("size", "mark").alias("bucket")).agg(F.max("size").alias("size"), F.min("place").alias("least"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, sid, group_id, links, keep) for each row.

    ``group_id`` is the smallest id of the row's near-duplicate group; ``links``
    counts the other rows that are a verified near duplicate of this one;
    ``sid`` is half of the signature's name and null for a text without words.
    Where an id occurs with several texts, ``text_hash`` tells which of them stays.
    """
    kind = dict(docs.dtypes)[id_col]
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    read = read.withColumn("text_hash", F.xxhash64("text"))
    signed, _ = runtime.written(runtime.mapped(runtime.spread(read), _sign, f"doc_id {kind}, text_hash long, sid long, more long, sig binary"), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")))
    classes = signed.where("sid is not null").groupBy("sid", "more").agg(first.alias("first"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    # Classes are numbered once, when they are written, so that no two have one number.
    classes, _ = runtime.written(classes.withColumn("nid", F.monotonically_increasing_id()), "classes")
    zero = F.lit(0).cast("long")
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    own = F.when(F.col("size") > BLOCK, F.pmod(F.xxhash64("nid"), blocks)).otherwise(zero)
    others = F.when(F.col("size") > BLOCK, F.sequence(zero, blocks - 1)).otherwise(F.array(zero))
    placed = _buckets(classes).select("nid", "bucket", "least", own.alias("own"), F.explode(others).alias("other")).select(
        "nid", "least", "own", (F.col("own") != F.col("other")).alias("cross"), F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bid")
    )
    compared = placed.join(classes.select("nid", "copies", "sig"), "nid").repartition("bid").sortWithinPartitions("bid", "nid")
    verified, _ = runtime.written(runtime.mapped(compared.select("nid", "bid", "least", "own", "cross", "copies", "sig"), _verify, "u long, v long, links long"), "verified")
    linked = verified.where("v is null").groupBy(F.col("u").alias("nid")).agg(F.sum("links").alias("linked"))
    roots, _ = runtime.written(components(verified.where("v is not null").select("u", "v")).join(linked.withColumnRenamed("nid", "node"), "node", "left"), "roots")
    # Only signatures with copies or near copies get the name of their group from elsewhere.
    named = (
        classes.select("nid", "sid", "more", "first", "copies")
        .join(roots.withColumnRenamed("node", "nid"), "nid", "left")
        .where("copies > 1 or root is not null")
        .withColumn("root", F.coalesce("root", "nid"))
    )
    links = F.col("copies") - 1 + F.coalesce("linked", zero)
    named = named.join(named.groupBy("root").agg(F.min("first").alias("top")), "root").select("sid", "more", "top", links.alias("links"))
    same = F.col("doc_id").eqNullSafe(F.col("top.id")) & F.col("text_hash").eqNullSafe(F.col("top.hash"))
    return signed.select("doc_id", "text_hash", "sid", "more").join(named, ["sid", "more"], "left").select(
        "doc_id",
        "text_hash",
        "sid",
        F.when(F.col("top").isNull(), F.col("doc_id")).otherwise(F.col("top.id")).alias("group_id"),
        F.coalesce("links", zero).alias("links"),
        (F.col("top").isNull() | same).alias("keep"),
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id, links, keep) for each row of ``docs``; ``keep`` holds for the document of each group that stays."""
    return groups(docs, id_col, text_col).select("doc_id", "group_id", "links", "keep")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group, all columns as they were.

    The row with the smallest id stays (of several texts under that id the one
    with the smallest hash, of rows equal in both any one). Texts never move
    unless an id and text occur twice or the keys to drop are too many to
    broadcast.
    """
    g, _ = runtime.written(groups(docs, id_col, text_col), "groups")
    names = docs.columns
    docs = docs.toDF(*(f"c{i}" for i in range(len(names))))  # columns may have any names, also those of the keys
    own_id, own_hash = F.col(f"c{names.index(id_col)}"), F.xxhash64(F.col(f"c{names.index(text_col)}").cast("string"))
    key = [F.col("doc_id").alias("key_id"), F.col("text_hash").alias("key_hash")]
    here = own_id.eqNullSafe(F.col("key_id")) & (own_hash == F.col("key_hash"))

    def joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        return left.join(F.broadcast(right) if right.count() <= BROADCAST_KEYS else right, here, how)

    out = joined(docs, g.where("not keep").select(*key).distinct(), "left_anti")
    twice = g.where("keep and sid is not null").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select(*key)
    if twice.isEmpty():
        return out.toDF(*names)
    repeated = joined(out, twice, "left_semi")
    # As JSON, as maps can't be hashed; of rows that differ in other columns the choice then doesn't depend on where they lie.
    order = Window.partitionBy(own_id, own_hash).orderBy(F.xxhash64(F.to_json(F.struct(*docs.columns))))
    once = repeated.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")
    return joined(out, twice, "left_anti").unionByName(once).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

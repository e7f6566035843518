"""Approximate nearest neighbours by a hierarchical k-means tree.

All vectors build the tree, level by level: a leaf of more than ``LEAF``
vectors gets up to ``BRANCH`` children by Lloyd's iterations, whose sums are
made where the vectors are. Every vector lies in one leaf. Queries are rows of
the table, all or those that a condition chooses: a query's search takes the
nearest node from a priority queue, adds the node's children to the queue, and
goes on until it has come to ``visits`` leaves, the best bins first. Each leaf
meets the queries that visit it; within a leaf all distances are computed. A
leaf that many queries visit meets them in pieces of about ``PIECE``, so no task
has more, however hot the leaf.

``visits`` is calibrated: for ``PROBES`` queries the true neighbours are found
by brute force over all vectors; leaf visits widen until the share of true
neighbours that lie in visited leaves reaches ``RECALL``.

Equal vectors count once as query; as neighbours at most ``k + 1`` of them,
those with the smallest ids, can ever be needed, so thousands of copies cost
no more than a few.

The tree is broadcast: about n / LEAF vectors. ``LEAVES`` bounds it; beyond,
leaves grow and are compared block by block, so memory is bounded, recall isn't
touched, and time by query grows with n / LEAVES.

Defined results: (id, neighbour, rank, distance) for each distinct id and
vector, neighbours by (Euclidean distance, id); ids may be of any type that has
an order; a row is never its own neighbour, nor is one of the same id. Fewer
than ``k`` rows where there are fewer other vectors. Rows whose id is null, whose vector is null or empty, or
holds a null or anything that isn't finite, or isn't of the length of most
vectors (the least of several such lengths), have no neighbours and are none.
An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import runtime

LEAF = 256
BRANCH = 16
LLOYD = 4
RECALL = 0.96
PROBES = 400
#: Leaves at most, so that what is broadcast is bounded (with 64 dimensions 32 MB).
LEAVES = 1 << 17
#: Vectors or queries of a leaf that are compared at a time.
BLOCK = 4096
#: Queries that meet a leaf in one task.
PIECE = 16_384
#: Rows about hot leaves that are broadcast (16 bytes each).
BROADCAST_PIECES = 1_000_000


@dataclass
class Tree:
    centre: np.ndarray  # by node
    low: np.ndarray  # first child, and one after the last; equal in a leaf
    high: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf in which each vector lies: the nearest child at every level."""
        node = np.zeros(len(x), np.int64)
        open_ = np.arange(len(x)) if self.high[0] > self.low[0] else np.empty(0, np.int64)
        while len(open_):
            order = open_[np.argsort(node[open_], kind="stable")]
            cuts = [0, *(np.flatnonzero(np.diff(node[order])) + 1).tolist(), len(order)]
            for i, j in zip(cuts, cuts[1:]):
                own = order[i:j]
                lo, hi = self.low[node[own[0]]], self.high[node[own[0]]]
                node[own] = lo + _squares(x[own], self.centre[lo:hi]).argmin(axis=1)
            open_ = order[self.high[node[order]] > self.low[node[order]]]
        return node

    def walk(self, x: np.ndarray) -> Iterator[int]:
        """Leaves in the order of a best-bin-first search."""
        queue = [(0.0, 0)]
        while queue:
            _, n = heapq.heappop(queue)
            lo, hi = int(self.low[n]), int(self.high[n])
            if lo == hi:
                yield n
                continue
            d = self.centre[lo:hi] - x
            for k, v in enumerate(np.einsum("ij,ij->i", d, d).tolist()):
                heapq.heappush(queue, (v, lo + k))

    def nearest(self, x: np.ndarray, visits: int) -> list[int]:
        return list(itertools.islice(self.walk(x), visits))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, but for what is the same in a row."""
    return (b * b).sum(axis=1) - 2 * (a @ b.T)


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0), np.float32)


def _order(ids: pa.Array) -> np.ndarray:
    """Numbers that sort like the ids, of whatever type."""
    return pc.rank(ids, sort_keys="ascending", tiebreaker="dense").to_numpy()


def best(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the ``k`` nearest, by (distance, id), of each query; fewer if there are fewer."""
    k = min(k, len(x))
    few = min(len(x), k + 8)
    rough = _squares(queries, x)
    cand = np.argpartition(rough, few - 1, axis=1)[:, :few] if few < len(x) else np.broadcast_to(np.arange(len(x)), rough.shape)
    d = x[cand].astype(np.float64) - queries[:, None, :].astype(np.float64)
    d = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    order = np.lexsort((ids[cand], d))[:, :k]
    at, dist = np.take_along_axis(cand, order, axis=1), np.take_along_axis(d, order, axis=1)
    if few < len(x):
        # Where rounding could have left out one as near as the last, all that are within its reach are compared.
        slack = 1e-5 * (1 + np.abs(rough).max(initial=0))
        last = np.take_along_axis(rough, at[:, -1:], axis=1)[:, 0] + slack
        for i in np.flatnonzero(np.take_along_axis(rough, cand, axis=1).max(axis=1) <= last):
            c = np.flatnonzero(rough[i] <= last[i])
            e = x[c].astype(np.float64) - queries[i].astype(np.float64)
            e = np.sqrt(np.einsum("ij,ij->i", e, e))
            o = np.lexsort((ids[c], e))[:k]
            at[i], dist[i] = c[o], e[o]
    return at, dist


def clean(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec, a, b): usable rows, each id and vector once, and two hashes of the vector."""
    v = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("vec")).where("id is not null and size(vec) > 0")
    v = v.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    usual = v.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").head()
    v = v.where(F.size("vec") == (usual["n"] if usual else 0))
    # A zero with a sign is a zero.
    v = v.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0).cast("float")))
    return v.select("id", "vec", F.xxhash64("vec").alias("a"), F.xxhash64(F.lit(7), "vec").alias("b")).dropDuplicates(["a", "b", "id"])


def few(usable: DataFrame, k: int) -> DataFrame:
    """(id, vec, a, b, copy): of equal vectors the ``k + 1`` of the smallest ids; ``copy`` numbers them. Tasks drop others before anything moves."""
    return usable.withColumn("copy", F.row_number().over(Window.partitionBy("a", "b").orderBy("id"))).where(F.col("copy") <= k + 1)


def _sums(members: DataFrame, tree: Tree) -> dict[int, tuple[int, np.ndarray]]:
    """By leaf the number of vectors and their sum; added up where they are, then by leaf."""
    model = members.sparkSession.sparkContext.broadcast(tree)

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, np.ndarray]] = {}
        for batch in it:
            x = _matrix(batch.column(0))
            if not len(x):
                continue
            leaf = model.value.leaves(x)
            order = np.argsort(leaf, kind="stable")
            at = np.concatenate(([0], np.flatnonzero(np.diff(leaf[order])) + 1))
            n = np.diff(np.concatenate((at, [len(leaf)])))
            for k, c, s in zip(leaf[order][at].tolist(), n.tolist(), np.add.reduceat(x[order].astype(np.float64), at, axis=0)):
                old = total.get(k)
                total[k] = (c, s) if old is None else (old[0] + c, old[1] + s)
        yield from _rows(total)

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, np.ndarray]] = {}
        for batch in it:
            for k, c, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _matrix(batch.column(2))):
                old = total.get(k)
                total[k] = (c, s) if old is None else (old[0] + c, old[1] + s)
        yield from _rows(total)

    def _rows(total: dict) -> Iterator[pa.RecordBatch]:
        if total:
            ks = sorted(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ks, pa.int64()), pa.array([total[k][0] for k in ks], pa.int64()), pa.array([total[k][1] for k in ks], pa.list_(pa.float64()))], ["leaf", "n", "sum"]
            )

    schema = "leaf long, n long, sum array<double>"
    parts = runtime.mapped(members.select("vec"), part, schema)
    found = runtime.mapped(parts.repartition("leaf"), add, schema).toLocalIterator()
    return {r["leaf"]: (r["n"], np.array(r["sum"])) for r in found}


def _leafed(rows: DataFrame, tree: Tree) -> DataFrame:
    """``rows`` (id, vec, a, b, copy) with the leaf in which each lies."""
    model = rows.sparkSession.sparkContext.broadcast(tree)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                yield batch.append_column("leaf", pa.array(model.value.leaves(_matrix(batch.column(1)))))

    return runtime.mapped(rows, run, runtime.added(rows, "leaf", "long"))


def build(members: DataFrame) -> Tree:
    """The tree of all ``members`` (id, vec, a, b, copy)."""
    seed = members.orderBy("a", "b", "id").head()
    dim = len(seed["vec"]) if seed else 1
    tree = Tree(np.zeros((1, dim), np.float32), np.zeros(1, np.int64), np.zeros(1, np.int64))
    while seed:
        now = _sums(members, tree)
        big = [k for k, (n, _) in sorted(now.items()) if n > LEAF]
        leaves = len(now)
        if not big or leaves >= LEAVES:
            break
        wide = _leafed(members, tree).where(F.col("leaf").isin(big)) if len(big) < leaves else _leafed(members, tree)
        nth = F.row_number().over(Window.partitionBy("leaf").orderBy("copy", "a", "b", "id"))
        seeds: dict[int, list] = {}
        for r in wide.withColumn("nth", nth).where(F.col("nth") <= BRANCH).select("leaf", "vec").toLocalIterator():
            seeds.setdefault(r["leaf"], []).append(r["vec"])
        centre, low, high = [tree.centre], tree.low.copy(), tree.high.copy()
        n = len(low)
        for k in big:
            c = np.unique(np.array(seeds[k], np.float32), axis=0)
            # A leaf of little more than LEAF vectors is cut into few.
            c = c[: max(2, min(BRANCH, -(-2 * now[k][0] // LEAF)))]
            if len(c) < 2:
                continue
            low[k], high[k] = n, n + len(c)
            n += len(c)
            centre.append(c)
        if n == len(low):
            break
        more = np.zeros(n - len(low), np.int64)
        tree = Tree(np.concatenate(centre), np.concatenate((low, more)), np.concatenate((high, more)))
        for _ in range(LLOYD):
            moved = tree.centre.copy()
            for k, (c, s) in _sums(members, tree).items():
                if k >= len(low):
                    moved[k] = s / c
            tree = Tree(moved, tree.low, tree.high)
    return tree


def calibrate(members: DataFrame, tree: Tree, k: int, recall: float = RECALL, probes: int = PROBES) -> int:
    """Leaf visits that a search needs for ``recall``, from the true neighbours of some queries."""
    spark = members.sparkSession
    asked = members.where("copy = 1").orderBy(F.xxhash64(F.lit(3), "a", "b"), "id").limit(probes).select("id", "vec").collect()
    if not asked:
        return 1
    vectors = np.array([r["vec"] for r in asked], np.float32)
    shared = spark.sparkContext.broadcast((tree, vectors))
    kind = members.schema["id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, q = shared.value
        for batch in it:
            for i in range(0, batch.num_rows, BLOCK):
                b = batch.slice(i, BLOCK)
                x = _matrix(b.column(1))
                at, dist = best(x, _order(b.column(0)), q, k + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.arange(len(q)), at.shape[1])), b.column(0).take(pa.array(at.ravel())), pa.array(dist.ravel()), pa.array(t.leaves(x)[at].ravel())],
                    ["q", "id", "d", "leaf"],
                )

    near = runtime.mapped(members.select("id", "vec"), run, f"q long, id {kind}, d double, leaf long")
    own = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(asked)], f"q long, own {kind}")
    nth = F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))
    # As many rows as probes.
    true = near.join(F.broadcast(own), "q").where("id <> own").withColumn("nth", nth).where(F.col("nth") <= k).select("q", "leaf").collect()
    wanted: dict[int, list[int]] = {}
    for r in true:
        wanted.setdefault(r["q"], []).append(r["leaf"])
    ranks = []
    for i, leaves in wanted.items():
        left, place = set(leaves), {}
        for j, leaf in enumerate(tree.walk(vectors[i]), 1):
            if leaf in left:
                place[leaf] = j
                left.discard(leaf)
                if not left:
                    break
        ranks += [place[leaf] for leaf in leaves]
    if not ranks:
        return 1
    return int(np.sort(ranks)[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))])


def neighbours(
    rows: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, queries: Column | None = None
) -> DataFrame:
    """(id, neighbour, rank, distance): the ``k`` nearest, among all rows, of every row for which ``queries``, a condition on ``id``, holds; of all if there is none."""
    spark, kind = rows.sparkSession, rows.schema[id_col].dataType.simpleString()
    usable, _ = runtime.written(clean(rows, id_col, vector_col), "vectors")
    members, _ = runtime.written(few(usable, k), "members")
    tree = build(members)
    visits = calibrate(members, tree, k, recall)
    shared = spark.sparkContext.broadcast(tree)

    def ask(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(0, batch.num_rows, 1024):
                b = batch.slice(i, 1024)
                ways = [shared.value.nearest(v, visits) for v in _matrix(b.column(2))]
                own = np.repeat(np.arange(len(ways)), [len(w) for w in ways])
                leaf = pa.array([n for w in ways for n in w], pa.int64())
                yield pa.RecordBatch.from_arrays([leaf, *(b.column(c).take(pa.array(own)) for c in range(3))], ["leaf", "a", "b", "vec"])

    asking = usable if queries is None else usable.where(queries)
    once = asking.groupBy("a", "b").agg(F.first("vec").alias("vec"))
    visiting, _ = runtime.written(runtime.mapped(once, ask, "leaf long, a long, b long, vec array<float>"), "visits")
    hot = visiting.groupBy("leaf").agg(F.ceil(F.count("*") / PIECE).cast("long").alias("pieces")).where("pieces > 1")
    n = hot.count()

    def pieced(df: DataFrame, piece: Column) -> DataFrame:
        out = df.join(F.broadcast(hot) if n <= BROADCAST_PIECES else hot, "leaf", "left") if n else df.withColumn("pieces", F.lit(None).cast("long"))
        return out.withColumn("piece", piece).drop("pieces")

    zero = F.lit(0).cast("long")
    own = F.when(F.col("pieces").isNull(), zero).otherwise(F.pmod("a", "pieces"))
    all_ = F.explode(F.when(F.col("pieces").isNull(), F.array(zero)).otherwise(F.sequence(zero, F.col("pieces") - 1)))
    lone = F.lit(None).cast(kind)
    left = pieced(visiting, own).select("leaf", "piece", F.lit(0).cast("long").alias("side"), lone.alias("id"), "vec", "a", "b")
    right = pieced(_leafed(members, tree).select("leaf", "id", "vec"), all_).select("leaf", "piece", F.lit(1).cast("long").alias("side"), "id", "vec", zero.alias("a"), zero.alias("b"))
    # Of a leaf's piece the queries come first, then the vectors.
    key = F.shiftleft("leaf", 32).bitwiseOR(F.shiftleft("piece", 1)).bitwiseOR(F.col("side"))
    both = left.unionByName(right).select(key.alias("key"), "id", "vec", "a", "b").repartition(F.shiftright("key", 1)).sortWithinPartitions("key")

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks: pa.Table | None = None
        for group in runtime.groups(it, "key"):
            at = group.column("key")[0].as_py()
            if not at & 1:
                asks, place = group, at | 1
                continue
            if asks is None or at != place:
                continue  # no query comes to this leaf
            x, ids = _matrix(group.column("vec").combine_chunks()), group.column("id").combine_chunks()
            order, q = _order(ids), _matrix(asks.column("vec").combine_chunks())
            for i in range(0, len(q), BLOCK):
                some = slice(i, min(i + BLOCK, len(q)))
                parts = []
                for j in range(0, len(x), BLOCK):
                    one, d = best(x[j : j + BLOCK], order[j : j + BLOCK], q[some], k + 1)
                    parts.append((one + j, d))
                near, dist = (np.concatenate([p[c] for p in parts], axis=1) for c in (0, 1))
                if len(parts) > 1:
                    top = np.lexsort((order[near], dist))[:, : k + 1]
                    near, dist = np.take_along_axis(near, top, axis=1), np.take_along_axis(dist, top, axis=1)
                size = near.shape[1]
                pairs = pa.StructArray.from_arrays([pa.array(dist.ravel()), ids.take(pa.array(near.ravel()))], ["d", "id"])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(near) * size + 1, size) if size else np.zeros(len(near) + 1), pa.int32()), pairs)
                own = asks.slice(i, len(near))
                yield pa.RecordBatch.from_arrays([own.column("a").combine_chunks(), own.column("b").combine_chunks(), lists], ["a", "b", "near"])
            asks = None

    found = runtime.mapped(both, meet, f"a long, b long, near array<struct<d: double, id: {kind}>>")
    # Of each query at most k + 1 from each leaf that it visits.
    near = found.groupBy("a", "b").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    others = asking.select("id", "a", "b").join(near, ["a", "b"]).withColumn("near", F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k))
    out = others.select("id", F.posexplode("near").alias("rank", "x"))
    return out.select("id", F.col("x.id").alias("neighbour"), (F.col("rank") + 1).alias("rank"), F.col("x.d").alias("distance"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest neighbours, among all embeddings, of those whose number is divisible by 50."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours(rows, queries=F.col("id") % 50 == 0).withColumnRenamed("id", "vec_id")

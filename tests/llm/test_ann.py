import numpy as np
import pytest
from pyspark.sql import functions as F

from scrutari.llm import ann


def true(ids, x, k):
    out = {}
    for i, v in zip(ids, x):
        d = np.sqrt(((x.astype(float) - v.astype(float)) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        out[i] = [(ids[j], d[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append((r["neighbour"], r["distance"]))
    return out


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "vec_id long, embedding array<float>")


def test_best_breaks_ties_by_id():
    x = np.array([[0, 0], [1, 0], [1, 0], [1, 0], [0, 1], [5, 5]] * 20, np.float32)
    ids = np.random.default_rng(0).permutation(len(x))
    at, dist = ann.best(x, ids, x[:3], 7)
    for q, row, d in zip(x[:3], at, dist):
        e = np.sqrt(((x - q) ** 2).sum(axis=1).astype(float))
        assert row.tolist() == np.lexsort((ids, e))[:7].tolist() and d == pytest.approx(e[row])


def test_search_visits_every_leaf_once(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(40, 4)).astype(np.float32)
    tree = ann.Tree(np.concatenate((np.zeros((1, 4), np.float32), x[:3], x[3:9])), np.array([1, 4, 0, 0, 0, 0, 0, 0, 0, 0]), np.array([4, 10, 0, 0, 0, 0, 0, 0, 0, 0]))
    for v in x:
        way = tree.nearest(v, 99)
        assert sorted(way) == [2, 3, 4, 5, 6, 7, 8, 9] and tree.nearest(v, 3) == way[:3]
        assert tree.leaves(v[None])[0] in way


def test_recall_and_copies(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 32)
    r = np.random.default_rng(2)
    centres = r.normal(size=(20, 16)) * 3
    x = (centres[r.integers(0, 20, 1200)] + r.normal(size=(1200, 16))).astype(np.float32)
    x[:150] = x[0]  # more copies than a leaf holds
    ids = r.permutation(5000)[:1200]
    got, want = found(ann.neighbours(frame(spark, ids, x))), true(ids, x, 10)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert recall(got, want) >= ann.RECALL - 0.01  # calibrated on some of the queries
    for i in ids[:150]:
        assert got[i] == want[i]
    for q in got:
        d = dict(want[q])
        assert all(abs(d[i] - v) < 1e-9 for i, v in got[q] if i in d)


def test_edge_cases(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (3, [0.0, 2.0]), (None, [0.0, 1.0]), (5, None), (6, []), (7, [None, 1.0]), (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (10, [1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, leaf string, copy int")
    got = found(ann.neighbours(df))
    assert {k: [i for i, _ in v] for k, v in got.items()} == {1: [2, 3], 2: [1, 3], 3: [1, 2]}
    assert ann.neighbours(df.where("false")).count() == 0
    assert ann.neighbours(df.where("vec_id = 1")).count() == 0


def test_ids_of_any_type(spark):
    """Strings of different lengths, also such as numbers sort otherwise, and dates; ties go to the least."""
    r = np.random.default_rng(5)
    x = r.integers(0, 3, (60, 2)).astype(np.float32)
    names = [("é" if i % 7 == 0 else "k") + "x" * (i % 13) + str(i) for i in range(60)]
    df = spark.createDataFrame([(n, [float(v) for v in row]) for n, row in zip(names, x)], "name string, v array<float>")
    got = found(ann.neighbours(df, 5, "name", "v"))
    for n, v in zip(names, x):
        d = [(float(np.sqrt(((w.astype(float) - v) ** 2).sum())), m) for m, w in zip(names, x) if m != n]
        assert [(i, e) for i, e in got[n]] == [(m, pytest.approx(e)) for e, m in sorted(d)[:5]]
    days = df.select(F.expr("date_add(DATE'2020-01-01', cast(regexp_extract(name, '[0-9]+', 0) as int))").alias("day"), "v")
    out = ann.neighbours(days, 3, "day", "v")
    assert dict(out.dtypes)["neighbour"] == "date" and out.count() == 180


def test_hot_leaves_and_chosen_queries(spark, monkeypatch):
    """Leaves that meet their queries in several pieces, and blocks smaller than a leaf, change nothing."""
    r = np.random.default_rng(6)
    x = np.concatenate((r.normal(size=(500, 8)) * 0.01, r.normal(size=(300, 8)))).astype(np.float32)
    ids = np.arange(800)
    df = frame(spark, ids, x)
    want = ann.neighbours(df, queries=F.col("id") % 3 == 0)
    first = found(want)
    assert set(first) == {i for i in range(800) if i % 3 == 0}
    monkeypatch.setattr(ann, "PIECE", 20)
    monkeypatch.setattr(ann, "BLOCK", 64)
    for most in (1_000_000, 0):
        monkeypatch.setattr(ann, "BROADCAST_PIECES", most)
        assert found(ann.neighbours(df, queries=F.col("id") % 3 == 0)) == first
    full = true(ids, x, 10)
    assert recall(first, {i: full[i] for i in first}) >= ann.RECALL - 0.02


def test_query(spark, folder):
    df = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").toPandas()
    x, ids = np.array(df["embedding"].tolist(), np.float32), df["vec_id"].to_numpy()
    got = found(ann.query(spark, folder).withColumnRenamed("vec_id", "id"))
    want = {i: n for i, n in true(ids, x, 10).items() if i % 50 == 0}
    assert got.keys() == want.keys()
    assert recall(got, want) >= 0.96


def test_recall_of_all_queries_of_a_larger_table(spark):
    from helpers import DATA

    df = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet")
    rows = df.orderBy("vec_id").toPandas()
    want = true(rows["vec_id"].to_numpy(), np.array(rows["embedding"].tolist(), np.float32), 10)
    assert recall(found(ann.neighbours(df)), want) >= ann.RECALL - 0.01

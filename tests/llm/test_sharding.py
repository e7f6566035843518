from collections import Counter

import pytest
from helpers import DATA, against_sql

from scrutari.llm import sharding

from awkward_rows import table


def test_query(spark):
    mine, theirs = against_sql(spark, sharding.query, sharding.SQL, f"{DATA}/sf0.001")
    assert mine == theirs


@pytest.mark.parametrize("bucket", [1, 7, 50, 10_000])
def test_buckets_do_not_matter(spark, bucket):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    want = sorted(map(tuple, sharding.assign(docs).collect()))
    assert sorted(map(tuple, sharding.assign(docs, bucket=bucket).collect())) == want


def test_every_shard_has_the_mixture(spark):
    df = spark.range(0, 3000).selectExpr("id AS doc_id", "CASE WHEN id % 10 < 7 THEN 'hot' WHEN id % 10 < 9 THEN 'b' ELSE null END AS source", "'t' AS text")
    rows = sharding.assign(df, shards=10, bucket=100, carry=["text"]).collect()
    assert sorted(r["position"] for r in rows) == list(range(3000))
    by = Counter((r["shard"], r["source"]) for r in rows)
    assert all(r["text"] == "t" for r in rows)
    for s in range(10):
        assert abs(by[s, "hot"] - 210) <= 1 and abs(by[s, "b"] - 60) <= 1 and abs(by[s, None] - 30) <= 1
    other = sharding.assign(df, shards=10, seed=1).collect()
    assert {(r["doc_id"], r["position"]) for r in rows} != {(r["doc_id"], r["position"]) for r in other}


def test_edge_cases(spark, awkward, nothing):
    rows = sharding.assign(awkward, shards=5).collect()
    assert sorted(r["position"] for r in rows) == list(range(awkward.count()))
    sizes = Counter(r["shard"] for r in rows)
    assert len(sizes) == 5 and max(sizes.values()) - min(sizes.values()) <= 1
    assert sharding.assign(nothing).count() == 0
    assert {r["shard"] for r in sharding.assign(table(spark, [(1, "a"), (2, "b")]), shards=64).collect()} == {0, 1}
    with pytest.raises(ValueError):
        sharding.assign(awkward, shards=0)


def test_carried_columns_keep_their_values(spark):
    df = spark.range(0, 50).selectExpr("id AS doc_id", "'s' AS source", "'keep' AS __b", "'f' AS __f", "concat('n', id) AS `__rank`", "id AS `a.b`", "'k' AS __key", "'t' AS __total", "7 AS __carried_1")
    carry = [c for c in df.columns if c not in ("doc_id", "source")]
    out = sharding.assign(df, shards=5, bucket=7, carry=carry)
    assert out.columns == ["doc_id", "source", *carry, "position", "shard"]
    rows = out.collect()
    assert sorted(r["position"] for r in rows) == list(range(50))
    assert all(tuple(r)[2:9] == ("keep", "f", f"n{r['doc_id']}", r["doc_id"], "k", "t", 7) for r in rows)
    for bad in (["position"], ["Shard"], ["doc_id"], ["__b", "__b"]):
        with pytest.raises(ValueError):
            sharding.assign(df.withColumns({"position": sharding.F.lit(1), "Shard": sharding.F.lit(1)}), carry=bad)

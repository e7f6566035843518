import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scrutari.functions import analysis, ids

CASES = [
    ("Don't  stop_this $5+3=8", ["don", "t", "stop", "this", "$5+3=8"]),
    ("a b c — «x» 3.14", ["a", "b", "c", "x", "3", "14"]),
    ("你好，世界", ["你好", "世界"]),
    ("a|b~c", ["a|b~c"]),
    ("", []),
    ("?!.. --", []),
    ("ΣΑΣ İX", ["σασ", "ix"]),
    ("\u0000a\u0001b", ["\u0000a\u0001b"]),
]


def test_tokens(spark):
    df = spark.createDataFrame([(k, s) for k, (s, _) in enumerate(CASES)] + [(99, None)], "k int, s string")
    got = {r[0]: r[1] for r in df.select("k", analysis.tokens(F.col("s"))).collect()}
    for k, (s, want) in enumerate(CASES):
        assert got[k] == want == analysis.tokenize(s)
    assert got[99] == []


def test_characters_are_not_looked_up_one_by_one(spark, capsys):
    df = spark.createDataFrame([(1, "ΣΣ-İİ xΣİy"), (2, "plain Text"), (3, "é" * 5000 + "İ" + "Σ" * 3), (4, None)], "k int, s string").select("k", analysis.lowered(F.col("s")).alias("s"))
    df.explain(True)
    assert "translate(" not in capsys.readouterr().out
    assert dict(df.collect()) == {1: "σσ-ii xσiy", 2: "plain text", 3: "é" * 5000 + "iσσσ", 4: None}


@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x24FF, exclude_categories=["Cs", "Cn", "Co"]), max_size=30), min_size=20, max_size=20))
@settings(max_examples=5, deadline=None)
def test_driver_and_executors_cut_alike(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, s string")
    got = {r[0]: r[1] for r in df.select("k", analysis.tokens(F.col("s"))).collect()}
    for k, s in enumerate(texts):
        if all(len(c.lower()) == 1 for c in s):
            assert got[k] == analysis.tokenize(s), s


def test_quantiser(spark):
    table = [analysis.decode_byte(b) for b in range(256)]
    assert table[-1] == 2_013_265_944 and table == sorted(set(table))
    want = {0: 0, 23: 23, 24: 24, 40: 40, 41: 40, 42: 42, 43: 42, 55: 54, 56: 56, 59: 56, 60: 60, 87: 84, 88: 88, 95: 88, 96: 96}
    rows = spark.range(0, 200_000).select("id", analysis.quantise(F.col("id"))).collect()
    i = 0
    for n, q in rows:
        while table[i + 1] <= n:
            i += 1
        assert q == table[i], n
        assert want.get(n, q) == q


def test_ids_and_keys(spark):
    row = spark.range(1).select(ids.pack(F.lit(3), F.lit(7)).alias("d")).select("d", ids.segment_of(F.col("d")), ids.local_of(F.col("d")), ids.sortable(F.lit(258)), ids.number(ids.sortable(F.lit(258))), F.length(ids.sortable(F.lit(1), 4))).head()
    assert tuple(row) == (3 << 32 | 7, 3, 7, b"\0\0\0\0\0\0\1\2", 258, 4)


@pytest.mark.parametrize("bad", [("a b",), ("1a",), ("a", "A"), ("local_id",)])
def test_names_of_fields(bad):
    from scrutari.plans.query import QueryError, Schema

    with pytest.raises(QueryError):
        Schema(bad)

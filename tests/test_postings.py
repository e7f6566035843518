"""Postings made in Arrow batches against those that Spark's expressions make."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from scrutari.functions import analysis
from scrutari.operators import postings, tables
from scrutari.plans.query import Schema
from scrutari.sources import shared
from scrutari.sources.index import Writer, open_index

SCHEMA = Schema(("t", "u"), ("k",))
SCHEMA_T = Schema(("t",), ("k",))
BLOCKS = ["segment_id", "field", "term", "block", "docs", "first_id", "last_id", "max_tf", "min_len_q", "average_then", "impact", "entries"]


def sample(spark):
    """Places far apart and in no order, in more batches than one, with nulls and empty texts."""
    r = random.Random(1)
    data = [(i * 7 % 1201 + (1 << 31) * (i % 5 == 0), " ".join(r.choices("a b c dé E 你好".split(), [8, 4, 3, 2, 1, 1], k=r.choice([0, 1, 3, 40]))), r.choice([None, "", "x y"]), r.choice(["k1", "k2", None])) for i in range(1200)]
    r.shuffle(data)
    return spark.createDataFrame(data, "n long, t string, u string, k string").repartition(5)


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_pieces_meet_wherever_they_come_from(spark, tmp_path, monkeypatch):
    """Postings are the same as without pieces: in many parts, batches and runs."""
    monkeypatch.setattr(postings, "PART", 3_000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 150)
    try:
        p = f"file://{tmp_path}/i"
        w = Writer(spark, p, SCHEMA)
        df = sample(spark)
        for k in range(2):
            w.add(df.where(F.col("n") % 2 == k), local_id="n")
        index = open_index(spark, p)
        own = df.select((F.col("n") % 2).alias("segment_id"), F.col("n").alias("local_id"), "t", "u", "k")
        want = [tables.build(own.where(f"segment_id = {k}"), SCHEMA) for k in range(2)]
        for name, columns in (("blocks", BLOCKS), ("term_stats", ["segment_id", "field", "term", "doc_freq"]), ("lengths", ["segment_id", "field", "local_id", "len", "len_q"])):
            assert rows(getattr(index, name), *columns) == rows(getattr(want[0], name).unionByName(getattr(want[1], name)), *columns)
        assert index.blocks.rdd.getNumPartitions() > 1 and len(index.blocks.inputFiles()) > 4
        before = rows(index.blocks, *BLOCKS)
        w.compact()
        assert rows(open_index(spark, p).blocks, *BLOCKS) == before
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_counts_larger_than_an_entry_holds(spark):
    df = spark.createDataFrame([(3, "a z " + "z " * 40_000), (2, "z")], "local_id long, t string").coalesce(1)
    s = Schema(("t",))
    stats = spark.createDataFrame([(0, "t", 2, 40_003)], tables.FIELD_STATS)
    got = postings.merged(postings.counted(df, s, 0), s, stats, 1).select("term", "docs", "max_tf", F.inline("entries")).collect()
    assert 40_001 > 2 * postings.MOST
    assert [tuple(r) for r in got] == [("a", 1, 1, 3, 1, 36888), ("z", 2, 40_001, 2, 1, 1), ("z", 2, 40_001, 3, 40_001, 36888)]


def test_parts_are_of_bounded_size(spark):
    df = spark.range(1)
    assert [postings.parts(df, n) for n in (0, 1, 3 << 20, 10 * postings.PART, 800 * postings.PART + 1)] == [1, 1, 3, 10, 801]


def test_building_moves_pieces_once_and_aggregates_no_postings(spark):
    df = spark.createDataFrame([(0, 0, "a b a")], "segment_id long, local_id long, t string")
    s = Schema(("t",))
    stats = spark.createDataFrame([(0, "t", 1, 3)], tables.FIELD_STATS)
    plan = postings.merged(postings.counted(df, s, 0), s, stats, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in plan and "Aggregate" not in plan


def test_text_goes_to_workers_whole_and_is_cut_there_as_on_columns(spark):
    """A list of tokens for each row is made only where an analyzer has no way to cut text in Arrow."""
    schema = Schema(("t",), ("k",), (("t", "letters"),))
    analysis.register("letters", analysis.Analyzer(lambda c: F.split(c, ""), list))
    df = spark.createDataFrame([(0, "ab", "k")], "local_id long, t string, k string")
    assert "split(" in postings.counted(df, schema, 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in postings.counted(df, SCHEMA_T, 0)._jdf.queryExecution().optimizedPlan().toString()
    # Every code point between two letters, and texts at each other's edges.
    every = "".join(f"x{chr(c)}Y" for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    texts = [None, "", "a", "b", " ", "É—ü", "x　", "　你好。", "\U0001f600", "..", every, "z"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").coalesce(1).orderBy("n")
    want = [r[0] for r in rows.select(analysis.tokens(F.col("t"))).collect()]
    low = pa.array([r[0] for r in rows.select(analysis.lowered(F.col("t"))).collect()])
    split = analysis.splitter(spark)
    assert split(low).to_pylist() == want
    assert split(low.slice(3, 7)).to_pylist() == want[3:10]


def test_workers_write_the_files_of_postings(spark, tmp_path, monkeypatch):
    """The plan of what is stored has no rows of blocks; files of attempts that failed go; other file systems get the same by Spark's writer."""
    df = sample(spark)
    kinds = []
    parts = postings._parts
    monkeypatch.setattr(postings, "_parts", lambda *a: kinds.append(a[-1]) or parts(*a))
    stored = postings.stored

    def with_a_failed_attempt(pieces, schema, stats, n, at, codec):
        with open(f"{at}/part-0.parquet", "wb") as f:
            f.write(b"PAR1")
        return stored(pieces, schema, stats, n, at, codec)

    monkeypatch.setattr(postings, "stored", with_a_failed_attempt)
    monkeypatch.setattr(postings, "GROUP_ROWS", 100)
    Writer(spark, f"file://{tmp_path}/a", SCHEMA).add(df, local_id="n")
    monkeypatch.setattr(shared, "mounted", lambda spark, path: None)
    Writer(spark, f"file://{tmp_path}/b", SCHEMA).add(df, local_id="n")
    assert kinds == [postings.SUMS, tables.POSTINGS]
    a, b = (open_index(spark, f"file://{tmp_path}/{x}") for x in "ab")
    assert rows(a.blocks, *BLOCKS) == rows(b.blocks, *BLOCKS)
    assert rows(a.term_stats, *a.term_stats.columns) == rows(b.term_stats, *a.term_stats.columns)
    assert not [f for f in tmp_path.rglob("*") if f.name == "sums"]


def test_an_index_of_texts_without_terms(spark, tmp_path):
    w = Writer(spark, f"file://{tmp_path}/i", Schema(("t",)))
    w.add(spark.createDataFrame([(0, "..."), (1, None)], "n long, t string"), local_id="n")
    index = open_index(spark, f"file://{tmp_path}/i")
    assert index.blocks.count() == 0 and index.term_stats.count() == 0 and index.documents.count() == 2

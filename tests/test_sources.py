import pytest
from pyspark.errors import AnalysisException

from scrutari.operators import search as ops
from scrutari.plans.query import Schema, Term
from scrutari.sources import shared
from scrutari.sources.index import Manifest, Writer, open_index
from scrutari.sources.keyvalue import KeyValue
from scrutari.sources.readers import read_jsonl, read_lines
from scrutari.streaming.append import append


def test_lines_are_numbered_across_splits(spark, tmp_path):
    want = [f"line {i} {'x' * (i % 50)}" for i in range(5000)]
    (tmp_path / "a.txt").write_text("\n".join(want) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = sorted((r["line_no"], r["text"]) for r in read_lines(spark, str(tmp_path / "a.txt")).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(enumerate(want))


def test_jsonl_skips_what_is_no_object(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"url": "u1", "title": "t", "body": "b"}\n{broken\n\n{"url": "u2", "title": null}\n')
    got = sorted(tuple(r) for r in read_jsonl(spark, str(tmp_path / "a.jsonl")).collect())
    assert got == [("u1", "t", "b"), ("u2", None, None)]


def test_key_value(spark, tmp_path):
    pairs = [(b"apple", b"fruit"), (b"carrot", b"vegetable"), (b"dog", b"animal"), (b"foo", b"bar"), (b"hello", b"world")]
    path = str(tmp_path / "kv")
    df = spark.createDataFrame([tuple(map(bytearray, p)) for p in pairs], "key binary, value binary")
    KeyValue.write(df, path)
    kv = KeyValue(spark, path)
    assert [kv.get(k) for k, _ in pairs] == [v for _, v in pairs]
    assert kv.get(bytes.fromhex("9661c61e")) is None
    with pytest.raises(AnalysisException):
        KeyValue.write(df, path)


def test_stream_is_added_once(spark, tmp_path):
    source, path = tmp_path / "in", f"file://{tmp_path}/index"
    w = Writer(spark, path, Schema(("text",)))
    for k in range(2):
        spark.createDataFrame([(k, f"word{k} common")], "id long, text string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("id long, text string").parquet(str(source))
        append(stream, w, str(tmp_path / "checkpoint"), once=True).awaitTermination(120)
    assert Manifest.read(spark, path).batches == {"stream": 1}
    index = open_index(spark, path)
    assert ops.search(index, Term("text", "common")).count() == 2
    assert ops.search(index, Term("text", "word1")).count() == 1


def test_lines_need_no_self_join(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n")
    plan = read_lines(spark, str(tmp_path / "a.txt"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and plan.count("Join") == 1


def test_shared_folder_must_be_named_on_a_cluster():
    class Context:
        applicationId, master = "other-app", "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError):
        shared.folder(Session())

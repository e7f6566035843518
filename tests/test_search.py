"""Known answers on a small index of two segments, and random corpora against a plain scorer."""

import dataclasses
import math
import random
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scrutari.functions import analysis
from scrutari.functions.analysis import decode_byte, tokenize
from scrutari.operators import search as ops
from scrutari.operators import tables
from scrutari.plans.query import Boolean, Clause, Compiled, Occur, QueryError, Schema, Term, match, must, should
from scrutari.sources import shared
from scrutari.sources.index import ConflictError, Manifest, Writer, open_index

SCHEMA = Schema(("body", "title"), ("id",))
FIRST = [
    (9, "This is a hello world. Business.", "Hello, world"),
    (3, "After years of struggling to stay afloat, a beloved local business... business world", "Local Business Closes its Doors"),
    (89, "This is an apple. This is an orange. This is a car.", "This is"),
]
SECOND = [(34, "Roger that", "Ok, this is ok")]


def rows(spark, data):
    return spark.createDataFrame(data, "id long, body string, title string").coalesce(1)


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    p = f"file://{tmp_path_factory.mktemp('index')}"
    w = Writer(spark, p, SCHEMA)
    assert w.add(rows(spark, FIRST)) == 0
    assert w.add(rows(spark, SECOND)) == 1
    return p


def hits(index, query, n=10, **k):
    found = ops.fetch(index, ops.search(index, query, n, **k), "id").orderBy(F.desc("score"), "doc").collect()
    return [(r["id"], r["score"]) for r in found]


def T(field, term):
    return Term(field, term)


GOLDEN = [
    (should(T("body", "hello")), [(9, 1.355169)]),
    (T("body", "hello"), [(9, 1.355169)]),
    (should(T("body", "business")), [(3, 0.820252), (9, 0.780194)]),
    (should(T("title", "is")), [(89, 0.822573), (34, 0.633355)]),
    (should(T("title", "is"), T("body", "is")), [(89, 1.815127), (9, 0.780194), (34, 0.633355)]),
    (must(T("title", "is"), T("body", "that")), [(34, 2.378034)]),
    (should(T("body", "business"), T("body", "business")), [(3, 1.640505), (9, 1.560387)]),
    (must(T("title", "is"), T("body", "is")), [(89, 1.815127)]),
    (should(T("body", "this"), T("body", "is"), T("body", "business")), [(9, 2.340581), (89, 1.985108), (3, 0.820252)]),
    (T("id", "89"), [(89, 1.203973)]),
    (T("body", "Hello"), []),
    (Boolean(), []),
    (Boolean((Clause(should(T("body", "hello")), Occur.MUST),)), [(9, 1.355169)]),
    (match("body", "Hello"), [(9, 1.355169)]),
]


@pytest.mark.parametrize("query,want", GOLDEN)
def test_golden(spark, path, query, want):
    got = hits(open_index(spark, path), query)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-5)


def test_errors(spark, path):
    index = open_index(spark, path)
    with pytest.raises(QueryError, match="must be either all should or all must"):
        ops.search(index, Boolean((Clause(T("body", "a")), Clause(T("body", "b"), Occur.MUST))))
    with pytest.raises(QueryError, match="not supported"):
        ops.search(index, Boolean((Clause(T("body", "a")), Clause(should(T("body", "b")), Occur.MUST))))
    for n in (0, -1):
        with pytest.raises(ValueError):
            ops.search(index, T("body", "a"), n)
    with pytest.raises(QueryError):
        ops.search(index, T("nothing", "a"))
    with pytest.raises(QueryError):
        ops.value(index, "nothing", 0)


def test_lookups(spark, path):
    index = open_index(spark, path)
    assert sorted(tuple(r)[1:] for r in ops.exact(index, "id", ["89", "34", "7"]).collect()) == [(0, 2), (1, 0)]
    assert ops.value(index, "title", 1 << 32) == "Ok, this is ok"
    assert ops.value(index, "title", 7 << 32) is None
    assert [r["average"] for r in ops.averages(index).orderBy("field").collect()] == [8.25, 1.0, 3.25]


def test_deletes_stay(spark, path, tmp_path):
    p = f"file://{tmp_path}/i"
    w = Writer(spark, p, SCHEMA)
    w.add(rows(spark, FIRST))
    w.add(rows(spark, SECOND))
    before = open_index(spark, p)
    assert w.delete("id", ["7"]) is None
    assert w.delete("id", ["89"]) == 0
    one = open_index(spark, p)
    assert hits(one, should(T("title", "is"))) == [(34, 0.633355)]  # statistics count what is deleted
    assert len(ops.exact(one, "title", ["is"]).collect()) == 2
    assert len(ops.exact(one, "title", ["is"], include_deleted=False).collect()) == 1
    assert ops.value(one, "id", 2) == 89
    assert w.delete("id", ["89"]) is None
    assert w.delete("id", ["34"]) == 1
    assert hits(open_index(spark, p), should(T("title", "is"))) == []
    assert len(hits(before, should(T("title", "is")))) == 2  # a reader keeps what it opened


def test_manifest(spark, tmp_path, monkeypatch):
    p = f"file://{tmp_path}/i"
    empty = open_index(spark, p)
    assert empty.postings.count() == empty.documents.count() == 0
    w = Writer(spark, p, SCHEMA)
    assert w.add(rows(spark, [])) is None and Manifest.read(spark, p).version == 0
    assert w.add(rows(spark, FIRST), batch=("b", 0)) == 0
    assert w.add(rows(spark, FIRST), batch=("b", 0)) is None
    with pytest.raises(QueryError):
        Writer(spark, p, Schema(("body",)))
    with pytest.raises(QueryError):
        w.add(spark.createDataFrame([(1,)], "id long"))
    old = Manifest.read(spark, p)
    w.add(rows(spark, SECOND))
    with pytest.raises(ConflictError):
        w._commit(old, old)
    assert Manifest.read(spark, p).segments == (0, 1)


def test_a_late_writer_loses_nothing_of_others(spark, tmp_path, monkeypatch):
    p = f"file://{tmp_path}/i"
    w, other = Writer(spark, p, SCHEMA), Writer(spark, p, SCHEMA)
    keep = Writer._keep

    def meanwhile(self, df, at, kind=None):  # the other writer commits while this one writes
        monkeypatch.setattr(Writer, "_keep", keep)
        other.add(rows(spark, FIRST))
        return keep(self, df, at, kind)

    monkeypatch.setattr(Writer, "_keep", meanwhile)
    with pytest.raises(ConflictError):
        w.add(rows(spark, SECOND))
    assert [i for i, _ in hits(open_index(spark, p), T("body", "hello"))] == [9]
    assert open_index(spark, p).documents.count() == 3
    assert len(shared.names(spark, f"{p}/data")) == 1  # what the late one wrote is gone
    monkeypatch.setattr(Writer, "_keep", keep)

    def deletes(self, df, at, kind=None):
        monkeypatch.setattr(Writer, "_keep", keep)
        assert other.delete("id", ["9"]) == 0
        return keep(self, df, at, kind)

    monkeypatch.setattr(Writer, "_keep", deletes)
    with pytest.raises(ConflictError):
        w.delete("id", ["3"])
    assert [r["local_id"] for r in open_index(spark, p).deletes.collect()] == [0]


def test_of_writers_that_commit_at_once_one_wins(spark, tmp_path, monkeypatch):
    """Both have seen that no newer manifest is there before either makes one."""
    p = f"file://{tmp_path}/i"
    w = Writer(spark, p, SCHEMA)
    w.add(rows(spark, FIRST))
    old = Manifest.read(spark, p)
    together = threading.Barrier(8)
    create = shared.create_text
    monkeypatch.setattr(shared, "create_text", lambda *a: together.wait() and False or create(*a))
    done = []

    def commit(k):
        try:
            w._commit(old, dataclasses.replace(old, next_segment=100 + k))
            done.append(k)
        except ConflictError:
            pass

    threads = [threading.Thread(target=commit, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(done) == 1 and Manifest.read(spark, p).next_segment == 100 + done[0] and Manifest.read(spark, p).version == 2


def test_places_are_checked(spark, tmp_path):
    w = Writer(spark, f"file://{tmp_path}/i", SCHEMA)
    for bad in ([0, 0], [0, -1], [0, 1 << 32], [0, None]):
        df = spark.createDataFrame([(i, "a", "b", "c") for i in bad], "n long, body string, title string, id string")
        with pytest.raises(QueryError):
            w.add(df, local_id="n")
    assert w.add(df.where("n = 0"), local_id="n") == 0
    assert len(shared.names(spark, f"file://{tmp_path}/i/data")) == 1


def test_compaction_changes_no_result(spark, tmp_path):
    p = f"file://{tmp_path}/i"
    w = Writer(spark, p, SCHEMA, {"sizes": lambda d: d.groupBy("segment_id").count()})
    w.add(rows(spark, FIRST), batch=("s", 0))
    w.add(rows(spark, SECOND), batch=("s", 1))
    w.delete("id", ["9"])
    w.delete("id", ["3"])
    before = open_index(spark, p)
    want = [(hits(before, q), hits(before, q, 1)) for q, _ in GOLDEN[:7]]
    w.compact()
    after = open_index(spark, p)
    for index in (before, after):
        assert [(hits(index, q), hits(index, q, 1)) for q, _ in GOLDEN[:7]] == want
        assert sorted(map(tuple, index.extra["sizes"].collect())) == [(0, 3), (1, 1)]
    m = Manifest.read(spark, p)
    assert len(m.folders) == 1 and m.segments == (0, 1) and m.batches == {"s": 1} and w.add(rows(spark, SECOND), batch=("s", 1)) is None
    w.vacuum()
    assert shared.names(spark, f"{p}/data") == list(m.folders)
    assert [(hits(open_index(spark, p), q), hits(open_index(spark, p), q, 1)) for q, _ in GOLDEN[:7]] == want


def test_missing_fields_and_clashing_columns(spark, tmp_path):
    p = f"file://{tmp_path}/i"
    data = [(1, None, "a b", 5, "x"), (2, "a", None, 6, "y"), (3, "", "--", 7, "z")]
    df = spark.createDataFrame(data, "id long, body string, title string, segment_id int, `odd.name` string")
    Writer(spark, p, SCHEMA).add(df)
    index = open_index(spark, p)
    assert {(r["field"], r["doc_count"], r["sum_tf"]) for r in index.field_stats.collect()} == {("body", 1, 1), ("title", 1, 2), ("id", 3, 3)}
    assert [i for i, _ in hits(index, should(T("body", "a"), T("title", "a")))] == [1, 2]


def test_places_are_dense(spark, tmp_path):
    p = f"file://{tmp_path}/i"
    df = spark.range(0, 1000, 1, 7).select(F.col("id"), F.lit("w").alias("body"), F.lit("t").alias("title"))
    Writer(spark, p, SCHEMA).add(df)
    assert sorted(r[0] for r in open_index(spark, p).documents.select("local_id").collect()) == list(range(1000))


def plain(docs, query, every):
    """Scores of documents that are lists of tokens, straight from the definition."""
    n = sum(bool(d) for d in docs)
    average = sum(map(len, docs)) / n if n else 0
    table = [decode_byte(b) for b in range(256)]
    out = {}
    for i, d in enumerate(docs):
        tf = Counter(d)
        if not (all(tf[t] for t in query) if every else any(tf[t] for t in query)):
            continue
        length = max(v for v in table if v <= len(d))
        score = 0.0
        for t in query:
            if tf[t]:
                df = sum(t in x for x in docs)
                score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * length / average))
        out[i] = score
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_corpora(spark, seed):
    r = random.Random(seed)
    words = "a b c d e f".split()
    texts = [" ".join(r.choices(words, [8, 4, 3, 2, 1, 1], k=r.choice([0, 1, 3, 30, 90]))) for _ in range(60)]
    df = spark.createDataFrame([(i % 3, i, t) for i, t in enumerate(texts)], "segment_id long, local_id long, t string")
    index = tables.build(df, Schema(("t",)))
    docs = [tokenize(t) for t in texts]
    queries = {f"{k}{every}": (r.choices(words, k=k), every) for k in (1, 2, 3) for every in (False, True)}
    trees = {k: (must if e else should)(*(Term("t", w) for w in q)) for k, (q, e) in queries.items()}
    many = ops.search_many(index, trees, 5).collect()
    for k, (q, e) in queries.items():
        want = plain(docs, q, e)
        got = {x["local_id"]: x["score"] for x in ops.search(index, trees[k], None).collect()}
        assert got.keys() == want.keys()
        for i in got:
            assert got[i] == pytest.approx(want[i], abs=2e-6)
        best = ops.search(index, trees[k], 5).collect()
        assert seed or ops.search_pruned(index, trees[k], 5).collect() == best
        assert [(x["doc"], x["score"]) for x in best] == sorted(((i % 3 << 32 | i, s) for i, s in got.items()), key=lambda x: (-x[1], x[0]))[:5]
        assert [(x["doc"], x["score"]) for x in sorted((x for x in many if x["query"] == k), key=lambda x: x["rank"])] == [(x["doc"], x["score"]) for x in best]


def test_block_bounds_hold(spark, path):
    index = open_index(spark, path)
    blocks = ops.bounds(index, tables.successive(index.postings)).collect()
    assert len(blocks) == index.term_stats.count()
    for b in blocks:
        best = ops.search(index, T(b["field"], b["term"]), 1).head() if b["term"] in ("is", "business") else None
        assert best is None or best["score"] <= b["upper"] + 1e-6 or best["segment_id"] != b["segment_id"]


def test_plan_has_one_exchange_and_pushes_the_terms(spark, path):
    df = ops.search(open_index(spark, path), must(T("body", "is"), T("body", "this")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [is,this])" in plan.replace("EqualTo(field,body), ", "") or "In(term" in plan
    assert "TakeOrderedAndProject" in plan and "SortMergeJoin" not in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_deletes_are_broadcast(spark, tmp_path, monkeypatch):
    p = f"file://{tmp_path}/i"
    w = Writer(spark, p, SCHEMA)
    w.add(rows(spark, FIRST))
    w.delete("id", ["9"])
    plan = plan_of(ops.search(open_index(spark, p), T("body", "is")))
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(ops, "BROADCAST_DELETES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = ops.search(open_index(spark, p), T("body", "is"))
        assert "SortMergeJoin" in plan_of(found) and [r["local_id"] for r in found.collect()] == [2]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stored_documents_do_not_move_for_few_hits(spark, path, monkeypatch):
    index = open_index(spark, path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = ops.search(index, T("title", "is"))
        plan = plan_of(ops.fetch(index, found, "title"))
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "In(local_id" in plan.replace("EqualTo(local_id", "In(local_id")
        monkeypatch.setattr(ops, "PUSHED_HITS", 0)
        assert "BroadcastHashJoin" in plan_of(ops.fetch(index, found, "title"))
        assert sorted(r["title"] for r in ops.fetch(index, found, "title").collect()) == ["Ok, this is ok", "This is"]
        assert "SortMergeJoin" in plan_of(ops.fetch(index, ops.search(index, T("title", "is"), None), "title"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_postings_are_built_with_one_exchange(spark):
    df = spark.createDataFrame([(0, 0, "a b a")], "segment_id long, local_id long, t string")
    s = Schema(("t",))
    f = tables.forward(df, s)
    assert "Exchange" not in plan_of(f)
    stats = spark.createDataFrame([(0, "t", 1, 3)], tables.FIELD_STATS)
    plan = plan_of(tables.stored(tables.flat(f), stats).sortWithinPartitions("field", "term", "block"))
    body = plan[: plan.index("BroadcastExchange")] if plan.index("BroadcastExchange") > plan.index("rangepartitioning") else plan
    assert plan.count("rangepartitioning") == 1 and body.count("hashpartitioning") <= 1
    assert sorted(tuple(r) for r in tables.flat(f).collect()) == [(0, "t", "a", 0, 2, 3), (0, "t", "b", 0, 1, 3)]


@pytest.mark.parametrize("seed", range(2))
def test_pruned_reads_less_and_finds_the_same(spark, tmp_path, seed, monkeypatch):
    """Many blocks of which few hold the best; averages that change from segment to segment; deletes; ties."""
    monkeypatch.setattr(ops, "FIRST_BLOCKS", 4)
    r = random.Random(seed)
    p = f"file://{tmp_path}/i"
    w = Writer(spark, p, Schema(("t",), ("k",)))
    for part in range(2):
        data = [(" ".join(["a"] * r.choice([0, 1, 1, 1, 1, 1, 2 + 40 * (i // 700)]) + ["b"] * r.choice([0, 0, 1, 3]) + ["x"] * r.choice([5, 20, 60 * (1 + part)])), f"k{i % 9}") for i in range(1500)]
        w.add(spark.createDataFrame(data, "t string, k string").coalesce(1))
    w.delete("k", ["k3"])
    index = open_index(spark, p)
    for q in (T("t", "a"), should(T("t", "a"), T("t", "b")), must(T("t", "a"), T("t", "none")), must(T("t", "a"), T("t", "b"))):
        for n in (1, 2500) if isinstance(q, Term) else (10,):
            want = ops.search(index, q, n).collect()
            got = ops.pruned(index, q, n)
            assert got.hits.collect() == want and got.read <= got.total
            if n == 1:
                assert got.read < got.total / 2
    monkeypatch.setattr(ops, "PUSHED_BLOCKS", 0)
    assert ops.search_pruned(index, q, 10).collect() == want


def test_bounds_hold_for_any_average():
    r = random.Random(0)
    for _ in range(300):
        block = [(r.randrange(1, 30), r.randrange(1, 200)) for _ in range(r.randrange(1, 8))]
        then, now = r.uniform(1, 150), r.uniform(1, 150)
        free = lambda a: a * (0.25 / 0.75)
        impact = max(tf / (n + free(then)) for tf, n in block)
        most, least = max(tf for tf, _ in block), min(n for _, n in block)
        grown = impact * max(1, (least + free(then)) / (least + free(now)))
        upper = 2.2 / (1 + 0.9 / now / min(grown, most / (least + free(now))))
        best = max(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / now)) for tf, n in block)
        assert upper >= best - 1e-12 and (then != now or upper == pytest.approx(best))


def test_own_analyzers_nodes_and_tables(spark, tmp_path):
    if "halves" not in analysis._analyzers:
        analysis.register("halves", analysis.Analyzer(lambda t: F.split(t, "/"), lambda t: t.split("/")))
    s = Schema(("t", "u"), (), (("t", "halves"),))
    p = f"file://{tmp_path}/i"
    w = Writer(spark, p, s, {"sizes": lambda d: d.select("segment_id", "local_id", F.length("t").alias("n"))})
    w.add(spark.createDataFrame([("A b/c", "A b/c")], "t string, u string"))
    index = open_index(spark, p)
    assert index.schema == s
    assert {(r["field"], r["term"]) for r in index.postings.collect()} == {("t", "A b"), ("t", "c"), ("u", "a"), ("u", "b"), ("u", "c")}
    assert len(hits_of(ops.search(index, match("t", "A b/x", schema=s)))) == 1 and not hits_of(ops.search(index, match("t", "A b/x")))
    assert [tuple(r) for r in index.extra["sizes"].collect()] == [(0, 0, 5)]
    with pytest.raises(QueryError):
        Writer(spark, p, s)
    with pytest.raises(QueryError):
        Schema(("t",), ("k",), (("k", "halves"),))
    with pytest.raises(ValueError):
        tables.build(index.documents, Schema(("t",), (), (("t", "unknown"),)))

    class Heavy:
        def __init__(self, *terms, required=1):
            self.terms, self.required = terms, required

        def compiled(self, schema):
            return Compiled(self.terms, self.required)

    one = ops.search(index, T("u", "a")).head()["score"]
    assert ops.search(index, Heavy(("u", "a", 2.5))).head()["score"] == pytest.approx(2.5 * one, abs=1e-5)
    for bad in (Heavy(("u", "a", 0.0)), Heavy(("u", "a", 1.0), ("u", "a", 1.0)), Heavy(("u", "a", 1.0), required=0), Heavy(("nothing", "a", 1.0))):
        with pytest.raises(QueryError):
            ops.search(index, bad)


def hits_of(df):
    return [r["doc"] for r in df.collect()]

import random

import numpy as np
import regex
from helpers import DATA, against_sql

from scrutari.llm import decontaminate as d
from scrutari.llm import tokens

from awkward_rows import LONG, table

NO_SPACES = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
WORD = regex.compile(rf"(?V1)[{NO_SPACES}]|[[\p{{L}}\p{{N}}\p{{M}}]--[{NO_SPACES}]]+")


def words(s):
    return WORD.findall((s or "").replace("İ", "i").replace("Σ", "σ").lower())


def plain(doc, item):
    """All maximal shared spans of at least SPAN words, of which those of one character without spaces count half."""
    a, b = words(doc), words(item)
    out = set()
    for x in range(len(a)):
        for y in range(len(b)):
            if a[x] == b[y] and (not x or not y or a[x - 1] != b[y - 1]):
                n = 0
                while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                    n += 1
                if sum(0.5 if regex.match(f"[{NO_SPACES}]", t) else 1 for t in a[x : x + n]) >= d.SPAN:
                    out.add((x, y, n))
    return out


def texts(seed, n):
    r = random.Random(seed)
    words = ["a", "b", "c"] if seed % 2 else [f"w{i}" for i in range(40)] if seed < 6 else list("你好世界的人") + ["a", "हिन्दी"]
    base = [" ".join(r.choices(words, k=r.randrange(5, 60))) for _ in range(5)]
    return [" ".join(r.choice(base).split()[r.randrange(4) :][: r.randrange(3, 40)]) + " " + r.choice(base) for _ in range(n)]


def test_every_shared_span_is_found():
    for seed in range(8):
        docs, items = texts(seed, 12), texts(seed, 6)
        b = d.Benchmark(list(range(len(items))), items)
        w = tokens.words(docs)
        assert b.shared(w).tolist() == [any(plain(s, t) for t in items) for s in docs]
        got = {}
        for i, j, x, y, n in b.spans(w):
            assert (x, y, n) not in got.setdefault((i, j), set())
            got[i, j].add((x, y, n))
        for i, s in enumerate(docs):
            for j, t in enumerate(items):
                assert got.get((i, j), set()) == plain(s, t), (seed, i, j)


def test_a_window_keeps_its_least_gram():
    r = np.random.default_rng(0)
    h = r.integers(0, 50, 400).astype(np.uint64)
    doc = np.array([0, 3, 100, 104, 400])
    _, pos = d.fingerprints(h, doc)
    for lo, hi in zip(doc, doc[1:]):
        grams = np.arange(lo, hi - d.GRAM + 1)
        for i in range(max(len(grams) - d.WINDOW + 1, 1 if len(grams) else 0)):
            assert np.isin(grams[i : i + d.WINDOW], pos).any()
        assert all(lo <= p <= hi - d.GRAM for p in pos[(pos >= lo) & (pos < hi)])


def test_query(spark):
    mine, theirs = against_sql(spark, d.query, d.SQL, f"{DATA}/sf0.01")
    assert mine and mine == theirs


def test_edge_cases(spark, awkward, nothing, monkeypatch):
    span = "one two three four five six seven eight nine ten eleven"
    items = spark.createDataFrame([(1, span), (2, None), (3, ""), (4, "too short"), (5, span), (None, span.upper())], "item_id long, text string")
    assert d.overlaps(awkward, items).count() == 0
    assert d.decontaminate(awkward, items).count() == awkward.count()
    rows = [(1, LONG + span), (2, None), (3, span[:-3]), (3, span), (3, span), (None, f"x {span}"), (9, "nine ten")]
    for piece in (4_000_000, 1):
        monkeypatch.setattr(d, "PIECE", piece)
        docs = table(spark, rows)
        got = [tuple(r) for r in d.overlaps(docs, items).collect()]
        assert len(got) == 10 and got.count((3, 1, 0, 0, 11)) == 2 and (None, None, 1, 0, 11) in got and (3, 1, 0, 0, 10) in got
        kept = d.decontaminate(docs, items)
        assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "9"]
    assert d.overlaps(nothing, items).count() == d.decontaminate(nothing, items).count() == 0
    assert d.overlaps(awkward, items.where("false")).count() == 0
    assert d.decontaminate(awkward, items.where("false")).count() == awkward.count()


def test_other_scripts_like_the_sql(spark, tmp_path):
    """Also where lower case is more than one character, or words have combining marks or no spaces."""
    clause = "我们 在这里写一段很长的中文文字没有空格只有标点".replace(" ", "")
    hindi = "यह हिन्दी में लिखा गया एक लंबा वाक्य है जो दोहराया गया है"
    turkish = "İstanbul'da bir gün çok güzel bir ev vardı ve orada ΣΑΣ yaşıyordu"
    items = [(1, clause), (2, hindi), (3, turkish), (4, clause), (5, clause[:12]), (6, "คนไทยทุกคนชอบกินข้าวกับปลาทุกวันเลย"), (7, None), (8, "")]
    rows = [(1, f"前言。{clause}。后记"), (2, f"क {hindi} ख"), (3, turkish.replace("İ", "i").lower().replace("σασ", "σaσ")), (4, turkish), (5, clause[:19]), (6, clause[:20]), (7, "x คนไทยทุกคนชอบกินข้าวกับปลาทุกวันเลย"), (8, f"one two {clause[:17]} three"), (9, None)]
    docs = table(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    import duckdb

    con = duckdb.connect()
    for n in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{tmp_path}/{n}.parquet/*.parquet'")
    theirs = sorted(con.execute(d.SQL).fetchall(), key=str)
    names = [c[0] for c in con.description]
    mine = sorted((tuple(r[n] for n in names) for r in d.overlaps(docs, bench).collect()), key=str)
    want = sorted(((i, j, *span) for i, s in rows for j, t in items if j not in (4,) for span in plain(s, t)), key=str)
    assert mine == theirs == want
    assert {i for i, *_ in mine} == {1, 2, 3, 4, 6, 7}
    assert sorted(r["doc_id"] for r in d.decontaminate(docs, bench).collect()) == [5, 8, 9]


def test_a_prompt_of_many_items_costs_what_it_costs_in_one():
    prompt = " ".join(f"p{i}" for i in range(60))
    items = [f"{prompt} question number {i} is this one" for i in range(3000)]
    b = d.Benchmark(list(range(len(items))), items)
    assert len(b.one_pos) < len(b.pos) / 2  # all but those near the end of the prompt
    w = tokens.words([f"x {prompt} y"] * 50 + ["p1 p2 p3 p4 p5 p6 p7 p8 p9 z", f"question number 7 is this one {prompt}", "question number 7 is this one"])
    assert b.shared(w).tolist() == [True] * 50 + [False, True, False]
